"""Reports over a long score table (dataset, algorithm, setting, metric, score)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_mean(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("score").alias("score"))


def pivoted(scores: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """A column per value, means inside; naming the values spares a pass over the data."""
    return scores.groupBy(*rows).pivot(column, values).agg(F.avg("score"))


def best_two(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """The two highest of each group with their rank, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), name)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)


def zero_filled(scores: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every row with every column; what is missing, a failed run, scores 0. Both sides are short lists of names."""
    grid = rows.crossJoin(columns)
    return grid.join(scores, [*rows.columns, *columns.columns], "left").fillna(0.0, ["score"])


def relative_error(scores: DataFrame, by: list[str], setting: str) -> DataFrame:
    """|score - score at the last setting| over the latter; groups whose last is 0 are left out."""
    last = Window.partitionBy(*by).orderBy(setting).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = scores.withColumn("last", F.last("score").over(last)).where("last <> 0")
    return out.select(*by, setting, (F.abs(F.col("score") - F.col("last")) / F.abs("last")).alias("error"))


def quartiles(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.percentile("score", F.lit(q)).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))


def mean_ranks(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """Each name's mean rank over groups, the highest score first, ties sharing their mean rank."""
    own = Window.partitionBy(*by).orderBy(F.desc("score"))
    same = Window.partitionBy(*by, "score")
    ranked = scores.withColumn("rank", F.rank().over(own) + (F.count("*").over(same) - 1) / 2)
    return ranked.groupBy(name).agg(F.avg("rank").alias("mean_rank"))


def friedman(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """One row: groups (those with a score of every name), names and the chi-square of their mean ranks' spread."""
    ranks = _complete(scores, by, name)
    one = ranks.groupBy(name).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("groups"))
    k = F.count("*")
    spread = F.sum(F.pow(F.col("mean_rank"), F.lit(2))) - k * F.pow(k + 1, F.lit(2)) / 4
    return one.agg(F.max("groups").alias("groups"), k.alias("names"), (12 * F.max("groups") / (k * (k + 1)) * spread).alias("chi_square")).where("names > 1")


def rank_differences(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """(better, worse, difference, z): for each two names how far their mean ranks are apart, and that in standard errors."""
    ranks = _complete(scores, by, name)
    each = ranks.groupBy(name).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("groups"))
    # A row per name: a short list.
    row = each.agg(F.array_sort(F.collect_list(F.struct("mean_rank", name))).alias("all"), F.max("groups").alias("groups"))
    row = row.select("all", "groups", F.size("all").alias("k"), F.posexplode("all").alias("place", "own"))
    row = row.select("groups", "k", "own", F.explode(F.slice("all", F.col("place") + 2, F.col("k"))).alias("other"))
    gap = F.col("other.mean_rank") - F.col("own.mean_rank")
    error = F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("groups")))
    return row.select(F.col(f"own.{name}").alias("better"), F.col(f"other.{name}").alias("worse"), gap.alias("difference"), (gap / error).alias("z"))


def _complete(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """Scores with their rank, the highest first, ties sharing their mean rank, of groups that have every name."""
    names = scores.select(F.count_distinct(name).alias("names"))  # one row
    whole = Window.partitionBy(*by)
    own, same = whole.orderBy(F.desc("score")), Window.partitionBy(*by, "score")
    ranked = scores.withColumn("rank", F.rank().over(own) + (F.count("*").over(same) - 1) / 2).withColumn("n", F.count("*").over(whole))
    return ranked.join(F.broadcast(names)).where("n = names").drop("n", "names")


# The normal distribution's tail by a polynomial in 1 / (1 + 0.2316419 x), off by less than 1e-7.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def tail(z: Column) -> Column:
    """How likely a normal number is farther from 0 than z."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    total = F.lit(0.0)
    for c in reversed(TAIL):
        total = (total + c) * t
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / (2 * math.pi) ** 0.5 * total)


def signed_ranks(scores: DataFrame, by: list[str], name: str) -> DataFrame:
    """(better, worse, groups, z, p, p_adjusted): for each two names, the better one by mean rank first, the signed-rank
    test of their scores over groups that have every name. Equal scores are left out and tied differences share
    their mean rank; z and p are those of the normal approximation. p_adjusted steps down: the least p counts times
    the number of pairs, the next times one less, and so on, never less than the one before. Pairs without different
    scores have p 1. Names are a short list, of which all pairs are made."""
    ranks = _complete(scores, by, name)
    names = ranks.groupBy(name).agg(F.avg("rank").alias("mean_rank"))
    order = names.select(F.col(name), F.row_number().over(Window.orderBy("mean_rank", name)).alias("place"))
    own = ranks.select(*by, F.col(name), "score").join(F.broadcast(order), name)
    a, b = (own.select(*by, F.col(name).alias(side), F.col("score").alias(f"{side}_score"), F.col("place").alias(f"{side}_place")) for side in ("better", "worse"))
    gaps = a.join(b, by).where("better_place < worse_place").withColumn("gap", F.col("better_score") - F.col("worse_score"))
    pair = ["better", "worse"]
    size = Window.partitionBy(*pair).orderBy(F.abs("gap"))
    same = Window.partitionBy(*pair, F.abs("gap"))
    ranked = gaps.where("gap <> 0").withColumn("same", F.count("*").over(same)).withColumn("r", F.rank().over(size) + (F.col("same") - 1) / 2)
    sums = ranked.groupBy(*pair).agg(F.sum(F.when(F.col("gap") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.count("*").alias("groups"), F.sum(F.col("same") * F.col("same") - 1).alias("ties"))
    n = F.col("groups")
    z = (F.col("up") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    every = gaps.select(*pair).distinct().join(sums, pair, "left").select(*pair, F.coalesce(n, F.lit(0).cast("long")).alias("groups"), F.coalesce(z, F.lit(0.0)).alias("z"))
    every = every.withColumn("p", F.when(F.col("groups") > 0, tail(F.col("z"))).otherwise(1.0))
    down = Window.orderBy("p", *pair)  # a row per pair of names
    every = every.withColumn("step", F.least(F.lit(1.0), F.col("p") * (F.count("*").over(Window.partitionBy()) - F.row_number().over(down) + 1)))
    return every.select(*pair, "groups", "z", "p", F.max("step").over(down).alias("p_adjusted"))


def cliques(scores: DataFrame, by: list[str], name: str, alpha: float = 0.05) -> DataFrame:
    """(clique, place, name): longest runs of names, ordered by mean rank, of which no two differ by signed_ranks at level
    alpha; runs of one name are left out. Cliques are numbered by where they begin."""
    ranks = _complete(scores, by, name).groupBy(name).agg(F.avg("rank").alias("mean_rank"))
    every = Window.orderBy("mean_rank", name)  # names are a short list
    order = ranks.select(F.col(name), F.row_number().over(every).alias("place"), F.count("*").over(Window.partitionBy()).alias("k"))
    apart = signed_ranks(scores, by, name).where(F.col("p_adjusted") < alpha).select("better", "worse")
    for side in ("better", "worse"):
        apart = apart.join(order.select(F.col(name).alias(side), F.col("place").alias(f"{side}_place")), side)
    # From a name on, up to before the first name that differs from any that comes no earlier.
    first = apart.groupBy(F.col("better_place").alias("place")).agg(F.min("worse_place").alias("first"))
    ends = order.join(first, "place", "left")
    back = Window.orderBy(F.desc("place"))
    ends = ends.withColumn("end", F.coalesce(F.min("first").over(back), F.col("k") + 1) - 1)
    new = F.col("end") > F.coalesce(F.lag("end").over(Window.orderBy("place")), F.lit(0))
    runs = ends.withColumn("new", new).where("new AND end > place").select(F.col("place").alias("begin"), "end")
    runs = runs.withColumn("clique", F.row_number().over(Window.orderBy("begin")))
    return runs.join(order.select(F.col(name), "place"), (F.col("place") >= F.col("begin")) & (F.col("place") <= F.col("end"))).select("clique", "place", name)


def count_error(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, error): predicted less true number of motifs, run by run. scores: (n_patterns, predicted_n_patterns, ...),
    a row a run and metric; each run counts once."""
    runs = scores.select(*dict.fromkeys([*by, *(c for c in ("algorithm", "config_idx", "signal_idx") if c in scores.columns), "n_patterns", "predicted_n_patterns"])).distinct()
    return runs.select(*dict.fromkeys([*by, *(c for c in ("config_idx", "signal_idx") if c in runs.columns)]), (F.col("predicted_n_patterns") - F.col("n_patterns")).alias("error"))


def quadratic_guide(times: DataFrame, length: str, time: str) -> DataFrame:
    """Each length with the time that quadratic growth from the mean time at the least length would give."""
    first = times.groupBy(length).agg(F.avg(time).alias("start")).agg(F.min_by("start", length).alias("start"), F.min(length).alias("least"))
    return times.select(length).distinct().join(F.broadcast(first)).select(length, (F.col("start") * F.pow(F.col(length) / F.col("least"), 2)).alias("guide"))  # one row


def renamed(table: DataFrame, column: str, names: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Rows whose value has a name, under that name, with its place in an explicit order if one is given."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    out = table.withColumn(column, F.element_at(pairs, F.col(column))).where(F.col(column).isNotNull())
    return out.withColumn(f"{column}_order", F.array_position(F.array(*map(F.lit, order)), F.col(column))) if order else out


def together(**tables: DataFrame) -> DataFrame:
    """Score tables one below the other, each under its name in the column `source`; columns that one lacks are null."""
    out = None
    for name, table in tables.items():
        one = table.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
