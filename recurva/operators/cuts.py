"""Thresholds on one number a row, series by series, as DataFrame operations: histogram split, gaps, outliers."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.plans.kernels import by_series

BINS = 1024


def ktanh(x: Column, alpha: float = 0.01, beta: float = 0.0) -> Column:
    """A monotone stretch of [0, 2] onto itself."""
    low = F.tanh(F.lit(beta * beta * alpha))
    return 2 * F.sqrt((low + F.tanh(alpha * (x * x - beta * beta))) / (low + F.tanh(F.lit(alpha * (4 - beta * beta)))))


def otsu(table: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(series_id, cut): the left edge of the first bin whose split into lower and upper values has the largest
    variance between. Values count as their bins' left edges, but the upper mean starts from the exact mean. Equal
    values give the bins a width of 1 / bins around them. Bins without values cannot be the first best."""
    by = table.groupBy("series_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"), F.count(column).alias("n"))
    by = by.withColumn("flat", F.col("lo") == F.col("hi"))
    by = by.select("series_id", "mean", "n", *(F.when(F.col("flat"), F.col(c) + d).otherwise(F.col(c)).alias(c) for c, d in (("lo", -0.5), ("hi", 0.5))))
    step = (F.col("hi") - F.col("lo")) / bins
    placed = table.join(by, "series_id").withColumn("bin", F.least(F.floor((F.col(column) - F.col("lo")) / step), F.lit(bins - 1)))
    counts = placed.groupBy("series_id", "bin", "lo", "hi", "mean", "n").agg(F.count("*").alias("c"))
    counts = counts.withColumn("p", F.col("c") / F.col("n")).withColumn("edge", F.col("lo") + F.col("bin") * step)
    so_far = Window.partitionBy("series_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.where(F.col("bin") < bins - 1).select("series_id", "bin", "edge", "mean", F.sum("p").over(so_far).alias("low"), F.sum(F.col("p") * F.col("edge")).over(so_far).alias("mass"))
    high = 1 - F.col("low")
    apart = F.when(high > 1e-12, F.col("mass") / F.col("low") - (F.col("mean") - F.col("mass")) / high).otherwise(0.0)
    scored = sums.withColumn("score", F.col("low") * high * apart * apart)
    return scored.groupBy("series_id").agg(F.max_by("edge", F.struct(F.round("score", 12), -F.col("bin"))).alias("cut"))


def gap_cut(table: DataFrame, column: str, jump: int = 1) -> DataFrame:
    """(series_id, cut): the middle of the jump-th successive largest gap among falling positive values, each looked
    for below the one before; once there is none, of the first gap. A single value is halved, as if 0 followed it."""
    order = Window.partitionBy("series_id").orderBy(F.desc(column))
    rows = table.where(F.col(column) > 0).select("series_id", F.col(column).alias("q"), F.lead(column).over(order).alias("next"), F.row_number().over(order).alias("t"), F.count("*").over(Window.partitionBy("series_id")).alias("n"))
    rows = rows.where("next IS NOT NULL OR n = 1").select("series_id", "t", (F.col("q") - F.coalesce("next", F.lit(0.0))).alias("gap"), ((F.col("q") + F.coalesce("next", F.lit(0.0))) / 2).alias("mid"))
    best = rows.groupBy("series_id").agg(F.max(F.struct("gap", -F.col("t"), "mid")).alias("b"), F.min_by("mid", "t").alias("first"))
    found = best.select("series_id", "first", (-F.col("b.col2")).alias("at"), F.col("b.mid").alias("cut"))
    for _ in range(jump - 1):
        later = rows.join(found, "series_id", "right").groupBy("series_id", "first").agg(F.max(F.when(F.col("t") > F.col("at"), F.struct("gap", -F.col("t"), "mid"))).alias("b"))
        found = later.select("series_id", "first", F.coalesce(-F.col("b.col2"), F.lit(2**31 - 1)).alias("at"), F.coalesce(F.col("b.mid"), F.col("first")).alias("cut"))
    return found.select("series_id", "cut")


def top_n_cut(table: DataFrame, column: str, n: int) -> DataFrame:
    """(series_id, cut): the middle between the n-th and the next largest value."""
    order = Window.partitionBy("series_id").orderBy(F.desc(column))
    ranked = table.select("series_id", F.col(column).alias("q"), F.row_number().over(order).alias("r")).where(F.col("r").isin(n, n + 1))
    return ranked.groupBy("series_id").agg(F.avg("q").alias("cut"))


def mad_outliers(table: DataFrame, column: str, t: float) -> DataFrame:
    """Rows whose distance from the median is t robust deviations or more."""
    middle = table.groupBy("series_id").agg(F.median(column).alias("med"))
    off = table.join(middle, "series_id").withColumn("off", F.abs(F.col(column) - F.col("med")))
    spread = off.groupBy("series_id").agg(F.median("off").alias("mad"))
    return off.join(spread, "series_id").where(NormalDist().inv_cdf(0.75) * F.col("off") >= t * F.col("mad")).where("mad > 0").select(*table.columns)


def normal_outliers(table: DataFrame, column: str, t: float) -> DataFrame:
    """Rows above the t quantile of a normal distribution with the series' mean and deviation."""
    by = table.groupBy("series_id").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return table.join(by, "series_id").where(F.col(column) - F.col("mean") > NormalDist().inv_cdf(t) * F.col("std")).select(*table.columns)


def gap_cuts(pers: DataFrame, jump: int = 1) -> DataFrame:
    """(series_id, b_cut, p_cut) from finite (birth, death) pairs."""
    births = otsu(pers, "birth").withColumnRenamed("cut", "b_cut")
    kept = pers.join(births, "series_id").where("birth < b_cut").withColumn("pers", F.col("death") - F.col("birth"))
    return births.join(gap_cut(kept, "pers", jump).withColumnRenamed("cut", "p_cut"), "series_id")


def fixed_cuts(pers: DataFrame, n: int) -> DataFrame:
    """(series_id, b_cut, p_cut) that leave n components, the one that never dies among them."""
    births = otsu(pers, "birth").withColumnRenamed("cut", "b_cut")
    kept = pers.join(births, "series_id").where("birth < b_cut").withColumn("pers", F.col("death") - F.col("birth"))
    return births.join(top_n_cut(kept, "pers", n).withColumnRenamed("cut", "p_cut"), "series_id")


def _prominent(pers: DataFrame) -> DataFrame:
    """Finite pairs that live for a while, with how long."""
    return pers.withColumn("pers", F.col("death") - F.col("birth")).where("pers > 0")


def _both(births: DataFrame, lives: DataFrame) -> DataFrame:
    return births.withColumnRenamed("cut", "b_cut").join(lives.withColumnRenamed("cut", "p_cut"), "series_id")


def _tail(table: DataFrame, cuts: DataFrame, condition: str) -> DataFrame:
    return table.join(cuts, "series_id").where(condition).drop("cut")


def split_cuts(pers: DataFrame, kind: str | None = None, bins: int = BINS) -> DataFrame:
    """(series_id, b_cut, p_cut): histogram splits of births and of persistence, each by itself. Skewed kinds split the
    births below (birth_skewed), the persistence above (prominence_skewed) or both (skewed) once more."""
    rows = _prominent(pers)
    births, lives = otsu(rows, "birth", bins), otsu(rows, "pers", bins)
    if kind in ("birth_skewed", "skewed"):
        births = otsu(_tail(rows, births, "birth < cut"), "birth", bins)
    if kind in ("prominence_skewed", "skewed"):
        lives = otsu(_tail(rows, lives, "pers > cut"), "pers", bins)
    return _both(births, lives)


def mixed_cuts(pers: DataFrame, bins: int = BINS) -> DataFrame:
    """(series_id, b_cut, p_cut): births split twice, then the persistence of those born below that, split twice."""
    rows = _prominent(pers)
    births = otsu(_tail(rows, otsu(rows, "birth", bins), "birth < cut"), "birth", bins)
    early = _tail(rows, births, "birth < cut")
    return _both(births, otsu(_tail(early, otsu(early, "pers", bins), "pers > cut"), "pers", bins))


def outlier_cuts(pers: DataFrame, t: float = 0.99, bins: int = BINS) -> DataFrame:
    """(series_id, b_cut, p_cut): births split, and of the persistence of those born below that the middle between the
    first normal outlier and the value before it. Series without such an outlier have no row."""
    births = otsu(pers, "birth", bins)
    early = _prominent(_tail(pers, births, "birth < cut"))
    order = Window.partitionBy("series_id").orderBy("pers")
    early = early.select("series_id", "pers", F.lag("pers").over(order).alias("before"))
    first = normal_outliers(early, "pers", t).groupBy("series_id").agg(F.min(F.struct("pers", "before")).alias("x"))
    return _both(births, first.where("x.before IS NOT NULL").select("series_id", ((F.col("x.pers") + F.col("x.before")) / 2).alias("cut")))


def plane_cuts(pers: DataFrame, bins: int = BINS, kind: str | None = None) -> DataFrame:
    """(series_id, p_cut, b_cut): the left edges of the cell of a histogram of persistence by birth that splits both at
    once with the largest variance between. kind skewed splits what lies below both cuts once more; published does so
    as published code does, which holds the persistence against the cut of births too. A series with nothing there
    keeps its first cuts. Kernel over a series' occupied cells: only there do the sums change."""
    if kind is not None:
        first = plane_cuts(pers, bins)
        other = {"skewed": "birth", "published": "death - birth"}[kind]
        below = pers.join(first, "series_id").where(f"death - birth < p_cut AND {other} < b_cut").select(*pers.columns)
        again = plane_cuts(below, bins).withColumnsRenamed({"p_cut": "p_again", "b_cut": "b_again"})
        both = first.join(again, "series_id", "left")
        return both.select("series_id", F.coalesce("p_again", "p_cut").alias("p_cut"), F.coalesce("b_again", "b_cut").alias("b_cut"))
    rows = _prominent(pers).select("series_id", "pers", "birth")

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        edges, places = [], []
        for x in (own["pers"], own["birth"]):
            lo, hi = (x.min(), x.max()) if x.min() < x.max() else (x.min() - 0.5, x.max() + 0.5)
            edge = np.linspace(lo, hi, bins + 1)
            occupied, at = np.unique(np.clip(np.searchsorted(edge, x, "right") - 1, 0, bins - 1), return_inverse=True)
            edges.append((edge[0], edge[occupied]))
            places.append(at)
        share = np.zeros([len(e) for _, e in edges])
        np.add.at(share, tuple(places), 1 / len(places[0]))
        sums = [x.cumsum(axis=0).cumsum(axis=1) for x in (share, share * edges[0][1][:, None], share * edges[1][1])]
        under = sums[0] * (1 - sums[0])
        apart = sum((s - s[-1, -1] * sums[0]) ** 2 for s in sums[1:])
        score = np.round(np.where(under > 1e-12, apart / np.where(under > 1e-12, under, 1), 0), 12)
        if not score.max() > 0:
            return [(float(edges[0][0]), float(edges[1][0]))]
        i, j = np.unravel_index(score.argmax(), score.shape)
        return [(float(edges[0][1][i]), float(edges[1][1][j]))]

    return by_series(rows, ["pers", "birth"], run, "p_cut double, b_cut double")
