"""Mix sources to target weights: whole copies first, then a subset-sum fit of what remains of each target.

A document's size is its number of words. A source whose target is k whole copies and a remainder takes every
document k times and one more of some documents whose sizes add up to the remainder. Those are found from the
counts of documents by exact size: every size takes its share rounded down, single documents take up the rounding,
and a bounded-knapsack programme over the counts left meets the last words exactly where some subset does. Which
documents of a size are taken follows a seeded hash of their ids, so reruns agree.

The programme spans SPAN words. Where rounding leaves more, single documents whose size fits fill it down to that
first, in order of how much their size was rounded by; another choice of those might meet the target more closely.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its
own, the last; repeated rows count and are taken like any other; very long texts are counted whole, and one larger than
what remains of its source's target is not taken once more; documents of equal hash are taken by doc_id; an empty
table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.llm.common import staged

#: Words that the programme spans; what is above it is filled by single documents before.
SPAN = 65_536
#: Parts of a hash range by which documents of one source and size are counted, so that no such group meets in one task.
BUCKETS = 1024


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, at most counts, for a sum near budget and never above it."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if whole <= budget:
        return counts.copy()
    if budget <= 0:
        return taken
    share = counts * (budget / whole)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((taken * sizes).sum())
    for i in np.argsort(taken - share, kind="stable").tolist():
        if rest <= SPAN:
            break
        if sizes[i] <= rest and taken[i] < counts[i]:
            taken[i] += 1
            rest -= int(sizes[i])
    return taken + _programme(sizes, counts - taken, rest)


def _programme(sizes: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over sizes: the largest reachable sum up to budget. Counts are split into powers of two;
    first[s] is the item with which s was first reached, so walking back meets each item once at most."""
    first = np.full(budget + 1, -1, np.int64)
    first[0] = -2
    items: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        if sizes[i] <= 0 or sizes[i] > budget:
            continue
        n, part = min(int(left[i]), budget // int(sizes[i])), 1
        while n > 0 and first[budget] == -1:
            part = min(part, n)
            weight = part * int(sizes[i])
            new = (first[weight:] == -1) & (first[: budget + 1 - weight] != -1)
            first[weight:][new] = len(items)
            items.append((i, part))
            n, part = n - part, part * 2
    out = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(first != -1)[-1])
    while at:
        i, part = items[first[at]]
        out[i] += part
        at -= part * int(sizes[i])
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(key, source_size, target) from (key, source, size): the weights repeat over the sources in code point order,
    a null source last. share times all sizes is dealt by weight; a source stops at `most` times its own size and the
    rest of its part is dealt again. One row per source passes through these windows."""
    by = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    everything, down = Window.partitionBy(), Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(down), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(down), F.lit(0.0))) / free
    by = by.withColumn("level", level).withColumn("open", F.col("fill") >= F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct("fill", "level"))).over(everything)["level"]
    by = by.withColumn("dealt", F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return by.select("key", "source_size", F.least("cap", "dealt").alias("target"))


def size_of(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """A row per document: doc_id, source, size, source_size and target of its source, copies (times it is taken)."""
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size_of(docs["text"]).alias("size"))
    sized = sized.withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = staged(sized.withColumn("bucket", F.shiftrightunsigned("hash", 54).cast("int")), "mix-sizes")
    goals = staged(targets(sized, weights, share, most), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("base", copies).withColumn("budget", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long"))

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        extra = fit(part["size"].to_numpy(), part["n"].to_numpy(), int(part["budget"].iloc[0]))
        return pd.DataFrame({"key": part["key"], "size": part["size"], "quota": extra})

    buckets = staged(sized.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    # A source's table has a row per exact size, however many documents it has.
    counts = buckets.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n"))
    quotas = counts.join(goals.select("key", "budget"), "key").groupBy("key").applyInPandas(fitted, "key string, size long, quota long")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0))
    rooms = buckets.join(quotas, ["key", "size"]).withColumn("room", F.greatest(F.lit(0), F.least(room, F.col("n"))))
    rooms = staged(rooms.where("room > 0").select("key", "size", "bucket", "n", "room"), "mix-rooms")
    wanted = sized.join(rooms, ["key", "size", "bucket"], "left")
    sure = wanted.where("room IS NULL OR room = n").withColumn("extra", F.when(F.col("room").isNull(), 0).otherwise(1))
    order = Window.partitionBy("key", "size", "bucket").orderBy("hash", "doc_id")
    cut = wanted.where("room < n").withColumn("extra", F.when(F.row_number().over(order) <= F.col("room"), 1).otherwise(0))
    # One row per source: its size is checked when the plan runs.
    out = sure.unionByName(cut).join(goals, "key")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base") + F.col("extra")).otherwise(0).cast("long").alias("copies"))
