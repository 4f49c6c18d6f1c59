"""From labelled windows to labelled, half-open stretches [start, end) of a series, and back."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.plans.kernels import by_series


def islands(points: DataFrame) -> DataFrame:
    """(series_id, label, start, end) of runs of consecutive idx in (series_id, label, idx)."""
    order = Window.partitionBy("series_id", "label").orderBy("idx")
    runs = points.distinct().withColumn("run", F.col("idx") - F.row_number().over(order))
    return runs.groupBy("series_id", "label", "run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).drop("run")


class Stretches:
    """Disjoint stretches in order, each with its owner; what touches or overlaps and has one owner is one stretch."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.owners: list[int] = []

    def claim(self, start: int, end: int, owner: int) -> bool:
        """[start, end) becomes the owner's, unless another has any of it."""
        low = bisect_left(self.ends, start)  # the first that ends at start or later
        high = bisect_right(self.starts, end)  # past the last that starts at end or sooner
        for k in range(low, high):
            if self.owners[k] != owner and self.starts[k] < end and self.ends[k] > start:
                return False
        low += low < high and self.owners[low] != owner and self.ends[low] <= start  # another's that only touches
        high -= low < high and self.owners[high - 1] != owner and self.starts[high - 1] >= end
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high], self.owners[low:high] = [start], [end], [owner]
        return True


def paint(nodes: DataFrame, m: int, parity: bool = False) -> DataFrame:
    """(series_id, label, start, end, birth) from (series_id, label, node, birth): windows claim their samples in order
    of birth unless another run of windows has one of them; runs are windows of one label without a gap. What a run
    has claimed is an occurrence. parity counts as published code does: a label's first run is one with the last run
    of the label before, so those two may overlap, and occurrences are what a label has claimed, a sample shorter at
    either end. Kernel: the order decides."""

    def run(_: int, part: dict[str, np.ndarray]) -> list[tuple]:
        labels, nodes_, births = (part[c] for c in ("label", "node", "birth"))
        same, broken = labels[1:] == labels[:-1], nodes_[1:] != nodes_[:-1] + 1
        runs = np.cumsum(np.concatenate(([True], same & broken if parity else ~same | broken)))
        order = np.lexsort((labels, nodes_, births))
        taken = Stretches()
        ends: dict[tuple, list] = {}
        for label, node, birth, own in zip(labels[order].tolist(), nodes_[order].tolist(), births[order].tolist(), runs[order].tolist(), strict=True):
            if taken.claim(node, node + m, own):
                ends.setdefault((label, None if parity else own), []).append([label, node, node + m - parity, birth])
        return [(s[0], s[1] + parity, *s[2:]) for own in ends.values() for s in merged(own)]

    def merged(stretches: list[list]) -> list[list]:
        out: list[list] = []
        for s in sorted(stretches):
            if out and s[1] <= out[-1][2]:
                out[-1][2:4] = max(out[-1][2], s[2]), min(out[-1][3], s[3])
            else:
                out.append(s)
        return out

    return by_series(nodes.select("series_id", "label", "node", "birth"), ["label", "node"], run, "label long, start long, end long, birth double")


def extended(nodes: DataFrame, m: int, least: int | None = None) -> DataFrame:
    """(series_id, label, start, end, birth): runs of windows of a label, each with the smallest birth of its windows,
    reaching on by a window but not into the next run. From the latest birth to the earliest a run goes if it, or what
    lies between the start of the run before and its own, is shorter than least (m if not given). Kernel: the order decides."""
    order = Window.partitionBy("series_id", "label").orderBy("node")
    runs = nodes.withColumn("run", F.col("node") - F.row_number().over(order))
    runs = runs.groupBy("series_id", "label", "run").agg(F.min("node").alias("start"), F.max("node").alias("last"), F.min("birth").alias("birth"))
    shortest = m if least is None else least

    def run(_: int, part: dict[str, np.ndarray]) -> list[tuple]:
        starts, lasts, births, labels = (part[c] for c in ("start", "last", "birth", "label"))
        n = len(starts)
        # The runs still there as a list linked both ways; place n stands for either end.
        after, before = [*range(1, n + 1), 0], [n, *range(n)]
        ends: dict[int, int] = {}
        for k in np.lexsort((starts, labels, -births)).tolist():
            left, right = before[k], after[k]
            end = min(int(lasts[k]) + m, int(starts[right]) if right < n else np.iinfo(np.int64).max)
            if end - starts[k] >= shortest and (left == n or starts[k] - starts[left] >= shortest):
                ends[k] = end
            else:
                after[left], before[right] = right, left
        return [(int(labels[k]), int(starts[k]), end, float(births[k])) for k, end in sorted(ends.items())]

    return by_series(runs.select("series_id", "label", "start", "last", "birth"), ["start", "label"], run, "label long, start long, end long, birth double")


def without_singletons(found: DataFrame) -> DataFrame:
    """Labels with more than one occurrence."""
    own = Window.partitionBy("series_id", "label")
    return found.withColumn("n", F.count("*").over(own)).where("n > 1").drop("n")


def similar_length(found: DataFrame, similarity: float = 0.25) -> DataFrame:
    """Occurrences whose length is within a share of their label's median length."""
    size = F.col("end") - F.col("start")
    middle = found.groupBy("series_id", "label").agg(F.median(size).alias("middle"))
    return found.join(middle, ["series_id", "label"]).where(F.abs(size - F.col("middle")) <= similarity * F.col("middle")).select(*found.columns)


def with_births(found: DataFrame, profile: DataFrame, m: int, parity: bool = False) -> DataFrame:
    """found with birth, the least distance of the windows that lie in each occurrence (null if there is none). parity
    takes windows as published code does, from start up to, without it, end - m + 3, for its occurrences that are a
    sample shorter. Kernel: range minima of a series' profile by a table of minima over powers of two."""
    reach = 3 - m if parity else 1 - m

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        is_node = own["of"] == 0
        at, dist = own["start"][is_node], own["x"][is_node]
        table = [dist]
        while 2 << (len(table) - 1) <= len(dist):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        rows = []
        for label, start, end in zip(*(own[c][~is_node].tolist() for c in ("label", "start", "end")), strict=True):
            a, b = np.searchsorted(at, (start, end + reach)).tolist()
            k = (b - a).bit_length() - 1
            rows.append((label, start, end, float(min(table[k][a], table[k][b - (1 << k)])) if b > a else None))
        return rows

    nodes = profile.select("series_id", F.lit(0).alias("of"), F.lit(0).cast("long").alias("label"), F.col("i").alias("start"), F.lit(0).cast("long").alias("end"), F.col("dist").alias("x"))
    asked = found.select("series_id", F.lit(1).alias("of"), "label", "start", "end", F.lit(0.0).alias("x"))
    return by_series(nodes.union(asked), ["of", "start", "label"], run, "label long, start long, end long, birth double")


def masks(found: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, label, mask): for every label of a series an array as long as the series, 1 in its occurrences, else 0."""
    length = series.groupBy("series_id").agg((F.max("idx") + 1).alias("length"))
    runs = islands(points(found)).groupBy("series_id", "label").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    zero, one = F.lit(0), F.lit(1)
    starts = F.concat(F.transform("runs", lambda r: r["start"]), F.array("length"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["end"]))
    parts = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gaps = F.transform(parts, lambda p: F.array_repeat(zero, (p["a"] - p["b"]).cast("int")))
    whole = F.zip_with(gaps, F.concat(F.transform("runs", lambda r: F.array_repeat(one, (r["end"] - r["start"]).cast("int"))), F.array(F.array().cast("array<int>"))), lambda g, r: F.concat(g, r))
    return runs.join(length, "series_id").select("series_id", "label", F.flatten(whole).alias("mask"))


def points(found: DataFrame) -> DataFrame:
    """(series_id, label, idx): every sample of every occurrence once."""
    return found.select("series_id", "label", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx")).distinct()
