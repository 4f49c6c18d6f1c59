"""Windows of a series against all its others: pairs, profiles (for every window its nearest outside its own zone) and
nearest neighbours.

A series is cut into tiles of samples. Every task takes the windows of one tile as rows (of several, in series of more
than ROW_TILES) and meets all tiles of the series as columns, a bounded block of the distance matrix at a time, one step
an entry whatever the length of a window, and keeps what each row needs. One pass over the samples makes the tiles,
rows are never merged again, and a task holds the samples of one whole series, never a matrix of them; the work of
a long series spreads over as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.distance import DISTANCES, HELD, Crossing

#: Samples of a tile; tasks that a series is dealt out to at most, so that its samples are sent no more often.
TILE, ROW_TILES = 1_024, 1_000

#: (places of the rows, places of all windows, their rounded distances, infinite within the own zone) to columns.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def scan(series: DataFrame, m: int, name: str, work: Work, columns: str, digits: int | None = None, tile: int = TILE, exact: bool = False) -> DataFrame:
    """series_id and the columns that work makes of the rows of the distance matrix. series has no gaps in idx. Where
    all distances are results, exact makes them sample by sample."""
    d = DISTANCES[name]
    cut = series.groupBy("series_id", F.floor(F.col("idx") / tile).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    cut = cut.select("series_id", "tile", F.col("s")[0]["idx"].alias("first"), F.transform("s", lambda x: x["value"]).alias("xs"))
    cut = cut.withColumn("last", F.max("tile").over(Window.partitionBy("series_id")))
    cut = cut.withColumn("each", F.ceil((F.col("last") + 1) / ROW_TILES))  # tiles a task
    cut = cut.select("series_id", "first", "xs", "tile", "each", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / F.col("each")))).alias("row"))
    # Short series have one tile and stay where they are; only longer ones are dealt out row by row.
    met = cut.repartition("series_id", "row").sortWithinPartitions("series_id", "row", "tile")
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for series_id, row, each, first, xs in _gathered(batches):
            n = len(xs) - m + 1
            begin, end = (min(n, max(0, k * each * tile - first)) for k in (row, row + 1))
            if begin >= end:
                continue
            at = np.arange(n) + first
            for own, dist in Crossing(d, xs, m).rows(begin, end, exact):
                made = work(at[own], at, dist if digits is None else np.round(dist, digits))
                if len(made[names[0]]):
                    yield pa.record_batch({"series_id": pa.array(np.full(len(made[names[0]]), series_id)), **{c: pa.array(made[c]) for c in names}})

    return met.mapInArrow(run, f"series_id long, {columns}")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(series_id, row, tiles a task, first idx, all samples in order) of each series and row."""
    key, first, parts = None, 0, []
    for batch in batches:
        ids, rows, each, firsts = (batch.column(c).to_pylist() for c in ("series_id", "row", "each", "first"))
        lists = batch.column("xs")
        for i, now in enumerate(zip(ids, rows, each, strict=True)):
            if now != key:
                if parts:
                    yield *key, first, np.concatenate(parts)
                key, first, parts = now, firsts[i], []
            parts.append(lists[i].values.to_numpy(zero_copy_only=False))
    if parts:
        yield *key, first, np.concatenate(parts)


def pairs(series: DataFrame, m: int, name: str, tile: int = TILE) -> DataFrame:
    """(series_id, i, j, dist) with j - i >= m."""

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        i, j = np.nonzero(np.isfinite(dist) & (at > rows[:, None]))
        return {"i": rows[i], "j": at[j], "dist": dist[i, j]}

    return scan(series, m, name, work, "i long, j long, dist double", tile=tile, exact=True)


def profile(series: DataFrame, m: int, name: str = "znorm", digits: int = 6, tile: int = TILE) -> DataFrame:
    """(series_id, i, j, dist): each window's nearest, distances rounded, ties to the smaller j."""

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        best = dist.argmin(axis=1)
        least = dist[np.arange(len(rows)), best]
        keep = np.isfinite(least)
        return {"i": rows[keep], "j": at[best][keep], "dist": least[keep]}

    return scan(series, m, name, work, "i long, j long, dist double", digits, tile)


def tiled_profile(series: DataFrame, m: int, name: str = "znorm", tile: int = TILE, digits: int = 6) -> DataFrame:
    """The profile of long series by tiles of a stated size, which a window must fit."""
    if m > tile:
        raise ValueError("a window must fit a tile")
    return profile(series, m, name, digits, tile)


def top_pair(profile: DataFrame) -> DataFrame:
    """Each series' closest pair."""
    best = profile.groupBy("series_id").agg(F.min(F.struct("dist", "i", "j")).alias("b"))
    return best.select("series_id", "b.i", "b.j", "b.dist")


def discords(profile: DataFrame, k: int = 3) -> DataFrame:
    """Each series' k windows farthest from their nearest."""
    order = Window.partitionBy("series_id").orderBy(F.desc("dist"), "i")
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(series: DataFrame, m: int, k: int, name: str = "znorm", digits: int = 6, tile: int = TILE) -> DataFrame:
    """(series_id, i, rank, j, dist): the k nearest of every window, which may overlap one another."""

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        return chosen(rows, at, dist, k, lambda left, best: left)

    return scan(series, m, name, work, "i long, rank int, j long, dist double", digits, tile)


def chosen(rows: np.ndarray, at: np.ndarray, dist: np.ndarray, k: int, without: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """The nearest of each row, then, of what without(what is left, places of the nearest) leaves, the next, k times."""
    dist, each = dist.copy(), np.arange(len(rows))
    parts = []
    for rank in range(1, k + 1):
        best = dist.argmin(axis=1)
        least = dist[each, best]
        keep = np.isfinite(least)
        if rank > 1 and not keep.any():
            break
        parts.append((rows[keep], np.full(keep.sum(), rank, np.int32), at[best][keep], least[keep]))
        left = np.isfinite(dist)
        left[each, best] = False
        dist[~without(left, best)] = np.inf
    return dict(zip(("i", "rank", "j", "dist"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def within(rows: np.ndarray, at: np.ndarray, dist: np.ndarray, radius: float | np.ndarray, m: int, overshoot: bool = False) -> dict[str, np.ndarray]:
    """Of each row all that are nearer than its radius and overlap neither one another nor those picked before, nearest
    first. overshoot: after them the nearest of what is left, as published code does, which stops one pick too late.
    Only what lies within the radius is sorted, and a pick blocks its zone at once."""
    reach, zone = np.broadcast_to(radius, len(rows)), b"\x01" * (2 * m - 1)
    parts = []
    for k in range(len(rows)):
        near = np.flatnonzero(dist[k] < reach[k])
        if not len(near):
            continue
        blocked, own = bytearray(len(at) + 2 * m), []
        for p in near[np.argsort(dist[k, near], kind="stable")].tolist():
            if not blocked[p + m]:
                own.append(p)
                blocked[p + 1 : p + 2 * m] = zone
        if overshoot:
            left = np.where(np.frombuffer(blocked, np.uint8)[m : m + len(at)] == 0, dist[k], np.inf)
            if np.isfinite(left.min()):
                own.append(int(left.argmin()))
        parts.append((np.full(len(own), rows[k]), np.arange(1, len(own) + 1, dtype=np.int32), at[own], dist[k, own]))
    if not parts:
        parts = [(rows[:0], np.zeros(0, np.int32), at[:0], dist[0, :0])]
    return dict(zip(("i", "rank", "j", "dist"), map(np.concatenate, zip(*parts, strict=True)), strict=True))


def multi_length(series: DataFrame, lengths: list[int], name: str = "znorm", per_length: bool = True) -> DataFrame:
    """(series_id, m, i, j, dist) for several lengths; per_length divides by the root of m, which makes them comparable."""
    out = None
    for m in lengths:
        one = profile(series, m, name).withColumn("m", F.lit(m))
        if per_length:
            one = one.withColumn("dist", F.round(F.col("dist") / m**0.5, 6))
        out = one if out is None else out.unionByName(one)
    return out.select("series_id", "m", "i", "j", "dist")
