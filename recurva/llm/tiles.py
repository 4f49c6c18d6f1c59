"""Searches of a stated query set against all vectors: blocks of queries meet blocks of vectors, one tile a task step.

A vector table is cut by a hash of its ids into blocks of a fixed size. A block's vectors are indexed once, then
chunks of queries search the index. Every tile returns each query's best few; heaps of k entries merge them, query
after query. Neither side is ever collected or broadcast whole.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part; of rows with
one vec_id the least vector counts; vectors shorter than the longest are filled with zeros; equal scores go by the
smaller vec_id; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import staged

BASE_BLOCK, QUERY_BLOCK, CHUNK = 8_192, 16_384, 512

#: Given a block's vectors and ids: a search for (queries, their ids, k).
Tile = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, x array<double>), one row per vec_id."""
    x = table["embedding"].cast("array<double>")
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def search(vectors: DataFrame, every: int, k: int, tile: Tile, kind: str, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by `every`) against vectors (vec_id, x).
    tile(vectors, their ids) indexes a block; the search it gives, called with (queries, their ids, k), yields (query
    row, vector row, score) arrays that hold each query's k best of the block, or more; ids ascend."""
    vectors = staged(vectors, "tile-vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    n_base, n_query = max(1, math.ceil(n / BASE_BLOCK)), max(1, math.ceil(n / every / QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_base)).alias("b")
    base = vectors.select(block, F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("q"), "vec_id", "x", F.lit(False).alias("asks"))
    asked = vectors.where(F.col("vec_id") % every == 0)
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query)).cast("int").alias("q")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_base - 1).cast("long"))).alias("b"), own, "vec_id", "x", F.lit(True).alias("asks"))

    def of_tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        sides = [table.filter(pa.compute.equal(table.column("asks"), side)) for side in (True, False)]
        (qs, cs), (q_ids, c_ids) = [matrix(s.column("x"), width) for s in sides], [s.column("vec_id").to_numpy() for s in sides]
        parts = []
        if len(qs) and len(cs):
            find = tile(cs, c_ids)
            for at in range(0, len(qs), CHUNK):
                for q, c, score in find(qs[at : at + CHUNK], q_ids[at : at + CHUNK], k):
                    parts.append((q_ids[at : at + CHUNK][q], c_ids[c], score))
        got = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(3)]
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.int64() if kind == "long" else pa.float64())})

    found = base.unionByName(asked).groupBy("b", "q").applyInArrow(of_tile, f"query_id long, vec_id long, score {kind}")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64() if kind == "long" else pa.float64()]
        heap: list[tuple] = []
        query = None

        def ranked() -> list[tuple]:
            return [(query, r, -c, s if largest else -s) for r, (s, c) in enumerate(sorted(heap, reverse=True), 1)]

        for batch in batches:
            rows: list[tuple] = []
            for q, c, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if q != query:
                    rows += ranked()
                    heap, query = [], q
                entry = (s if largest else -s, -c)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["query_id", "rank", "vec_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in ranked()], kinds[i]) for i in range(4)], names=["query_id", "rank", "vec_id", "score"])

    found = found.repartition("query_id").sortWithinPartitions("query_id")
    return found.mapInArrow(merged, f"query_id long, rank int, vec_id long, score {kind}")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Row by row the k-th largest score (the smallest, if there are fewer)."""
    if scores.shape[1] <= k:
        return scores.min(axis=1, initial=np.inf)
    return np.partition(scores, -k, axis=1)[:, -k]


def leading(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of entries given by row, the places of each row's k largest scores, ties to the smaller column."""
    order = np.lexsort((cols, -scores, rows))
    own = rows[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < k]
