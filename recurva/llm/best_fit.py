"""Best-fit decreasing packing: documents into as few windows as the tightest fit finds, none cut that fits one.

Pieces are taken from the longest to the shortest; each goes into the open window whose remaining room is the least that
holds it. A segment tree over remaining room finds that window in logarithmic time. The outcome depends on the pieces'
lengths alone, and there are no more lengths than a window has places, so the tree works on the histogram of lengths:
pieces of one length go to a run of windows with equal room at once. The plan that comes out is as long as its number
of runs allows, whatever the number of documents: two runs a length at most are new, and a run is met once for each
of its different lengths (fewer than 91 in 4,096). Which piece takes which place is settled without a global order:
a piece counts those of its length before it in its own task, a running sum over tasks does the rest.

Defined results: a null text is empty and still has its end id; null doc_ids and repeated rows are documents of
their own; very long texts are cut into full windows and a last piece; pieces of equal length are in the order of tasks
and rows; windows with equal room are equally good; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.llm.common import staged, texts_of
from recurva.llm.tokens import encode, slices

#: A piece that the plan places: its length, first rank, first window, pieces a window, place in the window.
PLAN = ("length", "rank", "window", "each", "offset")


class Rooms:
    """Runs of open windows by remaining room. Leaf r of the tree is set when a window has room for exactly r more."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            node = room + self.leaves
            self.some[node] = 0
            node >>= 1
            while node and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
                node >>= 1
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining room of length or more: up until a right neighbour has any, then down its left side."""
        node = length + self.leaves
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: Mapping[int, int], window: int) -> np.ndarray:
    """Rows PLAN in order of length and rank: the k-th piece from a row's rank on stands in window + k // each, at
    offset + k % each * length."""
    rooms, opened, out = Rooms(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, held = window, opened, -(-left // (window // length))
                opened += held
            else:
                first, held = rooms.take(room)
            each = room // length
            used = min(held, -(-left // each))
            placed = min(left, used * each)
            full, rest = divmod(placed, each)
            out.append((length, rank, first, each, window - room))
            for own, number, after in ((first, full, room - each * length), (first + full, int(rest > 0), room - rest * length), (first + used, held - used, room)):
                if number and after:
                    rooms.add(after, own, number)
            rank, left = rank + placed, left - placed
    return np.array(sorted(out), np.int64).reshape(-1, len(PLAN))


def pieces_of(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """task, nth (pieces of this length before it in the task), doc_id, piece, start, length and ids (little-endian
    unsigned 32-bit, the end id last)."""
    kinds = {"task": pa.int64(), "nth": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for some in slices(batch):
                bounds, ids = encode(some.column("text"), tokenizer)
                raw, rows = ids.tobytes(), []
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for piece, at in enumerate(range(a, b, window)):
                        length = min(window, b - at)
                        rows.append((task, int(seen[length]), doc_id, piece, at - a, length, raw[4 * at : 4 * (at + length)]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return texts_of(docs).mapInArrow(run, "task long, nth long, doc_id long, piece int, start long, length long, ids binary")


def best_fit(docs: DataFrame, tokenizer: str, window: int = 4096) -> DataFrame:
    """A row per piece: doc_id, piece (from 0), start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit), sequence_id and offset (its place there). No sequence is longer than window."""
    spark = docs.sparkSession
    held = staged(pieces_of(docs, tokenizer, window), "best-fit-ids", "zstd")
    by_task = held.groupBy("task", "length").agg(F.count("*").alias("n"))
    by_task = staged(by_task, "best-fit-lengths")
    # A row per length, window of them at most.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = spark.sparkContext.broadcast(plan(counts, window))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, size, k = planned.value, length.to_numpy(), rank.to_numpy()
        # The last row of its length that begins at its rank or before: lengths spread far apart, one search finds it.
        apart = int(rows[:, 1].max(initial=0) + k.max(initial=0)) + 1
        at = np.searchsorted(rows[:, 0] * apart + rows[:, 1], size * apart + k, "right") - 1
        _, since, window_, each, offset = rows[at].T
        return pd.DataFrame({"sequence_id": window_ + (k - since) // each, "offset": offset + (k - since) % each * size})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    out = held.join(first, ["task", "length"]).withColumn("at", placed("length", F.col("first") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
