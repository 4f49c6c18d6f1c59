"""Exact top-k by inner product over an impact-ordered index, score at a time.

A block's vectors become postings (dimension, vector, impact), sorted by falling size of the impact quantised to
powers of two; postings of one quantised impact are a segment. The index is built once for a block and holds, for
each segment, the matrix of its postings, and what of each vector's length the segments after it still hold. A search
takes segments from the largest impact down. After each, an accumulator is within |query| * |rest of the vector| of
the true score. A search stops only when those bounds prove that few vectors can still be among the best k, or when
no segment is left; every vector that may be a member is then scored exactly in integers.

Defined results, beside those of tiles: scores beyond 64 bits stand as the largest or smallest such integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.tiles import best, leading, search, usable

#: Quantised impacts below the largest one's SEGMENTS - 1 powers of two are one segment; with at most so many possible
#: members for each one wanted, scoring them costs less than another segment.
SEGMENTS, FEW = 6, 8
#: Up to this, sums of products are exact in single and in double precision.
EXACT, EXACT_DOUBLE = 1 << 24, 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class ImpactIndex:
    """Segments of postings in order of falling impact: (dimensions, vectors' impacts there, lengths of the rest)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.most = vectors, np.abs(vectors).max(initial=0)
        vector, dim = np.nonzero(vectors)
        impact = vectors[vector, dim]
        level = np.minimum(np.floor(np.log2(max(self.most, 1))) - np.floor(np.log2(np.abs(impact))), SEGMENTS - 1).astype(np.int64)
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(SEGMENTS + 1))
        left = (vectors**2).sum(axis=1)
        self.segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            own = order[a:b]
            dims, at = np.unique(dim[own], return_inverse=True)  # only dimensions with a posting in this segment
            held = np.zeros((len(dims), len(vectors)), np.float32 if self.most < EXACT else np.float64)
            held[at, vector[own]] = impact[own]
            left = left - np.bincount(vector[own], impact[own] ** 2, len(vectors))
            self.segments.append((dims, held, np.sqrt(np.maximum(left, 0)) if b < len(order) else np.zeros(len(vectors))))

    def scores(self, queries: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Exact integer products of pairs."""
        size = np.abs(queries).max(initial=0) * self.most * queries.shape[1]
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 100_000):
            q, c = queries[rows[i : i + 100_000]], self.vectors[cols[i : i + 100_000]]
            if size < EXACT_DOUBLE:
                out[i : i + 100_000] = (q * c).sum(axis=1)
            elif size < MOST / 4:
                out[i : i + 100_000] = (q.astype(np.int64) * c.astype(np.int64)).sum(axis=1)
            else:
                out[i : i + 100_000] = [min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q.tolist(), c.tolist(), strict=True)]
        return out


def impact_tile(cs: np.ndarray, c_ids: np.ndarray):
    index = ImpactIndex(cs)
    lengths = np.sqrt((cs**2).sum(axis=1))

    def find(qs: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple]:
        size = index.most * np.abs(qs).max(initial=0) * qs.shape[1]
        kind = np.float32 if size < EXACT else np.float64
        own = c_ids[None, :] == q_ids[:, None]
        norms = np.sqrt((qs**2).sum(axis=1))
        # Beyond EXACT_DOUBLE accumulators and rests in double precision are a little off.
        slack = 0 if size < EXACT_DOUBLE else 1e-7 * norms[:, None] * lengths
        sums, queries, possible = np.zeros((len(qs), len(cs)), kind), qs.astype(kind), ~own
        for dims, held, rest in index.segments:
            sums += queries[:, dims] @ held.astype(kind, copy=False)
            bound = norms[:, None] * rest * (1 + 1e-6) + slack
            low = np.where(own, -np.inf, sums - bound)
            possible = (sums + bound >= best(low, k)[:, None]) & ~own
            if possible.sum() <= FEW * k * len(qs):
                break
        rows, cols = np.nonzero(possible)
        scores = index.scores(qs, rows, cols)
        keep = leading(rows, cols, scores, k)
        yield rows[keep], cols[keep], scores[keep]

    return find


def impact_top_k(table: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x) for every vector whose
    id is divisible by `every`, against all others; ties to the smaller vec_id."""
    whole = usable(table).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    return search(whole, every, k, impact_tile, "long", largest=True)
