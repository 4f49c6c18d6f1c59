"""Nearest neighbours by a block matrix join: int8 product tiles, error bounds, float for the pairs that survive.

Each vector is a scale times an int8 vector plus an error of known length, so a tile's integer products give every
squared distance to within a bound that is computed, not assumed. Pairs that the bounds cannot exclude from the
k nearest are measured in double precision. Nothing is lost, so recall is 1.

Defined results, beside those of tiles: a distance whose square is beyond double precision is infinite, as the plain
formula has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.tiles import best, leading, search, usable


def quantised(xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales and the lengths of what they miss."""
    scale = np.abs(xs).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    small = np.rint(xs / scale[:, None])
    return small.astype(np.int8), scale, np.sqrt(((xs - small * scale[:, None]) ** 2).sum(axis=1))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


def int8_tile(cs: np.ndarray, c_ids: np.ndarray):
    c8, c_scale, c_miss = quantised(cs)
    # Products of int8 values sum to at most 127 * 127 a component: exact in single precision up to 1040 of them.
    kind = np.float32 if cs.shape[1] <= 1040 else np.float64
    c8, c_norm = c8.astype(kind).T.copy(), np.sqrt((cs**2).sum(axis=1))

    def find(qs: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple]:
        q8, q_scale, q_miss = quantised(qs)
        q_norm = np.sqrt((qs**2).sum(axis=1))
        with np.errstate(over="ignore", invalid="ignore"):
            near = q_norm[:, None] ** 2 + c_norm**2 - 2 * (q_scale[:, None] * c_scale * (q8.astype(kind) @ c8).astype(np.float64))
            bound = 2 * ((q_norm + q_miss)[:, None] * c_miss + q_miss[:, None] * c_norm) + 1e-12 * (q_norm[:, None] + c_norm) ** 2
            least, upper = near - bound, near + bound
        unknown = ~np.isfinite(upper) | ~np.isfinite(least)  # too large to be bounded: measured
        least[unknown], upper[unknown] = -np.inf, np.inf
        own = c_ids[None, :] == q_ids[:, None]
        upper[own] = np.inf
        rows, cols = np.nonzero((least <= -best(-upper, k)[:, None]) & ~own)
        scores = np.empty(len(rows))
        with np.errstate(over="ignore"):
            for i in range(0, len(rows), 100_000):
                scores[i : i + 100_000] = distance(qs[rows[i : i + 100_000]], cs[cols[i : i + 100_000]])
        keep = leading(rows, cols, -scores, k)
        yield rows[keep], cols[keep], scores[keep]

    return find


def nearest(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by Euclidean distance of every vector whose id is divisible by
    `every`, among all others; ties to the smaller vec_id. Zero vectors take no part either."""
    vectors = usable(table).where(F.exists("x", lambda v: v != 0))
    return search(vectors, every, k, int8_tile, "double", largest=False)
