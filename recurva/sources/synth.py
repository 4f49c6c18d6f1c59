"""Seeded series with planted motifs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Places in [0, 1] to values.
Shape = Callable[[np.ndarray], np.ndarray]


def spline(xs: np.ndarray, ys: np.ndarray) -> Shape:
    """The cubic spline through the points without a knot at the second and the last but one: a cubic polynomial and
    a cubic bend at each other inner point; through four points or fewer the polynomial alone."""
    bends = xs[2:-2]

    def terms(t: np.ndarray) -> np.ndarray:
        powers = [t**k for k in range(min(4, len(xs)))]
        return np.stack([*powers, *(np.maximum(t - b, 0) ** 3 for b in bends)], axis=1)

    weights = np.linalg.solve(terms(xs), ys)
    return lambda t: terms(t) @ weights


def shape_of(kind: str, waves: int, draw: np.random.Generator) -> Shape:
    """A drawn pattern: "sine", a sum of so many sinusoids, or "cubic", a spline through so many points between two zeros."""
    if kind == "sine":
        parts = [(draw.normal(), k, draw.random()) for k in range(1, waves + 1)]
        return lambda t: sum(a * np.sin(2 * np.pi * (k * t + shift)) for a, k, shift in parts)
    if kind == "cubic":
        return spline(np.linspace(0, 1, waves + 2), np.concatenate(([0.0], draw.standard_normal(waves), [0.0])))
    raise ValueError(f"no such kind of pattern: {kind}")


def planted(
    spark: SparkSession,
    n_series: int,
    n_motifs: int = 2,
    length: int = 20,
    repeats: tuple[int, int] = (2, 5),
    gap: float = 0.2,
    noise: float = 0.1,
    walk: float = 0.0,
    stretch: float = 0.0,
    seed: int = 0,
    kind: str = "sine",
    waves: int = 4,
    amplitude: tuple[float, float] = (1.0, 1.0),
    swell: float = 0.0,
    gap_stretch: float = 0.0,
    novelties: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(series, truth): patterns repeated in shuffled order with gaps between them, noise and a random walk on top;
    truth has each occurrence (series_id, label, start, end). Each pattern has an amplitude of its own from a range;
    stretch, swell and gap_stretch vary the length and height of occurrences and the gaps by up to that share.
    Novelties are patterns that occur once, with labels from n_motifs on. A series depends on its id and the arguments
    alone."""

    def one(i: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        draw = np.random.default_rng([seed, i])
        shapes = [(draw.uniform(*amplitude), shape_of(kind, waves, draw)) for _ in range(n_motifs + novelties)]
        times = np.concatenate((draw.integers(repeats[0], repeats[1] + 1, n_motifs), np.ones(novelties, int)))
        parts, truth, at = [], [], 0
        for label in draw.permutation(np.repeat(np.arange(len(times)), times)).tolist():
            space, size, height = (1 + share * draw.uniform(-1, 1) for share in (gap_stretch, stretch, swell))
            space, size = max(1, round(gap * length * space)), max(2, round(length * size))
            most, shape = shapes[label]
            parts += [np.zeros(space), most * height * shape(np.linspace(0, 1, size))]
            truth.append((label, at + space, at + space + size))
            at += space + size
        xs = np.concatenate([*parts, np.zeros(max(1, round(gap * length)))])
        return xs + noise * draw.standard_normal(len(xs)) + walk * draw.standard_normal(len(xs)).cumsum(), truth

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                xs = one(i)[0]
                yield pd.DataFrame({"series_id": i, "idx": np.arange(len(xs)), "value": xs})

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                yield pd.DataFrame([(i, *t) for t in one(i)[1]], columns=["series_id", "label", "start", "end"])

    ids = spark.range(n_series)
    return ids.mapInPandas(values, "series_id long, idx long, value double"), ids.mapInPandas(labels, "series_id long, label long, start long, end long")
