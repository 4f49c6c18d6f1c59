"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A document's features are its words and their beginnings, hashed; a feature's value is how often it stands among a
hundred words (of a text below LEAST_WORDS words, as if it had that many). P(grade >= k) = sigmoid(w.x - t_k): one weight
vector serves all ordered thresholds t_1 < t_2 < ..., and the expected severity is the sum of these probabilities.
The labels say toxic or not; among the toxic, the values of its telling features together set the grade, in thirds.
The model is fitted on a bounded sample of labelled documents (SAMPLE of each class) and scores every whole text.

The model keeps of the sample's features those that tell most (KEPT, LEAST_TELLING, and five toxic documents at
least), equally telling ones by their hash; all other words count in a text's length alone.

Defined results: a null or empty text scores by the thresholds alone; very long texts are read whole, a piece at a
time; null doc_ids and repeated rows are kept, one
result row each; without labels of both classes nothing is toxic; labels that are null, or that contradict each
other for one doc_id, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import staged, texts_of
from recurva.llm.shingles import NOT_LETTERS, word_spans
from recurva.llm.tokens import slices

#: Labelled documents of each class that fit the model, at most; features it keeps; bytes of the beginnings; grades above 0.
SAMPLE, KEPT, BEGINNINGS, GRADES = 3_000, 256, (4, 5, 6), 3
LEAST_WORDS, LEAST_TELLING = 20, 4.0


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(value of one occurrence in each text, text numbers, 32-bit features) piece by piece, an entry per occurrence."""
    for _, bounds, starts, ends, hashed in word_spans(texts, NOT_LETTERS):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        got, own = [hashed(starts, ends)], [owner]
        for n in BEGINNINGS:
            long = ends - starts > n
            got.append(hashed(starts[long], starts[long] + n))
            own.append(owner[long])
        yield 100 / np.maximum(np.diff(bounds), LEAST_WORDS), np.concatenate(own), (np.concatenate(got) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def reach(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for share, own, got in text_features(texts):
            at = np.searchsorted(self.features, got)
            hit = self.features[np.minimum(at, len(self.features) - 1)] == got if len(self.features) else np.zeros(len(got), bool)
            out.append(share * np.bincount(own[hit], self.weights[at[hit]], len(share)))
        return np.concatenate(out) if out else np.zeros(0)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, toxic_share: float = 0.5, rounds: int = 600, rate: float = 0.3, shrink: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds): gradient ascent on the likelihood of all comparisons grade >= k; the rows above grade 0
    together weigh toxic_share, whatever their number in the sample."""
    n, d = x.shape
    weights, steps = np.zeros(d), np.zeros(GRADES)  # thresholds are sums of positive steps
    over = grade[:, None] >= np.arange(1, GRADES + 1)
    share = np.where(grade > 0, toxic_share / max(1, (grade > 0).sum()), (1 - toxic_share) / max(1, (grade == 0).sum()))[:, None]
    seen_w, seen_s = np.full(d, 1e-8), np.full(GRADES, 1e-8)
    for _ in range(rounds):
        thresholds = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
        gap = share * (over - 1 / (1 + np.exp(np.clip(thresholds - (x @ weights)[:, None], -500, 500))))
        slope_w = x.T @ gap.sum(axis=1) - shrink * weights
        down = -np.cumsum(gap.sum(axis=0)[::-1])[::-1]
        slope_s = down * np.concatenate(([1.0], np.exp(steps[1:])))
        seen_w, seen_s = seen_w + slope_w**2, seen_s + slope_s**2
        weights, steps = weights + rate * slope_w / np.sqrt(seen_w), steps + rate * slope_s / np.sqrt(seen_s)
    return weights, np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch):
            names, values = [], []
            for share, own, got in text_features(some.column("text")):
                order = np.argsort(own, kind="stable")
                bounds = np.searchsorted(own[order], np.arange(len(share) + 1)).tolist()
                for each, a, b in zip(share.tolist(), bounds[:-1], bounds[1:], strict=True):
                    distinct, n = np.unique(got[order[a:b]], return_counts=True)
                    names.append(distinct.tobytes())
                    values.append((each * n).astype(np.float32).tobytes())
            yield pa.record_batch({"toxic": some.column("toxic"), "features": pa.array(names, pa.binary()), "shares": pa.array(values, pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        rows = [np.frombuffer(raw.as_py(), np.uint32) for raw in batch.column("features")]
        got = np.concatenate([*rows, np.zeros(0, np.uint32)])
        bad = np.repeat(toxic, [len(r) for r in rows])
        names, at = np.unique(got, return_inverse=True)
        yield pa.record_batch({"feature": pa.array(names.astype(np.int64)), "bad": pa.array(np.bincount(at, bad, len(names)).astype(np.int64)), "n": pa.array(np.bincount(at, minlength=len(names)).astype(np.int64))})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most").select("doc_id", "toxic")
    known = staged(known, "toxicity-labels")
    all_labels = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    # Twice `sample` rows at most.
    chosen = F.broadcast(staged(parts[0].union(parts[1]), "toxicity-sample"))
    rows = staged(texts_of(docs).join(chosen, "doc_id").select("text", "toxic").mapInArrow(_distinct, "toxic int, features binary, shares binary"), "toxicity-features", "zstd")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.full(GRADES, np.inf))
    counts = rows.mapInArrow(_counted, "feature long, bad long, n long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    # How far a feature's toxic documents outnumber what its documents would have by chance, in standard deviations.
    chance = F.col("n") * F.lit(size[1] / (size[0] + size[1]))
    telling = (F.col("bad") - chance) / F.sqrt(chance + 1)
    top = counts.where("bad >= 5").where(telling >= LEAST_TELLING).orderBy(telling.desc(), "feature").limit(KEPT).collect()
    names = np.array(sorted(r["feature"] for r in top), np.uint32)
    # The sample's rows over KEPT features: bounded by both parameters.
    held = rows.mapInArrow(_narrow(names), "toxic int, shares binary").collect()
    x = np.array([np.frombuffer(r["shares"], np.float32) for r in held], np.float64).reshape(len(held), len(names))
    toxic = np.array([r["toxic"] for r in held])
    hits = x.sum(axis=1)
    cuts = np.quantile(hits[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(x, grade, all_labels[1] / (all_labels[0] + all_labels[1]))
    return Model(names, weights, thresholds)


def _narrow(names: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for features, shares in zip(batch.column("features"), batch.column("shares"), strict=True):
                row, got = np.zeros(len(names), np.float32), np.frombuffer(features.as_py(), np.uint32)
                known = np.isin(got, names)
                row[np.searchsorted(names, got[known])] = np.frombuffer(shares.as_py(), np.float32)[known]
                cells.append(row.tobytes())
            yield pa.record_batch({"toxic": batch.column("toxic"), "shares": pa.array(cells, pa.binary())})

    return run


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (expected grade), grade (the largest k with P(grade >= k) >= 1/2) and toxic (grade > 0)."""
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                reach = model.reach(model.scores(some.column("text")))
                grade = (reach >= 0.5).sum(axis=1)
                extra = [pa.array(reach.sum(axis=1).round(6)), pa.array(grade, pa.int32()), pa.array((grade > 0).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], names=[*some.schema.names, "severity", "grade", "toxic"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "severity double, grade int, toxic int"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic for every document, by a model fitted on a sample of labels."""
    return graded(texts_of(docs), fit(docs, labels)).select("doc_id", "severity", "grade", "toxic")
