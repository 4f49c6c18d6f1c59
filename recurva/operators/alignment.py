"""Lags between series by overlap-normalised cross-correlation, and means of aligned series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lags, overlaps, correlations) of x[i + lag] with y[i] for all lags with so much overlap and spread on both sides:
    products of all lags by one transform, means and deviations of what overlaps by running sums."""
    least = max(least, 1)
    lags = np.arange(-(len(y) - 1), len(x))
    n = np.minimum(len(x), lags + len(y)) - np.maximum(0, lags)
    keep = n >= least
    if not keep.any():
        return lags[:0], n[:0], np.zeros(0)
    x, y = x - x.mean(), y - y.mean()
    size = 1 << (len(x) + len(y) - 1).bit_length()
    products = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[: len(x) + len(y) - 1]
    lags, n, products = lags[keep], n[keep], products[keep]
    sums = []
    for own, begin in ((x, np.maximum(0, lags)), (y, np.maximum(0, -lags))):
        first, second = (np.concatenate(([0.0], np.cumsum(own**k))) for k in (1, 2))
        total, squares = first[begin + n] - first[begin], second[begin + n] - second[begin]
        sums.append((total, squares - total**2 / n, second[-1]))
    (sx, vx, all_x), (sy, vy, all_y) = sums
    spread = (vx > 1e-12 * all_x) & (vy > 1e-12 * all_y)
    corr = (products - sx * sy / n)[spread] / np.sqrt(vx[spread] * vy[spread])
    return lags[spread], n[spread], corr


def lag_correlation(a: DataFrame, b: DataFrame, least: int, which: str = "true") -> DataFrame:
    """(a_id, b_id, lag, corr, n): correlation of a's sample idx + lag with b's sample idx, for lags whose overlap n is
    at least `least`. a and b: (series_id, idx, value), joined by a key column `pair`, for the a_id and b_id that `which`
    says. A task holds the two series of a pair; its time grows with their length and its logarithm."""
    sides = [t.groupBy("pair", F.col("series_id").alias(name)).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias(xs)) for t, name, xs in ((a, "a_id", "xs"), (b, "b_id", "ys"))]
    both = sides[0].join(sides[1], "pair").where(which).select("a_id", "b_id", "xs", "ys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lags, n, corr = correlations(*(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("xs", "ys")), least)
                ids = {c: pa.array(np.full(len(lags), batch.column(c)[k].as_py(), np.int64)) for c in ("a_id", "b_id")}
                yield pa.record_batch(ids | {"lag": pa.array(lags.astype(np.int64)), "n": pa.array(n.astype(np.int64)), "corr": pa.array(np.round(corr, 6))})

    return both.mapInArrow(run, "a_id long, b_id long, lag long, n long, corr double")


def best_lag(correlations: DataFrame) -> DataFrame:
    """(a_id, b_id, lag, corr): the lag of the largest correlation, ties to the smallest lag."""
    best = correlations.groupBy("a_id", "b_id").agg(F.max(F.struct("corr", -F.col("lag"))).alias("b"))
    return best.select("a_id", "b_id", (-F.col("b.col2")).alias("lag"), F.col("b.corr").alias("corr"))


def lag_matrix(series: DataFrame, least: int) -> DataFrame:
    """(pair, a_id, b_id, lag): the best lag of every two series of one `pair`, and its negative the other way round."""
    best = best_lag(lag_correlation(series, series, least, "a_id < b_id"))
    both = best.select("a_id", "b_id", "lag").union(best.select("b_id", "a_id", -F.col("lag")))
    return series.select("pair", F.col("series_id").alias("a_id")).distinct().join(both, "a_id").select("pair", "a_id", "b_id", "lag")


def relative_lags(matrix: DataFrame) -> DataFrame:
    """(pair, series_id, lag): lags to the series of each `pair` whose absolute lags have the least sum, ties to the
    smallest id, that series itself at 0."""
    cost = matrix.groupBy("pair", "a_id").agg(F.sum(F.abs("lag")).alias("cost"))
    centre = cost.groupBy("pair").agg(F.min(F.struct("cost", "a_id"))["a_id"].alias("a_id"))
    return matrix.join(centre, ["pair", "a_id"]).select("pair", F.col("b_id").alias("series_id"), "lag").union(centre.select("pair", "a_id", F.lit(0).cast("long")))


def aligned_mean(series: DataFrame, lags: DataFrame) -> DataFrame:
    """(pair, at, mean): the series of each `pair` shifted by their lags, averaged over all of them; where one has no
    sample it counts as 0."""
    n = lags.groupBy("pair").agg(F.count("*").alias("n"))
    moved = series.select("series_id", "idx", "value").join(lags, "series_id").groupBy("pair", (F.col("idx") + F.col("lag")).alias("at")).agg(F.sum("value").alias("total"))
    return moved.join(n, "pair").select("pair", "at", (F.col("total") / F.col("n")).alias("mean"))


def medoid(lags: DataFrame) -> DataFrame:
    """(series_id, cost): the series with the least sum of absolute lags, ties to the smallest id."""
    both = lags.select(F.col("a_id").alias("series_id"), "lag").unionByName(lags.select(F.col("b_id").alias("series_id"), "lag"))
    cost = both.groupBy("series_id").agg(F.sum(F.abs("lag")).alias("cost"))
    return cost.agg(F.min(F.struct("cost", "series_id")).alias("m")).select("m.series_id", "m.cost").where("series_id IS NOT NULL")


def barycenter(found: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, label, at, mean): samples of a label's occurrences by place, over all of them; where an occurrence is
    shorter it counts as 0."""
    n = Window.partitionBy("series_id", "label")
    rows = found.withColumn("n", F.count("*").over(n)).select("series_id", "label", "n", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx"))
    values = rows.join(series, ["series_id", "idx"]).groupBy("series_id", "label", (F.col("idx") - F.col("start")).alias("at"), "n").agg(F.sum("value").alias("total"))
    return values.select("series_id", "label", "at", F.round(F.col("total") / F.col("n"), 6).alias("mean"))
