"""Motif searches over a grid of configurations as a table of work: an item is a series under a configuration.

A path holds `items`, the finished ones with their errors, and `scores`, the score rows of each unit of work: some series
under one configuration. A unit's scores are written first, then its items; scores whose unit no item names do not
count. So a run that broke off goes on where it stopped, and a finished one computes nothing. Units of different
configurations run side by side. A unit that fails is halved until the series that fail stand alone; only those
lose their rows. Series are dealt out by a hash, their ids never reach the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.operators import metrics
from recurva.plans.store import found_at, stored
from recurva.sources.tables import SCORES

ITEMS = "algorithm string, config_idx int, signal_idx long, unit string, error string"
UNIT_SCORES = f"{SCORES}, unit string"


def value_of(text: str | None) -> object:
    """A parameter's value: what the text says in JSON, else the text itself."""
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


def run(series: DataFrame, truth: DataFrame, searches: dict[str, Callable[..., DataFrame]], configs: DataFrame, path: str, thresholds: list[float] | None = None, of: Callable[[str], object] = value_of, batch: int = 10_000, beside: int = 4, counted: str = "n") -> DataFrame:
    """Run every configuration (algorithm, config_idx, params) over all series that path has no item of, and return all
    items that failed (ITEMS). A search gets series and its parameters, texts turned into values by `of`; a whole number
    under `counted` is replaced by the number of the series' true labels, so that series with equal numbers go
    together. A unit has about `batch` series, `beside` units run at a time. execution_time is the seconds of a unit's
    search, scoring left out, shared evenly by its series. The grid is a short list; the series are as long as they are.
    A search that raises before any job runs fails for all its series at once."""
    spark = series.sparkSession
    ids = series.select("series_id").distinct()
    counts = truth.groupBy("series_id").agg(F.countDistinct("label").cast("int").alias("true_n"))
    known = stored(ids.join(counts, "series_id", "left").fillna(0, ["true_n"]))
    grid = configs.orderBy("algorithm", "config_idx").collect()

    def work(c) -> None:
        params = {k: of(v) for k, v in c["params"].items()}
        due = known
        done = found_at(spark, f"{path}/items", ITEMS)
        if done is not None:
            mine = done.where((F.col("algorithm") == c["algorithm"]) & (F.col("config_idx") == c["config_idx"]))
            due = known.join(mine.select(F.col("signal_idx").alias("series_id")).distinct(), "series_id", "left_anti")
        by_count = type(params.get(counted)) is int
        due = due if by_count else due.withColumn("true_n", F.lit(0))
        # As many rows as there are different numbers of labels.
        for r in due.groupBy("true_n").agg(F.count("*").alias("series")).orderBy("true_n").collect():
            own = params | {counted: r["true_n"]} if by_count else params
            ways = max(1, -(-r["series"] // batch))
            for k in range(ways):
                unit(c, own, due.where(F.col("true_n") == r["true_n"]).select("series_id"), ways, k)

    def unit(c, params: dict[str, object], due: DataFrame, ways: int, rest: int) -> None:
        """The series of due whose hash leaves this rest."""
        own = due.where(F.pmod(F.xxhash64("series_id"), F.lit(ways)) == rest)
        name = f"u{uuid.uuid4().hex}"
        found = None
        try:
            began = time.time()
            mine = series.join(own, "series_id", "left_semi")
            if own.isEmpty():
                return
            found = searches[c["algorithm"]](mine, **params).select("series_id", "label", "start", "end").persist()
            found.count()
            took = (time.time() - began) / own.count()
            rows = scored(mine, truth.join(own, "series_id", "left_semi"), found, c["algorithm"], c["config_idx"], took, thresholds)
            rows.write.mode("overwrite").parquet(f"{path}/scores/unit={name}")  # units beside one another share no folder
            finished(c, own, name, None)
        except Exception as e:  # one bad item must not end the others
            halves = isinstance(e, (PySparkException, Py4JError)) and not isinstance(e, AnalysisException) and len(own.take(2)) == 2
            if halves:
                for half in (rest, rest + ways):
                    unit(c, params, due, 2 * ways, half)
            else:
                finished(c, own, name, f"{type(e).__name__}: {e}"[:1000])
        finally:
            if found is not None:
                found.unpersist()

    def finished(c, own: DataFrame, name: str, error: str | None) -> None:
        rows = own.select(F.lit(c["algorithm"]).alias("algorithm"), F.lit(c["config_idx"]).alias("config_idx"), F.col("series_id").alias("signal_idx"), F.lit(error).cast("string").alias("error"))
        rows.write.mode("overwrite").parquet(f"{path}/items/unit={name}")

    with ThreadPoolExecutor(beside) as pool:
        for ended in [pool.submit(work, c) for c in grid]:
            ended.result()
    done = found_at(spark, f"{path}/items", ITEMS)
    return (done if done is not None else spark.createDataFrame([], ITEMS)).where("error IS NOT NULL")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """The score rows of finished units."""
    rows, items = found_at(spark, f"{path}/scores", UNIT_SCORES), found_at(spark, f"{path}/items", ITEMS)
    if rows is None or items is None:
        return spark.createDataFrame([], SCORES)
    return rows.join(items.select("unit").distinct(), "unit", "left_semi").drop("unit")


def scored(series: DataFrame, truth: DataFrame, found: DataFrame, algorithm: str, config_idx: int, took: float, thresholds: list[float] | None = None) -> DataFrame:
    """Score rows of one run: every metric of every series, with the true and the predicted number of motifs."""
    counts = [t.groupBy("series_id").agg(F.countDistinct("label").cast("int").alias(c)) for t, c in ((truth, "n_patterns"), (found, "predicted_n_patterns"))]
    rows = metrics.battery(truth, found, series, thresholds).join(counts[0], "series_id", "left").join(counts[1], "series_id", "left").fillna(0, ["n_patterns", "predicted_n_patterns"])
    own = {"algorithm": F.lit(algorithm), "config_idx": F.lit(config_idx), "execution_time": F.lit(took), "signal_idx": F.col("series_id")}
    return rows.withColumns(own).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCORES.split(", ")))
