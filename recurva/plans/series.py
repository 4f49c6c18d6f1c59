"""Series as long tables (series_id, idx, value), their sliding windows and rolling statistics.

Rows without a series, an order or a value take no part, so idx counts the rest without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def indexed(table: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(series_id, idx, value): the rows of each series in order, from 0."""
    at = Window.partitionBy(table[series]).orderBy(*(table[c] for c in order))
    rows = table.where(table[series].isNotNull() & table[value].isNotNull() & ~F.isnan(table[value].cast("double")))
    return rows.select(rows[series].cast("long").alias("series_id"), (F.row_number().over(at) - 1).cast("long").alias("idx"), rows[value].cast("double").alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events in time."""
    return indexed(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "value")


def unpacked(table: DataFrame, series: str, values: str) -> DataFrame:
    """Series from arrays, an element a sample."""
    return table.select(table[series].cast("long").alias("series_id"), F.posexplode(table[values].cast("array<double>")).alias("idx", "value")).select("series_id", F.col("idx").cast("long").alias("idx"), "value")


def daily(table: DataFrame, at: str, value: Column) -> DataFrame:
    """One long series: sums by day, days without rows as 0. Only the daily sums meet in one partition."""
    by = table.groupBy(F.to_date(table[at]).alias("day")).agg(F.sum(value).alias("value")).where("day IS NOT NULL")
    ends = by.select(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    full = days.join(by, "day", "left").join(F.broadcast(ends.select(F.col("a").alias("first"))))  # one row
    return full.select(F.lit(0).cast("long").alias("series_id"), F.date_diff("day", "first").cast("long").alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value"))


def frame(m: int):
    """The m samples that begin here."""
    return Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, m - 1)


def windows(series: DataFrame, m: int) -> DataFrame:
    """(series_id, i, w): every full window of m samples."""
    w = F.collect_list("value").over(frame(m))
    return series.select("series_id", F.col("idx").alias("i"), w.alias("w")).where(F.size("w") == m)


def middle(xs: Column, m: int) -> Column:
    """The median of an array of m numbers."""
    ordered = F.array_sort(xs)
    return (F.get(ordered, F.lit((m - 1) // 2)) + F.get(ordered, F.lit(m // 2))) / 2


def rolling(series: DataFrame, m: int) -> DataFrame:
    """Each full window's mean, deviation (population), energy, slope and norm of what is left beside the trend."""
    own = frame(m)
    t_var = (m * m - 1) / 12
    out = series.select(
        "series_id",
        F.col("idx").alias("i"),
        F.count("value").over(own).alias("n"),
        F.avg("value").over(own).alias("mean"),
        F.stddev_pop("value").over(own).alias("std"),
        F.sum(F.col("value") * F.col("value")).over(own).alias("energy"),
        F.regr_slope("value", "idx").over(own).alias("slope"),
    ).where(F.col("n") == m)
    left = F.greatest(F.lit(0.0), F.col("std") * F.col("std") - F.col("slope") * F.col("slope") * t_var)
    return out.drop("n").withColumn("detrended_norm", F.sqrt(m * left))


def robust(series: DataFrame, m: int) -> DataFrame:
    """Each full window's median and median absolute deviation."""
    out = windows(series, m).withColumn("median", middle(F.col("w"), m))
    return out.select("series_id", "i", "median", middle(F.transform("w", lambda x: F.abs(x - F.col("median"))), m).alias("mad"))


def packed(series: DataFrame, *extra: Column) -> DataFrame:
    """(series_id, xs): one row a series, its samples in order."""
    return series.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("xs"), *extra)
