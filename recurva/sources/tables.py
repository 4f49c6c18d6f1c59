"""Reading series and configurations, writing scores."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "metric string, score double, algorithm string, config_idx int, execution_time double, signal_idx int, n_patterns int, predicted_n_patterns int"


def series_files(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(series_id, idx, value) from parquet, csv or json files with those columns."""
    return spark.read.schema("series_id long, idx long, value double").format(kind).option("header", "true").load(path)


def configs(spark: SparkSession, path: str) -> DataFrame:
    """(algorithm, config_idx, params) from JSON files whose values are JSON texts of lists of objects."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("algorithm", "list"))
    each = raw.select("algorithm", F.posexplode(F.from_json("list", "array<map<string,string>>")).alias("config_idx", "params"))
    return each


def grid(spark: SparkSession, **lists: list) -> DataFrame:
    """A row per combination of the lists' values."""
    out = spark.range(1).select()
    for name, values in lists.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def swept(configs: DataFrame, name: str, values: list) -> DataFrame:
    """Every configuration once for each value of one parameter, numbered anew: those of one configuration in a row."""
    each = configs.select("algorithm", "config_idx", "params", F.posexplode(F.array(*(F.lit(json.dumps(v)) for v in values))).alias("at", "value"))
    params = F.map_concat(F.map_filter("params", lambda k, _: k != name), F.create_map(F.lit(name), F.col("value")))
    return each.select("algorithm", (F.col("config_idx") * len(values) + F.col("at")).alias("config_idx"), params.alias("params"))


def read_results(spark: SparkSession, folder: str, suffix: str = "_0.csv") -> DataFrame:
    """The score rows of all CSV files of a folder whose names end so, columns by their names in the header, with
    `source`, the rest of the file's name."""
    raw = spark.read.option("header", "true").option("pathGlobFilter", f"*{suffix}").csv(folder)
    source = F.regexp_extract("_metadata.file_name", f"^(.*){re.escape(suffix)}$", 1).alias("source")
    return raw.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCORES.split(", ")), source)


def append_scores(scores: DataFrame, path: str) -> None:
    """Add rows to a score table, a folder per algorithm; nothing written before is written again."""
    scores.write.mode("append").partitionBy("algorithm").parquet(path)


def read_scores(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(SCORES).format(kind).option("header", "true").load(path)
