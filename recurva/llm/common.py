"""Helpers that several operators share: column access, the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may leave it unset: then a temporary one, set from then on."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="recurva-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, because what came from them is a staged table itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as empty; other columns, whatever their names, are left behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable, by alternating
    large-star and small-star rounds. Every round is one grouped minimum and one join, and a table in the
    shared folder ends it; a round never lengthens a node's list beyond the edges it had. Null ends and
    loops are left out; an empty input gives an empty table."""
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    pairs, before = staged(pairs.where("lo < hi").distinct(), name), None
    while True:
        both = pairs.union(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = staged(large.where("lo < hi").distinct(), name)
        discard(pairs)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = staged(moved.union(least.select("m", "hi")).where("lo < hi").distinct(), name)
        discard(large)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            roots = small.select(F.col("lo").alias("node")).distinct()
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        pairs, before = small, now
