"""A training-data pipeline over documents. Each stage is one operator; all but the last return documents.

Every stage takes any documents: null or empty texts and null ids are kept unless a docstring says otherwise, extra columns
are left behind, an empty table gives an empty one, and very long texts are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurva.llm import mixing, ngram_join, packing, secrets, toxicity
from recurva.llm.common import staged
from recurva.llm.queries import _vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are copies from this share of common shingles of so many words; op9's query has limits of its own.
SIMILAR_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is 0. Rows are judged one by one, equal ones alike; those without text stay."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.graded(docs, model).where("toxic = 0").select(COLUMNS)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one: the smallest doc_id's, one without an id only if none has one. Rows are
    told apart by a number of their own, as ids may be null or repeated. Texts without words are no copies of others,
    but rows that are equal, id and all, stay once."""
    # Written once, so that every later read of a row has the same number.
    rows = staged(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows", "zstd")
    groups = ngram_join.similar_groups(rows.select(F.col("row").alias("doc_id"), "text"), n=SIMILAR_WORDS, percent=SIMILAR_PERCENT)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "row")
    repeated = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash")))
    own = rows.join(groups.select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "row")
    own = own.select("row", order.alias("order"), repeated.alias("repeated"), F.when(repeated.isNull(), F.col("component_id")).alias("component_id"))
    first = own.groupBy("component_id", "repeated").agg(F.min_by("row", "order").alias("row"))
    return rows.join(staged(first.select("row"), "pipeline-first"), "row", "left_semi").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, overlapping ones by one; a null text stays null, repeated
    rows stay, n_chars follows a changed text."""
    docs = docs.select(COLUMNS)
    _, found = secrets.findings(docs)
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    out = docs.withColumn("sha", sha).join(found, "sha", "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(secrets.masked(F.col("text"), F.col("cover")))
    n_chars = F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, none if never; documents without words stay once. Rows that agree
    in id, size and source take their copies in the order of a hash of their texts; a null source is one of its own."""
    docs = docs.select(COLUMNS)
    same = ["doc_id", "size", "source"]
    copies = mixing.mix(docs).groupBy(*same).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    sized = docs.withColumn("size", mixing.size_of(docs["text"]))
    both = sized.join(staged(copies, "pipeline-copies").select(*(F.col(c).alias(f"own_{c}") for c in same), "copies", "rows"), F.expr(" AND ".join(f"{c} <=> own_{c}" for c in same)))
    order = Window.partitionBy(*same).orderBy(F.xxhash64("text"))
    alone = both.where("rows = 1").withColumn("n", F.col("copies"))
    # Rows that agree in id, source and size share their copies evenly, the first ones taking the rest.
    shared = both.where("rows > 1").withColumn("n", F.floor(F.col("copies") / F.col("rows")) + (F.row_number().over(order) <= F.col("copies") % F.col("rows")).cast("long"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("n")).cast("int")
    return alone.unionByName(shared).select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full windows, with their ids; a null text is empty, repeated rows are documents of their own."""
    return packing.pack(docs, _vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_similar),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack),
]
#: SQL can express neither the ordinal model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"pipeline-{name}")
    return docs
