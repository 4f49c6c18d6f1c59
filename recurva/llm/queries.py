"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm import secrets

    spans = secrets.joined(F.col("found"))
    counts = [_of_kind("found", i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)]
    return secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op3_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.topk import impact_top_k

    return impact_top_k(_table(spark, sf_dir, "embeddings"))


def op4_int8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.mixing import mix

    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken)


def op6_ids_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.ids_file import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.ngram_join import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm import pii

    counts = [_of_kind("base", i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.best_fit import best_fit

    pieces = best_fit(_table(spark, sf_dir, "documents"), _vocabulary())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm.lexical_search import lexical_search

    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recurva.llm import spelling

    return spelling.variants(spelling.words_of(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_impact_top_k": op3_impact_top_k,
    "op4_int8_neighbours": op4_int8_neighbours,
    "op5_source_mix": op5_source_mix,
    "op6_ids_file": op6_ids_file,
    "op7_toxicity": op7_toxicity,
    "op8_main_text": op8_main_text,
    "op9_ngram_join": op9_ngram_join,
    "op10_personal_data": op10_personal_data,
    "op11_best_fit": op11_best_fit,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": oracles.SECRETS,
    "op3_impact_top_k": oracles.TOP_K,
    "op4_int8_neighbours": oracles.NEAREST,
    "op9_ngram_join": oracles.GROUPS,
    "op12_lexical_search": oracles.SEARCH,
    "op13_spelling": oracles.SPELLING,
}
