"""Stages of the pipeline on small tables."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute

WORDS = [f"w{i}" for i in range(100)]


def test_drop_similar_goes_by_rows(spark):
    def text(mark, *changed):
        return " ".join(f"{mark}{'z' * (i in changed)}{w}" for i, w in enumerate(WORDS))

    rows = [
        (1, text("a")), (2, text("a", 50)), (3, text("a", 30, 60)),  # a few words changed: copies at five words and 0.8
        (4, text("b")), (4, text("c")),  # different texts of one id
        (None, text("d")), (None, text("d")), (None, text("e")), (9, text("e", 99)), (None, text("f")),
        (10, text("g")), (10, text("g")), (11, ""), (11, ""), (12, ""), (None, None), (None, ""),
    ]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_similar(spark, table.repartition(4), "")
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, text("a")), (4, text("b")), (4, text("c")), (None, text("d")), (9, text("e", 99)), (None, text("f")), (10, text("g")), (11, ""), (12, ""), (None, None), (None, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.drop_similar(spark, table.limit(0), "").collect() == []


def test_stages_of_the_pipeline(spark, sf_dir):
    """Each stage on what the one before kept: which rows stay, and what becomes of them."""
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "secret_scan", "source_mix", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    tame = [i for i, toxic in labels.items() if toxic == 0]
    assert clean.columns == corpus_pipeline.COLUMNS and sum(i in kept for i in tame) >= 0.95 * len(tame)
    single = corpus_pipeline.drop_similar(spark, clean, sf_dir)
    groups = brute.groups([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, n, least in groups if not n or i == least)
    masked = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, single, sf_dir).collect()}
    for r in single.collect():
        text, at = "", 0
        for a, _, b in sorted(brute.secret_spans(r["text"])):
            text, at = (text + (r["text"] or "")[at:a] + "[SECRET]", b) if a >= at else (text, max(at, b))
        assert (masked[r["doc_id"]]["text"] or "") == text + (r["text"] or "")[at:]
    mixed = corpus_pipeline.mix_sources(spark, single, sf_dir)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == corpus_pipeline.COLUMNS and max(times.values()) <= 2
    pieces = corpus_pipeline.pack(spark, mixed, sf_dir)
    assert pieces.selectExpr("sum(length)").first()[0] == mixed.count() + sum(len(ids) - 1 for ids in brute.ids_of([r["text"] for r in mixed.collect()], corpus_pipeline._vocabulary()))


def test_odd_rows_through_every_stage(spark, sf_dir):
    """Null, empty and repeated rows, extra columns and empty tables: what each stage makes of them."""
    rows = [(1, None, None, None, None, 5), (2, "", "en", "a", 0, 5), (3, "one two three", "en", None, 13, 5), (3, "one two three", "en", None, 13, 5), (None, "four five", "en", "a", 9, 5), (4, "secret=abcdefgh1 x", "en", "a", 18, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int").repartition(3)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_similar, corpus_pipeline.mask_secrets, corpus_pipeline.mix_sources):
        got = stage(spark, table, sf_dir)
        assert got.columns == corpus_pipeline.COLUMNS and stage(spark, table.limit(0), sf_dir).collect() == []
        kept = {(r["doc_id"], r["text"]) for r in got.collect()}
        want = {(r[0], "[SECRET] x" if stage is corpus_pipeline.mask_secrets and r[0] == 4 else r[1]) for r in rows}
        assert kept <= want if stage is corpus_pipeline.mix_sources else kept == want
    assert corpus_pipeline.pack(spark, table.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.pack(spark, table, sf_dir).selectExpr("sum(length)").first()[0] == sum(len(i) for i in brute.ids_of([r[1] for r in rows], corpus_pipeline._vocabulary()))
