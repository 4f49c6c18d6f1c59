"""Best-fit packing, ranked search and spelling variants against plain definitions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from recurva.llm import best_fit, lexical_search, queries, spelling
from tests.llm import brute
from tests.llm.test_texts import VOCABULARY, docs, odd, real, rows_of, same  # noqa: F401


def test_plan_is_best_fit_decreasing():
    draw = random.Random(1)
    for window in (1, 2, 7, 16, 100):
        for _ in range(60):
            lengths = [draw.choice((draw.randint(1, window), max(1, window // 3))) for _ in range(draw.randrange(0, 80))]
            counts = Counter(lengths)
            rows = best_fit.plan(counts, window).tolist()
            fills = defaultdict(list)
            for length, n in counts.items():
                own = [r for r in rows if r[0] == length]
                for rank in range(n):
                    _, since, first, each, offset = max(r for r in own if r[1] <= rank)
                    fills[first + (rank - since) // each].append((offset + (rank - since) % each * length, length))
            for pieces in fills.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
            assert sorted(sum(n for _, n in p) for p in fills.values()) == brute.best_fit_decreasing(lengths, window)


def test_tightest_room():
    draw = random.Random(2)
    rooms, held = best_fit.Rooms(50), Counter()
    for _ in range(2_000):
        length = draw.randint(1, 50)
        want = min((r for r, n in held.items() if n and r >= length), default=None)
        assert rooms.tightest(length) == want
        if want is not None and draw.random() < 0.6:
            rooms.take(want)
            held[want] -= 1
        room = draw.randint(1, 50)
        rooms.add(room, 0, 1)
        held[room] += 1


@pytest.mark.parametrize("window", [64, 4096])
def test_best_fit(docs, window):  # noqa: F811
    texts = rows_of(docs)
    known = defaultdict(list)
    want, whole = Counter(), []
    for (doc_id, _), ids in zip(texts, brute.ids_of([t for _, t in texts], VOCABULARY)):
        known[doc_id].append(ids)
        for piece, at in enumerate(range(0, len(ids), window)):
            want[doc_id, piece, at, tuple(ids[at : at + window])] += 1
            whole.append(len(ids[at : at + window]))
    rows = best_fit.best_fit(docs, VOCABULARY, window).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(memoryview(r["ids"]).cast("I"))) for r in rows) == want
    fills = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in fills.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
    assert sorted(sum(n for _, n in own) for own in fills.values()) == brute.best_fit_decreasing(whole, window)


def test_best_fit_query(spark, sf_dir):
    texts = dict(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ids = dict(zip(texts, brute.ids_of(texts.values(), VOCABULARY)))
    for r in queries.op11_best_fit(spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        assert r["start"] == 4096 * r["piece"] and r["length"] == min(4096, len(own) - r["start"])
        assert r["ids_crc32"] == brute.crc(own[r["start"] : r["start"] + r["length"]])


ITEMS = [(1, "one two word1 word2 MORE"), (1, "one two word1 word2 MORE"), (2, None), (3, ""), (4, "zzzz ¤ unknown"), (None, "x 1 漢字 naïve"), (5, "one one one É é"), (6, "word7 " * 3_000), (7, "..,;!")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "d", 1, 2) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int, score int").repartition(2)


def test_ranked_search(docs, items, monkeypatch):  # noqa: F811
    want = brute.ranked_search(rows_of(docs), ITEMS)
    same(lexical_search.lexical_search(docs, items).collect(), want)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 3)  # several blocks of items, small blocks of documents and groups of tasks
    monkeypatch.setattr(lexical_search, "DOC_BLOCK", 4)
    monkeypatch.setattr(lexical_search, "TASKS", 1)
    same(lexical_search.lexical_search(docs, items).collect(), want)
    assert lexical_search.lexical_search(docs, items.limit(0)).collect() == []


def test_equal_scores_go_by_id(spark):
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (None, "same other")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(9, "words")], "item_id long, text string")
    got = lexical_search.lexical_search(table, asked, k=45).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [*range(1, 41), None]


def test_near_words_against_all_pairs(spark, monkeypatch):
    draw = random.Random(4)
    letters = "abcdeñé"
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(120)]
    n = {}
    for w in base:
        n[w] = draw.choice((5, 30, 200, 1_000, 9_000))
        for _ in range(6):
            v, at = list(w), draw.randrange(len(w))
            kind = draw.randrange(3)
            v[at : at + (kind > 0)] = "" if kind == 2 else draw.choice(letters)
            n["".join(v)] = draw.choice((1, 5, 6, 40))
    n |= {"x" * 3_000: 7, "x" * 2_999: 40, "x" * 2_998 + "y": 7, "": 3, "😀a": 5, "😀b": 50}
    table = spark.createDataFrame([(w, k, "f", 1) for w, k in n.items()] + [(None, 9, "f", 1)], "word string, n long, form string, near int").repartition(3)
    want = brute.variants(n)
    same(spelling.variants(table).collect(), want)
    monkeypatch.setattr(spelling, "CHUNK", 20)  # most band values are cut into tiles
    monkeypatch.setattr(spelling, "HELD", 64)
    same(spelling.variants(table).collect(), want)
    split = table.selectExpr("word", "n - 1 AS n").union(table.selectExpr("word", "1L AS n"))
    same(spelling.variants(split).collect(), want)
    assert spelling.variants(table.limit(0)).collect() == []


def test_more_letters_than_bits(spark):
    words = [chr(0x4E00 + i) + chr(0x4E00 + (7 * i) % 200) + chr(0x4E00 + (i * i) % 200) for i in range(200)]
    n = {w: 5 + i % 90 for i, w in enumerate(words)}
    same(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect(), brute.variants(n))


def test_words_of_texts(docs):  # noqa: F811
    same(spelling.words_of(docs).collect(), brute.spelled_words(rows_of(docs)).items())


def test_spelling_query(spark, sf_dir):
    want = brute.variants(brute.spelled_words(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    same(queries.op13_spelling(spark, sf_dir).collect(), want)
