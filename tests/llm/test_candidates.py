"""What meets in the lists of the similarity join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from recurva.llm import ngram_join


def test_large_sets_with_little_in_common_do_not_meet():
    draw = np.random.default_rng(5)
    for n in (200, 600, 1100, 3000, 9000):
        sets = [draw.integers(0, 2**63, n).astype(np.uint64) for _ in range(8)]
        near = sets[0].copy()
        near[: n // 50] = draw.integers(0, 2**63, n // 50).astype(np.uint64)
        sets += [near, np.append(sets[1], draw.integers(0, 2**63, n // 20).astype(np.uint64))]
        ids = list(range(len(sets)))
        rows = {"list": [1] * 10, "i": [0] * 10, "j": [0] * 10, "sid": ids, "n": [len(s) for s in sets], "brief": [ngram_join.brief(s) for s in sets], "label": ids, "block": [0] * 10}
        got = [(a, b) for batch in ngram_join._met(90, True)([pa.record_batch(rows)]) for a, b in zip(*batch.to_pydict().values())]
        assert got == [(0, 8), (1, 9)]


def test_lists_with_the_same_members_are_one():
    keys = [3, 3, 5, 5, 7, 7, 9]
    rows = {"key": keys, "sid": [1, 2, 1, 2, 1, 4, 1], "n": pa.array([20] * 7, pa.int32()), "salts": pa.array([1] * 7, pa.int32()), "salt": pa.array([0] * 7, pa.int32())}
    got = [row for batch in ngram_join._runs(90)([pa.record_batch(rows)]) for row in zip(*batch.to_pydict().values())]
    assert len(got) == 6 and len(set(got)) == 4


def lists_of(sets: list[np.ndarray], percent: int, lists: int) -> pa.RecordBatch:
    """All sets in each of so many lists."""
    ids = list(range(len(sets)))
    rows = {"list": np.repeat(np.arange(lists), len(sets)), "i": [0] * len(sets) * lists, "j": [0] * len(sets) * lists}
    own = {"sid": ids, "n": [len(s) for s in sets], "brief": [ngram_join.brief(s, percent) for s in sets], "label": ids, "block": [0] * len(sets)}
    return pa.record_batch(rows | {k: list(x) * lists for k, x in own.items()})


def test_brief_bitmaps_tell_sets_apart_at_lower_limits():
    draw = np.random.default_rng(6)
    for percent in (60, 80, 90):
        for n in (100, 900, 4000):
            sets = [draw.integers(0, 2**63, n).astype(np.uint64) for _ in range(6)]
            sets.append(np.append(sets[2][n // 50 :], draw.integers(0, 2**63, n // 50).astype(np.uint64)))
            got = [pair for batch in ngram_join._met(percent, True)([lists_of(sets, percent, 1)]) for pair in zip(*batch.to_pydict().values())]
            assert got == [(2, 6)], (percent, n)


def test_pairs_of_many_lists_are_made_once():
    base = np.random.default_rng(7).integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.append(base[2 * k :], np.arange(2 * k).astype(np.uint64)) for k in range(5)]
    table = lists_of(sets, 80, 40)
    for made in (ngram_join._met(80, True)([table]), ngram_join._stars(80)([table.select(["list", "sid", "n"])])):
        got = [pair for batch in made for pair in zip(*batch.to_pydict().values())]
        assert got and len(got) == len(set(got))


def test_lists_with_nearly_the_same_members_have_one_hub():
    keys = [k for k in range(30) for _ in range(8)]
    sids = [s for k in range(30) for s in range(9) if s != k % 9]
    rows = {"key": keys, "sid": sids, "n": pa.array([20] * 240, pa.int32()), "salts": pa.array([1] * 240, pa.int32()), "salt": pa.array([0] * 240, pa.int32())}
    got = [dict(zip(batch.schema.names, row)) for batch in ngram_join._runs(90)([pa.record_batch(rows)]) for row in zip(*batch.to_pydict().values())]
    assert len({r["list"] for r in got}) == 9 and len({r["hub"] for r in got}) == 2


def test_words_that_come_again_are_tokenized_once(monkeypatch):
    from recurva.llm import tokens
    from recurva.llm.queries import _vocabulary

    draw = np.random.default_rng(9)
    often = ["".join(draw.choice(list("abcdefghij"), 9)) for _ in range(40)]
    texts = [" ".join(often + ["".join(draw.choice(list("klmnopqrst"), 9)) for _ in range(60)]) for _ in range(30)]
    whole = tokens.encode(pa.array(texts), _vocabulary())
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    monkeypatch.setattr(tokens, "_loaded", {_vocabulary(): (pieces := tokens._Pieces(_vocabulary()))})
    added: list[str] = []
    monkeypatch.setattr(pieces, "_add", lambda words, add=pieces._add: (added.extend(words), add(words)))
    parts = [tokens.encode(pa.array([text]), _vocabulary()) for text in texts]
    assert np.array_equal(np.concatenate([ids for _, ids in parts]), whole[1])
    assert len(pieces.place) == len(pieces.again) == len(pieces.ends) <= 200 and all(added.count(w) == 1 for w in often)
