"""Whole texts to token ids, a batch at a time, by the tokenizers library."""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Words whose ids a Python worker remembers between batches, and their letters; at a limit it keeps those that came again,
#: or none if they are more than half of it, so that memory stays bounded whatever the words are.
REMEMBERED, LETTERS = 350_000, 8_000_000
#: Letters of words without a usual form that are tokenized at once; a longer word alone.
AT_ONCE = 200_000
#: Words of plain letters that go through the tokenizer in one text.
TOGETHER = 300
#: Bytes of text (or other cells) worked on at once; a longer text is worked on alone.
SLICE = 3_000_000
#: Letters that stay single letters when lower-cased and in composed form, so that what follows cannot join them.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{410}-\x{44F}]+"

_loaded: dict[str, _Pieces] = {}


class _Pieces:
    """The ids of the words seen so far, back to back in one pool."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # every word comes once
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.final[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place, self.ends, self.pool, self.letters = {"": 0}, np.zeros(1, np.int32), np.zeros(0, "<u4"), 0
        self.again = np.ones(1, bool)  # whether a word has come again

    def forget(self) -> None:
        """Only the words that came again stay, if they are few enough to leave room."""
        words = [w for w, again in zip(self.place, self.again.tolist(), strict=True) if again]
        letters = sum(map(len, words))
        if 2 * len(words) > REMEMBERED or 2 * letters > LETTERS:
            return self.clear()
        lengths = np.diff(self.ends, prepend=np.int32(0))
        self.pool, lengths = _gathered(self.pool, (self.ends - lengths)[self.again], lengths[self.again])
        self.place, self.ends, self.letters = dict(zip(words, range(len(words)), strict=True)), np.cumsum(lengths, dtype=np.int32), letters
        self.again = np.zeros(len(words), bool)
        self.again[0] = True  # the empty one

    def of(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the pool's index; new ones are tokenized and added. The words are distinct."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if not new:
            self.again[at] = True
            return at
        added = [words[i] for i in new]
        letters = sum(map(len, added))
        self.again[at[at >= 0]] = True
        if len(self.place) > 1 and (len(self.place) + len(new) > REMEMBERED or self.letters + letters > LETTERS):
            before = len(self.place)
            self.forget()
            if 2 * len(self.place) > before:
                self.clear()
            return self.of(words)
        self.letters += letters
        at[new] = self._add(added)
        self.again = np.append(self.again, np.zeros(len(added), bool))
        return at

    def _add(self, words: list[str]) -> np.ndarray:
        """Tokenizes new words, and says where each stands."""
        alpha = np.fromiter(map(str.isalpha, words), bool, len(words))
        order = np.argsort(~alpha, kind="stable")
        at = np.empty(len(words), np.int32)
        at[order] = np.arange(len(self.place), len(self.place) + len(words))
        words = [words[i] for i in order.tolist()]
        plain, sizes, ids = int(alpha.sum()), [np.diff(self.ends, prepend=np.int32(0))], [self.pool]
        for begin in range(0, plain, TOGETHER):
            some = words[begin : min(plain, begin + TOGETHER)]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[got]) + 1
            if len(ends) != len(some) or ends[-1] != len(got):  # not one piece a word after all
                got, ends = self._each(some)
            sizes.append(np.diff(ends, prepend=0))
            ids.append(got)
        if plain < len(words):
            got, ends = self._each(words[plain:])
            sizes.append(np.diff(ends, prepend=0))
            ids.append(got)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.ends, self.pool = np.cumsum(np.concatenate(sizes), dtype=np.int32), np.concatenate(ids)
        return at

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got: list[np.ndarray] = []
        at, ends = 0, np.cumsum([len(w) for w in words])
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - len(words[at]) + AT_ONCE, "right")))
            got += (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words[at:to], add_special_tokens=False))
            at = to
        return np.concatenate(got), np.cumsum([len(ids) for ids in got])


def _split_tail(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of plain letters with ASCII punctuation after them, taken apart (the vocabulary does so too); others whole."""
    core = pc.ascii_rtrim(words, string.punctuation)
    plain = pc.match_substring_regex(core, _LETTERS + "$")
    whole = pc.if_else(plain, pc.ascii_lower(core), words)
    return whole, pc.if_else(plain, pc.replace_substring_regex(words, _LETTERS, ""), "")


def encode(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids): the ids of text i are ids[bounds[i]:bounds[i+1]], its end id last.

    The vocabulary drops white space and no piece crosses it, so a text's ids are those of its words in turn;
    a distinct word goes through the tokenizer once as long as it is remembered. A null text counts as empty."""
    if path not in _loaded:
        _loaded[path] = _Pieces(path)
    pieces = _loaded[path]
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten().dictionary_encode()
    at = words.indices.to_numpy(zero_copy_only=False)
    both = [x.dictionary_encode() for x in _split_tail(words.dictionary)]
    distinct = pa.concat_arrays([x.dictionary for x in both]).dictionary_encode()
    known = pieces.of(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())[distinct.indices.to_numpy(zero_copy_only=False)]
    head = known[: len(both[0].dictionary)][both[0].indices.to_numpy(zero_copy_only=False)]
    tail = known[len(both[0].dictionary) :][both[1].indices.to_numpy(zero_copy_only=False)]
    # The ids of this batch's distinct words, each with its tail, the end id last of all.
    lengths = np.diff(pieces.ends, prepend=np.int32(0))
    pool, sizes = _gathered(pieces.pool, (pieces.ends - lengths)[np.stack((head, tail), axis=1).ravel()], lengths[np.stack((head, tail), axis=1).ravel()])
    sizes = sizes.reshape(-1, 2).sum(axis=1, dtype=np.int32)
    edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    units = at
    if end_id is not None:
        pool, sizes = np.append(pool, np.uint32(end_id)), np.append(sizes, np.int32(1))
        units = np.insert(at, edges[1:], len(sizes) - 1)
        edges = edges + np.arange(len(edges))
    got, lengths = _gathered(pool, (np.cumsum(sizes, dtype=np.int32) - sizes)[units], sizes[units])
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return ends[edges], got


def _gathered(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the pool one after another, and their lengths; far fewer than 2**31 entries in all."""
    ends = np.cumsum(lengths, dtype=np.int32)
    at = np.repeat(begins - (ends - lengths), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return pool[at], lengths


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes of strings, a longer row alone: what is made from texts stays small."""
    sizes = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
