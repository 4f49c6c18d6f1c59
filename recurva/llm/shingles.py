"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text hashed at once; a longer text is a piece of its own.
PIECE = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers (shifts and odd multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd base's powers, and those of its inverse modulo 2**64."""
    if 0 not in _tables or len(_tables[0][0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _tables[0] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b))), dtype=np.uint64) for b in (_ODD, inverse))
    return _tables[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def word_spans(texts: pa.Array, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """(first text, bounds, starts, ends, hashed): word w of text first + i, bounds[i] <= w < bounds[i+1], lies from
    starts[w] to ends[w]; hashed(starts, ends) gives a 64-bit hash of any such stretches, A-Z lowered. Words are
    maximal runs without the bytes marked in `apart`. Null texts have none."""
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        raw = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        edge = np.ones(len(raw) + 1, bool)
        edge[:-1] = apart[raw]
        before = np.concatenate(([True], edge[:-1]))
        before[at] = True  # a word ends with its text
        starts = np.flatnonzero(~edge[:-1] & before[:-1])
        stop = edge.copy()
        stop[at] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, starts, "right")]
        power, inverse = _powers(max(len(raw), 1))
        total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)))

        def hashed(s: np.ndarray, e: np.ndarray, total: np.ndarray = total, inverse: np.ndarray = inverse) -> np.ndarray:
            return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD)

        yield i, np.searchsorted(starts, at), starts, ends, hashed
        i = j


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles of n words; fewer words make one shingle, none none."""
    for _, bounds, starts, ends, hashed in word_spans(texts):
        hashes = hashed(starts, ends)
        own = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            own = mix(own * _ODD + hashes[k : k + len(own)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(own[a : b - n + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    short = mix(short * _ODD + h)
                yield short
            else:
                yield np.zeros(0, np.uint64)
