"""Personal data by a semi-Markov conditional random field over candidate segments.

Base spans come from fixed rules and always stay. Wider patterns propose further segments; whole-span features
(checksum, digits, separators, what stands beside them, words before them) score each as a type, and a dynamic
programme over a region's segments chooses boundaries and types jointly. Weights are learned by maximum likelihood
from the base spans of a bounded sample of documents; their regions become features on the executors, so only
numbers reach the driver.

Defined results: a null text is empty; null doc_ids and repeated rows are kept, one result row each; very long texts
are read whole, in time proportional to their length; of choices with equal scores the one with fewer, earlier
segments counts; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import staged, texts_of
from recurva.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents whose regions train the field, at most, and those regions, at most.
TRAIN_DOCS, TRAIN_REGIONS = 2_000, 10_000

# The base rules. Emails are found from their @, and no address begins inside a run of digits, so long
# runs cost no more than their length.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider forms that base rules miss.
_WIDER = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[./_ ]){3}[0-9]{4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00[1-9][0-9]{0,2}|\([0-9]{2,4}\))[\x20.-]?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])"),
}
_AT = re.compile(r"[\[(]at[\])]")
#: What a wider email spans at most before and after its (at).
_REACH = (66, 420)
_NOT_DIGITS = re.compile(r"[^0-9]+")
_HINTS = {
    "email": re.compile(r"(?i)(e-?mail|contact|write|@)"),
    "ip": re.compile(r"(?i)\b(ip|host|server|addr)"),
    "card": re.compile(r"(?i)\b(card|visa|credit|amex|mastercard)"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|fax|mobile)"),
}


def luhn(digits: str) -> bool:
    each = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    twice = 2 * each[1::2]
    return (each[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _digits(s: str) -> str:
    return _NOT_DIGITS.sub("", s)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping, by walking from each @ back over the local part and on over the domain."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and _LOCAL.fullmatch(text, begin - 1, begin):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind a place in KINDS."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    at = _AT.search(text)
    while at:  # emails are sought around each (at) alone
        for m in _WIDER["email"].finditer(text, max(0, at.start() - _REACH[0]), min(len(text), at.end() + _REACH[1])):
            yield m.start(), 0, m.end()
        at = _AT.search(text, at.end())
    for kind, name in enumerate(KINDS[1:], 1):
        if name != "ip" or ":" in text:
            yield from ((m.start(), kind, m.end()) for m in _WIDER[name].finditer(text))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments (start, kind, end) that might be personal data: base spans, failing matches, and wider forms."""
    found = set(base)
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found.update((m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= 7)
    found.update(_wider(text))
    return sorted(found)


N_FEATURES = 12


def features(text: str, start: int, kind: int, end: int) -> np.ndarray:
    """Features of the whole span, laid out in one stretch per type."""
    own = text[start:end]
    digits = _digits(own)
    before, after = text[start - 1 : start], text[end : end + 1]
    parts = own.split(".")
    out = np.zeros(N_FEATURES * len(KINDS))
    out[N_FEATURES * kind : N_FEATURES * (kind + 1)] = [
        1,
        luhn(digits) if digits else 0,
        12 <= len(digits) <= 19,
        9 <= len(digits) <= 15,
        own.startswith(("+", "00")),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        "@" in own or "at" in own,
        not (before.isalnum() or after.isalnum()),
        len(set(digits)) > 3,
        bool(_HINTS[KINDS[kind]].search(text[max(0, start - 24) : start])),
        "(" in own and ")" in own,
        own.count(":") == 7,
    ]
    return out


def regions(segments: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Segments that overlap, directly or through others, by end: what one programme decides together."""
    own: list[tuple[int, int, int]] = []
    end = -1
    for s in segments:
        if own and s[0] >= end:
            yield sorted(own, key=lambda x: (x[2], x))
            own = []
        own.append(s)
        end = max(end if len(own) > 1 else -1, s[2])
    if own:
        yield sorted(own, key=lambda x: (x[2], x))


def _before(segments: list[tuple[int, int, int]]) -> np.ndarray:
    """For each segment, how many end at or before its start."""
    return np.searchsorted([s[2] for s in segments], [s[0] for s in segments], "right")


def best_choice(segments: list[tuple[int, int, int]], scores: np.ndarray) -> list[int]:
    """The non-overlapping segments with the largest sum of scores."""
    back = _before(segments)
    value = np.zeros(len(segments) + 1)
    for i, s in enumerate(scores):
        value[i + 1] = max(value[i], value[back[i]] + s)
    out, i = [], len(segments)
    while i:
        if value[i] > value[i - 1]:
            out.append(i - 1)
            i = int(back[i - 1])
        else:
            i -= 1
    return out[::-1]


def marginals(segments: list[tuple[int, int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Each segment's probability, and the log of the sum over all choices."""
    n, back = len(segments), _before(segments)
    forward = np.zeros(n + 1)
    for i, s in enumerate(scores):
        forward[i + 1] = np.logaddexp(forward[i], forward[back[i]] + s)
    outside = np.full(n + 1, -np.inf)
    outside[n] = 0.0
    chosen = np.zeros(n)
    for i in range(n - 1, -1, -1):
        chosen[i] = np.exp(forward[back[i]] + scores[i] + outside[i + 1] - forward[n])
        outside[i] = np.logaddexp(outside[i], outside[i + 1])
        outside[back[i]] = np.logaddexp(outside[back[i]], outside[i + 1] + scores[i])
    return chosen, float(forward[n])


def training(text: str) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """A text's regions: segments, their features, and which of them the base rules choose."""
    base = base_spans(text)
    known = set(base)
    for own in regions(candidates(text, base)):
        gold = set(best_choice(own, np.array([1.0 if s in known else -1.0 for s in own])))
        yield own, np.array([features(text, *s) for s in own]), np.array([i in gold for i in range(len(own))], float)


def fit(data: list[tuple], rounds: int = 60, rate: float = 0.5, shrink: float = 1e-3) -> np.ndarray:
    """Weights by gradient ascent on the likelihood of the base spans among the candidates of regions. A region of one
    segment is a matter of that segment alone; those are done together."""
    weights = np.zeros(N_FEATURES * len(KINDS))
    squares = np.full_like(weights, 1e-6)
    alone = [(x[0], gold[0]) for own, x, gold in data if len(own) == 1]
    single, wanted = np.array([x for x, _ in alone]).reshape(len(alone), len(weights)), np.array([gold for _, gold in alone])
    for _ in range(rounds):
        slope = -shrink * weights
        slope += (wanted - 1 / (1 + np.exp(-np.clip(single @ weights, -500, 500)))) @ single / max(1, len(data))
        for own, x, gold in data:
            if len(own) > 1:
                slope += (gold - marginals(own, x @ weights)[0]) @ x / len(data)
        squares += slope**2
        weights += rate * slope / np.sqrt(squares)
    return weights


def spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): base spans stay; the field chooses among the segments clear of them."""
    base = base_spans(text)
    starts, ends = np.array([s[0] for s in base], np.int64), np.maximum.accumulate(np.array([s[2] for s in base], np.int64))
    found = candidates(text, base)
    # Of the base spans that begin before a segment's end, the one that ends last must end before the segment.
    before = np.searchsorted(starts, [s[2] for s in found], "left")
    free = [s for s, n in zip(found, before.tolist(), strict=True) if not n or ends[n - 1] <= s[0]]
    added = []
    for own in regions(free):
        scores = np.array([features(text, *s) @ weights for s in own])
        added += [own[i] for i in best_choice(own, scores)]
    return base, sorted(base + added)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            rows = [(hash_of(text, k), np.array(own, "<i8").tobytes(), x.astype("<f4").tobytes(), gold.astype("<f4").tobytes()) for k, (own, x, gold) in enumerate(training(text))]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["draw", "segments", "x", "gold"])


def hash_of(text: str, k: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{k}:{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def find_pii(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_regions: int = TRAIN_REGIONS) -> DataFrame:
    """doc_id, base and found, arrays of (start, kind, end) in code points by start, then kind (a place in KINDS)."""
    texts = texts_of(docs)
    telling = texts.where(F.col("text").rlike(r"[0-9][0-9][0-9.() -]{3}|@")).select(F.xxhash64("doc_id", "text").alias("draw"), "text")
    # At most train_docs numbers; the regions of their texts, at most train_regions, reach the driver as features.
    chosen = F.broadcast(staged(telling.select("draw").orderBy("draw").limit(train_docs).distinct(), "pii-sample"))
    sample = telling.join(chosen, "draw").select("text").mapInArrow(_trained, "draw long, segments binary, x binary, gold binary")
    data = []
    for r in sorted(sample.orderBy("draw", "segments").limit(train_regions).collect()):
        own = [tuple(s) for s in np.frombuffer(r["segments"], "<i8").reshape(-1, 3).tolist()]
        data.append((own, np.frombuffer(r["x"], "<f4").reshape(len(own), -1).astype(float), np.frombuffer(r["gold"], "<f4").astype(float)))
    weights = fit(data)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                rows = [spans(t, weights) if t else ([], []) for t in some.column("text").to_pylist()]
                cells = [pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in r[k]] for r in rows], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *cells], names=["doc_id", "base", "found"])

    out = "array<struct<start:long,kind:int,end:long>>"
    return texts.mapInArrow(run, f"doc_id long, base {out}, found {out}")


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
