"""Retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25.

Every document is tokenized once. Full windows of a long document are sequences of their own; what is left of each
document, always less than a window, is packed with others. Rests whose documents have the same most telling id
(rarest under a fixed weighted draw) come to stand next to each other, in shards of bounded size; a hot id spreads
over as many shards as it needs. Each shard holds a BM25 inverted index with document frequencies of the whole
corpus. All terms of a seed but the end id are its query. Its best unused neighbours fill its window, best first, as long as
any shares a term; only then follow others in the shard's order. What does not fit stays for later windows, and what the last window of a shard
lacks comes from the next shard. What is left at the end of a partition goes into windows whose lengths are powers
of two, so nothing is padded.

Defined results: a null text is empty and still has its end id; null doc_ids and repeated rows are documents of
their own; very long texts fill windows by themselves, a window at a time; of neighbours with equal scores the one
earlier in the shard comes first; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import staged, texts_of
from recurva.llm.tokens import END_ID, encode, slices

K1, B = 0.9, 0.4
#: Ids in a shard: the index of one shard stays within some tens of MB.
SHARD_IDS = 1_000_000
#: Cells of a shard's dense lists: the commonest terms' postings are kept as one row of all documents each.
DENSE = 1 << 21
#: Neighbours ranked at first; if all of them leave room, all others that share a query term are ranked as well.
FIRST = 32


def id_kind(tokenizer: str) -> str:
    """Little-endian unsigned integers just wide enough for the vocabulary: what is written and shuffled is half as much."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


class Frequencies:
    """In how many documents each id stands, after the numbers of documents and of all their ids."""

    def __init__(self):
        self.docs = self.ids = 0
        self.total = np.zeros(0, np.int64)
        self.last = np.zeros(0, np.int64)  # where each id stood last

    def add(self, bounds: np.ndarray, ids: np.ndarray) -> None:
        """Documents, document i from bounds[i] to bounds[i + 1]."""
        if len(ids) and (more := int(ids.max()) + 1 - len(self.total)) > 0:
            self.total, self.last = (np.append(x, np.zeros(more, np.int64)) for x in (self.total, self.last))
        at = np.arange(len(ids))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = ids[i:j]
            self.last[own] = at[i:j]
            self.total[own[self.last[own] == at[i:j]]] += 1  # each id once
        self.docs += len(bounds) - 1
        self.ids += len(ids)

    def bytes(self) -> bytes:
        return np.concatenate(([self.docs, self.ids], self.total)).astype("<i8").tobytes()


def tokenized(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """doc_id, ids (of that kind, the end id last) and n (their number); beside them a row a task that has only
    `counts`, the frequencies of its ids, so that nothing reads the ids again to count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Frequencies()
        for batch in batches:
            for some in slices(batch):
                bounds, ids = encode(some.column("text"), tokenizer)
                counts.add(bounds, ids)
                raw, width = ids.astype(kind).tobytes(), int(kind[-1])
                cells = [raw[width * i : width * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch({"doc_id": some.column("doc_id"), "ids": pa.array(cells, pa.binary()), "n": pa.array(np.diff(bounds)), "counts": pa.nulls(len(cells), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.int64()), "counts": pa.array([counts.bytes()], pa.binary())})

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, n long, counts binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies as (id, n); under id -2 the documents, under -1 all ids."""
    for batch in batches:
        for raw in batch.column("counts"):
            n = np.frombuffer(raw.as_buffer(), "<i8")
            at = np.flatnonzero(n)
            yield pa.record_batch({"id": pa.array(at - 2), "n": pa.array(n[at])})


class Shard:
    """A BM25 inverted index over some documents, and the windows made from them."""

    def __init__(self, docs: list[tuple], idf: np.ndarray, mean_length: float):
        self.lengths = lengths = np.array([len(d[2]) for d in docs], np.int64)
        flat = np.concatenate([d[2] for d in docs]).astype(np.int64)
        pairs, tf = np.unique(flat * len(docs) + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
        self.term, self.doc = (pairs // len(docs)).astype(np.int32), (pairs % len(docs)).astype(np.int32)
        norm = K1 * (1 - B + B * lengths / mean_length)
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.begin = np.searchsorted(self.term, np.arange(len(idf) + 1))
        # Short lists are read entry by entry; the longest ones, most of all entries, are added up row by row.
        lists = np.diff(self.begin)
        self.row = np.full(len(lists), -1)
        common = np.argsort(-lists, kind="stable")[: DENSE // len(docs)]
        common = common[lists[common] > 0]
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(docs)), np.float32)
        entries = self.row[self.term] >= 0
        self.dense[self.row[self.term[entries]], self.doc[entries]] = self.weight[entries]
        self.ids = [d[2] for d in docs]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score, ties to the earlier one; those sharing no query term are left out."""
        terms = np.unique(self.ids[seed])
        terms = terms[terms != END_ID]
        rows = self.row[terms]
        score = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32)
        rare = terms[rows < 0]
        if len(rare):
            begins, sizes = self.begin[rare], self.begin[rare + 1] - self.begin[rare]
            at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            score = score + np.bincount(self.doc[at], self.weight[at], minlength=len(score))
        score[~unused] = 0
        score[seed] = 0
        found = np.flatnonzero(score)
        if len(found) > FIRST:
            least = np.partition(score[found], -FIRST)[-FIRST]
            some = found[score[found] >= least]
            yield from some[np.argsort(-score[some], kind="stable")].tolist()
            found = found[score[found] < least]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_shard(docs: list[tuple], idf: np.ndarray, mean_length: float, window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows of exactly `window` ids, each a list of (doc, begin, end), and the pieces that fill none.
    A doc is (doc_id, begin of its rest, its rest of ids, ids of the whole document); a rest is below a window."""
    index = Shard(docs, idf, mean_length)
    begin, sizes = [0] * len(docs), [len(d[2]) for d in docs]
    unused = np.array([n > 0 for n in sizes])
    windows: list[list[tuple]] = []

    def take(i: int, space: int, into: list[tuple]) -> int:
        n = min(space, sizes[i] - begin[i])
        into.append((i, begin[i], begin[i] + n))
        begin[i] += n
        unused[i] = begin[i] < sizes[i]
        return space - n

    following = iter(range(len(docs)))
    for seed in range(len(docs)):
        if not unused[seed]:
            continue
        space = take(seed, window, own := [])
        if space:
            for i in index.neighbours(seed, unused):
                space = take(i, space, own)
                if not space:
                    break
        while space:
            i = next((i for i in following if unused[i]), None)
            if i is None:
                return windows, own
            space = take(i, space, own)
            if unused[i]:  # cut: its rest is next in line
                following = iter(range(i, len(docs)))
        windows.append(own)
    return windows, []


def pack(docs: DataFrame, tokenizer: str, window: int = 2048) -> DataFrame:
    """A row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (its place there). Every id lies in one piece; a sequence has `window` ids or,
    at the end of a partition, fewer: a power of two. window must be a power of two itself."""
    kind = id_kind(tokenizer)
    width = int(kind[-1])
    held = staged(tokenized(docs, tokenizer, kind), "packing-ids", "zstd")
    # At most one row per vocabulary entry reaches the driver.
    found = held.where("counts IS NOT NULL").select("counts").mapInArrow(_unpacked, "id long, n long")
    counts = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_ids = max(1, counts.pop(-2, 1)), counts.pop(-1, 0)
    held = held.where("n IS NOT NULL").select("doc_id", "ids", "n")
    df = np.zeros(max(counts, default=0) + 1)
    df[list(counts)] = list(counts.values())
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    draw = np.random.default_rng(0).random(len(df))
    place = np.empty(len(df), np.int64)
    place[np.argsort(-np.log(draw) / np.maximum(idf, 1e-9), kind="stable")] = np.arange(len(df))
    mean_length = n_ids / n_docs or 1.0

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The full windows of documents of a window or more."""
        from pyspark import TaskContext

        sequence = 1 << 62 | TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch):
                out = []
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), some.column("ids"), strict=True):
                    raw = raw.as_buffer()
                    own = np.frombuffer(raw, kind)
                    for start in range(0, len(own) - window + 1, window):
                        out.append((doc_id, start, window, own[start : start + window].astype("<u4").tobytes(), len(own), sequence, 0))
                        sequence += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=names)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each document, with its document's most telling id."""
        for batch in batches:
            for some in slices(batch):
                out = []
                for doc_id, raw in zip(some.column("doc_id").to_pylist(), some.column("ids"), strict=True):
                    raw = raw.as_buffer()
                    n, start = raw.size // width, raw.size // width // window * window
                    if start < n:
                        out.append((int(place[np.frombuffer(raw, kind)].min()), doc_id, start, raw[width * start :].to_pybytes(), n))
                cells = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.binary(), pa.int64()])]
                yield pa.RecordBatch.from_arrays(cells, names=["key", "doc_id", "start", "ids", "doc_tokens"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []
        size = 0

        def rows(docs: list[tuple], windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for own in windows:
                offset = 0
                for i, a, b in own:
                    doc_id, start, ids, n = docs[i]
                    out.append((doc_id, start + a, b - a, ids[a:b].tobytes(), n, sequence, offset))
                    offset += b - a
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=names)

        def close(last: bool) -> pa.RecordBatch:
            nonlocal rest, size
            docs, windows, own = rest, *pack_shard(rest, idf, mean_length, window)
            rest = [] if last else [(docs[i][0], docs[i][1] + a, docs[i][2][a:b], docs[i][3]) for i, a, b in own]
            size = sum(len(d[2]) for d in rest)
            return rows(docs, windows + (powers(own) if last else []))

        for batch in batches:
            for doc_id, start, raw, n in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids = np.frombuffer(raw.as_py(), kind).astype("<u4")
                rest.append((doc_id.as_py(), start.as_py(), ids, n.as_py()))
                size += len(ids)
                if size >= SHARD_IDS:
                    yield close(False)
        if rest:
            yield close(True)

    keys = held.mapInArrow(keyed, "key long, doc_id long, start long, ids binary, doc_tokens long").withColumn("salt", F.xxhash64("doc_id", "ids"))
    near = keys.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "doc_tokens").select("doc_id", "start", "ids", "doc_tokens")
    pieces = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return held.where(F.col("n") >= window).mapInArrow(whole, pieces).union(near.mapInArrow(packed, pieces))


def powers(own: list[tuple]) -> list[list[tuple]]:
    """Cut the pieces of one short window into windows whose lengths are powers of two, the largest first."""
    out, total = [], sum(b - a for _, a, b in own)
    queue = list(own)
    while total:
        space = 1 << (total.bit_length() - 1)
        total -= space
        window = []
        while space:
            i, a, b = queue.pop(0)
            n = min(space, b - a)
            window.append((i, a, a + n))
            if a + n < b:
                queue.insert(0, (i, a + n, b))
            space -= n
        out.append(window)
    return out
