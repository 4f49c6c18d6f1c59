"""Token ids in compressed files: static range asymmetric numeral systems over independent interleaved blocks.

Layout of the folder: `table` (id, freq: the shared frequency table, summing to 2**SCALE_BITS) and `blocks`,
one row per block: part and block (ascending, they give the order), first (ids before it in its part), doc_ids and
doc_lengths, n_ids, crc32 of the ids, and payload. A payload is little-endian: the 32-byte header HEADER, the
checkpoints (every CHECK_STEPS steps the word position and the LANES lane states from which decoding can start,
with the crc32 of that stretch), then 32-bit words. Lane i holds the ids i, i + LANES, ...

Defined results: null texts count as empty; null doc_ids come first; rows of one doc_id stand in order of their
texts and are all kept, one result row each; a very long text is a block of its own; an empty table gives an empty
result; other columns are left behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.llm.common import discard, shared_dir, staged, texts_of
from recurva.llm.tokens import END_ID, encode, slices

SCALE_BITS, LANES, CHECK_STEPS, BLOCK_IDS = 20, 512, 128, 262_144
LOWER = np.uint64(1 << 31)
HEADER = struct.Struct("<4sIQIIII")
MAGIC = b"RNS1"


def frequency_table(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, freqs): counts scaled to sum to 2**SCALE_BITS, at least 1 each; the most frequent ids take the rounding."""
    ids = np.array(sorted(counts), np.int64)
    if not len(ids):
        return ids, ids
    raw = np.array([counts[i] for i in ids.tolist()], np.float64)
    total = 1 << SCALE_BITS
    freqs = np.maximum(1, np.floor(raw / raw.sum() * total)).astype(np.int64)
    order, over = np.argsort(-freqs, kind="stable"), int(freqs.sum() - total)
    at = 0
    while over:
        i = order[at % len(order)]
        step = min(over, int(freqs[i]) - 1, max(1, int(freqs[i]) // 8)) if over > 0 else over
        freqs[i] -= step
        over -= step
        at += 1
    return ids, freqs


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        self.freq = np.asarray(freqs, np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))
        self.index = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        self.index[self.ids] = np.arange(len(self.ids))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        steps = -(-n // LANES)
        at = self.index[ids]
        x = np.full(LANES, LOWER, np.uint64)
        chunks: list[np.ndarray] = [np.zeros(0, "<u4")] * steps
        saved: dict[int, np.ndarray] = {}
        for s in range(steps - 1, -1, -1):
            some = at[s * LANES : (s + 1) * LANES]
            f, y = self.freq[some], x[: len(some)]
            full = y >= f << np.uint64(63 - SCALE_BITS)
            chunks[s] = y[full].astype("<u4")
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(some)] = (q << np.uint64(SCALE_BITS)) + (y - q * f) + self.cum[some]
            if s % CHECK_STEPS == 0:
                saved[s] = x.copy()
        words = np.cumsum([0, *map(len, chunks)])
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        checks = b"".join(
            struct.pack("<II", int(words[s]), zlib.crc32(raw[4 * s * LANES : 4 * (s + CHECK_STEPS) * LANES])) + saved[s].astype("<u8").tobytes()
            for s in sorted(saved)
        )
        body = b"".join(c.tobytes() for c in chunks)
        return HEADER.pack(MAGIC, SCALE_BITS, n, LANES, CHECK_STEPS, len(saved), zlib.crc32(checks + body)) + checks + body

    def decode(self, payload: bytes, stretch: int | None = None) -> np.ndarray:
        """All ids of a block, or those of one stretch between checkpoints; a wrong checksum raises ValueError."""
        magic, bits, n, lanes, every, n_checks, crc = HEADER.unpack_from(payload)
        if magic != MAGIC or bits != SCALE_BITS or zlib.crc32(payload[HEADER.size :]) != crc:
            raise ValueError("damaged block")
        each = 8 + 8 * lanes
        words = np.frombuffer(payload, "<u4", offset=HEADER.size + n_checks * each)
        out = []
        for c in range(n_checks) if stretch is None else [stretch]:
            pos, want = struct.unpack_from("<II", payload, HEADER.size + c * each)
            x = np.frombuffer(payload, "<u8", lanes, HEADER.size + c * each + 8).astype(np.uint64)
            ids = np.empty(min(n - c * every * lanes, every * lanes), np.int64)
            for s in range(-(-len(ids) // lanes)):
                m = min(lanes, len(ids) - s * lanes)
                low = x[:m] & np.uint64((1 << SCALE_BITS) - 1)
                at = self.slot[low.astype(np.int64)]
                y = self.freq[at] * (x[:m] >> np.uint64(SCALE_BITS)) + low - self.cum[at]
                short = np.flatnonzero(y < LOWER)
                y[short] = (y[short] << np.uint64(32)) | words[pos : pos + len(short)]
                pos += len(short)
                x[:m] = y
                ids[s * lanes : s * lanes + m] = self.ids[at]
            if zlib.crc32(ids.astype("<u4").tobytes()) != want:
                raise ValueError("damaged stretch")
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _gathered(tokenizer: str):
    """Batches of ordered texts to blocks of whole documents, BLOCK_IDS ids or one document long. At the end a row
    under block -1 has the ids seen (doc_ids) and their counts (doc_lengths)."""
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size, total = 0, np.zeros(0, np.int64)

        def close():
            raw = np.concatenate(held).astype("<u4").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "doc_ids": doc_ids, "doc_lengths": lengths, "ids": raw}], kinds)

        for batch in batches:
            for some in slices(batch):
                bounds, ids = encode(some.column("text"), tokenizer)
                got = np.bincount(ids, minlength=len(total))
                got[: len(total)] += total
                total = got
                for i, doc_id in enumerate(some.column("doc_id").to_pylist()):
                    own = ids[bounds[i] : bounds[i + 1]]
                    doc_ids.append(doc_id)
                    lengths.append(len(own))
                    held.append(own)
                    size += len(own)
                    if size >= BLOCK_IDS:
                        yield close()
                        block, first, doc_ids, lengths, held, size = block + 1, first + size, [], [], [], 0
        if held:
            yield close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"part": part, "block": -1, "first": 0, "doc_ids": at.tolist(), "doc_lengths": total[at].tolist(), "ids": b""}], kinds)

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode all texts of docs (doc_id, text) in ascending doc_id order into the folder path."""
    # Rows of one doc_id (or of none) can be many: the beginnings of their texts share them out, in the same order.
    near = F.substring("text", 1, 32)
    ordered = texts_of(docs).repartitionByRange("doc_id", near).sortWithinPartitions(F.asc_nulls_first("doc_id"), near, "text")
    blocks = staged(
        ordered.mapInArrow(_gathered(tokenizer), "part int, block int, first long, doc_ids array<long>, doc_lengths array<long>, ids binary"), "id-blocks"
    )
    # At most one row per vocabulary entry reaches the driver.
    seen = blocks.where("block = -1").select(F.explode(F.arrays_zip("doc_ids", "doc_lengths")).alias("x"))
    counts = seen.groupBy(F.col("x.doc_ids").alias("id")).agg(F.sum("x.doc_lengths").alias("n")).collect()
    blocks_table, blocks = blocks, blocks.where("block >= 0")
    ids, freqs = frequency_table({r["id"]: r["n"] for r in counts})
    spark = docs.sparkSession
    table = spark.createDataFrame(list(zip(ids.tolist(), freqs.tolist(), strict=True)), "id long, freq long")
    table.coalesce(1).write.parquet(f"{path}/table")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, freqs)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = np.frombuffer(row.column("ids")[0].as_buffer(), "<u4")
                extra = [pa.array([len(own)], pa.int64()), pa.array([zlib.crc32(own.tobytes())], pa.int64()), pa.array([coder.encode(own)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns[:5], *extra], names=[*row.schema.names[:5], "n_ids", "crc32", "payload"])

    kinds = "part int, block int, first long, doc_ids array<long>, doc_lengths array<long>, n_ids long, crc32 long, payload binary"
    blocks.mapInArrow(coded, kinds).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(blocks_table)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode the folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in no stated order."""
    table = sorted(spark.read.parquet(f"{path}/table").collect())  # at most one row per vocabulary entry
    ids, freqs = (np.array([r[c] for r in table], np.int64) for c in ("id", "freq"))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:  # one row per part of the file
        offsets.append((part, total))
        total += n
    parts = spark.createDataFrame(offsets, "part int, offset long")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, freqs)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = coder.decode(row.column("payload")[0].as_buffer().to_pybytes()).astype("<u4").tobytes()
                if zlib.crc32(own) != row.column("crc32")[0].as_py():
                    raise ValueError("damaged block")
                doc_ids = row.column("doc_ids")[0].values
                lengths = np.array(row.column("doc_lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(own[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({
                    "part": pa.array([row.column("part")[0].as_py()] * len(ends), pa.int32()),
                    "doc_id": doc_ids,
                    "at": pa.array(ends - lengths + row.column("first")[0].as_py(), pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                })

    docs = blocks.mapInArrow(decoded, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # As many rows as the file has parts.
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all of docs into a new folder of the shared folder and read it back."""
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)


__all__ = ["END_ID", "Coder", "frequency_table", "read_ids", "round_trip", "write_ids"]
