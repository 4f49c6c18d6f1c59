"""Words that are one edit apart, by letter-parity bit masks in bands, and the common form each is a variant of.

A word's mask has a bit for every letter, set when the letter occurs an odd number of times. An inserted or deleted
letter flips one bit, a replaced one two or none, so of three bands that the bits are dealt into one is always equal.
Words meet where a band is equal and lengths differ by one at most; there whole masks are compared (two bits at most may
differ), and what is left is checked letter by letter. Letters are dealt by how much their parity tells in the table at
hand, so that bands are about equally selective.

A band value that holds many words is cut into tiles: words are dealt into chunks of bounded size, and every two chunks
meet in one task step. Pairs are never rows: a step returns, for each word in it, the number of near words and the best.

Defined results: words are compared by code points; of near words with equal counts the smallest counts as the
best; repeated rows of one word are added up; null words are left out; very long words are compared whole; an empty
table gives no rows; other columns are left behind. In texts: a null text has no words, a null doc_id stands as "".
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import discard, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a band, words of a chunk, entries compared at once.
BITS, CHUNK, HELD = 30, 16_384, 1 << 22
BANDS = 3


def runs(docs: DataFrame, least: int, every: int) -> DataFrame:
    """word: each maximal run of at least so many letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. Where `every`
    divides the crc32 of "<doc_id>:<run>", the letter at place crc32 % length is left out."""
    own = docs.select(docs["doc_id"].cast("long").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    own = own.select("doc_id", lower.alias("run")).withColumn("h", F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), "run")))
    at = "cast(h % length(run) as int)"
    return own.select(F.expr(f"if(h % {every} = 0, concat(substring(run, 1, {at}), substring(run, {at} + 2)), run)").alias("word"))


def words_of(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of at least so many letters that occur at least so often."""
    every_word = runs(docs, least_length, every).where(F.length("word") >= least_length)
    return every_word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many words each letter occurs an odd number of times; under -1 the words."""
    total, n = np.zeros(0x110000, np.int64), 0
    for batch in batches:
        words = batch.column("word").to_pylist()
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            cells, times = np.unique(np.repeat(np.arange(len(some)), [len(w) for w in some]) << 21 | _codes(some), return_counts=True)
            total += np.bincount(cells[times % 2 == 1] & 0x1FFFFF, minlength=0x110000)
            n += len(some)
    at = np.flatnonzero(total)
    yield pa.record_batch({"letter": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], n), pa.int64())})


def dealt(odd: dict[int, int], n: int) -> np.ndarray:
    """The bit of every code point, band * BITS + place: letters by falling entropy of their parity go to the bands in
    turn, there and back, and share the places of a band only when it has more than BITS of them."""

    def entropy(letter: int) -> float:
        p = odd[letter] / n
        return -p * math.log(p) - (1 - p) * math.log(1 - p) if 0 < p < 1 else 0.0

    table = (np.arange(0x110000) % (BANDS * BITS)).astype(np.uint8)
    for i, letter in enumerate(sorted(odd, key=lambda c: (-entropy(c), c))):
        turn, place = divmod(i, BANDS)
        table[letter] = (place if turn % 2 == 0 else BANDS - 1 - place) * BITS + turn % BITS
    return table


def masks(words: list[str], table: np.ndarray) -> np.ndarray:
    """A row of BANDS numbers a word: the parities of the letters dealt to each band."""
    out = np.zeros((len(words), BANDS), np.int64)
    for i in range(0, len(words), 20_000):
        some = words[i : i + 20_000]
        bits, owner = table[_codes(some)].astype(np.int64), np.repeat(np.arange(len(some)), [len(w) for w in some])
        cells, times = np.unique(owner * (BANDS * BITS) + bits, return_counts=True)
        cells = cells[times % 2 == 1]
        word, bit = cells // (BANDS * BITS), cells % (BANDS * BITS)
        np.add.at(out, (i + word, bit // BITS), 1 << (bit % BITS))
    return out


def _replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(axis=1) == 1


def _inserted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row by row y is x with one letter more: equal up to some place, and from there on one place later."""
    front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= x.shape[1]


def near_in(words: list[str], rest: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words that this band alone, or it first, brings together. rest: the other two bands'
    bits; with two sides only words of different sides are compared. Lengths ascend."""
    lengths = np.array([len(w) for w in words])
    two = side.min() != side.max()
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        """Words at places rows with those at cols; same: both are one list, each pair once."""
        if not len(rows) or not len(cols):
            return
        a, b = (_codes([words[i] for i in x.tolist()]).reshape(len(x), -1) for x in (rows, cols))
        step = max(1, HELD // len(cols))
        for at in range(0, len(rows), step):
            own = slice(at + 1 if same else 0, None)
            flips = rest[rows[at : at + step], None] ^ rest[None, cols[own]]
            near = np.bitwise_count(flips) <= 2
            if band >= 1:
                near &= flips >> BITS != 0
            if band == 2:
                near &= flips & ((1 << BITS) - 1) != 0
            i, j = np.nonzero(near)
            i, j = i + at, j + own.start
            if same:
                i, j = i[i < j], j[i < j]
            most = max(1, HELD // max(1, a.shape[1]))
            for k in range(0, len(i), most):
                p, q = i[k : k + most], j[k : k + most]
                right = (_replaced if a.shape[1] == b.shape[1] else _inserted)(a[p], b[q])
                found.append((rows[p[right]], cols[q[right]]))

    for length in np.unique(lengths).tolist():
        own, longer = np.flatnonzero(lengths == length), np.flatnonzero(lengths == length + 1)
        if not two:
            compare(own, own, True)
            compare(own, longer, False)
        else:
            low = side.min()
            compare(own[side[own] == low], own[side[own] != low], False)
            for mine in (True, False):
                compare(own[(side[own] == low) == mine], longer[(side[longer] == low) != mine], False)
    return tuple(np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, count and word of the best) for every word in the pairs."""
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    at = np.lexsort((order[j], -n[j], i))
    i, j = i[at], j[at]
    own, first, times = np.unique(i, return_index=True, return_counts=True)
    for k, f, c in zip(own.tolist(), j[first].tolist(), times.tolist(), strict=True):
        yield words[k], c, int(n[f]), words[f]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) that has any near one. Words are distinct."""
    odd = {r["letter"]: r["n"] for r in words.select("word").mapInArrow(_odd, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    n_words = max(1, odd.pop(-1, 1))  # beside it a row per letter: no more than there are code points
    table = words.sparkSession.sparkContext.broadcast(dealt(odd, n_words))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = masks(batch.column("word").to_pylist(), table.value)
            for band in range(BANDS):
                others = [made[:, k] for k in range(BANDS) if k != band]
                yield pa.record_batch({"band": pa.array(np.full(len(made), band, np.int32)), "value": pa.array(made[:, band]), "rest": pa.array(others[0] << BITS | others[1]), "word": batch.column("word"), "n": batch.column("n")})

    keyed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(banded, "band int, value long, rest long, word string, n long")
    keyed = staged(keyed, "spelling-bands")
    # Band values with more words than a chunk holds: there are fewer than BANDS * words / CHUNK of them.
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("held")).where(F.col("held") > CHUNK)
    chunks = sizes.select("band", "value", F.ceil(F.col("held") / (CHUNK // 2)).cast("int").alias("chunks"))
    keyed = keyed.join(F.broadcast(chunks), ["band", "value"], "left").withColumn("side", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = keyed.withColumn("other", other).withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))
    keys = ["band", "value", "a", "b"]
    tiles = tiles.withColumn("size", F.length("word")).repartition(*keys).sortWithinPartitions(*keys, "size", "word").select(*keys, "side", "rest", "n", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for band, tile in _tiles(batches):
            side = tile.column("side").to_numpy()
            # Off the diagonal of tiles both sides are there, or there is nothing to compare.
            a, b = tile.column("a")[0].as_py(), tile.column("b")[0].as_py()
            if tile.num_rows > 1 and (a == b or side.min() != side.max()):
                words_ = tile.column("word").to_pylist()
                i, j = near_in(words_, tile.column("rest").to_numpy(), side, band)
                if len(i):
                    out += _best(words_, tile.column("n").to_numpy(), i, j)
            if len(out) > 20_000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

    found = tiles.mapInArrow(run, "word string, near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(band, rows) of every tile; rows of one tile stand together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "value", "a", "b")])
        cuts = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0))))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            now = tuple(columns[:, x].tolist())
            if held and now != key:
                yield key[0], pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(x, y - x))
    if held:
        yield key[0], pa.Table.from_batches(held)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form (its near word of the largest count, if that is at least ratio times its own, else null), root (from
    word along forms to the last), n, n_near and form_n, for (word, n). Counts grow by ratio a step, so that a chain
    of forms has few; ratio must be 2 or more."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = staged(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    found = words.join(near_words(words), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    found = found.select("word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n"))
    found = staged(found, "spelling-forms")
    links = staged(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:  # twice as far along the forms each time
        above = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        farther = links.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        farther = staged(farther, "spelling-links")
        discard(links)
        if farther.where("moved").isEmpty():
            break
        links = staged(farther.select("word", "root"), "spelling-links")
        discard(farther)
    out = found.join(farther.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
