"""Ranked lexical search of a set of items against all documents, as a blocked sparse matrix product.

Items form a sparse matrix of term multiplicities, documents one of integer impacts by term. Their product is taken a
block of items and a block of documents at a time: the row of an item is the sum of its terms' rows of impacts, merged
one after another into an accumulator over the block's documents (Gustavson). A block gives each item its k best; a task
keeps the k best of its blocks, and those are merged group by group of tasks, then for good.

Documents are read once for each block of items: their terms that items have are written, with counts, to the shared
folder, from where statistics and products read them. Document frequencies and sizes are those of the whole table.
All sums are exact 64-bit integers; only a term's weight is made from a logarithm in double precision.

Defined results: a null or empty text has no terms; documents without terms count in no statistic; items without terms,
and those that no document scores above 0 for, have no rows; repeated rows of items or documents each count by
themselves; equal scores go by the smaller doc_id, null ones last; a very long item or text is held whole by one task;
empty tables give no rows; other columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.llm.common import staged, texts_of
from recurva.llm.tokens import slices

#: Letters and digits of ASCII, and all that is not ASCII.
TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Terms of items (each item's different ones) in a block; documents in a block; tasks whose results meet first.
ITEM_TERMS, DOC_BLOCK, TASKS = 1 << 20, 8_192, 64
LAST = (1 << 63) - 1


def terms_of(texts: pa.Array) -> Iterator[Counter]:
    """Each text's terms with their numbers; only A-Z are lower-cased."""
    for text in pc.ascii_lower(pc.fill_null(texts, "")).to_pylist():
        yield Counter(TERM.findall(text))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.string()), pa.list_(pa.int64())
    for batch in batches:
        for some in slices(batch):
            counted = list(terms_of(some.column("text")))
            cells = [pa.array([list(f(c)) for c in counted], k) for f, k in zip((Counter.keys, Counter.values), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("item_id"), *cells], names=["item_id", "terms", "times"])


class Items:
    """A block of items: its terms, and row by row their columns and multiplicities."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.place: dict[str, int] = {}
        self.rows = [[(self.place.setdefault(t, len(self.place)), n) for t, n in zip(terms, times, strict=True)] for _, terms, times in rows]


def blocks_of(items: DataFrame) -> Iterator[Items]:
    """The items, so many at a time that their terms stay within ITEM_TERMS (an item with more is alone)."""
    held: list[tuple] = []
    size = 0
    rows = items.select(items["item_id"].cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<string>, times array<long>")
    for r in rows.where("size(terms) > 0").toLocalIterator():
        if held and size + len(r["terms"]) > ITEM_TERMS:
            yield Items(held)
            held, size = [], 0
        held.append(tuple(r))
        size += len(r["terms"])
    if held:
        yield Items(held)


def impacts(tf: np.ndarray, weight: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Block:
    """Impacts of some documents, term by term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))

    def row(self, item: list[tuple[int, int]]) -> np.ndarray:
        """An item's scores: its terms' rows times their multiplicity, merged. A document stands once in a term's row."""
        out = np.zeros(self.n_docs, np.int64)
        for term, times in item:
            own = slice(self.begin[term], self.begin[term + 1])
            out[self.doc[own]] += self.impact[own] if times == 1 else self.impact[own] * times
        return out


def first(score: np.ndarray, doc_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0, ties to the smaller doc_id."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        some = some[score[some] >= np.partition(score[some], -k)[-k]]
    return some[np.lexsort((doc_id[some], -score[some]))][:k]


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0."""
    found = [searched(docs, block, number, k) for number, block in enumerate(blocks_of(items))]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    own = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def searched(docs: DataFrame, items: Items, number: int, k: int) -> DataFrame:
    """block, item (its number there), item_id, doc_id and score: k rows an item and group of tasks at most."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)  # ITEM_TERMS entries, or one item's

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' terms that items have, with their numbers, and how many terms a document has in all."""
        place = shared.value.place
        for batch in batches:
            for some in slices(batch):
                sizes, terms, times = [], [], []
                for own in terms_of(some.column("text")):
                    known = [(place[t], n) for t, n in own.items() if t in place]
                    sizes.append(own.total())
                    terms.append(np.array([t for t, _ in known], "<i4").tobytes())
                    times.append(np.array([n for _, n in known], "<i4").tobytes())
                cells = [some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n", "terms", "times"])

    held = texts_of(docs).mapInArrow(counted, "doc_id long, n long, terms binary, times binary").where("n > 0")
    held = staged(held, "search-terms", "zstd")
    n_docs, n_all = held.agg(F.count("*"), F.sum("n")).first()
    n_terms = len(items.place)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for raw in batch.column("terms"):
                total[np.frombuffer(raw.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    df = np.zeros(n_terms, np.int64)
    for r in held.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, ids = shared.value.rows, shared.value.ids
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(rows)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_BLOCK):
                some = batch.slice(at, DOC_BLOCK)
                term, tf = (np.frombuffer(b"".join(some.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("terms", "times"))
                doc = np.repeat(np.arange(some.num_rows), pc.binary_length(some.column("terms")).to_numpy() // 4)
                # Whole numbers of any size: 25 * n * N may leave 64 bits.
                m = np.array([75 + 25 * n * n_docs // n_all for n in some.column("n").to_pylist()], np.int64)
                block = Block(doc, term, impacts(tf, weight[term], m[doc]), some.num_rows, n_terms)
                none = pc.is_null(some.column("doc_id")).to_numpy(zero_copy_only=False)
                doc_id = pc.fill_null(some.column("doc_id"), LAST).to_numpy()
                for i, item in enumerate(rows):
                    score = block.row(item)
                    top = first(score, doc_id, k)
                    if len(top) and (len(best[i][0]) < k or score[top[0]] >= best[i][0][-1]):
                        all_, ids_, none_ = (np.concatenate(x) for x in zip(best[i], (score[top], doc_id[top], none[top]), strict=True))
                        keep = np.lexsort((none_, ids_, -all_))[:k]
                        best[i] = all_[keep], ids_[keep], none_[keep]
        out = [(i, ids[i], None if n else d, s) for i, own in enumerate(best) for s, d, n in zip(*(x.tolist() for x in own), strict=True)]
        group = TaskContext.get().partitionId() // TASKS
        cells = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), number, np.int32)), pa.array(np.full(len(out), group, np.int32)), *cells], names=["block", "group", "item", "item_id", "doc_id", "score"])

    found = held.where("length(terms) > 0").mapInArrow(product, "block int, group int, item int, item_id long, doc_id long, score long")
    own = Window.partitionBy("block", "group", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r", "group")
