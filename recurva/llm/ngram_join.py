"""Similarity groups over word-shingle sets: a size-aware heavy-light join by Jaccard similarity.

Equal sets are one node from the start. All sets share one order of shingles, rare ones first (by a count sketch of
the whole corpus), so two sets that link share a shingle among the first few of both, and even a pair of them among
slightly more. A light (small) set enumerates all pairs of its first shingles; a heavy one stands in the inverted
lists of its first single shingles, where it also meets light sets of nearly its size. The boundary is the size at
which the expected cost, list entries met against pairs enumerated, is least; it is known before any key is made.

Keys are shuffled once, those of hot shingles by size and a salt. A list falls into runs of sizes that can link; a
member alone in its run is dropped. No pairs are listed wholesale: first every member of a list meets two others of
it that a hash picks, then, of what verified links have not joined, one of each other component, and only then all
of different components, in blocks of bounded size. Sizes and parity bitmaps drop pairs that cannot link before
anything is compared exactly.

Defined results: a text that is null or has no words has n_shingles 0 and is its own component; null doc_ids never
name a component unless all its members are null; repeated rows are members like any other; very long texts are
sets like any other, their bitmaps grow with them; an empty table gives an empty result; other columns are left
behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import components, staged, texts_of
from recurva.llm.shingles import mix, shingle_sets
from recurva.llm.tokens import slices

#: Counters of the sketch, as a power of two, and how many travel together.
SKETCH_BITS, CHUNK = 19, 16_384
#: Words of a parity bitmap, at least, and of the brief one that meets the members of a list; that has four bits or more
#: for every member in which two linking sets of a size may differ, so that sets of any size that differ in twice as many
#: members or more differ in more bits than linking ones.
WORDS, BRIEF = 8, 4
#: Members that meet in a block; list entries beyond the mean from which a shingle is hot and its list is salted.
BLOCK, HOT = 512, 50_000
#: Pairs that a task remembers so as not to make them again; tasks among which the lists of one hub are dealt for stars.
SEEN, DEALT = 200_000, 16
#: Pairs compared at once.
PAIRS = 500_000


def set_id(own: np.ndarray, salt: int) -> int:
    mixed = mix(own + np.uint64(salt))
    return int((mixed.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(mixed), initial=np.uint64(0))).astype(np.int64))


def parity(own: np.ndarray, words: int = 0) -> list[int]:
    """Bits, each flipped by the members that fall on it; without `words` as many as members or more. Of two halves
    the exclusive or is the bitmap of half the size."""
    bits = 64 * words or (max(64 * WORDS, 1 << (len(own) - 1).bit_length()) if len(own) else 64 * WORDS)
    odd = np.bincount((own >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def brief(own: np.ndarray, percent: int = 90) -> list[int]:
    words = len(own) * (100 - percent) // (8 * (100 + percent)) + 1
    return parity(own, max(BRIEF, 1 << (words - 1).bit_length()))


def folded(bitmaps: pa.ListArray, words: int) -> np.ndarray:
    """The bitmaps of a column halved down to so many words, a row each; shorter ones give rows without meaning."""
    flat, starts = bitmaps.values.to_numpy().view(np.uint64), bitmaps.offsets.to_numpy()
    out = np.zeros((len(bitmaps), words), np.uint64)
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes >= words]).tolist():
        rows = np.flatnonzero(sizes == size)
        own = flat[starts[rows, None] + np.arange(size)].reshape(len(rows), -1, words)
        out[rows] = np.bitwise_xor.reduce(own, axis=1)
    return out


def needed(total: Column, percent: int) -> Column:
    """Shingles that two sets with `total` between them must share at least."""
    return F.ceil(total * percent / F.lit(100 + percent) - 1e-9).cast("int")


def _summaries(n: int, percent: int):
    """A row per document (its set's id, a second hash, size and bitmaps), and at the end of a partition its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        mask = np.uint64(len(counts) - 1)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        names = ["doc_id", "sid", "second", "n", "bitmap", "brief", "chunk", "task", "counts"]
        for batch in batches:
            for some in slices(batch):
                rows = []
                for doc_id, own in zip(some.column("doc_id").to_pylist(), shingle_sets(some.column("text"), n), strict=True):
                    np.add.at(counts, (own & mask).astype(np.int64), 1)
                    rows.append((doc_id, set_id(own, 0), set_id(own, 1), len(own), parity(own), brief(own, percent), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], names=names)
        task = TaskContext.get().partitionId()
        for c in range(0, len(counts), CHUNK):
            row = (None, None, None, None, None, None, c // CHUNK, task, counts[c : c + CHUNK].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row[i]], kinds[i]) for i in range(9)], names=names)

    return run


def _added(kind: str):
    """The sums of counters of the type `kind`, as 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(CHUNK, np.int64), None
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            for raw in batch.column("counts"):
                total += np.frombuffer(raw.as_py(), kind)
        yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    return run


class Rarity:
    """What the count sketch says of shingles: how far each counter stands out from the mean."""

    def __init__(self, counts: np.ndarray):
        mean = counts.mean() if len(counts) else 0.0
        noise = 8 * np.sqrt(mean) + 1
        self.over = np.maximum(0, counts - mean - noise).astype(np.float32)
        # In doublings: a rough, shared notion of rare.
        self.level = np.ceil(np.log2(1 + np.maximum(0, counts - mean) / noise)).astype(np.uint8)
        self.mask = np.uint64(len(counts) - 1)

    def at(self, own: np.ndarray) -> np.ndarray:
        return (own & self.mask).astype(np.int64)

    def ordered(self, own: np.ndarray) -> np.ndarray:
        return own[np.argsort(self.level[self.at(own)], kind="stable")]

    def salts(self, own: np.ndarray) -> np.ndarray:
        """Into how many parts the lists of shingles are cut, 1 for all but hot ones."""
        return 1 + (self.over[self.at(own)] / HOT).astype(np.int64)


def _heads(own: np.ndarray, percent: int, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """A set's first single shingles and its first ones for pairs: a partner shares all but so many of its members."""
    drop = len(own) - -(-percent * len(own) // 100)
    order = rarity.ordered(own)[: drop + 2]
    return order[: drop + 1], order


def _costs(n: int, percent: int, rarity: Rarity):
    """By size of set, what its single keys and what its pairs are expected to cost, added up for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost: dict[int, list[float]] = {}
        for batch in batches:
            for some in slices(batch):
                for own in shingle_sets(some.column("text"), n):
                    if len(own) < 2:
                        continue
                    single, double = _heads(own, percent, rarity)
                    met = 1 + np.sort(rarity.over[rarity.at(double)])
                    entry = cost.setdefault(len(own), [0.0, 0.0])
                    entry[0] += float((1 + rarity.over[rarity.at(single)]).sum())
                    # A pair's list is as long as its rarer shingle's at most.
                    entry[1] += float((met * np.arange(len(met) - 1, -1, -1)).sum())
        rows = [(size, *both) for size, both in cost.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.float64()))], names=["n", "single", "double"])

    return run


def _boundary(costs: DataFrame) -> int:
    """Sizes below it are light. At most a row per size of set reaches the driver."""
    gain, best, total = 0.0, 0, 0.0
    for r in sorted(costs.groupBy("n").agg(F.sum("single").alias("single"), F.sum("double").alias("double")).collect()):
        total += r["single"] - r["double"]
        if total > gain:
            gain, best = total, r["n"] + 1
    return best


def _size_class(r: int, percent: int) -> int:
    """Sizes that can link are of one class or of neighbouring ones."""
    return int(np.floor(np.log(r) / np.log(100 / percent) + 1e-9)) if percent < 100 else r


def _keys(n: int, percent: int, rarity: Rarity, edge: int):
    """A row per key of a set, each set once a task: single shingles of heavy sets and of those nearly as large,
    pairs of light ones. salts > 1 marks the lists of hot shingles, whose keys go by size class as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for some in slices(batch):
                keys, sids, sizes, parts = [], [], [], []
                sets = list(shingle_sets(some.column("text"), n))
                ids = np.array([set_id(own, 0) for own in sets], np.int64)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                for own, sid in ((sets[i], ids[i]) for i in np.flatnonzero(first & ~np.isin(ids, seen))):
                    r = len(own)
                    if not r:
                        continue
                    single, double = _heads(own, percent, rarity)
                    made = []
                    if r >= edge or r * 100 >= edge * percent:
                        made.append((mix(single), rarity.salts(single)))
                    if 1 < r < edge:
                        i, j = np.triu_indices(len(double), 1)
                        salts = rarity.salts(double)
                        made.append((mix(mix(np.minimum(double[i], double[j])) + np.maximum(double[i], double[j])), np.minimum(salts[i], salts[j])))
                    for got, salts in made:
                        if (salts > 1).any():
                            own_class, hot = _size_class(r, percent), salts > 1
                            both = [mix(got[hot] + np.uint64(c)) for c in (own_class, own_class + 1)]
                            got, salts = np.concatenate([got[~hot], *both]), np.concatenate([salts[~hot], salts[hot], salts[hot]])
                        keys.append(got.view(np.int64))
                        sids.append(np.full(len(got), sid))
                        sizes.append(np.full(len(got), r, np.int32))
                        parts.append(salts.astype(np.int32))
                seen = ids  # copies often stand near one another; what is left of them goes in the lists
                if keys:
                    key, sid, size, salts = (np.concatenate(x) for x in (keys, sids, sizes, parts))
                    yield pa.record_batch({"key": pa.array(key), "sid": pa.array(sid), "n": pa.array(size), "salts": pa.array(salts), "salt": pa.array((sid % salts).astype(np.int32))})

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that are sorted by the columns `by`, and where the groups begin. A group that
    goes on in the next batch waits for it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = np.flatnonzero(_changes(table, by))
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])) if len(starts) else None
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _changes(table: pa.Table, by: list[str]) -> np.ndarray:
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in by:
        x = table.column(c).to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _runs(percent: int):
    """(list, hub, sid, n, members) from entries sorted by key, salt, size and set: each entry once, lists cut where sizes
    jump beyond what can link, runs of one member left out. A hot list stays whole. Others go by their members, so that
    those with the same members, of which near copies have many, are one list. The hub is the least hash of a member:
    lists with most members in common, of which near copies have many as well, mostly have the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _whole_groups(batches, ["key", "salt"]):
            new = _changes(table, ["key", "salt"])
            key, sid, n, salts = (table.column(c).to_numpy() for c in ("key", "sid", "n", "salts"))
            once = new.copy()
            once[1:] |= sid[1:] != sid[:-1]
            key, sid, n, salts, new = key[once], sid[once], n[once].astype(np.int64), salts[once], new[once]
            new[1:] |= (salts[1:] == 1) & (n[:-1] * 100 < n[1:] * percent)
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(key)))
            of = np.repeat(np.arange(len(starts)), lengths)
            hot = salts > 1
            keep = hot | (lengths[of] > 1)
            mixed = mix(sid.view(np.uint64))
            same, least = (mix(np.add.reduceat(mixed, starts)), np.minimum.reduceat(mixed, starts)) if len(starts) else (mixed, mixed)
            name, hub = (np.where(hot, key, x[of].view(np.int64)) for x in (same, least))
            members = np.where(hot, salts * HOT, lengths[of])
            yield pa.record_batch({"list": pa.array(name[keep]), "hub": pa.array(hub[keep]), "sid": pa.array(sid[keep]), "n": pa.array(n[keep].astype(np.int32)), "members": pa.array(members[keep].astype(np.int64))})

    return run


class _Seen:
    """The pairs that a task has made lately. Lists with the same hub follow one another, and near copies meet in many."""

    def __init__(self):
        self.pairs: set[tuple[int, int]] = set()

    def fresh(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Of pairs in any order those that are new, smaller ids first."""
        new = {*zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)} - self.pairs
        if len(self.pairs) + len(new) > SEEN:
            self.pairs = set()
        self.pairs |= new
        cells = list(zip(*sorted(new), strict=True)) or [(), ()]
        return pa.record_batch({"a": pa.array(cells[0], pa.int64()), "b": pa.array(cells[1], pa.int64())})


def _stars(percent: int):
    """Pairs (a, b): every member of a list with the two of it that a hash puts first and last. The hash is the same
    for all lists, so that lists with the same members pick the same two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for table, starts in _whole_groups(batches, ["list"]):
            sid, n = table.column("sid").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            if not len(sid):
                continue
            mixed = mix(sid.view(np.uint64))
            lengths = np.diff(np.append(starts, len(sid)))
            out = []
            for pick in (np.minimum, np.maximum):
                best = np.flatnonzero(mixed == np.repeat(pick.reduceat(mixed, starts), lengths))
                hub = best[np.searchsorted(best, starts)].repeat(lengths)
                small, large = np.minimum(n, n[hub]), np.maximum(n, n[hub])
                keep = (sid != sid[hub]) & (small * 100 >= large * percent)
                out.append((sid[keep], sid[hub][keep]))
            yield seen.fresh(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _met(percent: int, every: bool):
    """Pairs (a, b) of members of different components that sizes and brief bitmaps allow, from groups (list, i, j)
    of two blocks of a list; without `every` only one pair of a member and each other component in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for table, starts in _whole_groups(batches, ["list", "i", "j"]):
            sid, label, block = (table.column(c).to_numpy() for c in ("sid", "label", "block"))
            n = table.column("n").to_numpy().astype(np.int64)
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            column = table.column("brief").combine_chunks()
            words = column.value_lengths().to_numpy()
            bits = {w: folded(column, w) for w in np.unique(words).tolist()}
            lengths = np.diff(np.append(starts, len(sid)))
            for size in np.unique(lengths[lengths > 1]).tolist():
                x, y = np.triu_indices(size, 1)
                own = starts[lengths == size]
                step = max(1, PAIRS // len(x))
                for at in range(0, len(own), step):
                    a, b = ((own[at : at + step, None] + side).ravel() for side in (x, y))
                    total = n[a] + n[b]
                    most = total - 2 * -(-total * percent // (100 + percent))
                    keep = (label[a] != label[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
                    keep &= np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
                    a, b, most = a[keep], b[keep], most[keep]
                    shared = np.minimum(words[a], words[b])
                    near = np.zeros(len(a), bool)
                    for w in np.unique(shared).tolist():
                        here = np.flatnonzero(shared == w)
                        for few in np.array_split(here, -(-len(here) * w // (PAIRS * BRIEF))):
                            differ = np.bitwise_count(bits[w][a[few]] ^ bits[w][b[few]]).sum(axis=1, dtype=np.int64)
                            near[few] = differ <= most[few]
                    a, b = a[near], b[near]
                    if not every and len(a):
                        group = np.searchsorted(starts, a, "right")
                        first = np.unique(np.stack((group, sid[a], label[b])), axis=1, return_index=True)[1]
                        a, b = a[first], b[first]
                    if len(a):
                        yield seen.fresh(sid[a], sid[b])

    return run


def _survivors(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set ids those that sizes and bitmaps allow to link: the brief ones first, then the whole."""
    both = pairs.distinct()
    for bitmap in ("brief", "bitmap"):
        left, right = (nodes.select(F.col("sid").alias(c), F.struct("n", F.col(bitmap).alias("bitmap")).alias(f"{c}_set")) for c in "ab")
        both = both.join(left, "a").join(right, "b").where(_may_link("a_set", "b_set", percent)).select("a", "b")
        both = staged(both, f"join-{bitmap}")
    return both


def _exact_sets(texts: DataFrame, firsts: DataFrame, n: int) -> DataFrame:
    """(sid, members) of the set ids in firsts (sid, doc_id), one document's text each; a set whose documents all have
    null doc_ids is found among the texts without one."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                cells = [own.astype("<u8").tobytes() for own in shingle_sets(some.column("text"), n)]
                sids = [set_id(np.frombuffer(c, "<u8"), 0) for c in cells]
                yield pa.record_batch({"sid": pa.array(sids, pa.int64()), "want": some.column("sid"), "members": pa.array(cells, pa.binary())})

    kinds = "sid long, want long, members binary"
    sets = texts.join(firsts, "doc_id").select("text", "sid").mapInArrow(exact, kinds).where("sid = want")
    nameless = firsts.where("doc_id IS NULL").select("sid")
    if not nameless.isEmpty():  # these meet their sets by the set's id, as no doc_id leads to a text
        loose = texts.where("doc_id IS NULL").select("text", F.lit(0).cast("long").alias("sid")).mapInArrow(exact, kinds)
        sets = sets.union(loose.join(nameless, "sid", "left_semi"))
    return staged(sets.dropDuplicates(["sid"]).select("sid", "members"), "join-sets")


def _linked(both: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set ids those whose exact sets link."""
    both = both.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("a_members")), "a")
    both = both.join(sets.select(F.col("sid").alias("b"), F.col("members").alias("b_members")), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.record_batch({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compared, "a long, b long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes near enough, and the bitmaps differ in no more places than two linking sets can differ in members."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    words = F.least(F.size(f"{a}.bitmap"), F.size(f"{b}.bitmap"))

    def halved(bitmap: Column) -> Column:
        return F.when(F.size(bitmap) > words, F.zip_with(F.slice(bitmap, 1, words), F.slice(bitmap, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(bitmap)

    both = F.zip_with(halved(F.col(f"{a}.bitmap")), halved(F.col(f"{b}.bitmap")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(both, F.lit(0), lambda so_far, x: so_far + x)
    sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return sizes & (differ <= n + m - 2 * needed(n + m, percent))


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id. Sets link when 100 * shared >= percent * all; a component has the smallest
    doc_id reachable by links. percent is above 50: then different sets that link share two shingles or more, as pair
    keys need."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    texts = texts_of(docs)
    kinds = "doc_id long, sid long, second long, n int, bitmap array<long>, brief array<long>, chunk int, task int, counts binary"
    summary = staged(texts.mapInArrow(_summaries(n, percent), kinds), "join-summary", "zstd")
    members = summary.where("chunk IS NULL").select("doc_id", "sid", "n")
    parts = summary.where("chunk IS NOT NULL").select("chunk", (F.col("task") % 64).alias("part"), "counts")
    parts = parts.groupBy("chunk", "part").applyInArrow(_added("<u4"), "chunk int, counts binary")
    # 2 ** SKETCH_BITS counters in all.
    rows = parts.groupBy("chunk").applyInArrow(_added("<i8"), "chunk int, counts binary").collect()
    rarity = Rarity(np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(rows)]) if rows else np.zeros(1 << SKETCH_BITS, np.int64))
    nodes = summary.where("chunk IS NULL AND n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("brief").alias("brief"), F.min("second").alias("low"), F.max("second").alias("high")
    )
    nodes = staged(nodes, "join-nodes")
    if not nodes.where("low <> high").isEmpty():
        raise ValueError("two different sets have one 64-bit id")
    edge = _boundary(texts.select("text").mapInArrow(_costs(n, percent, rarity), "n int, single double, double double"))
    entries = texts.select("text").mapInArrow(_keys(n, percent, rarity, edge), "key long, sid long, n int, salts int, salt int")
    entries = entries.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "sid")
    lists = staged(entries.mapInArrow(_runs(percent), "list long, hub long, sid long, n int, members long").distinct(), "join-lists", "zstd")
    sets, links, labels = spark.createDataFrame([], "sid long, members binary"), spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, component long")
    for turn in ("stars", "one", "every"):
        if turn == "stars":
            whole = lists.repartition("hub", F.pmod("list", F.lit(DEALT))).sortWithinPartitions("hub", "list")
            pairs = whole.select("list", "sid", "n").mapInArrow(_stars(percent), "a long, b long")
        else:
            pairs = _across(lists, nodes, labels, percent, turn == "every")
        pairs = _survivors(pairs, nodes, percent)
        if turn != "stars":
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid"), "sid", "left_anti")
        firsts = staged(nodes.join(ends, "sid", "left_semi").select(F.col("first").alias("doc_id"), "sid"), "join-firsts")
        sets = sets.union(_exact_sets(texts, firsts, n))
        got = staged(_linked(pairs, sets, percent), "join-links")
        if got.isEmpty():
            continue
        links = links.union(got)
        labels = staged(components(links, "join-components"), "join-labels")
    label = F.coalesce("component", "sid")
    first = nodes.join(labels, F.col("sid") == F.col("node"), "left").select("sid", label.alias("label"), "first")
    least = first.groupBy("label").agg(F.min("first").alias("component_id"))
    named = staged(first.select("sid", "label").join(least, "label").select("sid", "component_id"), "join-named")
    out = members.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _across(lists: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of a list's members in different components that size and bitmap allow. A list of m members is cut into
    blocks of BLOCK; every block meets every other, so what meets in a group is bounded. Lists of one hub meet in one task,
    which makes a pair once however many of them hold it."""
    known = nodes.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "brief", F.coalesce("component", "sid").alias("label"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    full = lists.join(known, "sid").withColumn("block", block).withColumn("blocks", blocks)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    full = full.select("list", "hub", "sid", "n", "brief", "label", "block", other)
    full = full.select("list", "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "n", "brief", "label", "block")
    full = full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "list").drop("hub")
    return full.mapInArrow(_met(percent, every), "a long, b long")
