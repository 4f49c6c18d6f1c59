"""Neighbour graphs of windows and their degree-0 persistent homology.

Greedy neighbour selection runs row by row on the tiles of a series. The union-find scan depends on the order of all
edges, so it is a kernel, one series a group, with at most (k + 1) edges a window; persistence_by_rounds gives the same
rows by joins and minima, whatever the length of a series. Everything between them is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.operators import profile
from recurva.plans.kernels import by_series
from recurva.plans.store import stored

#: Edges that are thinned together; a task holds no more of them at once.
THINNED = 1 << 18


def outside(m: int, exclusion: str):
    """What the zones of picked neighbours leave: zones are in time, or, compacted, in places among what the removals
    before have left."""

    def without(left: np.ndarray, best: np.ndarray) -> np.ndarray:
        if exclusion == "time":
            return left & (np.abs(np.arange(left.shape[1]) - best[:, None]) >= m)
        place = np.cumsum(left, axis=1)  # of what is left beside the neighbour, 1-based up to and including
        own = place[np.arange(len(best)), best][:, None]
        return left & ((place >= own + m) | (place <= own - (m - 1)))

    return without


def knn_graph(series: DataFrame, m: int, k: int, name: str = "trend", exclusion: str = "compacted", digits: int = 9, tile: int = profile.TILE) -> DataFrame:
    """(series_id, i, rank, j, dist): k neighbours of every window that overlap neither it nor one another: the nearest,
    then the nearest outside its zone, and so on."""
    without = outside(m, exclusion)

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        return profile.chosen(rows, at, dist, k, without)

    return profile.scan(series, m, name, work, "i long, rank int, j long, dist double", digits, tile)


def similarity_edges(knn: DataFrame) -> DataFrame:
    """(series_id, u, v, w) with u < v, each once."""
    return knn.select("series_id", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("dist").alias("w")).distinct()


def temporal_edges(knn: DataFrame) -> DataFrame:
    """Each window with the next one, at the larger of their nearest distances."""
    nn = knn.groupBy("series_id", "i").agg(F.min("dist").alias("nn"))
    order = Window.partitionBy("series_id").orderBy("i")
    out = nn.select("series_id", F.col("i").alias("u"), F.lead("i").over(order).alias("v"), F.greatest("nn", F.lead("nn").over(order)).alias("w"))
    return out.where("v IS NOT NULL")


def filtration(knn: DataFrame, drop_first: bool = False) -> DataFrame:
    """(series_id, rank, u, v, w, kind) in the order (w, kind, u, v). drop_first leaves out the similarity edge with
    the least (u, v, w), as some published results do."""
    similar = similarity_edges(knn).withColumn("kind", F.lit("similar"))
    if drop_first:
        first = Window.partitionBy("series_id").orderBy("u", "v", "w")
        similar = similar.withColumn("r", F.row_number().over(first)).where("r > 1").drop("r")
    both = similar.unionByName(temporal_edges(knn).withColumn("kind", F.lit("temporal")))
    order = Window.partitionBy("series_id").orderBy("w", "kind", "u", "v")
    return both.select("series_id", (F.row_number().over(order)).alias("rank"), "u", "v", "w", "kind")


def node_births(edges: DataFrame) -> DataFrame:
    """(series_id, node, birth): the weight of the first edge that touches a node."""
    ends = edges.select("series_id", F.explode(F.array("u", "v")).alias("node"), "w")
    return ends.groupBy("series_id", "node").agg(F.min("w").alias("birth"))


class Forest:
    """Union-find whose roots are the oldest nodes of their trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.birth: dict[int, float] = {}

    def root(self, node: int, w: float) -> int:
        if node not in self.parent:
            self.parent[node], self.birth[node] = node, w
        top = node
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[node] != top:
            self.parent[node], node = top, self.parent[node]
        return top

    def merge(self, a: int, b: int) -> int:
        """The root that dies: the younger, of equals the first."""
        dies, stays = (a, b) if self.birth[a] >= self.birth[b] else (b, a)
        self.parent[dies] = stays
        return dies


def persistence(edges: DataFrame) -> DataFrame:
    """(series_id, seed, birth, death, u, v, w): each component's birth and death, with the edge that merged it; those
    edges are a minimum spanning forest. Components that never merge die at infinity and have no edge."""

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        forest, rows = Forest(), []
        for u, v, w in zip(own["u"].tolist(), own["v"].tolist(), own["w"].tolist(), strict=True):
            a, b = forest.root(u, w), forest.root(v, w)
            if a != b:
                dies = forest.merge(a, b)
                rows.append((dies, forest.birth[dies], w, u, v, w))
        return rows + [(n, forest.birth[n], np.inf, None, None, None) for n, p in forest.parent.items() if n == p]

    return by_series(edges.select("series_id", "rank", "u", "v", "w"), ["rank"], run, "seed long, birth double, death double, u long, v long, w double")


def joining(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges, taken in turn, join nodes that the ones before leave apart; nodes are numbered from 0. All parts
    choose their first edge out at once and become one with what it leads to, until no edge leads out."""
    keep, part, left = np.zeros(len(u), bool), np.arange(max(u.max(), v.max()) + 1 if len(u) else 0), np.arange(len(u))
    while True:
        a, b = part[u[left]], part[v[left]]
        left, a, b = (x[a != b] for x in (left, a, b))
        if not len(left):
            return keep
        first = np.full(len(part), -1)
        first[np.stack((a, b), axis=1).ravel()[::-1]] = np.repeat(np.arange(len(left)), 2)[::-1]  # the last one written stays
        own = np.flatnonzero(first >= 0)
        chosen = first[own]
        keep[left[chosen]] = True
        to = np.arange(len(part))
        to[own] = a[chosen] + b[chosen] - own
        ends = own[(to[to[own]] == own) & (own < to[own])]  # of two that chose each other one stays
        to[ends] = ends
        while not np.array_equal(to, farther := to[to]):
            to = farther
        part = to[part]


def thinned(edges: DataFrame) -> DataFrame:
    """(series_id, rank, u, v, w): edges without those whose ends earlier ones already join, as far as a task meets them
    together. Such an edge merges nothing and is no node's first, so the rest have the same persistence; of a series
    whose edges lie together there is one edge fewer than nodes in a component, whatever the number of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= THINNED:
                yield from kept(held)
                held = []
        yield from kept(held)

    def kept(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if not held:
            return []
        table = pa.Table.from_batches(held)
        series, rank, u, v = (table.column(c).to_numpy() for c in ("series_id", "rank", "u", "v"))
        order = np.argsort(rank, kind="stable")
        nodes = np.unique(np.concatenate((u, v)), return_inverse=True)[1]
        nodes = nodes + np.tile(np.unique(series, return_inverse=True)[1], 2) * (int(nodes.max(initial=0)) + 1)
        nodes = np.unique(nodes, return_inverse=True)[1]
        u, v = nodes[: len(u)], nodes[len(u) :]
        keep = u == v  # a loop merges nothing, but its node may be born by it
        keep[order[joining(u[order], v[order])]] = True
        return table.filter(pa.array(keep)).to_batches()

    some = edges.select("series_id", "rank", "u", "v", "w")
    return some.mapInArrow(run, some.schema)


def persistence_by_rounds(edges: DataFrame) -> DataFrame:
    """The rows of persistence by rounds of joins and minima, none of which holds a series in one task. Edges are made
    once and go into the rounds thinned.

    A component goes by its oldest node, of nodes born alike the later one. In a round every component looks at its
    first edge to another. If that one's node is older, its own node dies there: nothing can join the component sooner,
    and whatever the other has become by then has a node as old. The dying join what they met (met ones may die in
    the same round, of ever older ones), and edges inside a component go. Of two components that have each other's
    first edge one dies, so there are always fewer, and no more rounds than their number; in practice a few."""
    edges = stored(thinned(edges))
    births = stored(node_births(edges))

    def end(side: str) -> DataFrame:
        return births.select("series_id", F.col("node").alias(side), F.col("birth").alias(f"{side}_birth"))

    edge = F.struct("rank", "u", "v", "w").alias("edge")
    links = edges.where("u <> v").withColumns({"a": F.col("u"), "b": F.col("v")}).join(end("a"), ["series_id", "a"]).join(end("b"), ["series_id", "b"])
    links = stored(links.select("series_id", "a", "a_birth", "b", "b_birth", edge))
    dead = None
    while not links.isEmpty():
        other = links.select("series_id", F.col("b").alias("a"), F.col("b_birth").alias("a_birth"), F.col("a").alias("b"), F.col("a_birth").alias("b_birth"), "edge")
        first = links.unionByName(other).groupBy("series_id", "a").agg(F.min(F.struct("edge", "a_birth", "b", "b_birth")).alias("x")).select("series_id", "a", "x.*")
        dying = stored(first.where("b_birth < a_birth OR (b_birth = a_birth AND b > a)"))
        ended = dying.select("series_id", F.col("a").alias("seed"), F.col("a_birth").alias("birth"), F.col("edge.w").alias("death"), "edge.u", "edge.v", "edge.w")
        dead = ended if dead is None else dead.union(ended)
        # Each of the dying with the living one at the end of its way, twice as far a step.
        ways = dying.select("series_id", "a", F.col("b").alias("to"), F.col("b_birth").alias("to_birth"))
        while True:
            ahead = ways.select("series_id", F.col("a").alias("to"), F.col("to").alias("next"), F.col("to_birth").alias("next_birth"))
            farther = ways.join(ahead, ["series_id", "to"], "left").select("series_id", "a", F.coalesce("next", "to").alias("to"), F.coalesce("next_birth", "to_birth").alias("to_birth"), F.col("next").isNotNull().alias("moved"))
            farther = stored(farther)
            ways = farther.drop("moved")
            if farther.where("moved").isEmpty():
                break
        for side in ("a", "b"):
            to = ways.select("series_id", F.col("a").alias(side), "to", "to_birth")
            links = links.join(to, ["series_id", side], "left").withColumns({side: F.coalesce("to", side), f"{side}_birth": F.coalesce("to_birth", f"{side}_birth")}).drop("to", "to_birth")
        flip = F.col("a") > F.col("b")
        ends = {c: F.when(flip, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in (("a", "b"), ("a_birth", "b_birth"), ("b", "a"), ("b_birth", "a_birth"))}
        links = links.where("a <> b").select("series_id", *ends.values(), "edge").groupBy("series_id", *ends).agg(F.min("edge").alias("edge"))
        links = stored(links)
    alive = births.withColumnRenamed("node", "seed")
    if dead is not None:
        alive = alive.join(dead.select("series_id", "seed"), ["series_id", "seed"], "left_anti")
    alive = alive.select("series_id", "seed", "birth", F.lit(float("inf")).alias("death"), *(F.lit(None).cast(k).alias(c) for c, k in (("u", "long"), ("v", "long"), ("w", "double"))))
    return alive if dead is None else dead.union(alive)


def finite(pers: DataFrame) -> DataFrame:
    """Infinite deaths become the series' largest finite birth or death."""
    own = Window.partitionBy("series_id")
    most = F.greatest(F.max("birth").over(own), F.max(F.when(F.col("death") < float("inf"), F.col("death"))).over(own))
    return pers.withColumn("death", F.when(F.col("death") < float("inf"), F.col("death")).otherwise(most))


def components_at(pers: DataFrame, t: float) -> DataFrame:
    """(series_id, t, nodes, components): nodes born and components alive when edges up to t stand."""
    alive = pers.where(F.col("birth") <= t)
    out = alive.groupBy("series_id").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("death") > t, 1)).alias("components"))
    return out.select("series_id", F.lit(t).alias("t"), "nodes", "components")


def thresholded(pers: DataFrame, cuts: DataFrame, own_cuts: bool = True) -> DataFrame:
    """(series_id, label, node, birth): components of the spanning forest when only merges of persistence below p_cut
    count; of each, named by its oldest node, the members born before its own cut (own_cuts: its death, if that comes
    before b_cut; otherwise b_cut for all). cuts: (series_id, b_cut, p_cut)."""

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        b_cut, p_cut = float(own["b_cut"][0]), float(own["p_cut"][0])
        own_cut = {s: min(d, b_cut) for s, b, d in zip(own["seed"].tolist(), own["birth"].tolist(), own["death"].tolist(), strict=True) if own_cuts and d - b > p_cut and b <= b_cut}
        forest = Forest()
        for u, v, w in zip(own["u"].tolist(), own["v"].tolist(), own["w"].tolist(), strict=True):
            if w != w:  # never merged
                continue
            a, b = forest.root(int(u), w), forest.root(int(v), w)
            if a != b and w - max(forest.birth[a], forest.birth[b]) < p_cut:
                forest.merge(a, b)
        rows = []
        for node, birth in forest.birth.items():
            seed = forest.root(node, birth)
            if forest.birth[seed] < b_cut and birth < own_cut.get(seed, b_cut):
                rows.append((seed, node, birth))
        return rows

    table = pers.join(cuts, "series_id").select("series_id", "seed", "birth", "death", "u", "v", "w", "b_cut", "p_cut")
    return by_series(table, ["w", "u", "v"], run, "label long, node long, birth double")
