"""Motif discovery: the persistence method, stage by stage, and the methods it is compared with.

All return occurrences (series_id, label, start, end), half-open, and what orders them. What is quadratic in a series'
length is done row by row on its tiles; kernels hold the samples of one series and a few numbers for each window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.distance import DISTANCES, block, normalised
from recurva.operators import cuts, graph, latent, occurrences, profile
from recurva.plans.kernels import by_many, by_series
from recurva.plans.store import found_at, stored

FOUND = "label long, start long, end long"
PERSISTENCE = "series_id long, seed long, birth double, death double, u long, v long, w double"


def searched(series: DataFrame, m: int, k: int = 3, name: str = "trend", path: str | None = None) -> DataFrame:
    """The rows of graph.persistence of the neighbour graph: all that cuts need, whatever they are. They are stored, at
    path under the search's own parameters if it is given; a search that stands there is read, not made again."""
    if path is None:
        return stored(graph.persistence(graph.filtration(graph.knn_graph(series, m, k, name))))
    at = f"{path}/m={m}/k={k}/name={name}"
    pers = found_at(series.sparkSession, at, PERSISTENCE)
    if pers is not None and not pers.isEmpty():  # one that was broken off left nothing
        return pers
    return stored(graph.persistence(graph.filtration(graph.knn_graph(series, m, k, name))), at)


def cut_motifs(pers: DataFrame, m: int, jump: int = 1, n: int | None = None, similarity: float | None = 0.25, alpha: float = 10.0, beta: float = 0.0, own_cuts: bool = True, cuts_at: tuple[float, float] | None = None) -> DataFrame:
    """Occurrences with their births from the rows of a search, without another one. Births and deaths are stretched by
    ktanh (alpha, beta) before the cuts; the cuts are cuts_at (b_cut, p_cut) for all series, or leave n components, or
    lie at the jump-th largest gap of persistence."""
    stretched = graph.finite(pers).select("series_id", "seed", *(cuts.ktanh(F.col(c), alpha, beta).alias(c) for c in ("birth", "death")), "u", "v", cuts.ktanh(F.col("w"), alpha, beta).alias("w"))
    if cuts_at:
        limits = stretched.select("series_id").distinct().select("series_id", *(F.lit(float(x)).alias(c) for x, c in zip(cuts_at, ("b_cut", "p_cut"), strict=True)))
    else:
        limits = cuts.fixed_cuts(stretched, n) if n else cuts.gap_cuts(stretched.where("w IS NOT NULL"), jump)
    found = occurrences.without_singletons(occurrences.paint(graph.thresholded(stretched, limits, own_cuts), m))
    if similarity is None:
        return found
    return occurrences.without_singletons(occurrences.similar_length(found, similarity))


def persistent_motifs(series: DataFrame, m: int, k: int = 3, jump: int = 1, n: int | None = None, name: str = "trend", similarity: float | None = 0.25, alpha: float = 10.0, beta: float = 0.0, own_cuts: bool = True, path: str | None = None) -> DataFrame:
    """Components of the neighbour graph that persist, as occurrences with their births; n fixes their number, else
    the jump-th largest gap of persistence does. With a path the search is stored there for other cuts."""
    return cut_motifs(searched(series, m, k, name, path), m, jump, n, similarity, alpha, beta, own_cuts)


def radius_counts(series: DataFrame, m: int, radius: float, name: str = "znorm") -> DataFrame:
    """(series_id, i, neighbours, spread, rank): windows by falling number of neighbours within radius, then by the
    spread of their distances, then by place. Windows without any are left out."""

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        near = np.round(dist, 6) < radius
        n = near.sum(axis=1)
        some = np.maximum(n, 1)
        mean = np.where(near, dist, 0).sum(axis=1) / some
        spread = np.sqrt((np.where(near, dist - mean[:, None], 0) ** 2).sum(axis=1) / some) if near.any() else np.zeros(len(rows))
        return {"i": rows[n > 0], "neighbours": n[n > 0], "spread": np.round(spread[n > 0], 6)}

    by = profile.scan(series, m, name, work, "i long, neighbours long, spread double")
    order = Window.partitionBy("series_id").orderBy(F.desc("neighbours"), "spread", "i")
    return by.withColumn("rank", F.row_number().over(order))


def within(dist: np.ndarray, at: np.ndarray, own: int, m: int, radius: float, free: np.ndarray) -> list[int]:
    """Places nearer than radius to the window at place own, nearest first, none overlapping it or one another."""
    left = np.flatnonzero((np.abs(at - at[own]) >= m) & free & (dist < radius))
    out: list[int] = []
    while len(left):
        p = int(left[dist[left].argmin()])
        out.append(p)
        left = left[np.abs(at[left] - at[p]) >= m]
    return out


def _row(d, windows: np.ndarray, p: int, m: int) -> np.ndarray:
    """Rounded distances of window p to all, infinite where there are none."""
    out = np.empty(len(windows))
    own, step = d.np_normal(windows[p : p + 1]), max(m, profile.HELD // m)
    for j in range(0, len(windows), step):
        out[j : j + step] = block(d, own, d.np_normal(windows[j : j + step]), m)[0]
    return np.where(np.isnan(out), np.inf, np.round(out, 9))


def radius_neighbours(series: DataFrame, m: int, radius: float, name: str = "znorm", relative: bool = False, overshoot: bool = False) -> DataFrame:
    """(series_id, i, rank, j, dist): of every window those nearer than radius, nearest first, none overlapping it or
    one another. relative: nearer than radius times its nearest's distance (a window at distance 0 has none then).
    overshoot: and the next one after them."""

    def work(rows: np.ndarray, at: np.ndarray, dist: np.ndarray) -> dict[str, np.ndarray]:
        least = dist.min(axis=1) if relative else 1.0
        return profile.within(rows, at, dist, radius * np.where(np.isfinite(least), least, 0), m, overshoot)

    return profile.scan(series, m, name, work, "i long, rank int, j long, dist double", 9)


def radius_motifs(series: DataFrame, m: int, radius: float, n: int, name: str = "znorm", overshoot: bool = False) -> DataFrame:
    """The n windows with most neighbours within radius (overshoot: and one more) that lie more than twice the radius
    apart, with those."""
    d = DISTANCES[name]
    near = radius_neighbours(series, m, radius, name, overshoot=overshoot)
    by = near.groupBy("series_id", "i").agg(F.count("*").alias("neighbours"), F.round(F.stddev_pop("dist"), 9).alias("spread"))

    def pick(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        ranked = own["of"] == 1
        chosen: list[int] = []
        rows: list[np.ndarray] = []
        order = np.lexsort((own["i"][ranked], own["spread"][ranked], -own["x"][ranked]))
        for p in own["i"][ranked][order].tolist():
            if len(chosen) < n and all(row[p] > 2 * radius for row in rows):
                chosen.append(p)
                rows.append(_row(d, np.lib.stride_tricks.sliding_window_view(own["x"][~ranked], m), p, m))
        return list(enumerate(chosen))

    ranked = by.select("series_id", F.lit(1).alias("of"), "i", F.col("neighbours").cast("double").alias("x"), "spread")
    samples = series.select("series_id", F.lit(0).alias("of"), F.col("idx").alias("i"), F.col("value").alias("x"), F.lit(0.0).alias("spread"))
    centres = by_series(samples.union(ranked), ["of", "i"], pick, "label long, i long")
    members = centres.join(near, ["series_id", "i"]).select("series_id", "label", F.col("j").alias("start")).union(centres)
    return members.select("series_id", "label", "start", (F.col("start") + m).alias("end"))


def profile_motifs(series: DataFrame, m: int, n: int, ratio: float = 3.0, name: str = "znorm") -> DataFrame:
    """Again and again the window nearest to another, with all within ratio times that distance; taken stretches are
    masked for what follows."""
    d = DISTANCES[name]

    def pick(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        rows: list[tuple] = []
        near, xs = own["of"] == 1, own["x"][own["of"] == 0]
        if not near.any():
            return rows
        windows = np.lib.stride_tricks.sliding_window_view(xs, m)
        at, least, free = np.arange(len(windows)), np.full(len(windows), np.inf), np.ones(len(windows), bool)
        least[own["i"][near]] = own["x"][near]
        label = 0
        while label < n and np.isfinite(open_ := np.where(free, least, np.inf)).any():
            seed = int(open_.argmin())
            dist = _row(d, windows, seed, m)
            row = np.where(free & (np.abs(at - seed) >= m), dist, np.inf)
            if not np.isfinite(row.min()):
                free[seed] = False
                continue
            taken = [seed, *within(dist, at, seed, m, max(ratio * row.min(), np.nextafter(row.min(), np.inf)), free)]
            rows += [(label, p, p + m) for p in taken]
            for p in taken:
                free &= np.abs(at - p) >= m
            label += 1
        return rows

    nearest = profile.profile(series, m, name, 9).select("series_id", F.lit(1).alias("of"), "i", F.col("dist").alias("x"))
    samples = series.select("series_id", F.lit(0).alias("of"), F.col("idx").alias("i"), F.col("value").alias("x"))
    return by_series(samples.union(nearest), ["of", "i"], pick, FOUND)


def multi_length_motifs(series: DataFrame, lengths: list[int], n: int, ratio: float = 3.0, name: str = "znorm") -> DataFrame:
    """The n best of every length's motifs by distance per root of length that share no sample, longer ones first among
    equals. Each length is searched on its own; a kernel over the few motifs of a series picks."""
    found = None
    for m in lengths:
        one = profile_motifs(series, m, n, ratio, name).withColumn("m", F.lit(m))
        best = profile.profile(series, m, name).select("series_id", F.col("i").alias("start"), (F.col("dist") / m**0.5).alias("cost"))
        one = one.join(best, ["series_id", "start"])
        found = one if found is None else found.unionByName(one)

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        sets: dict[tuple, list] = {}
        for length, label, start, end, cost in zip(*(own[c].tolist() for c in ("m", "label", "start", "end", "cost")), strict=True):
            sets.setdefault((length, label), []).append((start, end, cost))
        taken: set[int] = set()
        rows: list[tuple] = []
        kept = 0
        for (length, label), members in sorted(sets.items(), key=lambda s: (min(x[2] for x in s[1]), -s[0][0], s[0][1])):
            cells = {c for a, b, _ in members for c in range(a, b)}
            if kept < n and not cells & taken:
                taken |= cells
                rows += [(kept, a, b) for a, b, _ in members]
                kept += 1
        return rows

    return by_series(found.select("series_id", "m", "label", "start", "end", "cost"), ["m", "label", "start"], run, FOUND)


def seeded_motifs(series: DataFrame, lengths: list[int], n: int, ratio: float = 3.0, name: str = "znorm", paired: bool = False) -> DataFrame:
    """Over all lengths at once, again and again the free window nearest to another by distance per root of length,
    with the windows within ratio times that distance, none overlapping it or one another; longer ones first among
    equals. paired seeds each motif by both windows of that pair, which must both be free, and takes the lesser
    distance to either. Taken stretches are masked for windows of every length."""
    d = DISTANCES[name]

    def pick(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        xs = own["x"][own["of"] == 0]
        windows = {m: np.lib.stride_tricks.sliding_window_view(xs, m) for m in lengths if len(xs) >= m}
        free = {m: np.ones(len(w), bool) for m, w in windows.items()}
        at = {m: np.arange(len(w)) for m, w in windows.items()}
        nearest = sorted(
            (dist / m**0.5, -m, i, j, dist)
            for m in windows
            for i, j, dist in zip(*(own[c][own["of"] == m].tolist() for c in ("i", "j", "x")), strict=True)
        )
        rows: list[tuple] = []
        label = 0
        for _cost, minus, i, j, least in nearest:
            m = -minus
            if label == n:
                break
            if not free[m][i] or paired and not free[m][j]:
                continue
            seeds = [i, j] if paired else [i]
            dist = np.minimum.reduce([_row(d, windows[m], p, m) for p in seeds])
            open_ = free[m].copy()
            for p in seeds:
                open_ &= np.abs(at[m] - p) >= m
            reach = max(ratio * least, np.nextafter(least, np.inf))
            members = [*seeds, *within(dist, at[m], i, m, reach, open_)]
            if len(members) < 2:  # its nearest is taken and nothing else is near
                continue
            rows += [(label, p, p + m) for p in members]
            for p in members:
                for length, mask in free.items():
                    mask[max(0, p - length + 1) : p + m] = False
            label += 1
        return rows

    best = None
    for m in lengths:
        one = profile.profile(series, m, name, 9).select("series_id", F.lit(m).alias("of"), "i", "j", F.col("dist").alias("x"))
        best = one if best is None else best.union(one)
    samples = series.select("series_id", F.lit(0).alias("of"), F.col("idx").alias("i"), F.lit(-1).cast("long").alias("j"), F.col("value").alias("x"))
    return by_series(samples.union(best), ["of", "i"], pick, FOUND)


def latent_motifs(series: DataFrame, m: int, n: int, radius: float, alpha: float = 1.0, rate: float = 0.1, rounds: int = 100, seed: int = 0, starts: int = 1) -> DataFrame:
    """n learned shapes, by ascent of soft frequency (the mean of exp(-alpha * d / radius) over windows, d squared
    distances of unit windows) minus a penalty for shapes nearer than 2 * radius, the best of so many starts; members
    lie within radius. Starts are drawn by seed and series. latent.latent_by_rounds does the same by tiles of windows."""

    def find(some: list[tuple[int, dict[str, np.ndarray]]]) -> list[list[tuple]]:
        xs = [np.stack(own["x"]) for _, own in some]
        shapes = latent.learned([series_id for series_id, _ in some], xs, n, m, radius, alpha, rate, rounds, seed, starts)
        return [taken(own["i"], x, best) for (_, own), x, best in zip(some, xs, shapes, strict=True)]

    def taken(at: np.ndarray, x: np.ndarray, shapes: np.ndarray) -> list[tuple]:
        dists = (((x - shape) ** 2).sum(axis=1) for shape in shapes)
        near = ((at[d < radius], d[d < radius]) for d in dists)
        return [(label, p, p + m) for label, own in enumerate(latent.claimed(near, m)) for p in own]

    return by_many(normalised(series, m, "unit"), ["i"], find, FOUND, 32 * latent.TOGETHER)
