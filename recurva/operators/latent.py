"""Learned shapes: ascent of soft frequency less a penalty for shapes that are alike, in a kernel a series or by rounds.

The value of n shapes is the mean of exp(-alpha * d / radius) over windows and shapes, d squared distances of unit
windows, less the mean over pairs of shapes of (1 - d / (2 * radius))^2 for those nearer than 2 * radius. A step needs
of all windows only sums a shape: of its pulls, and of pull times window. So a round by tiles is one aggregate of
n * (m + 1) numbers a series, and shapes are all that is sent out.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.distance import DISTANCES
from recurva.plans.kernels import by_series
from recurva.plans.store import shared_dir, stored

#: Windows of a tile; tiles that meet one copy of their series' shapes.
TILE, PART = 4_096, 64
#: Windows of series that are learned together: what a step holds of them stays in a core's cache.
TOGETHER = 4_096
STATE = "series_id long, start int, windows long, parts long, value double, shapes array<double>, squares array<double>"


def first_shapes(series_id: int, start: int, windows: int, n: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among a series' windows where shapes begin, and what is added to the windows there."""
    draw = np.random.default_rng([seed, abs(series_id), start])
    places = draw.choice(windows, min(n, windows), replace=False)
    return places, 0.01 * draw.standard_normal((len(places), m))


def pulls(x: np.ndarray, shapes: np.ndarray, alpha: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums a shape over windows x: of their pulls, and of pull times window. Axes before the last two are series."""
    pull = np.stack([np.exp(-alpha / radius * ((shapes[..., k, None, :] - x) ** 2).sum(axis=-1)) for k in range(shapes.shape[-2])], axis=-2)
    return pull.sum(axis=-1), pull @ x


def ascended(shapes: np.ndarray, squares: np.ndarray, pull: np.ndarray, drawn: np.ndarray, windows: int, alpha: float, radius: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The value of shapes, and shapes and sums of squared slopes one step on; axes before the last two are series."""
    n = shapes.shape[-2]
    between = shapes[..., :, None, :] - shapes[..., None, :, :]
    apart, others = (between**2).sum(axis=-1), n * (n - 1)
    push = np.where((apart < 2 * radius) & ~np.eye(n, dtype=bool), 1 - apart / (2 * radius), 0)
    value = pull.sum(axis=-1) / (n * windows) - (push**2).reshape(*push.shape[:-2], n * n).sum(axis=-1) / max(1, others)
    slope = -(2 * alpha / radius) * (pull[..., None] * shapes - drawn) / (n * windows)
    if others:
        slope += (4 / (others * radius)) * (push[..., None] * between).sum(axis=-2)
    squares = squares + slope**2
    return value, shapes + rate * slope / np.sqrt(squares), squares


def learned(ids: list[int], xs: list[np.ndarray], n: int, m: int, radius: float, alpha: float, rate: float, rounds: int, seed: int, starts: int) -> list[np.ndarray]:
    """The best shapes of every series' windows. Series of as many windows go together, step by step;
    each has the shapes, to the last bit, that it has alone."""
    out: list[np.ndarray] = [np.zeros(0)] * len(xs)
    alike: dict[int, list[int]] = {}
    for i, windows in enumerate(map(len, xs)):
        alike.setdefault(windows, []).append(i)
    parts = ((windows, own[k : k + max(1, TOGETHER // windows)]) for windows, own in alike.items() for k in range(0, len(own), max(1, TOGETHER // windows)))
    for windows, own in parts:
        x = np.stack([xs[i] for i in own])
        best = np.full(len(own), -np.inf)
        for start in range(starts):
            drawn = (first_shapes(ids[i], start, windows, n, m, seed) for i in own)
            shapes = np.stack([xs[i][places] + extra for i, (places, extra) in zip(own, drawn, strict=True)])
            squares = np.full_like(shapes, 1e-12)
            for _ in range(rounds):
                _, shapes, squares = ascended(shapes, squares, *pulls(x, shapes, alpha, radius), windows, alpha, radius, rate)
            value = ascended(shapes, squares, *pulls(x, shapes, alpha, radius), windows, alpha, radius, rate)[0]
            for k in np.flatnonzero((value > best) | (start == 0)).tolist():
                best[k], out[own[k]] = value[k], shapes[k]
    return out


def claimed(near: Iterable[tuple[np.ndarray, np.ndarray]], m: int) -> list[list[int]]:
    """Of (places, distances) of each shape those it takes, nearest first, none overlapping what was taken before."""
    taken: list[int] = []
    out = []
    for at, dist in near:
        own = []
        for p in at[np.lexsort((at, dist))].tolist():
            k = bisect(taken, p)
            if (k == 0 or p - taken[k - 1] >= m) and (k == len(taken) or taken[k] - p >= m):
                insort(taken, p)
                own.append(p)
        out.append(own)
    return out


def _windows(xs: np.ndarray, first: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit windows of a tile; those without spread are left out."""
    x = DISTANCES["unit"].np_normal(np.lib.stride_tricks.sliding_window_view(xs, m))
    some = ~np.isnan(x[:, 0])
    return first + np.flatnonzero(some), x[some]


def _tiles(series: DataFrame, m: int, tile: int) -> DataFrame:
    """(series_id, tile, part, first, xs): tiles of windows with all samples that these reach."""
    low, high = F.floor((F.col("idx") - (m - 1)) / tile), F.floor(F.col("idx") / tile)
    cut = series.select("series_id", "idx", "value", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), high)).alias("tile"))
    cut = cut.groupBy("series_id", "tile").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s")).where(F.size("s") >= m)
    return cut.select("series_id", "tile", F.floor(F.col("tile") / PART).alias("part"), F.col("s")[0]["idx"].alias("first"), F.transform("s", lambda x: x["value"]).alias("xs"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows with lists of numbers as arrays."""
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for r in range(batch.num_rows):
        cells = [c[r] for c in columns]
        yield {k: x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x.as_py() for k, x in zip(batch.schema.names, cells, strict=True)}


def _begun(tiles: DataFrame, m: int, n: int, seed: int, starts: int) -> DataFrame:
    """The state before the first round."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(_windows(row["xs"], row["first"], m)[0]) for row in _rows(batch)]
            yield pa.record_batch({"series_id": batch.column("series_id"), "tile": batch.column("tile"), "n": pa.array(sizes, pa.int64())})

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in _rows(batch):
                for start in range(starts):
                    places, extra = first_shapes(row["series_id"], start, row["windows"], n, m, seed)
                    out += ((row["series_id"], start, k, p, x) for k, (p, x) in enumerate(zip(places.tolist(), extra.tolist(), strict=True)))
            cells = list(zip(*out, strict=True)) or [()] * 5
            kinds = {"series_id": pa.int64(), "start": pa.int32(), "shape": pa.int32(), "place": pa.int64(), "extra": pa.list_(pa.float64())}
            yield pa.record_batch({c: pa.array(x, k) for x, (c, k) in zip(cells, kinds.items(), strict=True)})

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [_windows(row["xs"], row["first"], m)[1][row["own"]] + row["extra"] for row in _rows(batch)]
            kept = {c: batch.column(c) for c in ("series_id", "start", "shape")}
            yield pa.record_batch({**kept, "x": pa.array([s.tolist() for s in shapes], pa.list_(pa.float64()))})

    sizes = stored(tiles.select("series_id", "tile", "first", "xs").mapInArrow(counted, "series_id long, tile long, n long"))
    totals = sizes.groupBy("series_id").agg(F.sum("n").alias("windows"), F.floor(F.max("tile") / PART + 1).alias("parts")).where("windows > 0")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("series_id").orderBy("tile")) - F.col("n"))
    places = totals.select("series_id", "windows").mapInArrow(drawn, "series_id long, start int, shape int, place long, extra array<double>")
    at = places.join(before, "series_id").where("place >= before AND place < before + n")
    at = at.select("series_id", "tile", "start", "shape", "extra", (F.col("place") - F.col("before")).alias("own"))
    each = tiles.select("series_id", "tile", "first", "xs").join(at, ["series_id", "tile"]).mapInArrow(shaped, "series_id long, start int, shape int, x array<double>")
    by = each.groupBy("series_id", "start").agg(F.array_sort(F.collect_list(F.struct("shape", "x"))).alias("s"))
    shapes = F.flatten(F.transform("s", lambda s: s["x"])).alias("shapes")
    by = by.join(totals, "series_id").select("series_id", "start", "windows", "parts", F.lit(None).cast("double").alias("value"), shapes)
    return by.withColumn("squares", F.transform("shapes", lambda _: F.lit(1e-12)))


def latent_by_rounds(series: DataFrame, m: int, n: int, radius: float, alpha: float = 1.0, rate: float = 0.1, rounds: int = 100, seed: int = 0, starts: int = 1, tile: int = TILE) -> DataFrame:
    """The rows of motifs.latent_motifs, up to the order in which sums are added, for series of any length: every
    round is a join of tiles with shapes and one aggregate, its result a small table. Shapes meet the tiles by series
    and part, so that no task holds more than some parts of a long series. Only windows within radius of a shape meet
    in one task a series, in the end. An empty table, and series without a window that has spread, give no rows."""
    tiles = stored(_tiles(series, m, tile))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")

    def pulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for row in _rows(batch):
                _, x = _windows(row["xs"], row["first"], m)
                if len(x):
                    own = np.column_stack(pulls(x, row["shapes"].reshape(-1, m), alpha, radius)).ravel()
                    key = row["series_id"], row["start"]
                    sums[key] = sums[key] + own if key in sums else own
            sizes = [len(x) for x in sums.values()]
            keys = np.repeat(np.array(list(sums), np.int64).reshape(-1, 2), sizes, axis=0)
            cells = np.concatenate([*map(np.arange, sizes), np.zeros(0, int)]).astype(np.int32)
            yield pa.record_batch({"series_id": keys[:, 0], "start": keys[:, 1].astype(np.int32), "cell": cells, "x": np.concatenate([*sums.values(), np.zeros(0)])})

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, shapes, squares = [], [], []
            for row in _rows(batch):
                sums = row["sums"].reshape(-1, m + 1)
                value, *after = ascended(row["shapes"].reshape(-1, m), row["squares"].reshape(-1, m), sums[:, 0], sums[:, 1:], row["windows"], alpha, radius, rate)
                values.append(float(value))
                for to, x in zip((shapes, squares), after, strict=True):
                    to.append(x.ravel().tolist())
            kept = {c: batch.column(c) for c in ("series_id", "start", "windows", "parts")}
            yield pa.record_batch({**kept, "value": pa.array(values, pa.float64()), "shapes": pa.array(shapes, pa.list_(pa.float64())), "squares": pa.array(squares, pa.list_(pa.float64()))})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                at, x = _windows(row["xs"], row["first"], m)
                for label, shape in enumerate(row["shapes"].reshape(-1, m)):
                    dist = ((x - shape) ** 2).sum(axis=1)
                    own = dist < radius
                    some = int(own.sum())
                    yield pa.record_batch({"series_id": np.full(some, row["series_id"]), "label": np.full(some, label), "i": at[own], "dist": dist[own]})

    def take(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        labels = np.unique(own["label"]).tolist()
        by_shape = ((own["i"][own["label"] == k], own["dist"][own["label"] == k]) for k in labels)
        return [(k, p, p + m) for k, members in zip(labels, claimed(by_shape, m), strict=True) for p in members]

    def met(state: DataFrame) -> DataFrame:
        return tiles.select("series_id", "part", "first", "xs").join(state.select("series_id", "start", "shapes", spread), ["series_id", "part"]).drop("part")

    base = f"{shared_dir(series.sparkSession)}/latent-{np.random.default_rng().bytes(8).hex()}"
    state = stored(_begun(tiles, m, n, seed, starts), f"{base}-begun")
    for turn in range(rounds + 1):
        sums = met(state).mapInArrow(pulled, "series_id long, start int, cell int, x double")
        sums = sums.groupBy("series_id", "start", "cell").agg(F.sum("x").alias("x"))
        sums = sums.groupBy("series_id", "start").agg(F.array_sort(F.collect_list(F.struct("cell", "x"))).alias("s"))
        known = state.join(sums.select("series_id", "start", F.transform("s", lambda s: s["x"]).alias("sums")), ["series_id", "start"])
        if turn < rounds:  # two tables take turns, the one that is read stays
            state = stored(known.mapInArrow(stepped, STATE), f"{base}-{turn % 2}")
        else:
            valued = known.mapInArrow(stepped, STATE).select("series_id", "start", "value")
            state = stored(state.drop("value").join(valued, ["series_id", "start"]), f"{base}-best")
    order = Window.partitionBy("series_id").orderBy(F.desc("value"), "start")
    best = state.withColumn("r", F.row_number().over(order)).where("r = 1")
    found = met(best).select("series_id", "first", "xs", "shapes").mapInArrow(near, "series_id long, label long, i long, dist double")
    return by_series(found, ["label", "i"], take, "label long, start long, end long")
