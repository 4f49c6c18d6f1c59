"""Distances of windows. Each is a function of the squared Euclidean distance of two normalised windows, so that one
join serves all: normalise each window once, sum squared differences, finish.

A window that cannot be normalised (no spread, no length) has no distances and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.plans.series import middle, windows


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _scaled(w: Column, size: Column) -> Column:
    return F.when(size > 1e-12, F.transform(w, lambda x: x / size))


def raw(w: Column, m: int) -> Column:
    return w


def centred(w: Column, m: int) -> Column:
    mean = _sum(w) / m
    return F.transform(w, lambda x: x - mean)


def unit_z(w: Column, m: int) -> Column:
    """Centred, of length 1."""
    own = centred(w, m)
    return _scaled(own, F.sqrt(_sum(F.transform(own, lambda x: x * x))))


def unit_length(w: Column, m: int) -> Column:
    return _scaled(w, F.sqrt(_sum(F.transform(w, lambda x: x * x))))


def by_median(w: Column, m: int) -> Column:
    own = F.transform(w, lambda x: x - middle(w, m))
    return _scaled(own, middle(F.transform(own, F.abs), m))


def without_trend(w: Column, m: int) -> Column:
    """What is left beside a line, of length 1."""
    mean, mid = _sum(w) / m, (m - 1) / 2
    slope = _sum(F.transform(w, lambda x, t: x * (t - mid))) / (m * (m * m - 1) / 12)
    own = F.transform(w, lambda x, t: x - mean - slope * (t - mid))
    return _scaled(own, F.sqrt(_sum(F.transform(own, lambda x: x * x))))


@dataclass(frozen=True)
class Parts:
    """Windows as offset + slope * t + size * (the window made comparable), t from -(m - 1) / 2 on; power is the squared
    length of the latter. Windows that cannot be made comparable have no size."""

    offset: np.ndarray
    slope: np.ndarray | None
    size: np.ndarray
    power: np.ndarray


def _size(own: np.ndarray) -> np.ndarray:
    size = np.sqrt((own**2).sum(axis=1))
    return np.where(size > 1e-12, size, np.nan)


def _np_raw(w: np.ndarray) -> Parts:
    return Parts(np.zeros(len(w)), None, np.ones(len(w)), (w**2).sum(axis=1))


def _np_z(w: np.ndarray) -> Parts:
    mean = w.mean(axis=1)
    return Parts(mean, None, _size(w - mean[:, None]), np.ones(len(w)))


def _np_length(w: np.ndarray) -> Parts:
    return Parts(np.zeros(len(w)), None, _size(w), np.ones(len(w)))


def _np_median(w: np.ndarray) -> Parts:
    middle = np.median(w, axis=1)
    own = w - middle[:, None]
    mad = np.median(np.abs(own), axis=1)
    mad = np.where(mad > 1e-12, mad, np.nan)
    return Parts(middle, None, mad, (own**2).sum(axis=1) / mad**2)


def _np_trend(w: np.ndarray) -> Parts:
    t = np.arange(w.shape[1]) - (w.shape[1] - 1) / 2
    mean = w.mean(axis=1)
    own = w - mean[:, None]
    slope = (own * t).sum(axis=1) / (t @ t)  # row by row, so that the bits do not depend on the other rows
    return Parts(mean, slope, _size(own - np.outer(slope, t)), np.ones(len(w)))


@dataclass(frozen=True)
class Distance:
    """normal and parts: a window made comparable; finish: from squared difference (and m) to the distance, for
    columns and arrays alike, given the functions sqrt, exp, tanh and log1p. It must not fall as its argument grows.
    shifts: a constant added to all samples changes nothing."""

    normal: Callable[[Column, int], Column]
    parts: Callable[[np.ndarray], Parts]
    finish: Callable
    shifts: bool = True

    def np_normal(self, w: np.ndarray) -> np.ndarray:
        p = self.parts(w)
        own = w - p.offset[:, None]
        if p.slope is not None:
            own = own - np.outer(p.slope, np.arange(w.shape[1]) - (w.shape[1] - 1) / 2)
        return own / p.size[:, None]


DISTANCES = {
    "euclidean": Distance(raw, _np_raw, lambda s, m, f: f.sqrt(s)),
    "znorm": Distance(unit_z, _np_z, lambda s, m, f: f.sqrt(s * m)),
    "unit": Distance(unit_z, _np_z, lambda s, m, f: f.sqrt(s)),
    "pearson": Distance(unit_z, _np_z, lambda s, m, f: s / 2),
    "cosine": Distance(unit_length, _np_length, lambda s, m, f: s / 2, shifts=False),
    "robust": Distance(by_median, _np_median, lambda s, m, f: f.log1p(f.sqrt(s))),
    "gauss": Distance(unit_z, _np_z, lambda s, m, f: f.sqrt(2 * (1 - f.exp(-s)))),
    "tanh": Distance(unit_z, _np_z, lambda s, m, f: f.sqrt(2 * f.tanh(s))),
    "trend": Distance(without_trend, _np_trend, lambda s, m, f: f.sqrt(s)),
}


def normalised(series: DataFrame, m: int, name: str) -> DataFrame:
    """(series_id, i, x): windows made comparable for a distance."""
    made = windows(series, m).select("series_id", "i", DISTANCES[name].normal(F.col("w"), m).alias("x"))
    return made.where("x IS NOT NULL")


def block(d: Distance, x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Distances of normalised windows x (rows) and y (columns), squares summed in the order of the samples."""
    total = np.zeros((len(x), len(y)))
    part = np.empty_like(total)
    for k in range(m):
        np.subtract(x[:, k, None], y[None, :, k], out=part)
        part *= part
        total += part
    return d.finish(total, m, np)


#: Rows after which products of windows are taken afresh, so that rounding errors do not add up; entries of whole windows
#: and of a block of distances held at once.
AFRESH, HELD, BLOCK = 1_024, 1 << 21, 1 << 18
#: Products are this much off, in parts of the lengths of windows they went by; distances must not be more off than ERROR.
OFF, ERROR = 4e-15, 1e-10


class Crossing:
    """Distances of the windows of a series to all of its windows, row by row.

    The covariance of windows i and j is that of i - 1 and j - 1 and what the sample that joins and the one that leaves
    change, so it is carried along the diagonals: a step an entry, whatever the length of a window. All distances
    follow from it and from what each window is apart from its shape (Parts). Where that would leave an error in the
    digits that count, windows are compared sample by sample."""

    def __init__(self, d: Distance, xs: np.ndarray, m: int):
        self.d, self.m, self.windows = d, m, np.lib.stride_tricks.sliding_window_view(xs, m)
        self.xs = xs - xs.mean() if d.shifts else xs
        own = np.lib.stride_tricks.sliding_window_view(self.xs, m)
        t, n = np.arange(m) - (m - 1) / 2, len(own)
        self.mean, self.size, self.power, off, length = (np.empty(n) for _ in range(5))
        slope = np.zeros(n)
        for at in range(0, n, max(1, HELD // m)):
            some = slice(at, at + max(1, HELD // m))
            parts = d.parts(own[some])
            self.mean[some], self.size[some], self.power[some] = own[some].mean(axis=1), parts.size, parts.power
            off[some] = self.mean[some] - parts.offset
            length[some] = np.sqrt(((own[some] - parts.offset[:, None]) ** 2).sum(axis=1))
            if parts.slope is not None:
                slope[some] = parts.slope
        # What is not in the covariance: offsets other than the mean, and slopes. Rows of left times rows of right.
        terms = [(-m * off, off), (t @ t * slope, slope)]
        terms = [x for x in terms if np.abs(x[1]).max(initial=0) > 1e-300]
        self.left, self.right = (np.stack([x[k] for x in terms], axis=1) if terms else None for k in (0, 1))
        # The longest window of those an entry has come by since products were taken afresh.
        most = np.maximum.reduceat(length, np.arange(0, n, AFRESH))
        self.trust = np.repeat(np.maximum(most, np.append(most[:1], most[:-1])), AFRESH)[:n] / self.size
        joins, leaves = self.xs[m:], self.xs[: n - 1]
        self.half = (joins - leaves) / 2
        self.apart = joins - self.mean[1:] + leaves - self.mean[:-1]
        self.first = self.row(0)

    def row(self, i: int) -> np.ndarray:
        return np.correlate(self.xs, self.xs[i : i + self.m] - self.mean[i], "valid")

    def covariances(self, begin: int, end: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, covariances with all windows) for rows begin to end, at most step at a time."""
        before: np.ndarray | None = None
        columns = np.stack((self.apart, self.half))
        for at in range(begin, end, step):
            rows = min(step, end - at)
            out = np.empty((rows, len(self.windows)))
            top = at if before is None else at - 1  # the first row that others are made from
            change = np.stack((self.half[top : at + rows - 1], self.apart[top : at + rows - 1]), axis=1) @ columns
            out[rows - len(change) :, 1:] = change
            out[:, 0] = self.first[at : at + rows]
            if before is None:
                out[0] = self.row(at)
            else:
                out[0, 1:] += before[:-1]
            for k in range(1, rows):
                out[k, 1:] += out[k - 1, :-1]
            before = out[-1].copy() if (at + rows - begin) % AFRESH else None
            yield at, out

    def rows(self, begin: int, end: int, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of rows, their distances): infinite to windows that overlap and to those without distances. exact
        compares all windows sample by sample, so that every bit is the same whatever the rows are taken with."""
        n, m = len(self.windows), self.m
        step = 1 << max(0, min(AFRESH, BLOCK // n).bit_length() - 1)
        column, same = -2 / self.size, bool((self.power == 1).all())
        trust = (OFF / ERROR * self.trust) ** 2
        with np.errstate(invalid="ignore"):
            for at, s in self.covariances(begin, end, step):
                own = np.arange(at, at + len(s))
                if self.left is not None:
                    s -= self.left[own] @ self.right.T
                s *= column
                s /= self.size[own, None]
                s += 2 if same else self.power[own, None]
                if not same:
                    s += self.power
                inside = np.arange(-m + 1, m) + own[:, None]
                kept = (inside >= 0) & (inside < n)
                zone = np.broadcast_to(np.arange(len(own))[:, None], inside.shape)[kept], inside[kept]
                s[zone] = np.inf
                i, j = np.nonzero(np.isfinite(s) if exact else s < np.multiply.outer(self.trust[own] ** 2, trust))
                s[i, j] = self.squares(own[i], j)
                dist = self.d.finish(s, m, np)
                dist[np.isnan(dist)] = np.inf
                dist[zone] = np.inf
                yield own, dist

    def squares(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared differences of windows, made comparable, in the order of the samples."""
        out = np.zeros(len(i))
        for at in range(0, len(i), max(1, HELD // (4 * self.m))):
            some = slice(at, at + max(1, HELD // (4 * self.m)))
            x, y = (self.d.np_normal(self.windows[k[some]]) for k in (i, j))
            for k in range(self.m):
                out[some] += (x[:, k] - y[:, k]) ** 2
        return out
