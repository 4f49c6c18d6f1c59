"""Scores of predicted against true occurrences, both (series_id, label, start, end), half-open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.operators.occurrences import islands, points
from recurva.plans.kernels import by_series
from recurva.plans.store import stored


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _f1(table: DataFrame) -> DataFrame:
    total = F.col("precision") + F.col("recall")
    table = table.withColumn("fscore", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))
    return table


def sample_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, precision, recall, fscore) on samples, labels put together. A series of either side has a row."""
    sides = [points(t).select("series_id", "idx").distinct().withColumn(c, F.lit(1)) for t, c in ((truth, "t"), (found, "p"))]
    both = sides[0].join(sides[1], ["series_id", "idx"], "full")
    by = both.groupBy("series_id").agg(F.sum(F.when(F.col("t") + F.col("p") == 2, 1).otherwise(0)).alias("hit"), F.count("t").alias("n_t"), F.count("p").alias("n_p"))
    return _f1(by.select("series_id", _ratio("hit", "n_p").alias("precision"), _ratio("hit", "n_t").alias("recall")))


def overlaps(truth: DataFrame, found: DataFrame, width: int | None = None) -> DataFrame:
    """(series_id, label, start, end, p_label, p_start, p_end, overlap) of occurrences that share samples.

    Time is cut into bins of `width` samples (the mean length of an occurrence, if not given), an occurrence stands in
    every bin it touches, and only those of one bin meet; a pair counts in the bin where its overlap begins."""
    size = F.lit(width).cast("long").alias("width")
    if width is None:
        size = F.greatest(F.lit(1).cast("long"), F.ceil(F.avg(F.col("end") - F.col("start")))).alias("width")
    one = truth.select("start", "end").union(found.select("start", "end")).agg(size)  # one row
    sides = []
    for side, prefix in ((truth, ""), (found, "p_")):
        own = side.select("series_id", *(F.col(c).alias(f"{prefix}{c}") for c in ("label", "start", "end"))).join(F.broadcast(one))
        start, end = f"{prefix}start", f"{prefix}end"
        own = own.where(F.col(end) > F.col(start))
        sides.append(own.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("width")), F.floor((F.col(end) - 1) / F.col("width"))))))
    met = sides[0].join(sides[1].drop("width"), ["series_id", "bin"]).where("start < p_end AND p_start < end")
    met = met.where(F.col("bin") == F.floor(F.greatest("start", "p_start") / F.col("width"))).drop("bin", "width")
    return met.withColumn("overlap", F.least("end", "p_end") - F.greatest("start", "p_start"))


def label_overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, label, p_label, samples): samples that a true and a predicted label share."""
    p = points(found).withColumnRenamed("label", "p_label")
    return points(truth).join(p, ["series_id", "idx"]).groupBy("series_id", "label", "p_label").agg(F.count("*").alias("samples"))


def _solved(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column by column its row (-1: none), and dual values of rows and columns; no more rows than columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match[1:] - 1, u[1:], v[1:]


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest sum of gains, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    match = _solved(-(gain.T if flip else gain))[0]
    pairs = [(int(i), j) for j, i in enumerate(match) if i >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_first(gain: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairings with the largest sum of whole gains the first one: row after row takes its first column of some
    gain that still allows that sum, or none. Pairs with the largest sum are those that the dual values hold tight, so
    a row moves to a column if those it drives out find others along tight pairs."""
    n, size = len(gain), max(gain.shape)
    full = np.zeros((size, size))
    full[:n, : gain.shape[1]] = gain
    match, u, v = _solved(-full)
    row_of, col_of = match.copy(), np.argsort(match)
    free = -full == u[:, None] + v[None]

    def moved(i: int, j: int) -> bool:
        """Row i takes column j; whoever held it finds a way to the column that i leaves."""
        goal, start = col_of[i], row_of[j]
        came: dict[int, int] = {int(start): -1}
        queue = [int(start)]
        for r in queue:
            for c in np.flatnonzero(free[r]).tolist():
                if c == goal:
                    while r >= 0:  # back along the way, everyone moves up
                        left = col_of[r]
                        col_of[r], row_of[c], c, r = c, r, left, came[r]
                    col_of[i], row_of[j] = j, i
                    return True
                other = int(row_of[c])
                if c != j and other != i and other not in came:
                    came[other] = r
                    queue.append(other)
        return False

    for i in range(n):
        some = np.flatnonzero(free[i] & (full[i] > 0))
        for j in some.tolist():
            if col_of[i] == j or moved(i, j):
                free[i], free[:, j] = False, False
                free[i, j] = True
                break
        else:
            free[i, some] = False
    return [(i, int(col_of[i])) for i in range(n) if full[i, col_of[i]] > 0]


def matched_labels(truth: DataFrame, found: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(series_id, label, p_label): labels paired one to one for the largest number of shared samples; of equal numbers,
    the smallest true label has the smallest partner it can (none comes last), then the next. Kernel over the label
    pairs of a series that share any. shared: label_overlaps, if already made."""
    shared = label_overlaps(truth, found) if shared is None else shared

    def run(_: int, part: dict[str, np.ndarray]) -> list[tuple]:
        rows, i = np.unique(part["label"], return_inverse=True)
        cols, j = np.unique(part["p_label"], return_inverse=True)
        gain = np.zeros((len(rows), len(cols)))
        gain[i, j] = part["samples"]
        return [(int(rows[a]), int(cols[b])) for a, b in assign_first(gain)]

    return by_series(shared, ["label", "p_label"], run, "label long, p_label long")


def matched_samples(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(series_id, samples): samples that the paired labels share, the largest sum there is."""
    both = label_overlaps(truth, found).join(matched_labels(truth, found), ["series_id", "label", "p_label"])
    return both.groupBy("series_id").agg(F.sum("samples").alias("samples"))


def united(found: DataFrame) -> DataFrame:
    """All labels as one, 0; what touches or overlaps is one occurrence."""
    return islands(points(found).select("series_id", F.lit(0).cast("long").alias("label"), "idx"))


def _weights(sizes: DataFrame, weighted: bool) -> DataFrame:
    """(series_id, label, size, weight): equal weights of a series' true labels, or by their sizes."""
    own = Window.partitionBy("series_id")
    return sizes.withColumn("weight", F.col("size") / F.sum("size").over(own) if weighted else 1 / F.count("*").over(own))


def _weighted_sums(scored: DataFrame, by: list[str]) -> DataFrame:
    """Sums of precision, recall and their harmonic mean by weight; a label without a partner counts as 0."""
    sums = (F.sum(F.coalesce(c, F.lit(0.0)) * F.col("weight")).alias(c) for c in ("precision", "recall", "fscore"))
    return scored.groupBy(*by).agg(*sums)


def label_scores(truth: DataFrame, found: DataFrame, weighted: bool = False, matched: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """(series_id, precision, recall, fscore) on samples label by label, paired one to one; means over the true labels,
    or weighted by their samples. Series without true labels have no row. matched: matched_labels, shared:
    label_overlaps, if already made."""
    shared = label_overlaps(truth, found) if shared is None else shared
    matched = matched_labels(truth, found, shared) if matched is None else matched
    sizes = points(truth).groupBy("series_id", "label").agg(F.count("*").alias("size"))
    p_sizes = points(found).groupBy("series_id", F.col("label").alias("p_label")).agg(F.count("*").alias("p_size"))
    both = shared.join(matched, ["series_id", "label", "p_label"]).join(p_sizes, ["series_id", "p_label"])
    full = _weights(sizes, weighted).join(both.select("series_id", "label", "samples", "p_size"), ["series_id", "label"], "left")
    return _weighted_sums(_f1(full.withColumns({"precision": _ratio("samples", "p_size"), "recall": _ratio("samples", "size")}).fillna(0.0, ["precision", "recall"])), ["series_id"])


def _named(found: DataFrame, matched: DataFrame) -> DataFrame:
    """Predicted occurrences under the true label that theirs is paired with."""
    return found.select("series_id", F.col("label").alias("p_label"), "start", "end").join(matched, ["series_id", "p_label"]).select("series_id", "label", "start", "end")


def label_pairs(truth: DataFrame, named: DataFrame) -> DataFrame:
    """True and predicted occurrences of paired labels, paired one to one label by label."""
    return paired(overlaps(truth, named).where("label = p_label"))


def label_event_scores(truth: DataFrame, found: DataFrame, thresholds: list[float], weighted: bool = False, matched: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(series_id, threshold, precision, recall, fscore) on occurrences label by label, labels paired by samples; means
    over the true labels, or weighted by their numbers of occurrences. matched: matched_labels, pairs: label_pairs, if
    already made."""
    matched = matched_labels(truth, found) if matched is None else matched
    named = _named(found, matched)
    pairs = label_pairs(truth, named) if pairs is None else pairs
    sizes = _weights(truth.groupBy("series_id", "label").agg(F.count("*").alias("size")), weighted)
    every = sizes.join(named.groupBy("series_id", "label").agg(F.count("*").alias("n_p")), ["series_id", "label"], "left").withColumnRenamed("size", "n_t")
    return _weighted_sums(_right(pairs, every, thresholds, ["series_id", "label"]), ["series_id", "threshold"])


def battery(truth: DataFrame, found: DataFrame, series: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(series_id, metric, score): samples (united, by label, by label weighted), occurrences likewise at every
    threshold and their means over thresholds, and adjusted information."""
    thresholds = [k / 100 for k in range(101)] if thresholds is None else thresholds
    truth, found = stored(truth), stored(found)
    shared, one = stored(label_overlaps(truth, found)), [stored(united(t)) for t in (truth, found)]
    matched = stored(matched_labels(truth, found, shared))
    pairs = stored(label_pairs(truth, _named(found, matched)))
    out = adjusted_information(contingency(truth, found, series)).select("series_id", F.lit("amis").alias("metric"), F.col("ami").alias("score"))
    kinds = ("precision", "recall", "fscore")

    def tall(table: DataFrame, prefix: str, suffix: Column) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{prefix}-{c}"), suffix).alias("metric"), F.col(c).alias("score")) for c in kinds))).alias("x")
        return table.select("series_id", each).select("series_id", "x.metric", "x.score")

    for prefix, table in (("sss", sample_scores(truth, found)), ("ss", label_scores(truth, found, False, matched, shared)), ("w-ss", label_scores(truth, found, True, matched, shared))):
        out = out.union(tall(table, prefix, F.lit("")))
    for prefix, table in (("ses", event_scores(*one, thresholds)), ("es", label_event_scores(truth, found, thresholds, False, matched, pairs)), ("w-es", label_event_scores(truth, found, thresholds, True, matched, pairs))):
        table = stored(table)  # it serves twice
        out = out.union(tall(table, prefix, F.concat(F.lit("_"), F.round("threshold", 2).cast("string"))))
        means = threshold_mean(table)
        each = F.explode(F.array(*(F.struct(F.lit(f"{prefix}-auc-{c}").alias("metric"), F.col(c).alias("score")) for c in kinds))).alias("x")
        out = out.union(means.select("series_id", each).select("series_id", "x.metric", "x.score"))
    return out


def apart(side: list[tuple]) -> bool:
    """Whether sorted intervals share no sample."""
    return all(x[1] <= y[0] for x, y in zip(side, side[1:]))


def in_order(own: list[tuple]) -> list[tuple]:
    """The overlaps (start, end, label, p_start, p_end, p_label, overlap) of the best pairing of intervals that are apart
    on both sides, earlier ones taken where sums are equal."""
    own = sorted(set(own), key=lambda x: max(x[0], x[3]))
    same = [(x[:3] == y[:3], x[3:6] == y[3:6]) for x, y in zip(own, own[1:])] + [(False, False)]
    best = [[0, 0, 0, 0]]  # of what follows, if its first true (2) or predicted (1) interval is taken
    for x, (t, p) in zip(reversed(own), reversed(same), strict=True):
        rest = [best[-1][2 * (t and a) + (p and b)] for a in (0, 1) for b in (0, 1)]
        best.append([max(rest[0], x[6] + rest[3]), *rest[1:]])
    out, taken_t, taken_p = [], False, False
    for k, (x, (t, p)) in enumerate(zip(own, same, strict=True)):
        after = best[len(own) - 1 - k]
        if not taken_t and not taken_p and x[6] + after[2 * t + p] >= after[0]:
            out.append(x)
            taken_t = taken_p = True
        taken_t, taken_p = t and taken_t, p and taken_p
    return out


def paired(met: DataFrame) -> DataFrame:
    """(series_id, label, start, end, p_start, p_end, overlap): of overlaps those that pair true and predicted
    occurrences one to one for the largest sum. Where no occurrence overlaps another of its side, overlaps in time share
    occurrences with their neighbours alone: two passes find the best sum, in which earlier overlaps are taken where
    sums are equal. Elsewhere it is some best pairing."""

    def run(_: int, part: dict[str, np.ndarray]) -> list[tuple]:
        rows: list[tuple] = []
        every = list(zip(*(part[c].tolist() for c in ("start", "end", "label", "p_start", "p_end", "p_label", "overlap")), strict=True))
        for own in chains(every):
            ts, ps = sorted({x[:3] for x in own}), sorted({x[3:6] for x in own})
            if apart(ts) and apart(ps):
                rows += [(x[2], *x[:2], *x[3:5], x[6]) for x in in_order(own)]
                continue
            t, p = ({k: i for i, k in enumerate(side)} for side in (ts, ps))
            gain = np.zeros((len(ts), len(ps)))
            for x in own:
                gain[t[x[:3]], p[x[3:6]]] = x[6]
            rows += [(ts[i][2], *ts[i][:2], *ps[j][:2], int(gain[i, j])) for i, j in assign(gain) if gain[i, j] > 0]
        return rows

    def chains(every: list[tuple]) -> Iterator[list[tuple]]:
        """Overlaps that hang together in time; occurrences of different chains share none, so each is paired alone."""
        own: list[tuple] = []
        reach = 0
        for x in sorted(every, key=lambda x: (min(x[0], x[3]), x)):
            if own and min(x[0], x[3]) >= reach:
                yield own
                own = []
            reach = max(x[1], x[4], reach if own else 0)
            own.append(x)
        if own:
            yield own

    return by_series(met, ["start", "end", "label", "p_start", "p_end", "p_label"], run, "label long, start long, end long, p_start long, p_end long, overlap long")


def _right(pairs: DataFrame, sizes: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """sizes (by, n_t, n_p) with precision, recall and fscore at every threshold."""
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    shares = pairs.select(*by, (F.col("overlap") / (F.col("end") - F.col("start"))).alias("of_t"), (F.col("overlap") / (F.col("p_end") - F.col("p_start"))).alias("of_p"), levels)
    right = shares.groupBy(*by, "threshold").agg(*(F.sum((F.col(f"of_{c}") >= F.col("threshold")).cast("int")).alias(f"right_{c}") for c in "pt"))
    full = sizes.select("*", levels).join(right, [*by, "threshold"], "left").fillna(0, ["n_t", "n_p", "right_p", "right_t"])
    return _f1(full.withColumns({"precision": _ratio("right_p", "n_p"), "recall": _ratio("right_t", "n_t")}))


def event_scores(truth: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """(series_id, threshold, precision, recall, fscore): a predicted occurrence is right if it is paired one to one
    with a true one that it overlaps in at least a share of its own length; recall likewise by the true one's length."""
    sizes = [t.groupBy("series_id").agg(F.count("*").alias(c)) for t, c in ((truth, "n_t"), (found, "n_p"))]
    out = _right(paired(overlaps(truth, found)), sizes[0].join(sizes[1], "series_id", "full"), thresholds, ["series_id"])
    return out.select("series_id", "threshold", "precision", "recall", "fscore")


def threshold_mean(scores: DataFrame) -> DataFrame:
    """The mean over thresholds, an area under the curve."""
    return scores.groupBy("series_id").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "fscore")))


def contingency(truth: DataFrame, found: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, a, b, n): samples by the sum of label + 1 over true and over predicted occurrences, 0 outside."""
    sides = [points(t).groupBy("series_id", "idx").agg(F.sum(F.col("label") + 1).alias(c)) for t, c in ((truth, "a"), (found, "b"))]
    both = series.select("series_id", "idx").join(sides[0], ["series_id", "idx"], "left").join(sides[1], ["series_id", "idx"], "left").fillna(0, ["a", "b"])
    return both.groupBy("series_id", "a", "b").agg(F.count("*").alias("n"))


def adjusted_information(table: DataFrame) -> DataFrame:
    """(series_id, ami) from contingency counts: mutual information less its expectation, over the mean entropy less
    the same. Kernel over a series' counts."""

    def run(_: int, part: dict[str, np.ndarray]) -> list[tuple]:
        (rows, i), (cols, j) = (np.unique(part[c], return_inverse=True) for c in "ab")
        x, y, counts = np.bincount(i, part["n"]), np.bincount(j, part["n"]), part["n"].astype(float)
        n = counts.sum()
        mutual = float((counts / n * np.log(n * counts / (x[i] * y[j]))).sum())
        entropy = [-float((c / n * np.log(c / n)).sum()) for c in (x, y)]
        fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(n) + 1)))))  # logs of factorials
        chance = 0.0
        for a in x.astype(int).tolist():
            for b in y.astype(int).tolist():
                c = np.arange(max(1, a + b - int(n)), min(a, b) + 1)
                log_p = fact[a] + fact[b] + fact[int(n) - a] + fact[int(n) - b] - fact[int(n)] - fact[c] - fact[a - c] - fact[b - c] - fact[int(n) - a - b + c]
                chance += float((c / n * np.log(n * c / (a * b)) * np.exp(log_p)).sum())
        under = sum(entropy) / 2 - chance
        return [(1.0 if len(rows) == len(cols) == 1 else (mutual - chance) / under if abs(under) > 1e-15 else 0.0,)]

    return by_series(table, ["a", "b"], run, "ami double")
