"""Kernels against slow definitions, invariants, planted motifs and edge cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurva.operators import cuts, graph, latent, metrics, motifs, occurrences, profile, reports, runner
from recurva.sources import synth, tables

DRAW = np.random.default_rng(3)


def series(spark, *values):
    return spark.createDataFrame([(s, i, float(v)) for s, xs in enumerate(values) for i, v in enumerate(xs)], "series_id long, idx long, value double")


def test_flat_and_short_series_have_no_neighbours(spark):
    s = series(spark, [1.0] * 50, DRAW.normal(size=8), DRAW.normal(size=9), DRAW.normal(size=15), range(50))
    for name in ("znorm", "trend", "robust", "euclidean"):
        got = {r["series_id"] for r in profile.profile(s, 8, name).collect()}
        assert not got & {1, 2, 3} and (name == "euclidean" or 0 not in got) and (name != "trend" or 4 not in got)
    assert graph.knn_graph(s, 8, 3).count() == 0


def choose(dist, own, m, k, compacted):
    """One row's neighbours by the definition: the nearest, then its zone goes, and so on."""
    left = np.flatnonzero((np.abs(np.arange(len(dist)) - own) >= m) & np.isfinite(dist))
    out = []
    while len(left) and len(out) < k:
        p = int(dist[left].argmin())
        out.append(int(left[p]))
        zone = np.arange(len(left)) if compacted else left
        left = left[np.abs(zone - zone[p]) >= m]
    return out


def test_chosen_neighbours():
    for n, m, k in itertools.product((9, 60), (2, 8), (1, 3, 9)):
        dist, at = DRAW.random((n, n)), np.arange(n)
        lost = DRAW.random(n) < 0.05
        dist[:, lost] = dist[lost] = dist[np.abs(at[:, None] - at) < m] = np.inf
        for mode in ("time", "compacted"):
            got = profile.chosen(at, at, dist, k, graph.outside(m, mode))
            want = [(i, r, j) for i in range(n) for r, j in enumerate(choose(dist[i], i, m, k, mode == "compacted"), 1)]
            assert sorted(zip(*(got[c].tolist() for c in ("i", "rank", "j")))) == sorted(want)


def test_tiles_of_any_size_give_the_same_rows(spark, monkeypatch):
    s = series(spark, DRAW.normal(size=230).cumsum(), DRAW.normal(size=31), [*DRAW.normal(size=40), *[1.0] * 20, *DRAW.normal(size=40)])
    for make in (lambda t: graph.knn_graph(s, 8, 3, tile=t), lambda t: profile.nearest(s, 8, 4, tile=t), lambda t: profile.pairs(s, 8, "trend", tile=t)):
        assert sorted(map(tuple, make(1024).collect())) == sorted(map(tuple, make(16).collect()))


def test_repeated_intervals_of_two_labels_count_apart(spark):
    t = spark.createDataFrame([(0, 0, 3, 9), (0, 1, 3, 9), (0, 1, 20, 31)], "series_id long, label long, start long, end long")
    assert {tuple(r)[2:] for r in metrics.event_scores(t, t, [0.0, 1.0]).collect()} == {(1.0, 1.0, 1.0)}


def test_persistence_is_single_linkage(spark):
    s = series(spark, DRAW.normal(size=70).cumsum(), DRAW.normal(size=40))
    edges = graph.filtration(graph.knn_graph(s, 6, 3))
    rows, pers = edges.collect(), graph.persistence(edges).collect()
    births = {(r["series_id"], r["node"]): r["birth"] for r in graph.node_births(edges).collect()}
    for sid in (0, 1):
        own = [r for r in pers if r["series_id"] == sid]
        nodes = {n for s_, n in births if s_ == sid}
        assert len(own) == len(nodes) and all(r["birth"] <= r["death"] for r in own)
        for t in np.quantile([r["w"] for r in rows if r["series_id"] == sid], [0.1, 0.4, 0.8]):
            seen, left = 0, {n for n in nodes if births[sid, n] <= t}
            links = [(r["u"], r["v"]) for r in rows if r["series_id"] == sid and r["w"] <= t]
            while left:
                stack = [left.pop()]
                seen += 1
                while stack:
                    n = stack.pop()
                    for a, b in links:
                        if n in (a, b) and (other := a + b - n) in left:
                            left.remove(other)
                            stack.append(other)
            assert seen == sum(r["birth"] <= t for r in own) - sum(r["death"] <= t for r in own)


def test_equal_births_kill_the_first_root():
    forest = graph.Forest()
    forest.root(4, 1.0), forest.root(2, 1.0)
    assert forest.merge(4, 2) == 4 and forest.root(4, 9.0) == 2


def test_assignment_against_all_permutations():
    for shape in ((3, 3), (2, 4), (4, 2), (1, 1)):
        gain = DRAW.integers(0, 9, shape).astype(float)
        small, large = sorted(shape)
        best = max(sum(gain[(i, p) if shape[0] <= shape[1] else (p, i)] for i, p in enumerate(c)) for c in itertools.permutations(range(large), small))
        assert sum(gain[i, j] for i, j in metrics.assign(gain)) == best


def test_equal_labels_share_all_information(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 1, 7), (0, 2, 2, 9), (1, 0, 0, 5), (1, 0, 1, 5), (1, 1, 0, 5), (1, 1, 1, 5)], "series_id long, a long, b long, n long")
    got = {r["series_id"]: r["ami"] for r in metrics.adjusted_information(rows).collect()}
    assert got[0] == pytest.approx(1.0) and abs(got[1]) < 0.1


def test_exact_prediction_scores_one(spark):
    t = spark.createDataFrame([(0, 0, 3, 9), (0, 1, 20, 31)], "series_id long, label long, start long, end long")
    assert {tuple(r)[2:] for r in metrics.event_scores(t, t, [0.0, 0.5, 1.0]).collect()} == {(1.0, 1.0, 1.0)}
    assert metrics.event_scores(t, t.where("label = 9"), [0.5]).first()["fscore"] == 0.0


def test_equal_values_have_a_cut(spark):
    t = spark.createDataFrame([(0, 2.0)] * 5, "series_id long, x double")
    assert 1.5 <= cuts.otsu(t, "x").first()["cut"] <= 2.5
    assert cuts.gap_cut(t, "x", 3).first()["cut"] == 2.0


def test_stretch_keeps_its_ends_and_order(spark):
    xs = spark.range(21).selectExpr("id / 10.0D AS x").select(cuts.ktanh(F.col("x"), 10.0)).collect()
    ys = [r[0] for r in xs]
    assert ys[0] == 0 and ys[-1] == pytest.approx(2) and ys == sorted(ys)


def test_tiles_give_the_profile(spark):
    s = series(spark, DRAW.normal(size=230).cumsum(), DRAW.normal(size=31))
    want = {tuple(r) for r in profile.profile(s, 8, "znorm").collect()}
    assert {tuple(r) for r in profile.tiled_profile(s, 8, "znorm", tile=32).collect()} == want


def test_painted_runs_do_not_overlap(spark):
    nodes = spark.createDataFrame([(0, 1, n, b) for n, b in ((0, 0.1), (1, 0.2), (2, 0.3), (20, 0.1))] + [(0, 2, 4, 0.05), (0, 2, 40, 0.5)], "series_id long, label long, node long, birth double")
    got = sorted(tuple(r)[1:4] for r in occurrences.paint(nodes, 8).collect())
    assert got == [(1, 20, 28), (2, 4, 12), (2, 40, 48)]
    assert sorted(tuple(r)[1:4] for r in occurrences.paint(nodes.where("label = 1"), 8).collect()) == [(1, 0, 10), (1, 20, 28)]


def test_planted_motifs_are_found(spark):
    s, truth = synth.planted(spark, 4, n_motifs=2, length=24, repeats=(3, 4), noise=0.02, gap=0.5, seed=1)
    for found in (motifs.persistent_motifs(s, 20, 3, n=2), motifs.profile_motifs(s, 20, 2, 4.0)):
        scores = metrics.event_scores(truth, found, [0.5]).agg({"recall": "avg"}).first()[0]
        assert scores > 0.4
    again, _ = synth.planted(spark, 4, n_motifs=2, length=24, repeats=(3, 4), noise=0.02, gap=0.5, seed=1)
    assert s.exceptAll(again).isEmpty()


def test_configs_and_scores(spark, tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps({"a": json.dumps([{"m": 8}, {"m": 9}]), "b": json.dumps([{"k": 1}])}))
    got = [(r["algorithm"], r["config_idx"], r["params"]) for r in tables.configs(spark, str(tmp_path / "c.json")).collect()]
    assert sorted(got) == [("a", 0, {"m": "8"}), ("a", 1, {"m": "9"}), ("b", 0, {"k": "1"})]
    assert tables.grid(spark, m=[1, 2], k=[3, 4, 5]).count() == 6
    rows = spark.createDataFrame([("f", 0.5, "a", 0, 1.0, 0, 2, 2)], tables.SCORES)
    tables.append_scores(rows, str(tmp_path / "s"))
    tables.append_scores(rows, str(tmp_path / "s"))
    assert tables.read_scores(spark, str(tmp_path / "s")).count() == 2


def test_scores_by_label(spark):
    t = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 20, 30), (0, 1, 40, 50)], "series_id long, label long, start long, end long")
    p = spark.createDataFrame([(0, 7, 0, 10), (0, 8, 40, 45)], "series_id long, label long, start long, end long")
    assert tuple(metrics.label_scores(t, p).first())[1:] == pytest.approx((1.0, 0.5, (2 / 3 + 2 / 3) / 2))
    assert tuple(metrics.label_scores(t, p, True).first())[1:] == pytest.approx((1.0, 2 / 3 * 0.5 + 1 / 3 * 0.5, 2 / 3))
    got = {r["threshold"]: tuple(r)[2:] for r in metrics.label_event_scores(t, p, [0.4, 0.6]).collect()}
    assert got[0.4] == pytest.approx((1.0, 0.75, (2 / 3 + 1) / 2)) and got[0.6][1] == pytest.approx(0.25)
    weighted = {r["threshold"]: tuple(r)[2:] for r in metrics.label_event_scores(t, p, [0.4], True).collect()}
    assert weighted[0.4] == pytest.approx((1.0, 2 / 3 * 0.5 + 1 / 3, 2 / 3 * 2 / 3 + 1 / 3))
    s = series(spark, [0.0] * 60)
    names = {r["metric"]: r["score"] for r in metrics.battery(t, p, s).collect()}
    assert len(names) == 928 and names["sss-recall"] == 0.5 and names["ses-precision_0.5"] == 1.0 and "w-es-auc-fscore" in names and "es-recall_1.0" in names
    assert {r["score"] for r in metrics.battery(t, t, s, [0.5]).collect()} == {1.0}


def test_the_battery_makes_each_pairing_once(spark, monkeypatch):
    t = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 20, 30), (0, 1, 40, 50)], "series_id long, label long, start long, end long")
    p = spark.createDataFrame([(0, 7, 0, 10), (0, 8, 40, 45)], "series_id long, label long, start long, end long")
    made = []
    for name in ("paired", "label_overlaps", "matched_labels"):
        monkeypatch.setattr(metrics, name, lambda *x, n=name, f=getattr(metrics, name): (made.append(n), f(*x))[1])
    got = {r["metric"]: r["score"] for r in metrics.battery(t, p, series(spark, [0.0] * 60), [0.4, 0.6]).collect()}
    assert sorted(made) == ["label_overlaps", "matched_labels", "paired", "paired"]  # occurrences united, and by label
    for prefix, weighted in (("", False), ("w-", True)):
        assert got[f"{prefix}ss-recall"] == metrics.label_scores(t, p, weighted).first()["recall"]
        assert {got[f"{prefix}es-fscore_{x}"] for x in (0.4, 0.6)} == {r["fscore"] for r in metrics.label_event_scores(t, p, [0.4, 0.6], weighted).collect()}


def test_cuts_of_births_and_persistence(spark):
    births, lives = DRAW.random(80), np.concatenate((0.1 * DRAW.random(70), 3 + DRAW.random(10)))
    pers = spark.createDataFrame([(0, float(b), float(b + x)) for b, x in zip(births, lives)], "series_id long, birth double, death double")
    for got in (cuts.split_cuts(pers), cuts.outlier_cuts(pers.union(pers.limit(0)), 0.95)):
        assert 0.0 < got.first()["p_cut"] < 3.5
    skewed, mixed = cuts.split_cuts(pers, "skewed").first(), cuts.mixed_cuts(pers).first()
    assert skewed["b_cut"] <= cuts.split_cuts(pers).first()["b_cut"] and mixed["b_cut"] < 1
    grid, u, v = np.histogram2d(lives, births, bins=32)
    share = grid / grid.sum()
    best, at = -1.0, None
    for i in range(32):
        for j in range(32):
            w = share[: i + 1, : j + 1].sum()
            if 1e-12 < w * (1 - w):
                x, y = (u[:-1, None] * share)[: i + 1, : j + 1].sum(), (v[:-1] * share)[: i + 1, : j + 1].sum()
                score = ((x - w * (u[:-1, None] * share).sum()) ** 2 + (y - w * (v[:-1] * share).sum()) ** 2) / (w * (1 - w))
                best, at = (score, (u[i], v[j])) if score > best * (1 + 1e-9) else (best, at)
    assert tuple(cuts.plane_cuts(pers, 32).first())[1:] == pytest.approx(at)


def test_runs_are_scored_and_failures_kept(spark, tmp_path, monkeypatch):
    def few(truth, found, series, thresholds):  # the whole battery is tested by itself
        return metrics.sample_scores(truth, found).select("series_id", F.lit("es-fscore_0.5").alias("metric"), F.col("fscore").alias("score"))

    monkeypatch.setattr(metrics, "battery", few)
    s, truth = synth.planted(spark, 3, n_motifs=1, length=16, repeats=(3, 3), noise=0.02, gap=0.5, seed=2)
    configs = spark.createDataFrame([("profile", 0, {"m": "12", "n": "7", "ratio": "1.2"}), ("profile", 1, {"q": "1"}), ("breaks", 0, {"m": "12"})], "algorithm string, config_idx int, params map<string,string>")
    asked = []

    def search(series, **params):
        asked.append(params)
        return motifs.profile_motifs(series, **params)

    def breaks(series, m):
        own = series.withColumn("value", F.when(F.col("series_id") == 1, F.raise_error("no")).otherwise(F.col("value")))
        return motifs.profile_motifs(own, m, 1)

    searches, path = {"profile": search, "breaks": breaks}, str(tmp_path / "runs")
    failed = runner.run(s, truth, searches, configs, path, [0.5], batch=2).collect()
    assert sorted((r["algorithm"], r["config_idx"], r["signal_idx"]) for r in failed) == [("breaks", 0, 1), ("profile", 1, 0), ("profile", 1, 1), ("profile", 1, 2)]
    assert all(r["error"].startswith("TypeError") for r in failed if r["algorithm"] == "profile")
    assert {"m": 12, "n": 1, "ratio": 1.2} in asked  # the true number of labels
    rows = runner.scores(spark, path)
    assert rows.columns == [c.split()[0] for c in tables.SCORES.split(", ")]
    one = rows.where("metric = 'es-fscore_0.5'")
    assert sorted((r["algorithm"], r["signal_idx"]) for r in one.collect()) == [("breaks", 0), ("breaks", 2), ("profile", 0), ("profile", 1), ("profile", 2)]
    assert rows.where("execution_time > 0 AND n_patterns = 1").count() == rows.count()
    before = len(asked)
    assert len(runner.run(s, truth, searches, configs, path, [0.5]).collect()) == 4 and len(asked) == before
    more, more_truth = synth.planted(spark, 4, n_motifs=1, length=16, repeats=(3, 3), noise=0.02, gap=0.5, seed=2)
    runner.run(more, more_truth, searches, configs, path, [0.5])
    assert one.count() == 5 and runner.scores(spark, path).where("metric = 'es-fscore_0.5' AND signal_idx = 3").count() == 2
    errors = {(r["algorithm"], r["signal_idx"]): r["error"] for r in reports.count_error(rows, ["algorithm"]).collect()}
    assert len(errors) == 5 and errors["profile", 0] == rows.where("algorithm = 'profile' AND signal_idx = 0").first()["predicted_n_patterns"] - 1
    empty = runner.run(s.limit(0), truth.limit(0), searches, configs, str(tmp_path / "none"))
    assert empty.collect() == [] and runner.scores(spark, str(tmp_path / "none")).collect() == []
    guide = spark.createDataFrame([(10, 1.0), (10, 3.0), (20, 5.0)], "length int, time double")
    assert sorted(map(tuple, reports.quadratic_guide(guide, "length", "time").collect())) == [(10, 2.0), (20, 8.0)]
    assert [tuple(r) for r in reports.renamed(guide.selectExpr("'a' AS x", "time"), "x", {"a": "A"}, ["B", "A"]).limit(1).collect()] == [("A", 1.0, 2)]


def test_values_of_parameters():
    assert [runner.value_of(x) for x in ("12", "1.5", "null", "true", "[1, 2]", '"a"', "trend", None)] == [12, 1.5, None, True, [1, 2], "a", "trend", None]


def test_sweeps_and_results(spark, tmp_path):
    configs = spark.createDataFrame([("a", 0, {"m": "8", "k": "1"}), ("a", 1, {"m": "9"})], "algorithm string, config_idx int, params map<string,string>")
    got = sorted((r["config_idx"], tuple(sorted(r["params"].items()))) for r in tables.swept(configs, "k", [1, 5, None]).collect())
    assert got == [(i, (("k", k), ("m", m))) for i, (m, k) in enumerate((m, k) for m in "89" for k in ("1", "5", "null"))]
    head = "," + ",".join(c.split()[0] for c in tables.SCORES.split(", "))
    for name, score in (("ecg_A_0", 0.5), ("arm_A_0", 0.25), ("arm_A_1", 0.75)):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n0,es-fscore_0.5,{score},A,0,1.5,3,2,4\n")
    got = tables.read_results(spark, str(tmp_path), "_A_0.csv")
    assert sorted((r["source"], r["score"], r["signal_idx"]) for r in got.collect()) == [("arm", 0.25, 3), ("ecg", 0.5, 3)]
    both = reports.together(one=got.select("score"), two=got.select("metric", "score"))
    assert both.count() == 4 and both.where("source = 'one' AND metric IS NULL").count() == 2


def test_rounds_give_the_rows_of_the_kernel(spark):
    draw = np.random.default_rng(12)
    s = series(spark, draw.normal(size=300).cumsum(), draw.normal(size=60), [1.0] * 30, draw.normal(size=9))
    edges = graph.filtration(graph.knn_graph(s, 6, 3))
    columns = ["series_id", "seed", "birth", "death", "u", "v", "w"]
    rows = [sorted(map(str, f(edges).select(columns).collect())) for f in (graph.persistence, graph.persistence_by_rounds)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    # A path whose edges grow, and one that has the oldest nodes at its ends.
    path = [(7, r, r, r + 1, float(r)) for r in range(40)] + [(8, r, r, r + 1, float(min(r, 39 - r))) for r in range(40)]
    order = sorted(path, key=lambda e: (e[0], e[4], e[2]))
    table = spark.createDataFrame([(s_, i, u, v, w) for i, (s_, _, u, v, w) in enumerate(order)], "series_id long, rank int, u long, v long, w double")
    rows = [sorted((r["series_id"], r["birth"], r["death"], r["u"], r["v"]) if r["u"] is not None else (r["series_id"], r["birth"]) for r in f(table).collect()) for f in (graph.persistence, graph.persistence_by_rounds)]
    assert rows[0] == rows[1]
    assert graph.persistence_by_rounds(table.limit(0)).collect() == []


def test_edges_that_join_nothing_stay_out_of_the_rounds(spark, monkeypatch):
    draw = np.random.default_rng(14)
    for _ in range(200):  # against a union-find, edge by edge
        n, k = draw.integers(1, 12), draw.integers(0, 30)
        u, v = draw.integers(0, n, (2, k))
        forest = graph.Forest()
        want = [(a := forest.root(x, 0)) != (b := forest.root(y, 0)) and forest.merge(a, b) >= 0 for x, y in zip(u.tolist(), v.tolist())]
        assert graph.joining(u, v).tolist() == want
    table = [(s, r, int(a), int(b), float(r // 3)) for s in range(40) for r, (a, b) in enumerate(draw.integers(0, 30, (120, 2)))]  # loops too
    table = spark.createDataFrame([table[i] for i in draw.permutation(len(table))], "series_id long, rank int, u long, v long, w double")
    want = sorted(map(str, graph.persistence(table).select("series_id", "birth", "death", "w").collect()))
    sizes = []
    monkeypatch.setattr(graph, "stored", lambda df, f=graph.stored: (sizes.append((made := f(df)).count()), made)[1])
    for most, rows in ((1 << 18, 40 * 50), (100, None)):  # few together: less is left out, with the same result
        monkeypatch.setattr(graph, "THINNED", most)
        sizes.clear()
        got = graph.persistence_by_rounds(table.repartition(1, "series_id"))
        assert sorted(map(str, got.select("series_id", "birth", "death", "w").collect())) == want
        assert rows is None or max(sizes) < rows  # of 4,800


def test_radius_neighbours_one_by_one(spark):
    draw = np.random.default_rng(13)
    n, m = 80, 4
    dist, at = np.round(draw.random((n, n)), 2), np.arange(n)
    dist[np.abs(at[:, None] - at) < m] = np.inf
    for overshoot in (False, True):
        got = profile.within(at, at, dist, 0.3, m, overshoot)
        want = []
        for i in range(n):
            left, rank, last = np.isfinite(dist[i]), 0, dist[i].min()
            while left.any() and last < 0.3:
                j = int(np.where(left, dist[i], np.inf).argmin())
                if not overshoot and dist[i, j] >= 0.3:
                    break
                last, rank = dist[i, j], rank + 1
                want.append((i, rank, j))
                left &= np.abs(at - j) >= m
        assert list(zip(*(got[c].tolist() for c in ("i", "rank", "j")))) == want
    s = series(spark, draw.normal(size=90).cumsum())
    near = motifs.radius_neighbours(s, 6, 2.0, relative=True).collect()
    least = {r["i"]: r["dist"] for r in near if r["rank"] == 1}
    assert len(least) == 85 and all(r["dist"] < 2 * least[r["i"]] for r in near)


def test_long_windows_cost_no_more_than_short_ones():
    from recurva.functions.distance import DISTANCES, Crossing, block

    draw = np.random.default_rng(14)
    for name, d in DISTANCES.items():
        xs = np.concatenate((draw.normal(size=700).cumsum() + 1e4, np.ones(60), 1e-3 * draw.normal(size=300), draw.normal(size=400)))
        xs[1200:1300] = xs[100:200]
        m = 20
        windows = np.lib.stride_tricks.sliding_window_view(xs, m)
        normal = d.np_normal(windows)
        want = block(d, normal, normal, m)
        want[np.isnan(want) | (np.abs(np.subtract.outer(np.arange(len(windows)), np.arange(len(windows)))) < m)] = np.inf
        got = np.concatenate([dist for _, dist in Crossing(d, xs, m).rows(0, len(windows))])
        both = np.isfinite(want)
        assert (both == np.isfinite(got)).all() and np.abs(got - want)[both].max() < 2e-8 * max(1, want[both].max()), name


def test_grammar_keeps_both_invariants():
    import random
    from collections import Counter

    from recurva.operators.symbolic import Grammar

    draw = random.Random(0)
    for _ in range(300):
        words = [draw.randrange(draw.choice((1, 2, 4))) for _ in range(draw.randrange(0, 60))]
        grammar = Grammar(words)
        rules, todo = [], [grammar.start]
        while todo:
            if (rule := todo.pop()) not in rules:
                rules.append(rule)
                todo += [x.rule for x in rule.symbols() if x.rule]
        uses = Counter(x.rule for r in rules for x in r.symbols() if x.rule)
        assert all(uses[r] >= 2 for r in rules[1:])
        seen = {}
        for r in rules:
            own = [(x.value, x.rule) for x in r.symbols()]
            for k, pair in enumerate(zip(own, own[1:])):
                if pair in seen:  # only two that overlap
                    assert seen[pair] == (r, k - 1) and pair[0] == pair[1]
                seen.setdefault(pair, (r, k))

        def said(rule):
            return [w for x in rule.symbols() for w in (said(x.rule) if x.rule else [x.value])]

        assert said(grammar.start) == words
        assert all(words[a:b] == said(r) for r, places in grammar.spans().items() for a, b in places)


def test_repeated_words_are_motifs(spark):
    from recurva.operators import symbolic

    shape = [np.sin(np.arange(24) / 3), np.sign(np.sin(np.arange(24) / 2)) * np.arange(24) / 10]
    xs = np.concatenate([np.concatenate((shape[k], 0.3 * DRAW.normal(size=9).cumsum())) for k in (0, 1, 0, 0, 1, 1, 0, 1)])
    for how in ("close", "equal", "none"):
        rows = symbolic.grammar_motifs(series(spark, xs), 8, 4, 3, 2, how).collect()
        assert rows and all(r["start"] < r["end"] <= len(xs) for r in rows)
        for label in {r["label"] for r in rows}:
            own = sorted((r["start"], r["end"]) for r in rows if r["label"] == label)
            assert len(own) >= 2 and all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    with pytest.raises(ValueError):
        symbolic.grammar_motifs(series(spark, xs), 8, 4, 3, 2, "other")


def test_new_cuts_make_no_new_search(spark, tmp_path, monkeypatch):
    s, _ = synth.planted(spark, 3, n_motifs=2, length=20, repeats=(3, 4), noise=0.02, gap=0.5, seed=3)
    columns = ["series_id", "label", "start", "end", "birth"]
    want = {n: sorted(map(str, motifs.persistent_motifs(s, 12, 3, n=n).select(columns).collect())) for n in (1, 2)}
    assert sorted(map(str, motifs.persistent_motifs(s, 12, 3, n=1, path=str(tmp_path)).select(columns).collect())) == want[1]
    monkeypatch.setattr(profile, "scan", None)  # no distance can be computed any more
    assert sorted(map(str, motifs.persistent_motifs(s, 12, 3, n=2, path=str(tmp_path)).select(columns).collect())) == want[2]
    pers = motifs.searched(s, 12, 3, path=str(tmp_path))
    assert motifs.cut_motifs(pers, 12, cuts_at=(1.5, 0.2), beta=0.5, own_cuts=False).count() >= 0
    with pytest.raises(TypeError):
        motifs.searched(s, 13, 3, path=str(tmp_path)).count()


def test_stretches_by_cells():
    import random

    draw = random.Random(6)
    for _ in range(200):
        stretches, owner = occurrences.Stretches(), {}
        for _ in range(60):
            a = draw.randrange(60)
            b, own = a + draw.randint(1, 9), draw.randrange(3)
            free = all(owner.get(c, own) == own for c in range(a, b))
            assert stretches.claim(a, b, own) == free
            if free:
                owner.update(dict.fromkeys(range(a, b), own))
        held = {c: o for s_, e, o in zip(stretches.starts, stretches.ends, stretches.owners) for c in range(s_, e)}
        assert held == owner and stretches.starts == sorted(stretches.starts)
        assert all(e < s_ or o != p for e, s_, o, p in zip(stretches.ends, stretches.starts[1:], stretches.owners, stretches.owners[1:]))


def test_births_of_occurrences(spark):
    prof = spark.createDataFrame([(0, i, float(d)) for i, d in enumerate(DRAW.random(60)) if i % 7], "series_id long, i long, dist double")
    found = spark.createDataFrame([(0, 1, a, a + n) for a in range(0, 50, 3) for n in (2, 6, 17)], "series_id long, label long, start long, end long")
    dist = {r["i"]: r["dist"] for r in prof.collect()}
    for parity in (False, True):
        for r in occurrences.with_births(found, prof, 6, parity).collect():
            own = [dist[i] for i in range(r["start"], r["end"] - 6 + (3 if parity else 1)) if i in dist]
            assert r["birth"] == (min(own) if own else None)


def test_planes_below_both_cuts(spark):
    births, lives = DRAW.random(120), np.concatenate((0.1 * DRAW.random(80), 1 + DRAW.random(20), 4 + DRAW.random(20)))
    pers = spark.createDataFrame([(0, float(b), float(b + x)) for b, x in zip(births, lives)], "series_id long, birth double, death double")
    once = cuts.plane_cuts(pers, 64).first()
    below = pers.where(f"death - birth < {once['p_cut']} AND birth < {once['b_cut']}")
    assert tuple(cuts.plane_cuts(pers, 64, "skewed").first()) == tuple(cuts.plane_cuts(below, 64).first() or once)
    below = pers.where(f"death - birth < {once['p_cut']} AND death - birth < {once['b_cut']}")
    assert tuple(cuts.plane_cuts(pers, 64, "published").first()) == tuple(cuts.plane_cuts(below, 64).first() or once)


NODES = "series_id long, label long, node long, birth double"


def test_painting_as_published(spark):
    # Label 1's first run is one with label 0's last, so both may claim sample 12.
    nodes = spark.createDataFrame([(0, 0, 0, 0.1), (0, 0, 9, 0.2), (0, 1, 12, 0.3), (0, 1, 13, 0.4), (0, 1, 30, 0.5)], NODES)
    assert sorted(tuple(r)[1:] for r in occurrences.paint(nodes, 4, parity=True).collect()) == [(0, 1, 3, 0.1), (0, 10, 12, 0.2), (1, 13, 16, 0.3), (1, 31, 33, 0.5)]
    assert sorted(tuple(r)[1:4] for r in occurrences.paint(nodes, 4).collect()) == [(0, 0, 4), (0, 9, 13), (1, 13, 17), (1, 30, 34)]


def test_runs_reach_on(spark):
    rows = [(0, int(k), int(n), float(b)) for n, k, b in zip(range(0, 300), DRAW.integers(0, 3, 300), DRAW.permutation(300)) if DRAW.random() < 0.5]
    for least in (1, 4, 9):
        runs = {}
        for label in range(3):
            for _, k, n, b in [r for r in rows if r[1] == label]:
                start = next((s for s in runs if runs[s][0] == label and runs[s][1] == n - 1), n)
                old = runs.get(start, (label, n, np.inf))
                runs[start] = (label, n, min(b, old[2]))
        kept, want = set(runs), []
        for start in sorted(runs, key=lambda s: -runs[s][2]):
            end = min([runs[start][1] + 9, *(s for s in kept if s > start)])
            before = max((s for s in kept if s < start), default=-np.inf)
            if end - start >= least and start - before >= least:
                want.append((runs[start][0], start, end, runs[start][2]))
            else:
                kept.remove(start)
        assert sorted(tuple(r)[1:] for r in occurrences.extended(spark.createDataFrame(rows, NODES), 9, least).collect()) == sorted(want)


def test_motifs_over_all_lengths(spark):
    xs = DRAW.normal(size=160).cumsum()
    s = series(spark, xs, [1.0] * 40)
    lengths, ratio = [6, 9, 14], 1.5

    def distance(m, i, j):
        a, b = (xs[k : k + m] - xs[k : k + m].mean() for k in (i, j))
        return round(float(np.linalg.norm(a / a.std() - b / b.std())), 9)

    for paired in (False, True):
        used, want = set(), []
        free = lambda i, m: not used & set(range(i, i + m))
        near = {(m, i): min((distance(m, i, j), j) for j in range(len(xs) - m + 1) if abs(i - j) >= m) for m in lengths for i in range(len(xs) - m + 1)}
        for (m, i), (d, j) in sorted(near.items(), key=lambda x: (x[1][0] / x[0][0] ** 0.5, -x[0][0], x[0][1])):
            if len({w[0] for w in want}) == 4 or not free(i, m) or paired and not free(j, m):
                continue
            own = [i, j] if paired else [i]
            close = sorted((min(distance(m, p, q) for p in own[: 1 + paired]), q) for q in range(len(xs) - m + 1) if free(q, m) and all(abs(p - q) >= m for p in own))
            for c, q in close:
                if c < ratio * d and all(abs(q - p) >= m for p in own):
                    own.append(q)
            if len(own) > 1:
                label = len({w[0] for w in want})
                want += [(label, p, p + m) for p in own]
                used |= {x for p in own for x in range(p, p + m)}
        got = motifs.seeded_motifs(s, lengths, 4, ratio, "znorm", paired).collect()
        assert sorted(tuple(r)[1:] for r in got) == sorted(want) and {r["series_id"] for r in got} == {0}


def test_planted_patterns(spark):
    xs, ys = np.linspace(0, 1, 7), DRAW.normal(size=7)
    assert synth.spline(xs, ys)(xs) == pytest.approx(ys)
    t = np.linspace(0, 1, 50)
    assert synth.spline(xs, 2 * xs**3 - xs)(t) == pytest.approx(2 * t**3 - t) and synth.spline(xs[:3], xs[:3] ** 2)(t) == pytest.approx(t**2)
    s, truth = synth.planted(spark, 5, n_motifs=2, novelties=3, kind="cubic", amplitude=(2.0, 3.0), swell=0.2, stretch=0.3, gap_stretch=0.5, noise=0.0, seed=4)
    times = {(r["series_id"], r["label"]): r["count"] for r in truth.groupBy("series_id", "label").count().collect()}
    assert len(times) == 25 and all((n == 1) == (label >= 2) for (_, label), n in times.items())
    flat = s.join(truth, "series_id").where("idx >= start AND idx < end").groupBy("series_id", "label", "start").agg(F.max(F.abs("value")).alias("most"))
    assert flat.where("most < 0.01").isEmpty()


def test_ranks_of_complete_groups(spark):
    rows = [("x", "a", 3.0), ("x", "b", 2.0), ("x", "c", 1.0), ("y", "a", 2.0), ("y", "b", 2.0), ("y", "c", 1.0), ("z", "a", 1.0)]
    t = spark.createDataFrame(rows, "dataset string, algorithm string, score double")
    assert tuple(reports.friedman(t, ["dataset"], "algorithm").first()) == pytest.approx((2, 3, 12 * 2 / 12 * (1.25**2 + 1.75**2 + 9 - 12)))
    got = {(r["better"], r["worse"]): (r["difference"], r["z"]) for r in reports.rank_differences(t, ["dataset"], "algorithm").collect()}
    assert got[("a", "c")] == pytest.approx((1.75, 1.75)) and len(got) == 3
    assert reports.friedman(t.limit(0), ["dataset"], "algorithm").isEmpty() and reports.rank_differences(t.limit(0), ["dataset"], "algorithm").isEmpty()


def test_shapes_by_rounds_and_by_kernel(spark):
    """Tiles shorter than a window, flat stretches, a flat series, two starts."""
    wave = np.sin(np.arange(12) / 2)
    xs = DRAW.normal(size=200)
    for p in (10, 60, 120, 170):
        xs[p : p + 12] = 5 * wave + DRAW.normal(size=12) / 10
    xs[80:100] = 1.0
    s = series(spark, xs, [2.0] * 40, DRAW.normal(size=12), DRAW.normal(size=5))
    for starts, tile in ((1, 7), (2, 50)):
        kernel = motifs.latent_motifs(s, 12, 2, 0.4, rounds=8, starts=starts)
        rounds = latent.latent_by_rounds(s, 12, 2, 0.4, rounds=8, starts=starts, tile=tile)
        want = sorted(map(tuple, kernel.collect()))
        assert want and sorted(map(tuple, rounds.collect())) == want
    assert latent.latent_by_rounds(s.where("idx < 0"), 12, 2, 0.4, rounds=1).count() == 0


def test_first_of_equal_pairings():
    for _ in range(300):
        n, m = DRAW.integers(1, 5, 2)
        gain = DRAW.integers(0, 4, (n, m)).astype(float)
        every = [[j if j is not None and gain[i, j] > 0 else None for i, j in enumerate(c)] for c in itertools.product([*range(m), None], repeat=n) if len(x := [j for j in c if j is not None]) == len(set(x))]
        most = max(sum(gain[i, j] for i, j in enumerate(c) if j is not None) for c in every)
        best = [c for c in every if sum(gain[i, j] for i, j in enumerate(c) if j is not None) == most]
        want = min(best, key=lambda c: [m if j is None else j for j in c])
        assert metrics.assign_first(gain) == [(i, j) for i, j in enumerate(want) if j is not None]


def test_overlaps_paired_in_order():
    for _ in range(300):
        sides = []
        for _ in "tp":
            cuts_at = sorted(DRAW.choice(25, 2 * int(DRAW.integers(1, 5)), replace=False).tolist())
            sides.append([(a, b, 0) for a, b in zip(cuts_at[::2], cuts_at[1::2])])
        met = [(*t, *p, min(t[1], p[1]) - max(t[0], p[0])) for t in sides[0] for p in sides[1] if t[0] < p[1] and p[0] < t[1]]
        met.sort(key=lambda x: max(x[0], x[3]))
        best = max(
            (sum(x[6] for x in own), [x in own for x in met])
            for r in range(len(met) + 1)
            for own in itertools.combinations(met, r)
            if len({x[:3] for x in own}) == len({x[3:6] for x in own}) == r
        )
        assert [x in metrics.in_order(met) for x in met] == best[1]


def test_shapes_of_many_series_are_learned_together(monkeypatch):
    """To the last bit as alone, in far fewer steps."""
    draw, calls = np.random.default_rng(11), []
    xs = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (draw.normal(size=(k % 3 + 2, 8)) if k % 2 else draw.normal(size=(40, 8)) for k in range(30))]
    given = dict(n=3, m=8, radius=0.5, alpha=1.0, rate=0.1, rounds=6, seed=0, starts=2)
    monkeypatch.setattr(latent, "pulls", lambda *x, f=latent.pulls: (calls.append(1), f(*x))[1])
    some = latent.learned(list(range(30)), xs, **given)
    assert len(calls) == 4 * 2 * 7  # four numbers of windows, two starts, six rounds and the last value
    for i, x in enumerate(xs):
        assert np.array_equal(some[i], latent.learned([i], [x], **given)[0])
