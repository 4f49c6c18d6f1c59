"""DuckDB SQL that gives the rows of the queries, built from shared parts."""

from __future__ import annotations

from statistics import NormalDist

EVENTS = "SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, CAST(value AS DOUBLE) AS value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"
EMBEDDINGS = "SELECT vec_id AS series_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"
DAILY = """WITH b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT CAST(0 AS BIGINT) AS series_id, CAST(d.day - (SELECT min(day) FROM b) AS BIGINT) AS idx, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM d LEFT JOIN b USING (day)"""
DAILY_ROUNDED = f"SELECT series_id, idx, round(value, 4) AS value FROM ({DAILY})"


def _frame(m: int) -> str:
    return f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)"


def _windows(m: int = 8, series: str = EVENTS) -> str:
    return f"SELECT series_id, idx AS i, w FROM (SELECT series_id, idx, list(value) OVER {_frame(m)} AS w FROM ({series})) WHERE len(w) = {m}"


def series_index() -> str:
    return f"SELECT series_id, idx, round(value, 6) AS value FROM ({EVENTS})"


def rolling(*columns: str, m: int = 8, series: str = EVENTS) -> str:
    t_var = (m * m - 1) / 12
    parts = f"""SELECT series_id, idx AS i, count(value) OVER f AS n, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS std, sum(value * value) OVER f AS energy,
    covar_pop(value, idx) OVER f / {t_var} AS slope FROM ({series}) WINDOW f AS {_frame(m)}"""
    whole = f"SELECT *, sqrt({m} * greatest(0, std * std - slope * slope * {t_var})) AS detrended_norm FROM ({parts}) WHERE n = {m}"
    return f"SELECT series_id, i, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ({whole})"


def _median(xs: str, m: int = 8) -> str:
    return f"((list_sort({xs}))[{(m - 1) // 2 + 1}] + (list_sort({xs}))[{m // 2 + 1}]) / 2"


def robust(column: str) -> str:
    med = f"SELECT series_id, i, w, {_median('w')} AS median FROM ({_windows()})"
    mad = _median("list_transform(w, lambda x: abs(x - median))")
    return f"SELECT series_id, i, round({column}, 6) AS {column} FROM (SELECT series_id, i, median, {mad} AS mad FROM ({med}))"


_NORMAL = {
    "raw": ("0", "1"),
    "z": ("mean", "sqrt(list_sum(list_transform(w, lambda x: (x - mean) * (x - mean))))"),
    "cosine": ("0", "sqrt(list_sum(list_transform(w, lambda x: x * x)))"),
}
_FINISH = {
    "euclidean": "sqrt(s)",
    "znorm": "sqrt(s * {m})",
    "unit": "sqrt(s)",
    "pearson": "s / 2",
    "cosine": "s / 2",
    "robust": "ln(1 + sqrt(s))",
    "gauss": "sqrt(2 * (1 - exp(-s)))",
    "tanh": "sqrt(2 * tanh(s))",
    "trend": "sqrt(s)",
}


def _normalised(name: str, m: int, series: str) -> str:
    w = f"SELECT series_id, i, w, list_sum(w) / {m} AS mean FROM ({_windows(m, series)})"
    if name == "robust":
        w = f"SELECT series_id, i, list_transform(w, lambda x: x - {_median('w', m)}) AS w FROM ({w})"
        size = _median("list_transform(w, lambda x: abs(x))", m)
    elif name == "trend":
        t = f"list_transform(range({m}), lambda t: t - {(m - 1) / 2})"
        w = f"SELECT series_id, i, w, mean, list_sum(list_transform(list_zip(w, {t}), lambda p: p[1] * p[2])) / {m * (m * m - 1) / 12} AS slope FROM ({w})"
        w = f"SELECT series_id, i, list_transform(list_zip(w, {t}), lambda p: p[1] - mean - slope * p[2]) AS w FROM ({w})"
        size = _NORMAL["cosine"][1]
    else:
        off, size = _NORMAL["raw" if name == "euclidean" else "cosine" if name == "cosine" else "z"]
        w = f"SELECT series_id, i, w, mean, {off} AS off, {size} AS size FROM ({w})"
        return f"SELECT series_id, i, list_transform(w, lambda x: (x - off) / size) AS x FROM ({w}) WHERE size > 1e-12"
    return f"SELECT series_id, i, list_transform(w, lambda x: x / size) AS x FROM (SELECT series_id, i, w, {size} AS size FROM ({w})) WHERE size > 1e-12"


def window_znorm() -> str:
    return f"SELECT series_id, i, list_transform(x, lambda v: round(v * {8**0.5}, 6)) AS z FROM ({_normalised('unit', 8, EVENTS)})"


def _pairs(name: str, m: int = 8, series: str = EVENTS) -> str:
    s = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    inner = f"SELECT a.series_id, a.i AS i, b.i AS j, {s} AS s FROM x a JOIN x b ON a.series_id = b.series_id AND b.i - a.i >= {m}"
    return f"WITH x AS ({_normalised(name, m, series)}) SELECT series_id, i, j, {_FINISH[name].format(m=m)} AS dist FROM ({inner})"


def pairs(name: str) -> str:
    return f"SELECT series_id, i, j, round(dist, 5) AS dist FROM ({_pairs(name)})"


def _both(name: str, m: int = 8, series: str = EVENTS, digits: int = 6) -> str:
    return f"WITH p AS (SELECT series_id, i, j, round(dist, {digits}) AS dist FROM ({_pairs(name, m, series)})) SELECT * FROM p UNION ALL SELECT series_id, j, i, dist FROM p"


def _nearest(name: str, m: int = 8, series: str = EVENTS, digits: int = 6, k: int = 1) -> str:
    ranked = f"SELECT series_id, i, row_number() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS r, j, dist FROM ({_both(name, m, series, digits)})"
    return f"SELECT series_id, i, CAST(r AS INTEGER) AS \"rank\", j, dist FROM ({ranked}) WHERE r <= {k}"


def profile(name: str, m: int = 8, series: str = EVENTS, digits: int = 6) -> str:
    return f"SELECT series_id, i, j, dist FROM ({_nearest(name, m, series, digits)})"


def top_k() -> str:
    return _nearest("znorm", k=3)


def multi_length() -> str:
    return " UNION ALL ".join(f"SELECT series_id, {m} AS m, i, j, round(dist / {m**0.5}, 6) AS dist FROM ({profile('znorm', m)})" for m in (6, 8, 10))


def top_pair() -> str:
    return f"SELECT series_id, i, j, dist FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist, i, j) AS r FROM ({profile('znorm')})) WHERE r = 1"


def discords() -> str:
    return f"SELECT series_id, i, j, dist, CAST(r AS INTEGER) AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dist DESC, i) AS r FROM ({profile('znorm')})) WHERE r <= 3"


def daily_profile(m: int) -> str:
    return f"SELECT series_id, i, dist FROM ({profile('unit', m, DAILY, 4)})"


def knn_k1() -> str:
    return _nearest("trend")


def knn_k2() -> str:
    return f"""WITH b AS ({_both("trend")}),
one AS (SELECT series_id, i, j, dist FROM (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS r FROM b) WHERE r = 1),
two AS (SELECT series_id, i, j, dist FROM (SELECT b.*, row_number() OVER (PARTITION BY b.series_id, b.i ORDER BY b.dist, b.j) AS r FROM b JOIN one USING (series_id, i) WHERE abs(b.j - one.j) >= 8) WHERE r = 1)
SELECT series_id, i, CAST(1 AS INTEGER) AS "rank", j, dist FROM one UNION ALL SELECT series_id, i, CAST(2 AS INTEGER), j, dist FROM two"""


def _knn_k3(m: int = 8) -> str:
    """Each pick takes the m - 1 windows that are left next to it on either side."""
    steps = [f"b0 AS ({_both('trend', digits=9)})"]
    for k in range(3):
        steps.append(f"p{k} AS (SELECT series_id, i, j, dist FROM (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS r FROM b{k}) WHERE r = 1)")
        steps.append(f"b{k + 1} AS (SELECT series_id, i, j, dist FROM (SELECT b.*, row_number() OVER (PARTITION BY b.series_id, b.i, b.j < p.j ORDER BY abs(b.j - p.j)) AS far FROM b{k} b JOIN p{k} p USING (series_id, i) WHERE b.j <> p.j) WHERE far >= {m})")
    return f"WITH {', '.join(steps[:-1])} {' UNION ALL '.join(f'SELECT series_id, i, CAST({k + 1} AS INTEGER) AS rank, j, dist FROM p{k}' for k in range(3))}"


def knn_k3() -> str:
    return f"SELECT series_id, i, \"rank\", j, round(dist, 6) AS dist FROM ({_knn_k3()})"


def _edges_of(neighbours: str) -> str:
    return f"""n AS ({neighbours}), nn AS (SELECT series_id, i, min(dist) AS dist FROM n GROUP BY ALL),
alike AS (SELECT DISTINCT series_id, least(i, j) AS u, greatest(i, j) AS v, dist AS w FROM n),
temporal AS (SELECT series_id, u, v, w FROM (SELECT series_id, i AS u, lead(i) OVER o AS v, greatest(dist, lead(dist) OVER o) AS w FROM nn WINDOW o AS (PARTITION BY series_id ORDER BY i)) WHERE v IS NOT NULL),
e AS (SELECT *, 'similar' AS kind FROM alike UNION ALL SELECT *, 'temporal' FROM temporal)"""


_EDGES = _edges_of(profile("trend"))


def edges(kind: str) -> str:
    return f"WITH {_EDGES} SELECT series_id, u, v, w FROM {kind}"


def filtration() -> str:
    return f"WITH {_EDGES} SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY w, kind, u, v) AS INTEGER) AS \"rank\", u, v, w, kind FROM e"


_BIRTHS = "SELECT series_id, node, min(w) AS birth FROM (SELECT series_id, u AS node, w FROM e UNION ALL SELECT series_id, v, w FROM e) GROUP BY ALL"


def births() -> str:
    return f"WITH {_EDGES} {_BIRTHS}"


def components(t: float) -> str:
    return f"""WITH RECURSIVE {_EDGES}, b AS ({_BIRTHS}), s AS (SELECT * FROM b WHERE birth <= {t}),
l AS (SELECT series_id, u, v FROM e WHERE w <= {t} UNION SELECT series_id, v, u FROM e WHERE w <= {t}),
r(series_id, node, seen) AS (SELECT series_id, node, node FROM s UNION SELECT r.series_id, r.node, l.v FROM r JOIN l ON l.series_id = r.series_id AND l.u = r.seen),
c AS (SELECT series_id, node, min(seen) AS root FROM r GROUP BY ALL)
SELECT series_id, CAST({t} AS DOUBLE) AS t, count(*) AS nodes, count(DISTINCT root) AS components FROM c GROUP BY series_id"""


#: An edge is in the minimum spanning forest if no earlier edges join its ends. A seed dies of the edge that first joins
#: it with an older node, the largest on its path there; of nodes of equal birth the later one counts as older.
_FOREST = f"""WITH RECURSIVE {_edges_of(_knn_k3())},
f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY w, kind, u, v) AS r FROM e),
l AS (SELECT series_id, r, u, v FROM f UNION ALL SELECT series_id, r, v, u FROM f),
reach(series_id, r, goal, node) AS (SELECT series_id, r, v, u FROM f UNION SELECT x.series_id, x.r, x.goal, l.v FROM reach x JOIN l ON l.series_id = x.series_id AND l.u = x.node AND l.r < x.r),
tree AS (SELECT f.* FROM f ANTI JOIN (SELECT series_id, r FROM reach WHERE node = goal) USING (series_id, r))"""
_PAIRS = f"""{_FOREST}, b AS ({_BIRTHS}),
ways AS (SELECT series_id, r, u, v FROM tree UNION ALL SELECT series_id, r, v, u FROM tree),
path(series_id, seed, node, before, top) AS (SELECT series_id, node, node, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM b UNION ALL
SELECT p.series_id, p.seed, t.v, t.u, greatest(p.top, t.r) FROM path p JOIN ways t ON t.series_id = p.series_id AND t.u = p.node AND t.v <> p.before),
death AS (SELECT p.series_id, p.seed, min(p.top) AS r FROM path p JOIN b s ON s.series_id = p.series_id AND s.node = p.seed JOIN b o ON o.series_id = p.series_id AND o.node = p.node WHERE (o.birth, -o.node) < (s.birth, -s.node) GROUP BY ALL),
pairs AS (SELECT b.series_id, b.node AS seed, b.birth, coalesce(tree.w, greatest(max(b.birth) OVER y, max(tree.w) OVER y)) AS death FROM b
LEFT JOIN death ON death.series_id = b.series_id AND death.seed = b.node LEFT JOIN tree ON tree.series_id = b.series_id AND tree.r = death.r WINDOW y AS (PARTITION BY b.series_id))"""


def mst_edges() -> str:
    return f"{_FOREST} SELECT series_id, u, v, round(w, 6) AS w FROM tree"


def h0_pairs() -> str:
    return f"{_PAIRS} SELECT series_id, seed, round(birth, 6) AS birth, round(death, 6) AS death FROM pairs"


def split_cuts(skewed: bool = False) -> str:
    births, lives = _otsu("q", "birth"), _otsu("q", "pers")
    if skewed:
        births, lives = (_otsu(f"(SELECT q.* FROM q JOIN ({cuts}) USING (series_id) WHERE {keep})", c) for cuts, keep, c in ((births, "birth < cut", "birth"), (lives, "pers > cut", "pers")))
    return f"{_PAIRS}, q AS (SELECT *, death - birth AS pers FROM pairs WHERE death - birth > 0) SELECT series_id, round(x.cut, 6) AS b_cut, round(y.cut, 6) AS p_cut FROM ({births}) x JOIN ({lives}) y USING (series_id)"


def outlier_cuts(t: float = 0.9) -> str:
    return f"""{_PAIRS}, q AS (SELECT q.series_id, death - birth AS pers, cut AS b_cut FROM pairs q JOIN ({_otsu("pairs", "birth")}) USING (series_id) WHERE birth < cut AND death - birth > 0),
m AS (SELECT *, lag(pers) OVER (PARTITION BY series_id ORDER BY pers) AS before, avg(pers) OVER (PARTITION BY series_id) AS mean, stddev_pop(pers) OVER (PARTITION BY series_id) AS std FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pers, before NULLS FIRST) AS r FROM m WHERE pers - mean > {NormalDist().inv_cdf(t)!r} * std)
SELECT series_id, round(b_cut, 6) AS b_cut, round((pers + before) / 2, 6) AS p_cut FROM o WHERE r = 1 AND before IS NOT NULL"""


def _plane(table: str, bins: int = 1024) -> str:
    """Sums over all cells below and left of each of those that occupied rows and columns make."""
    ends = ", ".join(f"CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS {c}_lo, CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS {c}_hi" for c in ("pers", "birth"))
    places = ", ".join(f"least(floor(({c} - {c}_lo) / (({c}_hi - {c}_lo) / {bins})), {bins - 1}) AS {k}" for c, k in (("pers", "i"), ("birth", "j")))
    return f"""WITH q AS (SELECT series_id, death - birth AS pers, birth FROM {table} WHERE death - birth > 0),
a AS (SELECT series_id, count(*) AS n, {ends} FROM q GROUP BY 1),
c AS (SELECT series_id, i, j, count(*) / max(n) AS share FROM (SELECT series_id, n, {places} FROM q JOIN a USING (series_id)) GROUP BY ALL),
x AS (SELECT DISTINCT series_id, i, pers_lo + i * ((pers_hi - pers_lo) / {bins}) AS x FROM c JOIN a USING (series_id)),
y AS (SELECT DISTINCT series_id, j, birth_lo + j * ((birth_hi - birth_lo) / {bins}) AS y FROM c JOIN a USING (series_id)),
g AS (SELECT x.series_id, x.i, y.j, x, y, coalesce(share, 0) AS share FROM x JOIN y USING (series_id) LEFT JOIN c ON c.series_id = x.series_id AND c.i = x.i AND c.j = y.j),
d AS (SELECT *, sum(share) OVER o AS w, sum(share * x) OVER o AS u, sum(share * y) OVER o AS v FROM g WINDOW o AS (PARTITION BY series_id, j ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT series_id, i, j, x, y, sum(w) OVER o AS w, sum(u) OVER o AS u, sum(v) OVER o AS v FROM d WINDOW o AS (PARTITION BY series_id, i ORDER BY j ROWS UNBOUNDED PRECEDING)),
t AS (SELECT series_id, sum(share * x) AS mx, sum(share * y) AS my FROM g GROUP BY 1),
r AS (SELECT s.*, round(CASE WHEN w * (1 - w) > 1e-12 THEN ((u - mx * w) ** 2 + (v - my * w) ** 2) / (w * (1 - w)) ELSE 0 END, 12) AS score FROM s JOIN t USING (series_id))
SELECT series_id, CASE WHEN score > 0 THEN x ELSE pers_lo END AS p_cut, CASE WHEN score > 0 THEN y ELSE birth_lo END AS b_cut FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, i, j) AS k FROM r) JOIN a USING (series_id) WHERE k = 1"""


def plane_cuts(skewed: bool = False) -> str:
    if not skewed:
        return f"{_PAIRS} SELECT series_id, round(p_cut, 6) AS p_cut, round(b_cut, 6) AS b_cut FROM ({_plane('pairs')})"
    return f"""{_PAIRS}, one AS MATERIALIZED ({_plane('pairs')}), below AS (SELECT pairs.* FROM pairs JOIN one USING (series_id) WHERE death - birth < p_cut AND birth < b_cut), two AS ({_plane('below')})
SELECT one.series_id, round(coalesce(two.p_cut, one.p_cut), 6) AS p_cut, round(coalesce(two.b_cut, one.b_cut), 6) AS b_cut FROM one LEFT JOIN two USING (series_id)"""


_PROFILE = profile("trend")


def ktanh() -> str:
    return f"SELECT series_id, i, round(2 * sqrt(tanh(10.0 * dist * dist) / tanh(40.0)), 6) AS stretched FROM ({_PROFILE})"


def _otsu(table: str, column: str, bins: int = 1024) -> str:
    return f"""WITH p AS (SELECT series_id, {column} AS x FROM {table}),
a AS (SELECT series_id, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, avg(x) AS mean, count(*) AS n FROM p GROUP BY 1),
h AS (SELECT series_id, lo, hi, mean, n, least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS bin, count(*) AS c FROM p JOIN a USING (series_id) GROUP BY ALL),
z AS (SELECT *, lo + bin * ((hi - lo) / {bins}) AS edge, c / n AS share FROM h WHERE bin < {bins - 1}),
s AS (SELECT *, sum(share) OVER o AS low, sum(share * edge) OVER o AS mass FROM z WINDOW o AS (PARTITION BY series_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, round(CASE WHEN 1 - low > 1e-12 THEN low * (1 - low) * (mass / low - (mean - mass) / (1 - low)) ** 2 ELSE 0 END, 12) AS score FROM s)
SELECT series_id, edge AS cut FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, bin) AS r FROM g) WHERE r = 1"""


def otsu() -> str:
    return f"SELECT series_id, round(cut, 6) AS cut FROM ({_otsu(f'({_PROFILE})', 'dist')})"


def gap_cut() -> str:
    return f"""WITH q AS (SELECT series_id, dist AS q, lead(dist) OVER o AS next, row_number() OVER o AS t, count(*) OVER (PARTITION BY series_id) AS n FROM ({_PROFILE}) WHERE dist > 0 WINDOW o AS (PARTITION BY series_id ORDER BY dist DESC)),
g AS (SELECT series_id, t, q - coalesce(next, 0) AS gap, (q + coalesce(next, 0)) / 2 AS mid FROM q WHERE next IS NOT NULL OR n = 1),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gap DESC, t) AS r FROM g) WHERE r = 1),
two AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.series_id ORDER BY g.gap DESC, g.t) AS r FROM g JOIN one USING (series_id) WHERE g.t > one.t) WHERE r = 1)
SELECT f.series_id, round(coalesce(two.mid, f.mid), 7) AS cut FROM g f LEFT JOIN two USING (series_id) WHERE f.t = 1"""


def persistent_motifs(m: int = 8, n: int | None = None) -> str:
    """Cuts of stretched births and persistence; a step an edge joins trees that may, a step a window claims its samples;
    then runs of one label, without those of unusual length and without labels that stand alone."""

    def stretched(x: str) -> str:
        return f"2 * sqrt(tanh(10.0 * ({x} * {x})) / tanh(40.0))"

    few = "SELECT series_id, label, start, \"end\", birth FROM (SELECT *, count(*) OVER (PARTITION BY series_id, label) AS n FROM {}) WHERE n > 1"
    rows = "all_" if n else "met"
    q = f"SELECT t.series_id, death - birth AS q FROM {rows} t JOIN bc USING (series_id) WHERE birth < b_cut"
    if n:
        lives = f"SELECT series_id, avg(q) AS p_cut FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY q DESC) AS r FROM ({q})) WHERE r IN ({n}, {n + 1}) GROUP BY 1"
    else:
        gaps = f"SELECT series_id, q, lead(q) OVER o AS next, row_number() OVER o AS t, count(*) OVER (PARTITION BY series_id) AS n FROM ({q}) WHERE q > 0 WINDOW o AS (PARTITION BY series_id ORDER BY q DESC)"
        lives = f"SELECT series_id, arg_max((q + coalesce(next, 0)) / 2, (q - coalesce(next, 0), -t)) AS p_cut FROM ({gaps}) WHERE next IS NOT NULL OR n = 1 GROUP BY 1"
    return f"""{_PAIRS}, all_ AS MATERIALIZED (SELECT p.series_id, p.seed, {stretched("birth")} AS birth, {stretched("death")} AS death, d.r AS r FROM pairs p LEFT JOIN death d ON d.series_id = p.series_id AND d.seed = p.seed),
met AS (SELECT * FROM all_ WHERE r IS NOT NULL), bc AS (SELECT series_id, cut AS b_cut FROM ({_otsu(rows, "birth")})), cut AS MATERIALIZED (SELECT * FROM bc JOIN ({lives}) USING (series_id)),
te AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY w, u, v) AS k, max(greatest(u, v) + 1) OVER (PARTITION BY series_id) AS n FROM (SELECT series_id, u, v, {stretched("w")} AS w FROM tree) JOIN cut USING (series_id)),
uf(series_id, k, root, born) AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT), range(0, n), list_resize(CAST([] AS DOUBLE[]), n) FROM te UNION ALL
SELECT series_id, k, CASE WHEN a <> b AND w - greatest(born[a + 1], born[b + 1]) < p_cut THEN CASE WHEN born[a + 1] >= born[b + 1] THEN list_transform(root, lambda x: CASE WHEN x = a THEN b ELSE x END) ELSE list_transform(root, lambda x: CASE WHEN x = b THEN a ELSE x END) END ELSE root END, born FROM (
SELECT x.series_id, t.k, x.root, x.root[t.u + 1] AS a, x.root[t.v + 1] AS b, t.w, t.p_cut, list_transform(x.born, lambda y, i: CASE WHEN i = t.u + 1 OR i = t.v + 1 THEN coalesce(y, t.w) ELSE y END) AS born FROM uf x JOIN te t ON t.series_id = x.series_id AND t.k = x.k + 1)),
last AS (SELECT series_id, root, born FROM uf QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY k DESC) = 1),
nodes AS (SELECT series_id, root[i + 1] AS label, i AS node, born[i + 1] AS birth, born[root[i + 1] + 1] AS first FROM (SELECT *, unnest(range(0, len(root))) AS i FROM last)),
own AS (SELECT series_id, seed AS label, least(death, b_cut) AS own_cut FROM all_ JOIN cut USING (series_id) WHERE death - birth > p_cut AND birth <= b_cut),
z AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY label, gap) AS run, row_number() OVER (PARTITION BY series_id ORDER BY birth, node, label) AS k, max(node) OVER (PARTITION BY series_id) AS most FROM (
SELECT series_id, label, node, birth, node - row_number() OVER (PARTITION BY series_id, label ORDER BY node) AS gap FROM nodes JOIN cut USING (series_id) LEFT JOIN own USING (series_id, label) WHERE birth IS NOT NULL AND first < b_cut AND birth < coalesce(own_cut, b_cut))),
paint(series_id, k, owner, took) AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT), list_resize(CAST([] AS BIGINT[]), most + {m}), false FROM z UNION ALL
SELECT series_id, k, CASE WHEN took THEN list_transform(owner, lambda x, i: CASE WHEN i > node AND i <= node + {m} THEN run ELSE x END) ELSE owner END, took FROM (
SELECT p.series_id, z.k, p.owner, z.node, z.run, len(list_filter(p.owner[z.node + 1 : z.node + {m}], lambda x: x IS NOT NULL AND x <> z.run)) = 0 AS took FROM paint p JOIN z ON z.series_id = p.series_id AND z.k = p.k + 1)),
c AS (SELECT *, coalesce(node - lag(node) OVER (PARTITION BY series_id, run ORDER BY node) > {m}, true) AS new FROM z JOIN paint USING (series_id, k) WHERE took),
f0 AS (SELECT series_id, label, min(node) AS start, max(node) + {m} AS "end", min(birth) AS birth FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY series_id, run ORDER BY node) AS part FROM c) GROUP BY series_id, label, run, part),
f1 AS ({few.format("f0")}), f2 AS (SELECT f1.* FROM f1 JOIN (SELECT series_id, label, median("end" - start) AS mid FROM f1 GROUP BY ALL) USING (series_id, label) WHERE abs("end" - start - mid) <= 0.25 * mid)
SELECT series_id, label, start, "end", round(birth, 6) AS birth FROM ({few.format("f2")})"""


def top_n_cut() -> str:
    return f"SELECT series_id, round(avg(dist), 7) AS cut FROM (SELECT series_id, dist, row_number() OVER (PARTITION BY series_id ORDER BY dist DESC) AS r FROM ({_PROFILE})) WHERE r IN (5, 6) GROUP BY 1"


def mad_outliers() -> str:
    return f"""WITH p AS ({_PROFILE}), m AS (SELECT series_id, median(dist) AS med FROM p GROUP BY 1), o AS (SELECT p.*, abs(dist - med) AS off FROM p JOIN m USING (series_id)),
d AS (SELECT series_id, median(off) AS mad FROM o GROUP BY 1)
SELECT series_id, i, dist FROM o JOIN d USING (series_id) WHERE mad > 0 AND {NormalDist().inv_cdf(0.75)!r} * off >= 2.0 * mad"""


def normal_outliers() -> str:
    return f"WITH p AS ({_PROFILE}), a AS (SELECT series_id, avg(dist) AS mean, stddev_pop(dist) AS std FROM p GROUP BY 1) SELECT series_id, i, dist FROM p JOIN a USING (series_id) WHERE dist - mean > {NormalDist().inv_cdf(0.95)!r} * std"


def _islands(points: str) -> str:
    return f"SELECT series_id, label, min(idx) AS start, max(idx) + 1 AS \"end\" FROM (SELECT *, idx - row_number() OVER (PARTITION BY series_id, label ORDER BY idx) AS run FROM ({points})) GROUP BY series_id, label, run"


_MEAN = f"s AS ({EVENTS}), a AS (SELECT series_id, avg(value) AS mean FROM s GROUP BY 1)"
TRUTH = _islands(f"WITH {_MEAN} SELECT series_id, (idx // 10) % 3 AS label, idx FROM s JOIN a USING (series_id) WHERE value > mean")
FOUND = _islands(
    f"WITH {_MEAN} SELECT series_id, (idx // 10) % 2 AS label, idx FROM (SELECT series_id, idx, avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM s) JOIN a USING (series_id) WHERE value > mean"
)


def extended_runs(m: int = 8) -> str:
    return f"""WITH r AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, label ORDER BY i) AS run FROM (SELECT series_id, (i // 10) % 3 AS label, i, dist FROM ({_PROFILE}) WHERE dist < 1)),
g AS (SELECT series_id, label, min(i) AS start, max(i) + {m} AS stop, min(dist) AS birth FROM r GROUP BY series_id, label, run)
SELECT series_id, label, start, least(stop, coalesce(lead(start) OVER (PARTITION BY series_id ORDER BY start), stop)) AS "end", birth FROM g"""


def similar_length() -> str:
    return f"WITH t AS ({TRUTH}), m AS (SELECT series_id, label, median(\"end\" - start) AS mid FROM t GROUP BY ALL) SELECT t.* FROM t JOIN m USING (series_id, label) WHERE abs(\"end\" - start - mid) <= 0.25 * mid"


def drop_singletons() -> str:
    return f"SELECT series_id, label, start, \"end\" FROM (SELECT *, count(*) OVER (PARTITION BY series_id, label) AS n FROM ({TRUTH})) WHERE n > 1"


def radius_rank() -> str:
    return f"""SELECT series_id, i, neighbours, spread, CAST(row_number() OVER (PARTITION BY series_id ORDER BY neighbours DESC, spread, i) AS INTEGER) AS "rank"
FROM (SELECT series_id, i, count(*) AS neighbours, round(stddev_pop(dist), 6) AS spread FROM ({_both("znorm", digits=15)}) WHERE round(dist, 6) < 1.5 GROUP BY ALL)"""


def _apart(near: str, m: int) -> str:
    """Of a list of (d, j), nearest first, the j of those that overlap none picked before."""
    return f"list_reduce(list_transform({near}, lambda x: [x.j]), lambda own, x: CASE WHEN list_bool_and(list_transform(own, lambda y: abs(y - x[1]) >= {m})) THEN list_concat(own, x) ELSE own END)"


def radius_motifs(m: int = 8, radius: float = 1.5, n: int = 3) -> str:
    """Windows by rank; each motif's centre is the first whose distances to all centres before are above 2 * radius."""
    x = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    picks = ["c0 AS (SELECT series_id, i FROM r WHERE r = 1)"]
    for k in range(1, n):
        far = " AND ".join(f"EXISTS (SELECT 1 FROM far JOIN c{j} ON c{j}.series_id = far.series_id AND c{j}.i = far.i WHERE far.series_id = r.series_id AND far.j = r.i)" for j in range(k))
        picks.append(f"c{k} AS (SELECT series_id, arg_min(i, r) AS i FROM r WHERE {far} GROUP BY 1)")
    centres = " UNION ALL ".join(f"SELECT series_id, CAST({k} AS BIGINT) AS label, i FROM c{k}" for k in range(n))
    return f"""WITH b AS ({_both("znorm", m, digits=9)}), l AS (SELECT series_id, i, list({{'d': dist, 'j': j}} ORDER BY dist, j) AS near FROM b WHERE dist < {radius} GROUP BY ALL),
k AS (SELECT series_id, i, unnest({_apart("near", m)}) AS j FROM l), g AS (SELECT series_id, i, count(*) AS n, round(stddev_pop(dist), 9) AS spread FROM k JOIN b USING (series_id, i, j) GROUP BY ALL),
r AS (SELECT series_id, i, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, spread, i) AS r FROM g), x AS ({_normalised("znorm", m, EVENTS)}),
far AS (SELECT a.series_id, a.i, b.i AS j FROM x a JOIN x b ON a.series_id = b.series_id WHERE round(sqrt({x} * {m}), 9) > {2 * radius}),
{', '.join(picks)}, c AS ({centres})
SELECT series_id, label, start, start + {m} AS "end" FROM (SELECT series_id, label, j AS start FROM c JOIN k USING (series_id, i) UNION ALL SELECT series_id, label, i FROM c)"""


def profile_motifs(m: int = 8, n: int = 3, ratio: float = 1.2) -> str:
    """A step a seed: the free window nearest to another takes the free ones within ratio times its nearest free one; a
    seed without a free one is dropped."""
    reach = f"greatest({ratio} * open[1].d, nextafter(open[1].d, 'infinity'::DOUBLE))"
    return f"""WITH RECURSIVE b AS ({_both("znorm", m, digits=9)}), w AS (SELECT series_id, i, min(dist) AS least, list({{'d': dist, 'j': j}} ORDER BY dist, j) AS every FROM b GROUP BY ALL),
go(series_id, label, free, own) AS (SELECT series_id, CAST(0 AS BIGINT), list(i), CAST([] AS BIGINT[]) FROM w GROUP BY 1 UNION ALL
SELECT series_id, label + CAST(len(own) > 0 AS BIGINT), list_filter(free, lambda f: f <> seed AND coalesce(list_bool_and(list_transform(own, lambda y: abs(y - f) >= {m})), true)), own FROM (
SELECT series_id, label, free, seed, CASE WHEN len(open) > 0 THEN list_prepend(seed, {_apart(f"list_filter(open, lambda x: x.d < {reach})", m)}) ELSE [] END AS own FROM (
SELECT g.series_id, g.label, g.free, w.i AS seed, list_filter(w.every, lambda x: list_contains(g.free, x.j)) AS open FROM go g JOIN w ON w.series_id = g.series_id AND list_contains(g.free, w.i) WHERE g.label < {n}
QUALIFY row_number() OVER (PARTITION BY g.series_id ORDER BY w.least, w.i) = 1)))
SELECT series_id, label - 1 AS label, start, start + {m} AS "end" FROM (SELECT series_id, label, unnest(own) AS start FROM go)"""


def multi_length_motifs(lengths: list[int], n: int = 3, ratio: float = 1.2) -> str:
    """The motifs of all lengths in order of their least cost, each kept if it shares no sample with those kept."""
    every = " UNION ALL ".join(
        f"SELECT series_id, {m} AS m, f.label, f.start, f.\"end\", p.dist / sqrt({m}) AS cost FROM ({profile_motifs(m, n, ratio)}) f JOIN (SELECT series_id, i AS start, dist FROM ({profile('znorm', m)})) p USING (series_id, start)"
        for m in lengths
    )
    return f"""WITH RECURSIVE f AS ({every}), q AS (SELECT series_id, m, label, row_number() OVER (PARTITION BY series_id ORDER BY min(cost), m DESC, label) AS r, list({{'start': start, 'end': "end"}}) AS own, flatten(list(range(start, "end"))) AS cells FROM f GROUP BY series_id, m, label),
go(series_id, r, taken, kept, own) AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST([] AS STRUCT("start" BIGINT, "end" BIGINT)[]) FROM q UNION ALL
SELECT g.series_id, q.r, CASE WHEN ok THEN list_concat(taken, cells) ELSE taken END, kept + CAST(ok AS BIGINT), CASE WHEN ok THEN q.own ELSE [] END FROM go g JOIN q ON q.series_id = g.series_id AND q.r = g.r + 1, LATERAL (SELECT kept < {n} AND NOT list_has_any(taken, q.cells) AS ok))
SELECT series_id, kept - 1 AS label, x.start AS start, x."end" AS "end" FROM (SELECT series_id, kept, unnest(own) AS x FROM go)"""


def seeded_motifs(lengths: list[int], paired: bool = False, n: int = 3, ratio: float = 1.2) -> str:
    """Entries of all lengths by cost; a step takes the next one that is free, with what is free and within its reach."""
    every = []
    for m in lengths:
        near = f"SELECT series_id, i, arg_min({{'j': j, 'd': dist}}, (dist, j)) AS x FROM b{m} GROUP BY ALL"
        reach = f"greatest({ratio} * x.d, nextafter(x.d, 'infinity'::DOUBLE))"
        both = f"LEFT JOIN b{m} o ON o.series_id = e.series_id AND o.i = x.j AND o.j = b.j" if paired else ""
        dist = "least(b.dist, o.dist)" if paired else "b.dist"
        kept = f"FILTER ({dist} < {reach}{' AND o.j IS NOT NULL' if paired else ''})"
        every.append(f"SELECT e.series_id, CAST({m} AS BIGINT) AS m, e.i, x.j AS j, x.d / sqrt({m}) AS cost, coalesce(list({{'d': {dist}, 'j': b.j}} ORDER BY {dist}, b.j) {kept}, []) AS every FROM ({near}) e JOIN b{m} b ON b.series_id = e.series_id AND b.i = e.i {both} GROUP BY e.series_id, e.i, x")
    bases = ", ".join(f"b{m} AS MATERIALIZED ({_both('znorm', m, digits=9)})" for m in lengths)
    free = "coalesce(list_bool_and(list_transform(g.taken, lambda t: t.s >= {0} + e.m OR {0} >= t.e)), true)"
    seeds = "[e.i, e.j]" if paired else "[e.i]"
    picked = "list_reduce(list_transform(open, lambda x: [x.j]), lambda own, x: CASE WHEN list_bool_and(list_transform(own, lambda y: abs(y - x[1]) >= m)) THEN list_concat(own, x) ELSE own END)"
    return f"""WITH RECURSIVE {bases}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cost, m DESC, i, j) AS r FROM ({" UNION ALL ".join(every)})),
go(series_id, r, label, taken, own, m) AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM e UNION ALL
SELECT series_id, r, label + CAST(len(own) > 1 AS BIGINT), CASE WHEN len(own) > 1 THEN list_concat(taken, list_transform(own, lambda p: {{'s': p, 'e': p + m}})) ELSE taken END, CASE WHEN len(own) > 1 THEN own ELSE [] END, m FROM (
SELECT series_id, r, label, taken, m, CASE WHEN len(open) > 0 THEN list_concat(seeds, {picked}) ELSE seeds END AS own FROM (
SELECT g.series_id, e.r, g.label, g.taken, e.m, {seeds} AS seeds, list_filter(e.every, lambda x: {free.format("x.j")}) AS open FROM go g JOIN e ON e.series_id = g.series_id AND e.r > g.r
WHERE g.label < {n} AND {free.format("e.i")}{f" AND {free.format('e.j')}" if paired else ""} QUALIFY row_number() OVER (PARTITION BY g.series_id ORDER BY e.r) = 1)))
SELECT series_id, label - 1 AS label, start, start + m AS "end" FROM (SELECT series_id, label, m, unnest(own) AS start FROM go)"""


def paa() -> str:
    parts = ", ".join(f"round((x[{2 * k + 1}] + x[{2 * k + 2}]) / 2 * {8**0.5}, 6) AS p{k}" for k in range(4))
    return f"SELECT series_id, i, {parts} FROM ({_normalised('unit', 8, EVENTS)})"


def sax(what: str) -> str:
    low, high = (NormalDist().inv_cdf(k / 3) for k in (1, 2))
    letters = " || ".join(f"CASE WHEN round((x[{2 * k + 1}] + x[{2 * k + 2}]) / 2 * {8**0.5}, 9) >= {high!r} THEN 'c' WHEN round((x[{2 * k + 1}] + x[{2 * k + 2}]) / 2 * {8**0.5}, 9) >= {low!r} THEN 'b' ELSE 'a' END" for k in range(4))
    words = f"SELECT series_id, i, {letters} AS word FROM ({_normalised('unit', 8, EVENTS)})"
    if what == "words":
        return words
    if what == "reduced":
        return f"SELECT series_id, i, word FROM (SELECT *, lag(word) OVER (PARTITION BY series_id ORDER BY i) AS before FROM ({words})) WHERE before IS NULL OR before <> word"
    return f"SELECT series_id, word, next, count(*) AS n FROM (SELECT *, lead(word) OVER (PARTITION BY series_id ORDER BY i) AS next FROM ({words})) WHERE next IS NOT NULL GROUP BY ALL"


def _points(found: str) -> str:
    return f"SELECT DISTINCT series_id, label, unnest(range(start, \"end\")) AS idx FROM ({found})"


def sample_prf() -> str:
    return f"""WITH t AS (SELECT DISTINCT series_id, idx, 1 AS t FROM ({_points(TRUTH)})), p AS (SELECT DISTINCT series_id, idx, 1 AS p FROM ({_points(FOUND)})),
c AS (SELECT series_id, count(*) FILTER (t = 1 AND p = 1) AS hit, count(t) AS nt, count(p) AS np FROM t FULL JOIN p USING (series_id, idx) GROUP BY 1),
s AS (SELECT series_id, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN hit / nt ELSE 0 END AS re FROM c)
SELECT series_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS fscore FROM s"""


def overlaps(truth: str = TRUTH, found: str = FOUND) -> str:
    return f"""SELECT t.series_id, t.label, t.start, t."end", p.label AS p_label, p.start AS p_start, p."end" AS p_end, least(t."end", p."end") - greatest(t.start, p.start) AS overlap
FROM ({truth}) t JOIN ({found}) p ON t.series_id = p.series_id AND t.start < p."end" AND p.start < t."end\""""


def label_overlaps() -> str:
    return f"SELECT t.series_id, t.label, p.label AS p_label, count(*) AS samples FROM ({_points(TRUTH)}) t JOIN ({_points(FOUND)}) p USING (series_id, idx) GROUP BY ALL"


def contingency() -> str:
    sums = "SELECT series_id, idx, sum(label + 1) AS {} FROM ({}) GROUP BY ALL"
    return f"SELECT series_id, CAST(coalesce(a, 0) AS BIGINT) AS a, CAST(coalesce(b, 0) AS BIGINT) AS b, count(*) AS n FROM ({EVENTS}) LEFT JOIN ({sums.format('a', _points(TRUTH))}) USING (series_id, idx) LEFT JOIN ({sums.format('b', _points(FOUND))}) USING (series_id, idx) GROUP BY ALL"


def adjusted_information() -> str:
    """Chance is the mean over all tables with the same sums: over each pair of sums, all counts it can have."""
    return f"""WITH c AS ({contingency()}), x AS (SELECT series_id, a, sum(n) AS x FROM c GROUP BY ALL), y AS (SELECT series_id, b, sum(n) AS y FROM c GROUP BY ALL), t AS (SELECT series_id, sum(n) AS t FROM c GROUP BY 1),
m AS (SELECT series_id, sum(n / t * ln(t * n / (x * y))) AS mutual FROM c JOIN x USING (series_id, a) JOIN y USING (series_id, b) JOIN t USING (series_id) GROUP BY 1),
h AS (SELECT series_id, sum(-s / t * ln(s / t)) / 2 AS half, count(*) AS sides FROM (SELECT series_id, x AS s FROM x UNION ALL SELECT series_id, y FROM y) JOIN t USING (series_id) GROUP BY 1),
k AS (SELECT series_id, x, y, t, unnest(range(CAST(greatest(1, x + y - t) AS BIGINT), CAST(least(x, y) + 1 AS BIGINT))) AS k FROM x JOIN y USING (series_id) JOIN t USING (series_id)),
e AS (SELECT series_id, sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS chance FROM k GROUP BY 1)
SELECT series_id, round(CASE WHEN sides = 2 THEN 1 WHEN abs(half - chance) > 1e-15 THEN (mutual - chance) / (half - chance) ELSE 0 END, 6) AS ami FROM m JOIN h USING (series_id) JOIN e USING (series_id)"""


def lags(what: str) -> str:
    every = f"""WITH s AS ({EVENTS}),
c AS (SELECT a.series_id AS a_id, b.series_id AS b_id, a.idx - b.idx AS lag, count(*) AS n, stddev_pop(a.value) AS sx, stddev_pop(b.value) AS sy, covar_pop(a.value, b.value) AS c
FROM s a JOIN s b ON a.series_id // 2 = b.series_id // 2 WHERE a.series_id % 2 = 0 AND b.series_id % 2 = 1 GROUP BY ALL)
SELECT a_id, b_id, lag, n, round(c / (sx * sy), 6) AS corr FROM c WHERE n >= 30 AND sx > 0 AND sy > 0"""
    if what == "all":
        return every
    best = f"SELECT a_id, b_id, lag, corr FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY corr DESC, lag) AS r FROM ({every})) WHERE r = 1"
    if what == "best":
        return best
    return f"WITH l AS ({best}), c AS (SELECT series_id, CAST(sum(abs(lag)) AS BIGINT) AS cost FROM (SELECT a_id AS series_id, lag FROM l UNION ALL SELECT b_id, lag FROM l) GROUP BY 1) SELECT series_id, cost FROM c ORDER BY cost, series_id LIMIT 1"


def lag_groups(what: str) -> str:
    matrix = f"""WITH s AS ({EVENTS}),
c AS (SELECT a.series_id AS a_id, b.series_id AS b_id, a.idx - b.idx AS lag, count(*) AS n, stddev_pop(a.value) AS sx, stddev_pop(b.value) AS sy, covar_pop(a.value, b.value) AS c
FROM s a JOIN s b ON a.series_id // 4 = b.series_id // 4 AND a.series_id < b.series_id GROUP BY ALL),
r AS (SELECT a_id, b_id, lag, row_number() OVER (PARTITION BY a_id, b_id ORDER BY round(c / (sx * sy), 6) DESC, lag) AS r FROM c WHERE n >= 30 AND sx > 0 AND sy > 0)
SELECT a_id // 4 AS pair, a_id, b_id, lag FROM r WHERE r = 1 UNION ALL SELECT a_id // 4, b_id, a_id, -lag FROM r WHERE r = 1"""
    if what == "matrix":
        return matrix
    centre = "SELECT pair, a_id FROM (SELECT pair, a_id, row_number() OVER (PARTITION BY pair ORDER BY sum(abs(lag)), a_id) AS r FROM m GROUP BY pair, a_id) WHERE r = 1"
    relative = f"WITH m AS ({matrix}), k AS ({centre}) SELECT m.pair, m.b_id AS series_id, m.lag FROM m JOIN k USING (pair, a_id) UNION ALL SELECT pair, a_id, 0 FROM k"
    if what == "relative":
        return relative
    return f"""WITH l AS ({relative}), n AS (SELECT pair, count(*) AS n FROM l GROUP BY 1)
SELECT l.pair, e.idx + l.lag AS "at", round(sum(e.value) / n.n, 6) AS mean FROM l JOIN ({EVENTS}) e USING (series_id) JOIN n USING (pair) GROUP BY l.pair, e.idx + l.lag, n.n"""


def matched_samples() -> str:
    """The best of all one-to-one pairings of up to three true labels (0, 1, 2) with two predicted ones (0, 1)."""
    return f"""WITH o AS ({label_overlaps()}), g AS (SELECT series_id, label, p_label, samples FROM o UNION ALL SELECT DISTINCT series_id, -1, 0, 0 FROM o UNION ALL SELECT DISTINCT series_id, -2, 1, 0 FROM o)
SELECT a.series_id, CAST(max(a.samples + b.samples) AS BIGINT) AS samples FROM g a JOIN g b ON a.series_id = b.series_id AND a.p_label = 0 AND b.p_label = 1 AND a.label <> b.label GROUP BY 1"""


def matched_labels() -> str:
    """The best of the same pairings; of equal ones the first by the partners of labels 0, 1, 2, none last."""
    code = " + ".join(f"{3 ** (2 - k)} * CASE {k} WHEN a.label THEN 0 WHEN b.label THEN 1 ELSE 2 END" for k in range(3))
    return f"""WITH o AS ({label_overlaps()}), g AS (SELECT series_id, label, p_label, samples FROM o UNION ALL SELECT DISTINCT series_id, -1, 0, 0 FROM o UNION ALL SELECT DISTINCT series_id, -2, 1, 0 FROM o),
c AS (SELECT a.series_id, a.label AS x, b.label AS y, row_number() OVER (PARTITION BY a.series_id ORDER BY a.samples + b.samples DESC, {code}) AS r FROM g a JOIN g b ON a.series_id = b.series_id AND a.p_label = 0 AND b.p_label = 1 AND a.label <> b.label)
SELECT series_id, x AS label, CAST(0 AS BIGINT) AS p_label FROM c WHERE r = 1 AND x >= 0 UNION ALL SELECT series_id, y, 1 FROM c WHERE r = 1 AND y >= 0"""


def _f1(table: str, by: str) -> str:
    return f"SELECT {by}, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS fscore FROM ({table})"


def _weights(weighted: bool) -> str:
    return "size / sum(size) OVER (PARTITION BY series_id)" if weighted else "1 / count(*) OVER (PARTITION BY series_id)"


def _weighted(scored: str, by: str) -> str:
    return f"SELECT {by}, {', '.join(f'round(sum({c} * weight), 6) AS {c}' for c in ('precision', 'recall', 'fscore'))} FROM ({_f1(scored, f'{by}, weight')}) GROUP BY {by}"


def label_scores(weighted: bool = False) -> str:
    both = f"SELECT series_id, label, samples, p_size FROM ({label_overlaps()}) JOIN ({matched_labels()}) USING (series_id, label, p_label) JOIN (SELECT series_id, label AS p_label, count(*) AS p_size FROM ({_points(FOUND)}) GROUP BY ALL) USING (series_id, p_label)"
    sizes = f"SELECT series_id, label, size, {_weights(weighted)} AS weight FROM (SELECT series_id, label, count(*) AS size FROM ({_points(TRUTH)}) GROUP BY ALL)"
    return _weighted(f"SELECT series_id, weight, coalesce(samples / p_size, 0) AS precision, coalesce(samples / size, 0) AS recall FROM ({sizes}) LEFT JOIN ({both}) USING (series_id, label)", "series_id")


def _paired(met: str) -> str:
    """Overlaps in time: best sums of what follows by whether its true or predicted occurrence is taken, from the last one
    back, then from the first one on, each if it is free and taking it costs nothing."""
    return f"""WITH RECURSIVE m AS ({met}),
k AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY series_id) AS n, coalesce(CAST(lead(start) OVER o = start AS INTEGER), 0) AS t, coalesce(CAST(lead(p_start) OVER o = p_start AS INTEGER), 0) AS p FROM m WINDOW o AS (PARTITION BY series_id ORDER BY greatest(start, p_start))),
back(series_id, k, v, takes) AS (SELECT DISTINCT series_id, n + 1, [CAST(0 AS BIGINT), 0, 0, 0], false FROM k UNION ALL
SELECT k.series_id, k.k, [greatest(v[1], k.overlap + v[1 + 2 * k.t + k.p]), v[1 + k.p], v[1 + 2 * k.t], v[1 + 2 * k.t + k.p]], k.overlap + v[1 + 2 * k.t + k.p] >= v[1] FROM back b JOIN k ON k.series_id = b.series_id AND k.k = b.k - 1),
d AS (SELECT k.*, takes FROM k JOIN back USING (series_id, k)),
onward(series_id, k, a, b, took) AS (SELECT series_id, 1, CAST(takes AND t = 1 AS INTEGER), CAST(takes AND p = 1 AS INTEGER), takes FROM d WHERE k = 1 UNION ALL
SELECT d.series_id, d.k, CAST(d.t = 1 AND (a = 1 OR a + b = 0 AND takes) AS INTEGER), CAST(d.p = 1 AND (b = 1 OR a + b = 0 AND takes) AS INTEGER), a + b = 0 AND takes FROM onward o JOIN d ON d.series_id = o.series_id AND d.k = o.k + 1)
SELECT series_id, label, start, "end", p_start, p_end, overlap FROM d JOIN onward USING (series_id, k) WHERE took"""


def _right(pairs: str, sizes: str, thresholds: list[float], by: str, keep: str) -> str:
    """Shares of predicted and true occurrences that are paired and overlap by a threshold at least."""
    levels = ", ".join(f"CAST({t} AS DOUBLE)" for t in thresholds)
    right = f"SELECT {by}, threshold, count(*) FILTER (overlap / (p_end - p_start) >= threshold) AS right_p, count(*) FILTER (overlap / (\"end\" - start) >= threshold) AS right_t FROM ({pairs}), (SELECT unnest([{levels}]) AS threshold) GROUP BY ALL"
    return f"SELECT {keep}, threshold, CASE WHEN n_p > 0 THEN coalesce(right_p, 0) / n_p ELSE 0 END AS precision, CASE WHEN n_t > 0 THEN coalesce(right_t, 0) / n_t ELSE 0 END AS recall FROM (SELECT *, unnest([{levels}]) AS threshold FROM ({sizes})) LEFT JOIN ({right}) USING ({by}, threshold)"


def event_scores(thresholds: list[float], one: bool = False) -> str:
    truth, found = (f"SELECT series_id, CAST(0 AS BIGINT) AS label, start, \"end\" FROM ({_islands(f'SELECT DISTINCT series_id, 0 AS label, idx FROM ({_points(t)})')})" if one else t for t in (TRUTH, FOUND))
    sizes = f"SELECT series_id, n_t, n_p FROM (SELECT series_id, count(*) AS n_t FROM ({truth}) GROUP BY 1) FULL JOIN (SELECT series_id, count(*) AS n_p FROM ({found}) GROUP BY 1) USING (series_id)"
    scored = _f1(_right(_paired(overlaps(truth, found)), sizes, thresholds, "series_id", "series_id"), "series_id, threshold")
    return f"SELECT series_id, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fscore, 6) AS fscore FROM ({scored})"


def label_event_scores(thresholds: list[float], weighted: bool = False) -> str:
    named = f"SELECT f.series_id, l.label, f.start, f.\"end\" FROM ({FOUND}) f JOIN ({matched_labels()}) l ON l.series_id = f.series_id AND l.p_label = f.label"
    pairs = _paired(f"SELECT * FROM ({overlaps(TRUTH, named)}) WHERE label = p_label")
    sizes = f"SELECT *, size AS n_t, {_weights(weighted)} AS weight FROM (SELECT series_id, label, count(*) AS size FROM ({TRUTH}) GROUP BY ALL) LEFT JOIN (SELECT series_id, label, count(*) AS n_p FROM ({named}) GROUP BY ALL) USING (series_id, label)"
    return _weighted(_right(pairs, sizes, thresholds, "series_id, label", "series_id, weight"), "series_id, threshold")


def threshold_mean(scores: str) -> str:
    return f"SELECT series_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('precision', 'recall', 'fscore'))} FROM ({scores}) GROUP BY 1"


def battery(thresholds: list[float]) -> str:
    kinds = ("precision", "recall", "fscore")
    parts = [f"SELECT series_id, 'amis' AS metric, ami AS score FROM ({adjusted_information()})"]
    for prefix, scores in (("sss", sample_prf()), ("ss", label_scores()), ("w-ss", label_scores(True))):
        parts += [f"SELECT series_id, '{prefix}-{c}', {c} FROM ({scores})" for c in kinds]
    for prefix, scores in (("ses", event_scores(thresholds, one=True)), ("es", label_event_scores(thresholds)), ("w-es", label_event_scores(thresholds, True))):
        scores = scores.replace(", 6) AS", ", 15) AS")  # means are rounded once
        parts += [f"SELECT series_id, '{prefix}-{c}_' || CAST(threshold AS VARCHAR), round({c}, 6) FROM ({scores})" for c in kinds]
        parts += [f"SELECT series_id, '{prefix}-auc-{c}', {c} FROM ({threshold_mean(scores)})" for c in kinds]
    return " UNION ALL ".join(parts)


def united() -> str:
    return f"SELECT series_id, CAST(0 AS BIGINT) AS label, start, \"end\" FROM ({_islands(f'SELECT DISTINCT series_id, 0 AS label, idx FROM ({_points(TRUTH)})')})"


def barycenter() -> str:
    return f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY series_id, label) AS n FROM ({TRUTH})), p AS (SELECT series_id, label, n, start, unnest(range(start, "end")) AS idx FROM t)
SELECT series_id, label, idx - start AS "at", round(sum(value) / n, 6) AS mean FROM p JOIN ({EVENTS}) USING (series_id, idx) GROUP BY series_id, label, idx - start, n"""


def masks() -> str:
    return f"""WITH p AS ({_points(TRUTH)}), k AS (SELECT DISTINCT series_id, label FROM p)
SELECT k.series_id, k.label, list(CAST(p.idx IS NOT NULL AS INTEGER) ORDER BY e.idx) AS mask FROM k JOIN ({EVENTS}) e ON e.series_id = k.series_id
LEFT JOIN p ON p.series_id = k.series_id AND p.label = k.label AND p.idx = e.idx GROUP BY ALL"""


def interval_births(m: int = 4) -> str:
    return f"""SELECT t.series_id, t.label, t.start, t."end", round(min(p.dist), 6) AS birth FROM ({TRUTH}) t
LEFT JOIN ({profile("trend", m)}) p ON p.series_id = t.series_id AND p.i >= t.start AND p.i <= t."end" - {m} GROUP BY ALL"""


def _signed_ranks() -> str:
    mean = scores("mean")
    tail = " + ".join(f"({c!r}) * pow(t, {k})" for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1))
    return f"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY dataset, setting) AS k, rank() OVER (PARTITION BY dataset, setting ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, setting, score) - 1) / 2 AS r FROM ({mean})),
c AS (SELECT * FROM m WHERE k = (SELECT count(DISTINCT algorithm) FROM m)),
o AS (SELECT algorithm, row_number() OVER (ORDER BY avg(r), algorithm) AS place, count(*) OVER () AS k FROM c GROUP BY algorithm),
g AS (SELECT a.algorithm AS better, b.algorithm AS worse, a.score - b.score AS gap FROM c a JOIN c b ON a.dataset = b.dataset AND a.setting = b.setting JOIN o x ON x.algorithm = a.algorithm JOIN o y ON y.algorithm = b.algorithm WHERE x.place < y.place),
d AS (SELECT *, count(*) OVER (PARTITION BY better, worse, abs(gap)) AS t, rank() OVER (PARTITION BY better, worse ORDER BY abs(gap)) AS first FROM g WHERE gap <> 0),
w AS (SELECT better, worse, count(*) AS n, coalesce(sum(first + (t - 1) / 2) FILTER (gap > 0), 0) AS up, sum(t * t - 1) AS ties FROM d GROUP BY ALL),
z AS (SELECT better, worse, coalesce(n, 0) AS groups, coalesce((up - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM (SELECT DISTINCT better, worse FROM g) LEFT JOIN w USING (better, worse)),
p AS (SELECT *, CASE WHEN groups > 0 THEN least(1, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * ({tail})) ELSE 1 END AS p FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z)),
h AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, better, worse) + 1)) AS step FROM p),
s AS (SELECT better, worse, groups, z, p, max(step) OVER (ORDER BY p, better, worse) AS p_adjusted FROM h)"""


def signed_ranks() -> str:
    return f"{_signed_ranks()} SELECT better, worse, groups, round(z, 6) AS z, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted FROM s"


def cliques(alpha: float) -> str:
    """Of all runs of names without two that differ those that no other such run holds."""
    return f"""{_signed_ranks()},
r AS (SELECT a.place AS low, b.place AS high FROM o a JOIN o b ON a.place < b.place
      WHERE NOT EXISTS (SELECT 1 FROM s JOIN o x ON x.algorithm = s.better JOIN o y ON y.algorithm = s.worse WHERE p_adjusted < {alpha} AND x.place >= a.place AND y.place <= b.place)),
q AS (SELECT *, row_number() OVER (ORDER BY low) AS clique FROM r WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.low <= r.low AND y.high >= r.high AND (y.low < r.low OR y.high > r.high)))
SELECT CAST(clique AS INTEGER) AS clique, CAST(place AS INTEGER) AS place, algorithm FROM q JOIN o ON place BETWEEN low AND high"""


def scores(what: str) -> str:
    raw = "SELECT event_type AS dataset, 'a' || (user_id % 3) AS algorithm, user_id % 5 AS setting, value AS score FROM events WHERE value IS NOT NULL"
    mean = f"SELECT dataset, algorithm, setting, round(avg(score), 6) AS score FROM ({raw}) GROUP BY ALL"
    ranked = f"""SELECT algorithm, avg(r) AS mean_rank, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY dataset, setting ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, setting, score) - 1) / 2 AS r,
count(*) OVER (PARTITION BY dataset, setting) AS k FROM ({mean})) WHERE k = (SELECT count(DISTINCT algorithm) FROM ({mean})) GROUP BY 1"""
    return {
        "mean": mean,
        "pivot": f"SELECT dataset, setting, {', '.join(f'''round(avg(score) FILTER (algorithm = 'a{k}'), 6) AS a{k}''' for k in range(3))} FROM ({mean}) GROUP BY ALL",
        "top2": f"SELECT dataset, algorithm, setting, score, CAST(r AS INTEGER) AS \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY dataset, setting ORDER BY score DESC, algorithm) AS r FROM ({mean})) WHERE r <= 2",
        "error": f"SELECT dataset, algorithm, setting, round(abs(score - last) / abs(last), 6) AS error FROM (SELECT *, last_value(score) OVER (PARTITION BY dataset, algorithm ORDER BY setting ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM ({mean})) WHERE last <> 0",
        "quartiles": f"SELECT dataset, algorithm, {', '.join(f'round(quantile_cont(score, {q}), 6) AS {n}' for n, q in (('q1', 0.25), ('q2', 0.5), ('q3', 0.75)))} FROM ({raw}) GROUP BY ALL",
        "ranks": f"SELECT algorithm, round(avg(r), 6) AS mean_rank FROM (SELECT algorithm, rank() OVER (PARTITION BY dataset, setting ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, setting, score) - 1) / 2 AS r FROM ({mean})) GROUP BY 1",
        "friedman": f"SELECT max(n) AS groups, count(*) AS names, round(12 * max(n) / (count(*) * (count(*) + 1)) * (sum(mean_rank * mean_rank) - count(*) * (count(*) + 1) * (count(*) + 1) / 4), 6) AS chi_square FROM ({ranked})",
        "differences": f"WITH r AS ({ranked}), c AS (SELECT count(*) AS k, max(n) AS n FROM r) SELECT a.algorithm AS better, b.algorithm AS worse, round(b.mean_rank - a.mean_rank, 6) AS difference, round((b.mean_rank - a.mean_rank) / sqrt(k * (k + 1) / (6 * c.n)), 6) AS z FROM r a JOIN r b ON (a.mean_rank, a.algorithm) < (b.mean_rank, b.algorithm) CROSS JOIN c",
        "zero": f"WITH m AS ({mean}) SELECT dataset, setting, algorithm, coalesce(score, 0) AS score FROM (SELECT DISTINCT dataset, setting FROM m) CROSS JOIN (SELECT DISTINCT algorithm FROM m) LEFT JOIN m USING (dataset, setting, algorithm)",
    }[what]
