"""DuckDB SQL for the queries that SQL can express."""

_USABLE = """SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(x, lambda c: floor(64 * c)) AS w FROM ({_USABLE})),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score FROM r WHERE r <= 20"""

NEAREST = f"""
WITH v AS (SELECT * FROM ({_USABLE}) WHERE len(list_filter(x, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM s)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score FROM r WHERE r <= 10"""


def _matches(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    between, matches = f"string_split_regex(t, '{pattern}')", "regexp_extract_all(t, '{}', {})"
    zipped = f"list_zip({between}, {matches.format(pattern, 0)}, {matches.format(pattern, group)})"
    return f"SELECT doc_id, {place} AS kind, '{kind}' AS name, {zipped} AS m, {least} AS least FROM d"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


_ASSIGN = f"""({_either("password")}|{_either("passwd")}|{_either("secret")}|{_either("token")}|{_either("api")}_?{_either("key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({_matches("assign", 0, _ASSIGN, 2, 8)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 32)}),
u AS (SELECT doc_id, kind, name, least, generate_subscripts(m, 1) AS i, unnest(m) AS m FROM p),
e AS (SELECT doc_id, kind, name, i, m[2] AS own, length(m[3]) >= least AS stays,
             sum(length(m[1]) + length(coalesce(m[2], ''))) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
f AS (SELECT doc_id, kind, name, CAST(stop - length(own) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE own IS NOT NULL AND stays),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""

GROUPS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r(node, seen) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS least FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"

SEARCH = f"""
WITH q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM s, a),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM d, a GROUP BY t),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN d USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS o FROM r WHERE score > 0)
SELECT item_id, CAST(o AS INTEGER) AS "rank", doc_id, score FROM o WHERE o <= 20"""

# crc32 by a table made from its polynomial; a letter from U+00C0 on has the bytes 195 and its number less 64.
SPELLING = rf"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
u AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS u FROM documents),
c AS (SELECT doc_id, u, count(*) AS n FROM u WHERE length(u) >= 6 GROUP BY ALL),
b AS (SELECT doc_id, u, n, flatten(list_transform(string_split(doc_id || ':' || u, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM c),
h AS (SELECT u, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, crc),
r AS (SELECT CASE WHEN h % 199 = 0 THEN u[1:h % length(u)] || u[h % length(u) + 2:] ELSE u END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
p AS (SELECT DISTINCT x.word, x.n, y.word AS near, y.n AS near_n FROM v x JOIN v y ON x.v = y.v AND x.p = y.p AND x.word <> y.word
      UNION SELECT x.word, x.n, y.word, y.n FROM v x JOIN w y ON x.v = y.word
      UNION SELECT y.word, y.n, x.word, x.n FROM v x JOIN w y ON x.v = y.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
l AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN f USING (word)),
up(word, root) AS (SELECT word, coalesce(form, word) FROM l UNION ALL SELECT up.word, l.form FROM up JOIN l ON up.root = l.word WHERE l.form IS NOT NULL),
g AS (SELECT up.word, up.root FROM up JOIN l ON up.root = l.word WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM l JOIN g USING (word)"""
