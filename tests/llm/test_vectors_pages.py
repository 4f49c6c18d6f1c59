"""Vector searches and page texts against brute force and hand-made pages."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from recurva.llm import ann, html_text, topk
from tests.llm import brute

DRAW = random.Random(11)
VECTORS = [(i, [float(np.float32(DRAW.gauss(0, 1))) for _ in range(12)]) for i in range(150)]
VECTORS += [(i, VECTORS[i % 7][1]) for i in range(150, 220)] + [(400, [0.0] * 12), (500, [1e-3] * 12)]
ODD = [(230, None), (240, [1.0, None] + [0.0] * 10), (260, [math.nan] * 12), (280, [math.inf] + [0.0] * 11), (None, [1.0] * 12)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, x, 1, 2, "b", 3.0) for i, x in VECTORS + ODD]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q int, b string, score double").repartition(3)


def test_inner_products(table):
    got = sorted(map(tuple, topk.impact_top_k(table).collect()))
    assert got == brute.inner_top(VECTORS, 20, 20)


def test_nearest(table):
    usable = [v for v in VECTORS if any(v[1])]
    got, want = sorted(map(tuple, ann.nearest(table).collect())), brute.nearest(usable, 100, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_vectors(table):
    few = table.where("vec_id IN (0, 1, 2)")
    assert sorted(map(tuple, topk.impact_top_k(few).collect())) == brute.inner_top(VECTORS[:3], 20, 20)
    assert len(ann.nearest(few).collect()) == 2
    assert topk.impact_top_k(table.limit(0)).collect() == [] == ann.nearest(table.limit(0)).collect()
    assert topk.impact_top_k(table.where("vec_id = 0")).collect() == []


def test_repeated_rows_count_once(table):
    twice = table.union(table)
    assert sorted(map(tuple, topk.impact_top_k(twice).collect())) == brute.inner_top(VECTORS, 20, 20)


def test_tiles_with_long_vectors_and_ties():
    draw = np.random.default_rng(4)
    xs = np.floor(draw.normal(0, 40, (600, 64)))
    xs[300:] = xs[:300]
    ids = np.arange(600)
    got = {q: [] for q in range(5)}
    for q, c, s in topk.impact_tile(xs, ids)(xs[:5], ids[:5], 20):
        for a, b, v in zip(q.tolist(), c.tolist(), s.tolist()):
            got[a].append((-v, b))
    for q in range(5):
        scores = (xs @ xs[q]).astype(int).tolist()
        assert sorted(got[q])[:20] == sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]


def page(title, body, extra=""):
    menu = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var x='<p>no</p>';</script></head><body>{menu}{extra}<article><h1>{title}</h1>{body}</article><div class='comments'><p>nice!</p></div><footer>(c) me</footer></body></html>"


PAGES = [
    (1, "http://a.com/1", page("One", "<p>Fish &amp; chips &lt;b&gt; <b>bo</b>ld\n  text</p><p>Two</p>"), "One Fish & chips <b> bold text Two"),
    (2, "http://a.com/2", page("Two", "<p>a<br>b</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>"), "Two a b x y 1 2"),
    (3, "http://a.com/3", page("Three", "<p>un<i>bel</i>ievable</p><aside>ad</aside><form>f<input></form><!-- <p>c</p> --><p>end</p>", "<div class='cookie-notice'>ok?</div>"), "Three unbelievable end"),
    (4, "http://a.com/4", None, ""),
    (5, "http://a.com/5", "", ""),
    (6, None, "plain text only", "plain text only"),
    (7, "http://b.com/1", "<html><body><div class='menu'>m</div><div id='content'><p>First page of the site</p><p>with &eacute;&#233;&#x41;</p></div><div class='sidebar'>s</div></body></html>", "First page of the site with ééA"),
    (8, "http://b.com/2", "<html><body><div class='menu'>m</div><div id='content'><p>Second page here, longer than all menus</div><div class='sidebar'>s</div></body></html>", "Second page here, longer than all menus"),
    (8, "http://b.com/2", "<html><body><div class='menu'>m</div><div id='content'><p>Second page here, longer than all menus</div><div class='sidebar'>s</div></body></html>", "Second page here, longer than all menus"),
    (None, "http://b.com/3", "<html><body><div class='menu'>m</div><div id='content'><p>Third <script>1 < 2</script>page of it all</div></body>", "Third page of it all"),
    (9, "http://c.com/x", page("Long", "<p>" + "word " * 50_000 + "</p>"), "Long " + ("word " * 50_000).strip()),
    (10, "not a url", "<<p>>odd < markup &unknown; & <p", None),
]


def test_main_text(spark):
    rows = [(i, u, h, 1, "t") for i, u, h, _ in PAGES]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, article int, host string")
    got = html_text.extract(table).collect()
    assert len(got) == len(PAGES)
    by = {(r["page_id"], r["url"]): r["text"] for r in got}
    for i, u, _, want in PAGES:
        if want is not None:
            assert by[i, u] == want
    assert html_text.extract(table.limit(0)).collect() == []


def test_equal_pages_on_one_host_are_templates_of_it(spark):
    body = "<html><body><div class='x1'><p>shared words of a menu</p></div><div class='x2'><p>{}</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", body.format(f"page {i} has its own story to tell, number {i * i} of the series")) for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"page {r['page_id']} has its own story" in r["text"] for r in got)


def texts(spark, pages):
    rows = [(i, f"http://h.org/{i}", h) for i, h in enumerate(pages)]
    return [r["text"] for r in sorted(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())]


def test_template_decides_over_tags(spark):
    own = [f"Story {i} tells of number {i * i} at some length and goes on for a while" for i in range(6)]
    fixed = "<p>Read all our stories for a small monthly fee</p>"
    got = texts(spark, [f"<body><article>{fixed}<p>{x}</p></article></body>" for x in own])
    assert got == own  # repeated text is no article, though tagged as one
    got = texts(spark, [f"<body><main><p>{i}</p></main><div class='widget'><p>{x}</p></div></body>" for i, x in enumerate(own)])
    assert got == [f"{i} {x}" for i, x in enumerate(own)]  # most of the text is, though named as none


def test_other_layouts_and_sections_are_kept(spark):
    own = [f"Story {i} tells of number {i * i} at some length and goes on for a while" for i in range(9)]
    pages = [f"<body><div class='x2'><p>{x}</p></div></body>" for x in own[:5]]
    pages += [f"<body><section class='y'><p>{x}</p></section></body>" for x in own[5:7]]
    pages += [f"<body><div class='x2'><p>{x}</p></div><div class='x3'><p>More of {x}</p></div></body>" for x in own[7:]]
    assert texts(spark, pages) == own[:7] + [f"{x} More of {x}" for x in own[7:]]


def test_hidden_only_as_an_attribute(spark):
    shown = "<div class='overflow-hidden'><p>a</p></div><div class=\"is hidden\"><p>b</p></div><div data-x='display:none'><p>c</p></div><div title=\"style='display:none' hidden\"><p>d</p></div>"
    gone = "<div hidden><p>1</p></div><div HIDDEN=''><p>2</p></div><div class='x' style='color:red; display : none'><p>3</p></div><div aria-hidden=true><p>4</p></div>"
    assert texts(spark, [f"<body>{shown}{gone}<p>e</p></body>"]) == ["a b c d e"]


def test_real_pages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    assert len(got) == table.count()
    for r in table.collect():
        text = got[r["page_id"]]
        assert text == " ".join(text.split()) and "<p>" not in text and "track(" not in text and "&amp;" not in text


def test_deep_and_broken_pages_take_no_longer_than_their_length():
    import time

    began = time.time()
    for unit, want in (("<div class='a b'>", "x"), ("<i>y</b>", "y" * 20_000 + "x"), ("<ul><li>", "x"), ("<table><tr><td>", "x")):
        assert html_text.main_text(unit * 20_000 + "x", set(), set()) == want
    assert time.time() - began < 30


def test_very_large_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (100 + 10 * (i % 12)), 1.0, float(i)]) for i in range(0, 60)] + [(100, [1e200, 2.0, 3.0]), (200, [2.0, 2.0, 3.0]), (300, [2.0, 2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(table).collect()))
    with np.errstate(over="ignore"):
        want = brute.nearest(rows, 100, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    top = topk.impact_top_k(table).collect()
    assert len(top) == 6 * 20 and all(-(1 << 63) <= r["score"] <= (1 << 63) - 1 for r in top)
    small = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 1e6, 5)]) for i in range(50)]
    got = topk.impact_top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute.inner_top(small, 20, 20)


def test_deduction_alone_finds_most_articles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got, alone = ({r["page_id"]: r["text"] for r in html_text.extract(table, names).collect()} for names in (True, False))
    assert sum(got[i] == alone[i] for i in got) >= 0.9 * len(got)


def test_headings_and_sections_of_an_article_stay(spark):
    own = [f"Story {i} tells of number {i * i} at some length and goes on for a while" for i in range(4)]
    body = "<body><div class='ad'>buy {i} now</div><article><h2>Background</h2><p>{x}</p><section class='discussion'><p>talk {i}</p></section><section class='legal history'><p>law {i}</p></section><div class='related-work'><p>work {i}</p></div><div class='comments'><p>me too</p></div></article><div class='x9'>by {i}</div></body>"
    want = [f"Background {x} talk {i} law {i} work {i}" for i, x in enumerate(own)]
    assert texts(spark, [body.format(i=i, x=x) for i, x in enumerate(own)]) == want
    assert texts(spark, [body.format(i=0, x=own[0])]) == want[:1]  # one page is enough for a tree


def test_teasers_beside_a_story_are_left_out(spark):
    story = " ".join(f"sentence {i} of the story" for i in range(30))
    page_ = f"<body><div class='content'><h1>Title</h1><p>{story}</p></div><div class='x'><article><p>Read this too</p></article></div></body>"
    assert texts(spark, [page_]) == [f"Title {story}"] and texts(spark, [page_] * 2) == [f"Title {story}"] * 2


def test_trees_against_plain_sums():
    """Slots of a page: blocks and text of everything below each, and the way down by hand."""
    page_ = "<body><nav><a href=x>menu menu menu</a></nav><div class=a><div class=b><p>one two</p><p>three</p></div><div class=c><p>four</p></div></div><p>direct</p></body>"
    own, tree = html_text._slots(page_)
    by_size = {(n, size) for n, size, _, _ in tree.values()}
    assert by_size == {(5, 22), (1, 0), (3, 16), (2, 12), (1, 4)} and sum(n for n, _ in own.values()) == 5
    slots = {(n, size): s for s, (n, size, _, _) in tree.items()}
    parents = {s: p for s, (_, _, p, _) in tree.items()}
    assert parents[slots[2, 12]] == parents[slots[1, 4]] == slots[3, 16]
    rows = [(s, p, n, size, said) for s, (n, size, p, said) in tree.items()]
    # Down into a, then into b, with c, a third of it, as its neighbour.
    assert html_text.article_slots(sorted(rows)) == [slots[2, 12], slots[1, 4]]
    assert html_text.article_slots([(0, 0, 1, 9, 8), (1, 0, 1, 4, 0), (2, 0, 2, 5, 1)]) == [1] and html_text.article_slots([(0, 0, 1, 9, 8)]) == []
