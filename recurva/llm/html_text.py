"""Main text of web pages by equivalence-class template deduction.

Pages become sequences of tokens, each a tag or a run of text, told apart by the path of elements around it; runs
between separating elements make a block. A slot is such a path without inline and paragraph elements. Over the
different pages of a host every slot has an occurrence vector, how many blocks it holds in each page, and slots with
equal vectors are a class. Slots that stand in enough of the host's pages are valid and, nested as their paths are, form
the host's template tree. Going down from its root, into the slot that holds more than half of its parent's text outside
links, as long as there is one, leads to the article. Of the slots passed by on the way those are the article's as
well that hold a quarter as much or belong to the chosen slot's class. The text of these slots is extracted, whatever
they are called; what lies outside of them is not. A block that stands in enough of a host's pages, equally often in
each, is template text and left out, unless it is a heading.

Tags and names break ties only: reader comments, adverts, menus, forms and the like never lead the way down nor count as
text of the article around them; the way ends at an element that calls itself the article, inside which only such
elements are left out (a section called discussion or legal stays); and a page most of whose text outside links lies
elsewhere, being of another layout, is judged by its own tags, as is one where no slot holds most. Scripts and hidden
elements are never text.

Vectors are never gathered: the exclusive or of a hash of each page and its count stands for a vector and is added
up in the shuffle's partial aggregates, so a host with a third of all pages costs no single task. Valid slots of a host
are no more than twice those of a page, and only they come together.

Defined results: a null or empty html gives an empty text; a null url counts as a host of its own; null page_ids and
repeated rows are kept, one result row each; pages of equal html count once for their host's template; a host of any
number of pages has a tree, but text repeats by template only where LEAST_PAGES pages show it; very long or
deeply nested pages cost time in proportion to their length; an article's own <header> counts as page furniture;
an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.common import staged
from recurva.llm.tokens import slices

#: A slot or block is valid when it stands in this share of its host's pages.
SUPPORT = 0.5
#: Fewer different pages than these do not show that a text repeats by template.
LEAST_PAGES = 3
#: What is said of a slot: never leads to the article, is named as no part of it, names itself the article, whole page.
STRONG, WEAK, NAMED, PAGE = 1, 2, 4, 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
# HTML's elements by their part in a page.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rb", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "textarea", "iframe", "select", "button", "input", "dialog", "menu", "svg", "math", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp"}
#: Those whose content is no text of the page in any place.
_NEVER = _ASIDE - {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
_ARTICLE = {"article", "main"}
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|adbox|adsense|banner|sponsor(?:ed)?|promo|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|comment|comments|comment-list|respond|reply|replies|disqus|discussion|related|recommended|share|sharing|social|search|toolbar|pagination|pager|skip|legal|copyright|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_ARTICLE_MARKS = re.compile(r"(?:^|[\s_-])(?:article|article-body|post|post-content|entry|entry-content|content|main|main-content|story)(?:$|[\s_-])", re.I)
#: Names that set a container aside whatever else it is called.
_ALWAYS = re.compile(r"(?:^|[\s_-])(?:comments?|cookies?|ads?|adv|advert\w*|newsletter|disqus)(?:$|[\s_-])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "figure", "figcaption"}
_BLOCK_LIMITS = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main"}


def hidden(attributes: str) -> bool:
    """An element so marked by an attribute of its own; the words of its class say nothing."""
    if not _MAY_HIDE.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True
    return False


@lru_cache(100_000)
def _below(parent: int, label: str) -> int:
    return _hash(f"{parent}/{label}")


class Place:
    """An open element in its page: what its ancestors and it say of the text in it. Elements of one label and parent
    are one place, so that each is judged once."""

    __slots__ = ("name", "parent", "below", "shown", "aside", "inside", "linked", "heading", "slot", "place", "says", "own", "state")

    def __init__(self, label: str = "", parent: Place | None = None):
        self.name, self.parent = label.split(".", 1)[0].rstrip("!"), parent
        self.below: dict[str, Place] = {}
        self.state: int | None = None  # in the article, once that is known
        if parent is None:
            self.shown, self.aside, self.inside, self.linked, self.heading, self.slot, self.place, self.says, self.own = True, False, False, False, False, 0, 0, PAGE, self
            return
        self.shown = parent.shown and not label.endswith("!") and self.name not in _NEVER
        self.aside = parent.aside or set_aside(label)
        self.inside = parent.inside or self.name in _ARTICLE
        self.linked = parent.linked or self.name == "a"
        self.heading = parent.heading or self.name in _HEADINGS
        self.says = says(label)
        # A slot is a path without inline elements and the places of single paragraphs: the stretch of template text lies in.
        self.slot = parent.slot if self.name in _INLINE or self.name in _PARAGRAPHS else _below(parent.slot, label)
        self.place = parent.place if self.name in _INLINE else _below(parent.place, label)
        self.own = parent.own if self.slot == parent.slot else self  # where its slot begins

    def child(self, label: str) -> Place:
        if label not in self.below:
            self.below[label] = Place(label, self)
        return self.below[label]


def tokens(page: str) -> Iterator[tuple[str, Place]]:
    """(text or "", place) in page order. A "" text marks where an element that separates blocks begins or ends."""
    stack = [Place()]
    open_: dict[str, int] = {}
    at = 0

    def drop(to: int) -> None:
        for x in stack[to:]:
            open_[x.name] -= 1
        del stack[to:]

    def close_up_to(names: set[str], limits: set[str] | None) -> None:
        """Closes the nearest open element of the names, unless one of the limits (None: any but inline ones) is nearer."""
        if not any(open_.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return drop(i)
            if stack[i].name in limits if limits is not None else stack[i].name not in _INLINE:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield page[at:], stack[-1]
            return
        if m.start() > at:
            yield page[at : m.start()], stack[-1]
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in _INLINE:
            yield "", stack[-1]
        if close:
            close_up_to({name}, None if name in _INLINE else set())
            continue
        if name in _CLOSE_P:
            close_up_to({"p"}, None)
        if name in _CLOSED_BY:
            close_up_to(_CLOSED_BY[name], _BLOCK_LIMITS)
        if name in _VOID or attributes.endswith("/") and name in {"svg", "path"}:
            continue
        words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        label = f"{name}.{' '.join(words.lower().split())}" if words else name
        stack.append(stack[-1].child(label + "!" if hidden(attributes) else label))
        open_[name] = open_.get(name, 0) + 1
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            yield (page[at : end.start()] if end else page[at:]), stack[-1]
            at = end.end() if end else len(page)
            drop(len(stack) - 1)


@lru_cache(100_000)
def set_aside(label: str) -> bool:
    """An element that is a menu, header, footer, sidebar, notice, advert, form, comment, script or hidden.
    Words of classes count on containers; html and body may carry any."""
    name, _, words = label.partition(".")
    if name.rstrip("!") in _ASIDE or label.endswith("!"):
        return True
    return bool(words) and name not in ("html", "body", "main") and bool(_ALWAYS.search(words) or _MARKS.search(words) and not _ARTICLE_MARKS.search(words))


@lru_cache(100_000)
def says(label: str) -> int:
    name, _, words = label.partition(".")
    name = name.rstrip("!")
    if name in ("html", "body"):
        return PAGE
    out = NAMED if name in _ARTICLE or words and name not in _INLINE and _ARTICLE_MARKS.search(words) else 0
    if name in _ASIDE or words and name != "main" and _ALWAYS.search(words):
        return STRONG | WEAK
    return out | (WEAK if set_aside(label) else 0)


def blocks(page: str) -> Iterator[list[tuple[str, Place]]]:
    """Block by block its runs of text."""
    block: list[tuple[str, Place]] = []
    for text, place in tokens(page):
        if not text:
            if block:
                yield block
            block = []
        elif place.shown:
            block.append((entities.unescape(text), place))
    if block:
        yield block


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parts(block: list[tuple[str, Place]]) -> dict[tuple[int, int], int]:
    """(slot, hash of the block's place and text there) of each slot it has, and its length outside links."""
    runs: dict[int, list[tuple[str, Place]]] = {}
    for run in block:
        runs.setdefault(run[1].slot, []).append(run)
    whole = {at: " ".join("".join(text for text, _ in own).split()) for at, own in runs.items()}
    return {(at, _hash(f"{runs[at][0][1].place}\x00{text}")): sum(len(x.strip()) for x, place in runs[at] if not place.linked) for at, text in whole.items() if text}


OUTSIDE, AROUND, WITHIN, GONE = range(4)


def _settle(place: Place, article: set[int]) -> int:
    """The state of a place in the host's article: outside, in it but not in an element that names itself the article,
    within such an element, or gone. Each place of a page is settled once, its ancestors first."""
    way = []
    at: Place | None = place
    while at is not None and at.state is None:
        way.append(at)
        at = at.parent
    state = at.state if at is not None else OUTSIDE
    for at in reversed(way):
        if state in (AROUND, WITHIN) and at.says & (STRONG | (WEAK if state == AROUND and not at.says & NAMED else 0)):
            state = GONE
        elif state == OUTSIDE and at.own is at and at.slot in article:
            state = AROUND
        if state == AROUND and at.says & NAMED:
            state = WITHIN
        at.state = state
    return state


def main_text(page: str, article: set[int], template: set[int], names: bool = True) -> str:
    """The text of the article's slots without template text, or, where most text lies elsewhere, what tags allow.
    names: whether tags and names have a say at all."""
    parsed = list(blocks(page))
    inside = outside = 0
    for block in parsed:
        for text, at in block:
            size = 0 if at.linked else len(text.strip())
            if (_settle(at, article) if at.state is None else at.state) in (AROUND, WITHIN):
                inside += size
            elif not (names and at.aside):
                outside += size
    deduced = inside > outside
    tagged = names and any(at.inside and not at.aside for block in parsed for _, at in block)
    out = []
    for block in parsed:
        known = {at for at, text in _parts(block) if text in template} if template else set()
        for text, at in block:
            fixed = at.slot in known and not at.heading
            kept = at.state in (AROUND, WITHIN) if deduced else not (names and at.aside) and (at.inside or not tagged)
            out.append(text if kept and not fixed else "")
        out.append("\n")
    return " ".join("".join(out).split())


def article_slots(tree: list[tuple[int, int, int, int, int]], names: bool = True) -> list[int]:
    """The slots that hold a host's articles, from its valid slots (slot, parent, vector, size of the text outside links
    in it, what is said of it); none if the way down ends at the whole page."""
    said = {slot: say if names else say & PAGE for slot, _, _, _, say in tree}
    size, vector = {t[0]: t[3] for t in tree}, {t[0]: t[2] for t in tree}
    below: dict[int, list[int]] = {}
    for slot, parent, *_ in tree:
        if slot != parent:
            below.setdefault(parent, []).append(slot)
    at, also = 0, []
    while at in below and not said.get(at, 0) & NAMED:
        can = [k for k in below[at] if not said[k] & STRONG]
        whole = size.get(at, 0) - sum(size[k] for k in below[at] if said[k] & STRONG)
        best = max(can, key=lambda k: (size[k], k), default=None)
        if best is None or not size[best] or 2 * size[best] <= whole:
            break
        for k in can:
            if k != best and size[k] and (4 * size[k] >= size[best] or said[k] & NAMED or vector[k] == vector[best] and not said[k] & WEAK):
                also.append(k)
        at = best
    return [] if said.get(at, PAGE) & PAGE else [at, *also]


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("\x00"))


def _slots(page: str) -> tuple[dict[tuple[int, int], list[int]], dict[int, list]]:
    """Of a page's blocks, by slot and text: how often each stands there and its length outside links. Of its slots: how
    many blocks each holds, their length outside links, the slot around it and what is said of it."""
    own: dict[tuple[int, int], list[int]] = {}
    tree: dict[int, list] = {}
    for block in blocks(page):
        for key, size in _parts(block).items():
            entry = own.setdefault(key, [0, 0])
            entry[0] += 1
            entry[1] += size
        sizes: dict[int, list] = {}
        for text, at in block:
            if text.strip():
                entry = sizes.setdefault(at.slot, [at.own, 0])
                entry[1] += 0 if at.linked else len(text.strip())
        for slot, (place, size) in sizes.items():
            entry = tree.setdefault(slot, [0, 0, place])
            entry[0] += 1
            entry[1] += size
    # Inner slots first: each adds what it holds to the slot around it.
    around = list(tree.values())
    for _, _, place in around:
        while place.parent is not None:
            place = place.parent.own
            if place.slot in tree:
                break
            tree[place.slot] = [0, 0, place]
    depth: dict[int, int] = {}
    for slot, entry in tree.items():
        way, place = [], entry[2]
        while place.slot not in depth and place.parent is not None:
            way.append(place.slot)
            place = place.parent.own
        below = depth.get(place.slot, 0)
        depth.setdefault(place.slot, below)
        for n, x in enumerate(reversed(way), 1):
            depth[x] = below + n
    for slot in sorted(tree, key=depth.__getitem__, reverse=True):
        n, size, place = tree[slot]
        parent = place.parent.own.slot if place.parent is not None else 0
        if place.parent is not None:
            tree[parent][0] += n
            tree[parent][1] += size
        tree[slot] = [n, size, parent, place.says]
    return own, tree


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its blocks (how often each stands in a slot) and, with a null block, its slots."""
    for batch in batches:
        for some in slices(batch):
            rows: list[tuple] = []
            for host, page in zip(some.column("host").to_pylist(), some.column("html").to_pylist(), strict=True):
                own, tree = _slots(page or "")
                content = _hash(page or "") if own else 0
                rows += ((host, at, text, content, n, size, None, None) for (at, text), (n, size) in own.items())
                rows += ((host, at, None, content, n, size, parent, said) for at, (n, size, parent, said) in tree.items())
            kinds = (pa.string(), *[pa.int64()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "slot", "block", "content", "n", "size", "parent", "says"])


def templates(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, article (the slots of its template that hold its articles) and template (its blocks of template text)."""
    seen = pages.select("host", "html").mapInArrow(_occurrences, "host string, slot long, block long, content long, n long, size long, parent long, says long")
    seen = staged(seen.distinct(), "html-blocks", "zstd")
    slots = seen.where("block IS NULL")
    total = staged(slots.where("slot = 0").groupBy("host").agg(F.count("*").alias("total")), "html-totals")
    enough = F.col("pages") >= SUPPORT * F.col("total")
    fixed = seen.where("block IS NOT NULL").groupBy("host", "block").agg(F.count("*").alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"))
    fixed = fixed.where(f"least = most AND pages >= {LEAST_PAGES}").join(total, "host").where(enough)
    vector = F.bit_xor(F.xxhash64("content", "n")).alias("vector")
    valid = slots.groupBy("host", "slot").agg(vector, F.count("*").alias("pages"), F.sum("size").alias("size"), F.min("parent").alias("parent"), F.min("says").alias("says"))
    valid = valid.join(total, "host").where(enough).groupBy("host").agg(F.collect_list(F.struct("slot", "parent", "vector", "size", "says")).alias("tree"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(k, 1) for k in range(batch.num_rows)):
                tree = some.column("tree")[0].values.flatten()
                way = article_slots(sorted(zip(*(x.to_pylist() for x in tree), strict=True)), names)
                yield pa.record_batch({"host": some.column("host"), "article": pa.array([way], pa.list_(pa.int64()))})

    best = valid.mapInArrow(found, "host string, article array<long>")
    known = fixed.groupBy("host").agg(F.collect_set("block").alias("template"))
    return best.join(known, "host", "full")


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url and text of every page. Without names the deduction stands alone."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    known = staged(templates(rows, names), "html-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                texts = [main_text(p, set(a or ()), set(t or ()), names) for p, a, t in zip(*(some.column(c).to_pylist() for c in ("html", "article", "template")), strict=True)]
                yield pa.record_batch({"page_id": some.column("page_id"), "url": some.column("url"), "text": pa.array(texts, pa.string())})

    return rows.join(known, "host", "left").select("page_id", "url", "html", "article", "template").mapInArrow(run, "page_id long, url string, text string")
