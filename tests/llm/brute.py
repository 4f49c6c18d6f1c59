"""Plain definitions of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digest(spans, kinds):
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return joined, hashlib.sha256(joined.encode()).hexdigest()


def secret_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def shingles(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def groups(docs, n=3, percent=90):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if sets[i] and doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)]


def ids_of(texts, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def inner_top(rows, every, k, scale=64):
    out = []
    whole = {i: [int(np.floor(scale * float(np.float64(v)))) for v in x] for i, x in rows}
    for q in sorted(i for i in whole if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def nearest(rows, every, k):
    out = []
    xs = {i: np.array(x, float) for i, x in rows}
    for q in sorted(i for i in xs if i % every == 0):
        scored = sorted((float(np.sqrt(((xs[q] - x) ** 2).sum())), i) for i, x in xs.items() if i != q)[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(scored, 1)]
    return out


def best_fit_decreasing(lengths, window):
    """The fills of the windows, one by one: the longest first, each into the tightest window that holds it."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(window - length)
    return sorted(window - r for r in rooms)


def ranked_search(docs, items, k=20):
    import math
    from collections import Counter

    def terms(text):
        return Counter(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))

    known = [(i, c) for i, t in docs if (c := terms(t))]
    total = sum(c.total() for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in known:
            m = 100 - 25 + (25 * c.total() * len(known)) // total
            score = sum(n * math.floor(1000 * math.log((2 * len(known) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in terms(text).items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, doc_id, -s) for r, (s, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def spelled_words(docs):
    from collections import Counter

    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def variants(n):
    """(word, form, root, n, n_near, form_n) for words with counts, by trying all pairs."""

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out
