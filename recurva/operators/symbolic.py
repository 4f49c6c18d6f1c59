"""Symbolic windows: means of pieces, letters by equal shares of the normal distribution, words and their runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.plans.kernels import by_series
from recurva.plans.series import windows


def paa(series: DataFrame, m: int, pieces: int) -> DataFrame:
    """(series_id, i, means): the means of equal pieces of each z-normalised window. pieces must divide m."""
    if m % pieces:
        raise ValueError("pieces must divide the window")
    size = m // pieces
    w = windows(series, m)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    w = w.withColumn("mean", total / m)
    w = w.withColumn("std", F.sqrt(F.aggregate(F.transform("w", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x) / m)).where("std > 1e-12")
    parts = [F.aggregate(F.slice("w", 1 + k * size, size), F.lit(0.0), lambda a, x: a + x) / size for k in range(pieces)]
    return w.select("series_id", "i", F.array(*((p - F.col("mean")) / F.col("std") for p in parts)).alias("means"))


def letter(x: Column, alphabet: int) -> Column:
    out = F.lit("a")
    for k in range(1, alphabet):
        out = F.when(x >= NormalDist().inv_cdf(k / alphabet), F.lit(chr(97 + k))).otherwise(out)
    return out


def words(series: DataFrame, m: int, pieces: int, alphabet: int) -> DataFrame:
    """(series_id, i, word)."""
    made = paa(series, m, pieces)
    return made.select("series_id", "i", F.array_join(F.transform("means", lambda x: letter(F.round(x, 9), alphabet)), "").alias("word"))


def without_repeats(said: DataFrame) -> DataFrame:
    """The first of every run of equal words."""
    order = Window.partitionBy("series_id").orderBy("i")
    return said.withColumn("before", F.lag("word").over(order)).where("before IS NULL OR before <> word").drop("before")


def bigrams(said: DataFrame) -> DataFrame:
    """(series_id, word, next, n): how often one word follows another."""
    order = Window.partitionBy("series_id").orderBy("i")
    following = said.withColumn("next", F.lead("word").over(order)).where("next IS NOT NULL")
    return following.groupBy("series_id", "word", "next").agg(F.count("*").alias("n"))


class Symbol:
    """A letter of a rule's right side in a doubly linked ring around the rule's guard: a word's number, or a rule."""

    __slots__ = ("value", "rule", "before", "after")

    def __init__(self, value: int = -1, rule: Rule | None = None):
        self.value, self.rule = value, rule
        self.before = self.after = self


class Rule:
    """guard: the ring's end; number: tells rules apart; uses: how many symbols stand for the rule."""

    __slots__ = ("guard", "number", "uses")

    def __init__(self, number: int):
        self.guard, self.number, self.uses = Symbol(), number, 0

    def symbols(self) -> Iterator[Symbol]:
        at = self.guard.after
        while at is not self.guard:
            yield at
            at = at.after


class Grammar:
    """A grammar built symbol by symbol so that no pair of neighbours occurs twice without overlap and every rule is
    used at least twice. Each step is a constant number of look-ups on average, so the whole is linear in time."""

    def __init__(self, words: Iterable[int]):
        self.start, self.made = Rule(0), 0
        self.guards = {id(self.start.guard)}
        self.rules_of: dict[int, Rule] = {}
        self.pairs: dict[tuple, Symbol] = {}
        for word in words:
            self._join(self.start.guard.before, own := Symbol(word))
            self._join(own, self.start.guard)
            if own.before is not self.start.guard:
                self._check(own.before)

    def _is_end(self, s: Symbol) -> bool:
        return id(s) in self.guards

    def _name(self, s: Symbol) -> tuple:
        return tuple((x.value, x.rule.number if x.rule else 0) for x in (s, s.after))

    def _join(self, a: Symbol, b: Symbol) -> None:
        a.after, b.before = b, a

    def _forget(self, s: Symbol) -> None:
        """The pair that begins at s is about to go."""
        if self._whole(s) and self.pairs.get(name := self._name(s)) is s:
            del self.pairs[name]

    def _whole(self, s: Symbol) -> bool:
        return not self._is_end(s) and not self._is_end(s.after)

    def _check(self, s: Symbol) -> bool:
        """Whether the pair that begins at s was replaced, because it stands elsewhere too."""
        if not self._whole(s):
            return False
        other = self.pairs.setdefault(self._name(s), s)
        if other is s or other.after is s or s.after is other:
            return False
        if self._is_end(other.before) and self._is_end(other.after.after):
            rule = self.rules_of[id(other.before)]
            self._replace(s, rule)
        else:
            self.made += 1
            rule = Rule(self.made)
            self.guards.add(id(rule.guard))
            self.rules_of[id(rule.guard)] = rule
            for x in (s, s.after):
                self._join(rule.guard.before, copy := Symbol(x.value, x.rule))
                self._join(copy, rule.guard)
                if copy.rule:
                    copy.rule.uses += 1
            self._replace(other, rule)
            self._replace(s, rule)
            self.pairs[self._name(rule.guard.after)] = rule.guard.after
        if (first := rule.guard.after).rule and first.rule.uses == 1:
            self._expand(first)
        if (last := rule.guard.before).rule and last.rule.uses == 1:
            self._expand(last)
        return True

    def _replace(self, s: Symbol, rule: Rule) -> None:
        """The pair that begins at s becomes a use of rule."""
        before, last = s.before, s.after
        after = last.after
        # Of equal symbols in a row only one of two overlapping pairs is known: if it goes, the other takes its place.
        beside = [(before.before, before)] if not self._is_end(before) else []
        beside += [(after, last)] if not self._is_end(after) else []
        beside = [x for x, gone in beside if self._whole(x) and self._whole(gone) and self._name(x) == self._name(gone)]
        for x in (before, s, last):
            self._forget(x)
        for x in beside:
            self.pairs.setdefault(self._name(x), x)
        for x in (s, last):
            if x.rule:
                x.rule.uses -= 1
        own = Symbol(rule=rule)
        rule.uses += 1
        self._join(before, own)
        self._join(own, after)
        if not self._check(before):
            self._check(own)

    def _expand(self, s: Symbol) -> None:
        """The last use of a rule becomes the rule's right side."""
        before, after, guard = s.before, s.after, s.rule.guard
        self._forget(before)
        self._forget(s)
        first, last = guard.after, guard.before
        self._join(before, first)
        self._join(last, after)
        self.guards.discard(id(guard))
        self.rules_of.pop(id(guard), None)
        for x in (before, last):
            if self._whole(x):
                self.pairs.setdefault(self._name(x), x)

    def spans(self) -> dict[Rule, list[tuple[int, int]]]:
        """Where each rule's words stand, everywhere it is used: (first word, past the last one)."""
        sizes: dict[int, int] = {}
        pending = [self.start]
        while pending:  # inner rules first, without recursion
            rule = pending[-1]
            inner = [s.rule for s in rule.symbols() if s.rule and id(s.rule) not in sizes]
            if inner:
                pending += inner
            else:
                sizes[id(pending.pop())] = sum(sizes[id(s.rule)] if s.rule else 1 for s in rule.symbols())
        out: dict[Rule, list[tuple[int, int]]] = {}
        stack = [(self.start, 0)]
        while stack:
            rule, at = stack.pop()
            for s in rule.symbols():
                if s.rule:
                    out.setdefault(s.rule, []).append((at, at + sizes[id(s.rule)]))
                    stack.append((s.rule, at))
                at += sizes[id(s.rule)] if s.rule else 1
        return {r: sorted(p) for r, p in out.items()}


def close(word: str, other: str) -> bool:
    """Words at distance 0 by a table of letters: no letter is more than one away."""
    return len(word) == len(other) and all(abs(ord(a) - ord(b)) <= 1 for a, b in zip(word, other, strict=True))


def grammar_motifs(series: DataFrame, m: int, pieces: int, alphabet: int, n: int, numerosity: str = "close") -> DataFrame:
    """The n rules used most in the start rule of a grammar of the series' words, wherever they stand, a stretch cut
    short where the rule's next one begins; ties go to the rule that is used first. numerosity leaves out words that are
    close to the last one kept, or equal to the one before ("equal"), or none ("none"). Kernel: a series' words in order."""
    if numerosity not in ("close", "equal", "none"):
        raise ValueError("numerosity is close, equal or none")

    def run(_: int, own: dict[str, np.ndarray]) -> list[tuple]:
        said, at = own["word"].tolist(), own["i"].tolist()
        if numerosity == "close":
            kept: list[int] = []
            for k, word in enumerate(said):
                if not kept or not close(said[kept[-1]], word):
                    kept.append(k)
            said, at = [said[k] for k in kept], [at[k] for k in kept]
        numbers: dict[str, int] = {}
        grammar = Grammar(numbers.setdefault(w, len(numbers)) for w in said)
        uses = Counter(s.rule for s in grammar.start.symbols() if s.rule)
        spans = grammar.spans()
        best = sorted(uses, key=lambda r: (-uses[r], spans[r][0]))[:n]
        rows = []
        for label, rule in enumerate(best):
            starts = [at[a] for a, _ in spans[rule]]
            ends = [at[b - 1] + m for _, b in spans[rule]]
            rows += [(label, a, min(b, after)) for a, b, after in zip(starts, ends, [*starts[1:], ends[-1]], strict=True)]
        return rows

    said = words(series, m, pieces, alphabet)
    said = without_repeats(said) if numerosity == "equal" else said
    return by_series(said.select("series_id", "i", "word"), ["i"], run, "label long, start long, end long")
