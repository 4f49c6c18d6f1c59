"""Secret scans over a ledger of blobs: every distinct text is scanned once per rule version.

A blob is the SHA-256 of a text. The ledger folder holds `scanned` (sha, rule) and `found` (sha, rule, spans);
only pairs of blob and rule version that it lacks are scanned, and findings are joined back to every document with
that text. All of it is DataFrame functions. When few blobs are new, their ids are few, so Spark ships them to the
scan by its own size check and old texts do not move.

Defined results: a null text is empty; null doc_ids and repeated rows are kept, one result row each; very long texts
are read whole, in time proportional to their length and matches; spans that start alike come in the order of the rules; an empty table gives an
empty result; other columns are left behind.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurva.llm.common import shared_dir, staged, texts_of


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping; one stays if its group `group` has `least` code points."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules. A run of hex digits, or of AKIA and what follows it, that is too short
# fails as a whole wherever it is entered, so those two ask for the length in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
SPAN, STRETCH = "struct<start:long,kind:int,end:long>", "struct<start:long,end:long>"
#: Code points of a chunk that masked texts are put together from.
CHUNK = 4_096


def steps_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in turn: code points between the one before and it, its own, and whether it stays."""
    pattern = F.lit(rule.pattern)
    between, matches, kept = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("own")))
    return F.zip_with(steps, kept, lambda s, k: F.struct(s["gap"].alias("gap"), s["own"].alias("own"), (F.length(k) >= rule.least).alias("stays")))


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, found): paths has doc_id and sha of every document's text; found has sha, its spans (start, kind, end)
    by start, then kind, and cover, the stretches (start, end) that they cover, overlapping spans as one, for texts
    with any. ledger is a folder; without one, a new one is made in the shared folder. kind is the rule's place in
    rules. Places are running sums over a text's matches, in a window; nothing grows with the square of their number."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    texts = texts_of(docs).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("row", F.coalesce("doc_id", F.lit(-(2**63))))
    paths = staged(texts.select("doc_id", "row", "sha"), "secret-paths")
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = paths.groupBy("sha").agg(F.min("row").alias("row"))
    known = _known(spark, f"{ledger}/scanned", "sha binary, rule string")
    if known is None:
        due = blobs.withColumn("rules", names)
    else:
        # A blob's list is as long as there are rule versions.
        seen = known.groupBy("sha").agg(F.collect_set("rule").alias("seen"))
        due = blobs.join(seen, "sha", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        due = due.where(F.size("rules") > 0).drop("seen")
    due = staged(due, "secret-due")
    todo = texts.select("row", "sha", "text").join(due, ["row", "sha"])
    met = [F.when(F.array_contains("rules", r.name) & F.col("text").rlike(r.pattern), steps_of(F.col("text"), r)) for r in rules]
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("kind"), m.alias("steps")) for i, (r, m) in enumerate(zip(rules, met, strict=True))))
    steps = todo.select("sha", F.explode(F.filter(each, lambda x: F.size(x["steps"]) > 0)).alias("x")).select("sha", "x.rule", "x.kind", F.posexplode("x.steps").alias("at", "step"))
    # A text that stands in several rows of one id comes several times. Rows of a text and rule stay together from here on.
    steps = steps.dropDuplicates(["sha", "rule", "at"]).repartition("sha", "rule")
    end = F.sum(F.col("step.gap") + F.col("step.own")).over(Window.partitionBy("sha", "rule").orderBy("at"))
    spans = steps.withColumn("end", end).where("step.stays").select("sha", "rule", F.struct((F.col("end") - F.col("step.own")).alias("start"), "kind", "end").alias("span"))
    spans.groupBy("sha", "rule").agg(F.collect_list("span").alias("spans")).write.mode("append").parquet(f"{ledger}/found")
    due.select("sha", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{ledger}/scanned")
    found = spark.read.schema(f"sha binary, rule string, spans array<{SPAN}>").parquet(f"{ledger}/found").where(F.col("rule").isin([r.name for r in rules]))
    each = found.dropDuplicates(["sha", "rule"]).select("sha", F.explode("spans").alias("span")).select("sha", "span.*")
    own = Window.partitionBy("sha").orderBy("start", "kind")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("apart", F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0))
    each = each.withColumn("stretch", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    cover = each.groupBy("sha", "stretch").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"), F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("cover"))
    found = cover.groupBy("sha").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"), F.array_sort(F.collect_list("cover")).alias("cover"))
    return paths.select("doc_id", "sha"), staged(found, "secret-found")


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: doc_id, sha (of its text), found, its spans, and cover, what they cover."""
    paths, found = findings(docs, ledger, rules)
    out = paths.join(found, "sha", "left")
    return out.select("doc_id", F.lower(F.hex("sha")).alias("sha"), F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"), F.coalesce("cover", F.array().cast(f"array<{STRETCH}>")).alias("cover"))


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, cover: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of cover replaced by the mark. What is between is put together from chunks of the
    text, so that no place is sought from the text's beginning."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cover, lambda c: c["end"]))
    stops = F.concat(F.transform(cover, lambda c: c["start"]), F.array(F.length(text).cast("long")))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            begin = F.greatest(a, k * CHUNK)
            return F.substr(F.get(chunks, k.cast("int")), (begin - k * CHUNK + 1).cast("int"), (F.least(b, (k + 1) * CHUNK) - begin).cast("int"))

        whole = F.transform(F.sequence(F.floor(a / CHUNK), F.floor((b - 1) / CHUNK)), part)
        return F.when(b > a, F.array_join(whole, "")).otherwise("")

    # As an element the chunks are made once for a text, not once for each piece.
    once = F.array(F.struct(chunks.alias("chunks"), starts.alias("starts"), stops.alias("stops")))
    made = F.transform(once, lambda x: F.array_join(F.zip_with(x["starts"], x["stops"], lambda a, b: between(x["chunks"], a, b)), mark))
    return F.get(made, F.lit(0))
