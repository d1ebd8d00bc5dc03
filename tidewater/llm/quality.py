"""Quality rules from line frequencies across the documents of one host.

A line that stands in many different documents of a host is the host's
template, not prose. Lines are normalised and hashed; each (host, line) is
counted over distinct documents; lines above the limits are removed; a document
that loses most of its words is rejected. Two plain rules (too few words, too
much repetition inside the text) reject as well.

Documents are told apart by their whole text: exact copies count once, so a
group of them, however large, does not turn its own prose into "template"
lines. Texts that differ anywhere are different documents, near copies too: no
sketch tells a near copy from a short text under a long template.

Defined results: null text counts as empty (0 words, rejected); a null source
is a host of its own; repeated rows each get the same result and count as one
document; an empty table gives an empty table; extra columns pass through
``clean`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, read, words_of
from tidewater.llm.registry import register
from tidewater.operators.common import materialize, salted_join

#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is template when it stands in at least this many distinct documents
#: of its host, and in at least this share of them.
LINE_MIN_DOCS = 10
LINE_MIN_SHARE = 0.05
#: A document is depleted when it loses more than this share of its words.
MAX_LOST_SHARE = 0.7
SYMBOLS = "#*$%&|<>"


def line_hash(line: Column) -> Column:
    """Hash of a normalised line: lower case, digits alike, single spaces."""
    x = F.regexp_replace(F.lower(line), r"[0-9]+", "0")
    return F.xxhash64(F.btrim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))


def _windows(words: Column) -> Column:
    """(hash, position) of each three-word window, sorted."""
    pairs = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(pairs))


def _repeated(windows: Column) -> Column:
    """Sorted positions of windows that have an equal one next to them."""
    same = F.filter(windows, lambda x, i: F.coalesce(
        (F.get(windows, i + 1)["h"] == x["h"]) | (F.get(windows, i - 1)["h"] == x["h"]),
        F.get(windows, i + 1)["h"] == x["h"], F.get(windows, i - 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words under three-word windows at these sorted starts."""
    return F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)


def measure(docs: DataFrame) -> DataFrame:
    """Row-local measures in one scan of the texts: doc_id, host, h (content
    hash), the base counts, and lines (hash and words of each line).
    Written to the shared folder, because counting reads it more than once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumns({"words": words_of(F.col("text")), "raw": lines})
    d = d.select(
        "doc_id", "host", F.xxhash64("text").alias("h"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint").alias("n_dup_lines"),
        F.transform("raw", lambda x: F.struct(
            line_hash(x).alias("line"), F.size(words_of(x)).alias("words"))).alias("lines"),
        _windows(F.col("words")).alias("windows"))
    d = d.withColumn("starts", _repeated(F.col("windows")))
    d = d.select(
        "doc_id", "host", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _covered(F.col("starts")).alias("n_repeat_words"), "lines")
    return materialize(d, "quality")


def template_lines(measured: DataFrame, min_docs: int = LINE_MIN_DOCS, min_share: float = LINE_MIN_SHARE) -> DataFrame:
    """(host, line) above both limits. Distinct documents are counted in two
    steps, distinct rows first, so a hot line is combined before it is dealt."""
    lines = measured.select("host", "h", F.explode("lines.line").alias("line"))
    per_line = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    per_line = per_line.filter(F.col("n") >= min_docs)
    hosts = measured.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("all"))
    both = salted_join(per_line, hosts, ["host"], ["line"], null_safe=True, weight="all")
    return both.filter(F.col("n") >= min_share * F.col("all")).select("host", "line")


def judge(docs: DataFrame, max_lost: float = MAX_LOST_SHARE, **limits) -> DataFrame:
    """Measures and verdict for each row: ``kept`` is false if the base rules
    fail or more than ``max_lost`` of the words stand in template lines.
    ``n_lost_words`` counts those words, ``template`` holds their line hashes."""
    m = measure(docs)
    lines = m.select("doc_id", "host", "h", F.posexplode("lines").alias("pos", "l")).select(
        "doc_id", "host", "h", "pos", "l.line", "l.words")
    hit = salted_join(lines, template_lines(m, **limits), ["host", "line"], ["h"], null_safe=True).distinct()
    lost = hit.groupBy(F.col("doc_id").alias("_d"), F.col("host").alias("_s"), F.col("h").alias("_h")).agg(
        F.sum("words").alias("_lost"), F.collect_set("line").alias("template"))
    j = m.drop("lines").join(
        lost, m["doc_id"].eqNullSafe(lost["_d"]) & m["host"].eqNullSafe(lost["_s"]) & (m["h"] == lost["_h"]), "left")
    n_lost = F.coalesce("_lost", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return j.select(
        "doc_id", "host", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~(n_lost > max_lost * F.col("n_words"))).alias("kept"),
        n_lost.alias("n_lost_words"), "template")


def clean(docs: DataFrame, **limits) -> DataFrame:
    """Kept documents without their template lines; the columns of ``docs``.
    ``n_chars``, where present, follows the new text."""
    columns = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("_doc"),
        F.col("source").alias("_host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    verdict = judge(docs, **limits).filter("kept").select("doc_id", "host", "h", "template").distinct()
    on = (packed["_doc"].eqNullSafe(verdict["doc_id"]) & packed["_host"].eqNullSafe(verdict["host"])
          & (packed["_hash"] == verdict["h"]))
    j = packed.join(verdict, on).select("_row", "template")
    kept_lines = F.filter(F.split(F.col("_row.text"), "\n", -1), lambda x: (
        F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains(F.col("template"), line_hash(x)))
    text = F.when(F.col("template").isNull(), F.col("_row.text")).otherwise(F.array_join(kept_lines, "\n"))
    j = j.withColumn("_text", text)
    out = {c: F.col(f"_row.`{c}`").alias(c) for c in columns}
    out["text"] = F.col("_text").alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("template").isNull(), F.col("_row.n_chars")).otherwise(
            F.length("_text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return j.select(*[out[c] for c in columns])


@register("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    """Quality measures and the verdict for every document."""
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lost_words")
