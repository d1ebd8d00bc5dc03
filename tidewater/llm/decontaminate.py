"""Benchmark decontamination: windows as long as an item, compared by SimHash.

Words are lower-cased letters and digits; shingles are five words, with
repeats. For an item of n words the windows are n words of a document. A window
whose weighted similarity to the item (shared shingles over all, repeats
counted) is ``SIMILARITY`` or more lacks at most a fifth of the item's shingles,
so of any fifth and one more of them it has one: those are the item's anchors.
Windows are laid where an anchor stands in a document, aligned as in the item.
Each distinct window content gets a 64-bit SimHash, and joins the items of its
length through ``RADIUS + 1`` bit blocks: two fingerprints within RADIUS bits
agree in one block at least. Pairs within the radius are then compared exactly.
RADIUS leaves the fingerprints of windows at the similarity bound (about ten
bits apart) more than three standard deviations of room.

All of it is column expressions and joins. The anchors are broadcast in parts
of at most ``BROADCAST_ROWS`` rows, so a larger benchmark means more scans, not
a larger broadcast. Window contents are compared once, however many documents
hold them.

Defined results: null or blank text has no windows; items of fewer than five
words, or null, match nothing; a document shorter than an item is one window;
repeated items each get their rows; rows that repeat an id and a text count
once in the matches, and all of them go in ``drop_leaks``; a null id is matched
like any other; empty tables give no match; extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, words_of
from tidewater.llm.registry import register
from tidewater.operators.common import materialize, salted_join

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Anchor rows in one broadcast.
BROADCAST_ROWS = 200_000
_LANES = 0x0001000100010001


def plain(text: Column) -> Column:
    """Lower case; nothing but letters, digits and white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``n`` (words) and ``hashes`` (of its shingles, in order)."""
    d = df.withColumn("words", words_of(plain(F.col(text))))
    hashes = F.transform(
        F.slice("words", F.lit(1), F.size("words") - (SHINGLE - 1)),
        lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, SHINGLE)]))
    short = F.array().cast("array<bigint>")
    return d.withColumns({"n": F.size("words"), "hashes": F.when(F.size("words") >= SHINGLE, hashes).otherwise(short)})


def with_simhash(df: DataFrame) -> DataFrame:
    """``df`` with ``fp``, the 64-bit SimHash of its ``hashes``, repeats
    included: a bit is one if set in over half. Sixteen sums hold four 16-bit
    counters each; longer arrays are summed in pieces that do not overflow."""
    def count(part):
        zero = F.struct(*[F.lit(0).cast("bigint").alias(f"c{k}") for k in range(16)])
        return F.aggregate(part, zero, lambda acc, h: F.struct(*[
            (acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"c{k}") for k in range(16)]))

    size = 60_000
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / size).cast("int")),
                         lambda b: count(F.slice("hashes", b * size + 1, F.lit(size))))
    d = df.withColumn("counts", pieces)

    def ones(bit):
        lane, k = divmod(bit, 16)
        return F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, p: a + F.shiftrightunsigned(
            p[f"c{k}"], 16 * lane).bitwiseAND(F.lit(0xFFFF)))

    def bit_value(bit):
        return F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("bigint")

    bits = [F.when(2 * ones(b) > F.size("hashes"), bit_value(b)).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    return d.withColumn("fp", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("counts")


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block, value) of each of ``radius`` + 1 bit ranges."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def with_similarity(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``similarity``: shared over all shingles of the bags
    ``hashes`` and ``item_hashes``. Equal hashes are numbered to tell them
    apart, so a set operation counts them."""
    d = pairs.withColumns({"a": F.sort_array("hashes"), "b": F.sort_array("item_hashes")})
    d = d.withColumns({x: F.transform(x, _numbered(x)) for x in ("a", "b")})
    d = d.withColumn("shared", F.size(F.array_intersect("a", "b")))
    total = F.size("hashes") + F.size("item_hashes") - F.col("shared")
    return d.withColumn("similarity", F.col("shared") / total).drop("a", "b", "shared")


def _numbered(column: str):
    return lambda h, i: F.struct(h.alias("h"), (i + 1 - F.array_position(column, h)).alias("k"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n, hashes and fp of the items that can match."""
    d = with_shingles(benchmark.select("item_id", "text"), "text").filter(F.col("n") >= SHINGLE)
    return materialize(with_simhash(d.select("item_id", "n", "hashes")), "items")


def anchors_of(items: DataFrame, similarity: float) -> DataFrame:
    """h, n and the places ``js`` of the anchors of all items of n words. The
    anchors of an item are spread evenly over it."""
    m = F.size("hashes")
    need = F.floor((1 - similarity) * m + 1e-9).cast("int") + 1
    at = F.transform(F.sequence(F.lit(0), need - 1), lambda k: F.floor(k * m / need).cast("int"))
    d = items.select("n", "hashes", F.explode(at).alias("j0"))
    d = d.select("n", "hashes", F.get("hashes", F.col("j0")).alias("h"))
    # every place of the shingle in its item
    d = d.select("n", "h", F.explode(F.filter(
        F.transform("hashes", lambda x, i: F.when(x == F.col("h"), i)), lambda i: i.isNotNull())).alias("j"))
    return materialize(d.distinct(), "anchors")


def windows(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, th (text hash), start, n and hashes of each window laid on an
    anchor, once."""
    parts = max(1, -(-anchors.count() // BROADCAST_ROWS))
    shingled = with_shingles(docs.select("doc_id", "text"), "text")
    shingled = shingled.select("doc_id", F.xxhash64("text").alias("th"), F.col("n").alias("size"), F.col("hashes").alias("all"))
    found = []
    for part in range(parts):
        some = anchors.filter(F.pmod(F.col("h"), F.lit(parts)) == part)
        # outer: else a filter on the array's size is inferred and pushed below,
        # where it would spell the words out again for each shingle
        hit = shingled.select("*", F.posexplode_outer("all").alias("i", "h")).join(F.broadcast(some), "h")
        start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("j"), F.col("size") - F.col("n")))
        found.append(hit.select("doc_id", "th", "n", start.alias("start"), F.slice(
            "all", start + 1, F.col("n") - (SHINGLE - 1)).alias("hashes")))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "th", "start", "n"])


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, item_id, similarity and start (words) of the best window of
    each document for each item that it reaches the similarity with."""
    items = items_of(benchmark)
    laid = windows(docs, anchors_of(items, similarity))
    laid = materialize(laid.withColumn("content", F.xxhash64("hashes")), "windows")
    contents = laid.select("content", "n", "hashes").dropDuplicates(["content", "n"])
    prints = with_simhash(contents)
    left = prints.select("content", "n", "hashes", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    right = items.select("item_id", F.col("n").alias("item_n"), F.col("hashes").alias("item_hashes"), F.col("fp").alias("item_fp"),
                         F.explode(blocks(F.col("fp"), radius)).alias("item_b"))
    near = left.select("content", "n", "fp", "b.block", "b.value").join(
        right.select("item_id", "item_n", "item_fp", F.col("item_b.block").alias("block"), F.col("item_b.value").alias("value")),
        ["block", "value"]).filter("n = item_n").filter(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("content", "n", "item_id").distinct()
    both = near.join(contents, ["content", "n"]).join(
        items.select("item_id", F.col("hashes").alias("item_hashes"), F.col("n")), ["item_id", "n"])
    same = with_similarity(both).filter(F.col("similarity") >= similarity).select(
        "content", "n", "item_id", "similarity")
    per_content = same.groupBy("content", "n").agg(F.collect_list(F.struct("item_id", "similarity")).alias("found"))
    hits = salted_join(laid.drop("hashes"), per_content, ["content", "n"], ["doc_id"], null_safe=True).select(
        "doc_id", "th", "start", F.inline("found"))
    return hits.groupBy("doc_id", "th", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")).select(
        "doc_id", "th", "item_id", "best.similarity", (-F.col("best.s")).alias("start"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no item; the columns of ``docs``."""
    columns = docs.columns
    leaks = matches(docs, benchmark, **settings).select(F.col("doc_id").alias("_leak"), F.col("th").alias("_leak_th")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                         F.xxhash64("text").alias("_th"))
    clean = packed.join(leaks, packed["_doc"].eqNullSafe(leaks["_leak"]) & (packed["_th"] == leaks["_leak_th"]), "left_anti")
    return clean.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


# The same answer by way of every shared shingle, without fingerprints.
SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g'),
                                                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
ds AS (
  SELECT doc_id, n, p, array_to_string(words[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - 3)) AS p FROM d)),
bs AS (
  SELECT item_id, n, p, array_to_string(words[p:p + 4], ' ') AS g
  FROM (SELECT item_id, words, len(words) AS n, unnest(range(1, len(words) - 3)) AS p FROM b)),
laid AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, bs.n, greatest(0, least(ds.p - bs.p, ds.n - bs.n)) AS start
  FROM ds JOIN bs USING (g)),
held AS (
  SELECT laid.doc_id, item_id, laid.n, start, g, COUNT(*) AS k
  FROM laid JOIN ds ON ds.doc_id = laid.doc_id AND ds.p > start AND ds.p <= start + laid.n - 4 GROUP BY ALL),
wanted AS (SELECT item_id, g, COUNT(*) AS k FROM bs GROUP BY ALL),
shared AS (
  SELECT doc_id, held.item_id, n, start, SUM(held.k) AS size, SUM(least(held.k, coalesce(wanted.k, 0))) AS common
  FROM held LEFT JOIN wanted ON wanted.item_id = held.item_id AND wanted.g = held.g GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, common / CAST(size + n - 4 - common AS DOUBLE) AS similarity FROM shared)
SELECT doc_id, item_id, ROUND(similarity, 6) AS similarity, CAST(start AS BIGINT) AS start_word
FROM scored WHERE similarity >= {SIMILARITY}
QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@register("op7_decontamination", SQL)
def op7_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and the similarity
    of the best window."""
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("bigint").alias("start_word"))
