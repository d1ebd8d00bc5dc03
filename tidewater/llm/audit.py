"""Filter interaction audit: what each filter removes, in every order.

Five filters look at whole texts; four look at one text each, the fifth (``E``)
at copies in the whole table. What a filter removes depends on which ones ran
before it, so the audit counts, for each part of the table (``source``) and all
120 orders, what each step keeps, removes and would have removed.

Copies are found by radix text tries. The texts are range-partitioned by
adaptive prefixes: a first look takes cuts from the texts' first bytes, and
a prefix that holds more than its share is split again behind the longest
stretch its texts have in common. Where even that leaves a crowd (near copies
that differ here and there), the range is dealt further by a hash of the whole
text, so equal texts still meet. Each range arrives sorted and goes into
compressed tries whose terminals hold the smallest id; a walk gives the one id
for each text that is no copy. A trie is emptied once it has taken
``TRIE_BYTES`` of text, which only moves where it starts again: equal texts
stand next to each other. Equal texts of a map task meet as one row before they
are dealt, so a text that a third of all rows hold reaches its range once per
``FOLD_BYTES`` of input. Every document's five bits form a mask; the 600 rows of
a part come from its at most 32 mask counts, not from its documents.

The ranges decide balance only, never a result, so the looks are limited.

Defined results: a null text counts as empty; a null id is no smaller id and has
none, so it neither is a copy nor makes one; rows that share the smallest id of
a text are all first; of repeated labels of an id, one with the mark counts;
labels of null ids are ignored; a null ``source`` is the part ''; an empty table
has no part; other columns are ignored.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))

#: Bytes of text that a map task folds before it hands rows on, and that a trie
#: takes before it is walked and emptied.
FOLD_BYTES = 16 << 20
TRIE_BYTES = 32 << 20
#: Bytes of a prefix that one look reads (quantiles are doubles, so six bytes is
#: what they hold exactly), and the looks at crowded prefixes.
DIGIT = 6
LOOKS = 2


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def row_mask(text: bytes, points: int) -> int:
    """The bits of the filters A to D that a text fails."""
    words = text.split()
    mask = int(len(words) < MIN_WORDS) | int(100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    upper = len(text) - len(text.translate(None, UPPER))
    return mask | int(100 * upper > UPPER_PERCENT * points) << 2 | int(len(text.translate(None, SYMBOLS)) < len(text)) << 3


def _row_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _bytes(b.column("text"))
        points = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), pa.array(map(_digest, texts), pa.binary()),
             pa.array(map(row_mask, texts, points), pa.int32())], names=["doc_id", "part", "digest", "mask"])


# ---- adaptive prefixes


def _digit(text: Column, at: int) -> Column:
    """The bytes from ``at`` on as a number that sorts like them."""
    return F.conv(F.rpad(F.hex(F.substring(text, at + 1, DIGIT)), 2 * DIGIT, "0"), 16, 10).cast("bigint")


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes two texts share."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass(frozen=True)
class Ranges:
    """Where the texts go: ``cuts`` divide their order into ranges, and range r
    is ``widths[r]`` shards wide, chosen by a hash of the whole text."""

    cuts: tuple[bytes, ...]
    widths: tuple[int, ...]

    @property
    def shards(self) -> int:
        return sum(self.widths)

    def shard_of(self) -> Callable[[bytes], int]:
        begins = [0, *itertools.accumulate(self.widths)]

        def find(text: bytes) -> int:
            r = bisect_right(self.cuts, text)
            return begins[r] + (xxhash.xxh64_intdigest(text) % self.widths[r] if self.widths[r] > 1 else 0)
        return find


def ranges(texts: DataFrame, parts: int) -> Ranges:
    """Ranges that hold about equal numbers of the distinct texts, a few times
    ``parts`` of them at most. ``texts`` has one binary column ``text``."""
    grid = [i / parts for i in range(1, parts)]
    found: set[bytes] = set()
    crowded = [(b"", 1.0)] if grid else []
    for _ in range(LOOKS):
        fresh = []
        for prefix, share in crowded:
            under, shared = texts, prefix
            if prefix:
                under = texts.filter(F.startswith("text", F.lit(prefix)))
                ends = under.agg(F.min("text").alias("a"), F.max("text").alias("b")).first()
                if ends["a"] is None or ends["a"] == ends["b"]:
                    continue  # one text
                shared = bytes(ends["a"])[:common_prefix(bytes(ends["a"]), bytes(ends["b"]))]
            digits = under.groupBy(F.xxhash64("text")).agg(F.min(_digit(F.col("text"), len(shared))).alias("d"))
            cuts = digits.agg(F.percentile_approx("d", grid, F.lit(20 * parts))).first()[0] or []
            # a prefix with this share of the texts deserves this many of the cuts
            step = max(1, round(1 / share))
            for value, run in itertools.groupby(cuts[step - 1::step]):
                cut = shared + int(value).to_bytes(DIGIT, "big").rstrip(b"\0")
                found.add(cut)
                n = len(list(run))
                if n > 1:
                    fresh.append((cut, share * n * step / parts))
        crowded = fresh
    cuts = sorted(found)
    widths = [1] * (len(cuts) + 1)
    for cut, share in crowded:
        widths[bisect_right(cuts, cut)] = max(1, round(share * parts))
    return Ranges(tuple(cuts), tuple(widths))


# ---- tries


class RadixTrie:
    """A compressed trie of byte strings; a terminal holds the smallest id. An
    edge is a stretch of a text that is held anyway, so nothing is copied."""

    __slots__ = ("root",)

    def __init__(self):
        # text, where the edge starts and ends in it, children by first byte, id
        self.root = [b"", 0, 0, {}, None]

    def insert(self, text: bytes, doc: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[3].get(text[at])
            if child is None:
                node[3][text[at]] = [text, at, len(text), {}, doc]
                return
            label, start, end = child[0], child[1], child[2]
            if text[at:at + end - start] == label[start:end]:
                node, at = child, at + end - start
                continue
            n = common_prefix(text[at:at + end - start], label[start:end])
            fork = [label, start, start + n, {label[start + n]: child}, None]
            child[1] = start + n
            node[3][text[at]] = fork
            node, at = fork, at + n
        if node[4] is None or doc < node[4]:
            node[4] = doc

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Every text with its smallest id."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[4] is not None:
                yield node[0][:node[2]], node[4]
            stack.extend(node[3].values())


def _fold(batches: Iterator[pa.RecordBatch], dealt: Ranges) -> Iterator[pa.RecordBatch]:
    """One row for each text that this task meets within FOLD_BYTES: its shard,
    the text, its smallest id."""
    shard_of = dealt.shard_of()
    seen: dict[bytes, int] = {}
    held = 0

    def rows():
        texts = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(map(shard_of, texts), pa.int32()), pa.array(texts, pa.binary()),
             pa.array(seen.values(), pa.int64())], names=["shard", "text", "doc_id"])

    for b in batches:
        for text, doc in zip(_bytes(b.column("text")), b.column("doc_id").to_pylist(), strict=True):
            old = seen.get(text)
            if old is None:
                held += len(text) + 100
                seen[text] = doc
            elif doc < old:
                seen[text] = doc
            if held >= FOLD_BYTES:
                yield rows()
                seen.clear()
                held = 0
    if seen:
        yield rows()


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest id of each text of a sorted range."""
    def walked(trie):
        ids, digests = [], []
        for text, doc in trie.walk():
            ids.append(doc)
            digests.append(_digest(text))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "digest"])

    trie, held, last = RadixTrie(), 0, None
    for b in batches:
        for text, doc in zip(_bytes(b.column("text")), b.column("doc_id").to_pylist(), strict=True):
            if held >= TRIE_BYTES and text != last:
                yield walked(trie)
                trie, held = RadixTrie(), 0
            held += len(text) + 100 if text != last else 0
            trie.insert(text, doc)
            last = text
    if last is not None:
        yield walked(trie)


def firsts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): for every text the smallest id that has it."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.filter("doc_id IS NOT NULL").select(
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    to = ranges(texts.select("text"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folded = texts.mapInArrow(lambda b: _fold(b, to), "shard int, text binary, doc_id bigint")
    dealt = folded.repartitionById(to.shards, "shard").sortWithinPartitions("shard", "text")
    return dealt.mapInArrow(_tries, "doc_id bigint, digest binary")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: fails filter i) of every row."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), "text")
    own = rows.mapInArrow(_row_masks, "doc_id bigint, part string, digest binary, mask int")
    first = firsts(docs).withColumn("first", F.lit(True))
    met = own.join(first, ["doc_id", "digest"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return met.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).cast("int").alias("mask"))


# ---- orders


def _sum(entries: str, what: str, test) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda n, e: n + F.when(test(e), e[what]).otherwise(F.lit(0).cast("bigint")))


def interactions(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders and steps of every part, from the masks and the labels."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    counts = masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("e"))
    steps = [(("".join(FILTERS[i] for i in order)), s + 1, 1 << order[s], sum(1 << i for i in order[:s]))
             for order in itertools.permutations(range(len(FILTERS))) for s in range(len(FILTERS))]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before"))
                      for o, s, bit, before in steps])
    rows = parts.select("part", "e", F.explode(table).alias("x"))
    bit, before = F.col("x.bit"), F.col("x.before")
    fails = lambda e: e["mask"].bitwiseAND(bit) != 0
    gone = lambda e: e["mask"].bitwiseAND(before) != 0
    # a document that fails k filters is removed by each of them first in 120 / k orders
    orders = F.aggregate("e", F.lit(0).cast("bigint"), lambda n, e: n + F.when(
        fails(e), e["n"] * F.expr("120") / F.bit_count(e["mask"])).otherwise(0).cast("bigint"))
    return rows.select(
        "part", F.col("x.filter_order").alias("filter_order"), F.col("x.step").alias("step"),
        _sum("e", "n", lambda e: e["mask"].bitwiseAND(before + bit) == 0).alias("kept"),
        _sum("e", "n", lambda e: fails(e) & ~gone(e)).alias("removed"),
        _sum("e", "n", lambda e: fails(e) & gone(e)).alias("redundant"),
        _sum("e", "n", lambda e: e["mask"] == bit).alias("unique_fails"),
        _sum("e", "good", lambda e: fails(e) & ~gone(e)).alias("good_lost"),
        _sum("e", "bad", lambda e: fails(e) & ~gone(e)).alias("toxic_lost"),
        orders.alias("shapley"))


SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         MIN(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
m AS (
  SELECT doc_id, part,
         (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
  FROM w),
marks AS (
  SELECT doc_id, MAX((quality = 1)::INT) AS good, MAX((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, COUNT(*) AS n, coalesce(SUM(good), 0) AS good, coalesce(SUM(bad), 0) AS bad
  FROM m LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(SUM(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(SUM(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(SUM(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(SUM(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(SUM(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(SUM(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(SUM(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


@register("op11_filter_audit", SQL)
def op11_filter_audit(spark, sf_dir):
    """Every source and order of the five filters over whole texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interactions(masks(docs), read(spark, sf_dir, "labels"))
