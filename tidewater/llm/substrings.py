"""Exact removal of passages that repeat across documents.

A word goes when some window of ``WINDOW`` words around it also starts in a
document with a smaller id. Windows are not compared one by one: recompression
(``recompress``) names runs and pairs round by round, and each window has an
anchor, the name of a stretch of words inside it that every equal window shares.
Neighbouring windows mostly share one anchor, so there are few of them.

1. (anchor, document) pairs are dealt by anchor; anchors of one document alone
   go. 2. Documents meet the list of their shared anchors; windows under those
   are named. 3. Window names are dealt by anchor and the least document of each
   is found: a window in a larger one is a repeat. 4. Documents meet the starts
   of their repeats, and lose the words under them.

Whole copies of a smaller id are told first, by their hashes, and take no part
in the steps. Texts are dealt by document once, for all of them. An anchor is one of the
hundreds of its document, so even one that stands in every third document is a
small part of the rows; window functions spill, and nothing is gathered but the
anchors and repeats of one document.

Names have 64 bits, and a repeat needs equal anchors (60 bits) and equal names.

Defined results: null text has no words; a row with a null id loses nothing and
removes nothing elsewhere; rows that share an id are one document, each judged
by its own text; a document's own repeats stay; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.recompress import Stretches, anchors
from tidewater.llm.registry import register
from tidewater.operators.common import salted_join

WINDOW = 13


def word_lists(texts: pa.Array) -> list[list[bytes]]:
    return [t.split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]


def _taking_part(b: pa.RecordBatch) -> list[list[bytes]]:
    """Words of the texts that have an id and are no copy; none for others."""
    out = zip(word_lists(b.column("text")), b.column("copy").to_pylist(), b.column("doc_id").to_pylist(), strict=True)
    return [[] if copy or doc is None else words for words, copy, doc in out]


def word_ids(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for ws in lists for w in ws), np.uint64, lengths.sum()), lengths


def _hashes(texts: pa.Array) -> np.ndarray:
    """XXH64 of each text as Spark's function gives it: with the id, the key of
    a text."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t or b"", 42) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts)).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, lengths = word_ids(_taking_part(b))
        _, seq, anchor = anchors(words, lengths, window, Stretches(words))
        if not len(seq):
            continue
        order = np.lexsort((anchor, seq))
        seq, anchor = seq[order], anchor[order]
        new = np.concatenate(([True], (seq[1:] != seq[:-1]) | (anchor[1:] != anchor[:-1])))
        doc = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[new].view(np.int64)), pa.array(doc[seq[new]])], names=["anchor", "doc_id"])


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of windows under one shared anchor: the place of
    the first and the names of all."""
    for b in batches:
        words, lengths = word_ids(_taking_part(b))
        stretches = Stretches(words)
        start, seq, anchor = anchors(words, lengths, window, stretches)
        lists = b.column("anchors")
        own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        # (text, anchor) pairs as one value: equal ones are what is shared
        keep = np.flatnonzero(np.isin(_paired(seq, anchor), _paired(own, flat)))
        if not len(keep):
            continue
        start, seq, anchor = start[keep], seq[keep], anchor[keep]
        names = stretches.names(start, start + window).view(np.int64)
        cut = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (seq[1:] != seq[:-1])))
        first = np.flatnonzero(cut)
        offsets = np.concatenate((first, [len(names)])).astype(np.int32)
        doc = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        place = start - begins[seq]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[first].view(np.int64)), pa.array(doc[seq[first]]), pa.array(_hashes(b.column("text"))[seq[first]]),
             pa.array(place[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(names))],
            names=["anchor", "doc_id", "th", "place", "names"])


def _paired(seq: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return anchor + seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def copies(texts: DataFrame) -> DataFrame:
    """(doc_id, copied): hashes of those of its texts that a smaller id has
    whole. A large group of copies meets as one count, not as rows."""
    marks = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("size"))
    firsts = marks.groupBy("th", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    later = salted_join(marks, firsts, ["th", "size"], ["doc_id"], null_safe=True, weight="rows").filter("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("th").alias("copied"))


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The texts dealt by document, with ``copy`` (a smaller id has the whole
    text), and (doc_id, places): where windows start that also start in a
    document with a smaller id. Copies are left out of the latter: every word
    of theirs goes, and their windows start in the first of them as well."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # a text without an id is dealt by its hash
    texts = texts.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    dealt = texts.repartition("key").join(copies(texts).withColumnRenamed("doc_id", "key").hint("shuffle_hash"), "key", "left").select(
        "key", "doc_id", "text", F.xxhash64("text").alias("th"), F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False)).alias("copy"))
    # no filter and no inner join on these: they would be pushed below the deal,
    # and the texts dealt once more for each
    pairs = dealt.select("doc_id", "text", "copy").mapInArrow(lambda b: _anchor_rows(b, window), "anchor bigint, doc_id bigint")
    w = Window.partitionBy("anchor")
    shared = pairs.withColumns({"a": F.min("doc_id").over(w), "b": F.max("doc_id").over(w)}).filter("a < b")
    lists = shared.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("anchor").alias("anchors"))
    met = dealt.join(lists.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "copy", "anchors")
    rows = met.mapInArrow(lambda b: _window_rows(b, window), "anchor bigint, doc_id bigint, th bigint, place bigint, names array<bigint>")
    rows = rows.repartition("anchor").select("anchor", "doc_id", "th", "place", F.posexplode("names").alias("i", "name"))
    w = Window.partitionBy("anchor", "name")
    found = rows.withColumn("a", F.min("doc_id").over(w)).filter("a < doc_id")
    # plain lists of numbers for each text, then the few texts of a key
    found = found.groupBy(F.col("doc_id").alias("key"), "th").agg(F.collect_list(F.col("place") + F.col("i")).alias("places"))
    return dealt, found.groupBy("key").agg(F.collect_list(F.struct("th", "places")).alias("starts"))


def covered(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie under a window that starts at these places."""
    step = np.bincount(places, minlength=n + window) - np.bincount(places + window, minlength=n + window)[:n + window]
    return np.cumsum(step)[:n] > 0


def prune(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space)
    of every row."""
    dealt, found = repeats(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = word_lists(b.column("text"))
            places, copy = b.column("places"), b.column("copy").to_pylist()
            n_removed, kept = [], []
            for i, words in enumerate(lists):
                if copy[i]:
                    words = words if len(words) < window else []
                elif places[i].is_valid and words:
                    gone = covered(np.asarray(places[i].values, np.int64), len(words), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(len(lists[i]) - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    # joined by the key that the texts are dealt by; a text takes its own starts
    own = F.get(F.filter("starts", lambda x: x["th"] == F.col("th")), F.lit(0))["places"]
    met = dealt.join(found.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "copy", own.alias("places"))
    return met.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
least_id AS (SELECT g, MIN(doc_id) AS d FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN least_id USING (g) WHERE d < doc_id),
place AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, COUNT(*) AS n
  FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", SQL)
def op8_substring_dedup(spark, sf_dir):
    """Every document without the passages that a smaller id also has."""
    return prune(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
