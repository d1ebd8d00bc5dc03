"""Language spans of a text: word scores and a Viterbi path over them.

Each word is scored for each learnt language by the log likelihood of its
letter runs (one to three letters, word ends marked) and of the word itself,
against the average language. Its script narrows the candidates: a language
that hardly uses the script is out. A Viterbi path with a penalty for every
switch labels the words, so a quoted passage gets its own span and a stray
foreign word does not. The language with most letters on the path is the
prediction; the score is its share.

Learning is bounded: at most TRAIN_ROWS documents, the first by hash of doc_id;
runs are hashed to BUCKETS. Prediction covers every word of every text.

Defined results: null text, or text without a letter, is ``und`` with score 0;
null lang is not learnt from; with nothing to learn from, all is ``und``; equal
scores go to the language first in the alphabet; repeated rows each get their
result; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register

TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
#: Most frequent (language, word) counts that give words a score of their own.
WORDS = 1 << 16
#: Log odds that a switch of language costs.
SWITCH = 12.0
#: A word's log odds are cut off here, so that one word cannot carry a span.
CAP = 8.0
#: Share of a language's training words that a script needs to be its own.
SCRIPT_SHARE = 0.01
#: First code points of the script ranges told apart, in order.
SCRIPTS = {"latin": (0x41, 0x24F), "latin+": (0x1E00, 0x1EFF), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F),
           "armenian": (0x530, 0x58F), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x77F), "devanagari": (0x900, 0x97F),
           "bengali": (0x980, 0x9FF), "tamil": (0xB80, 0xBFF), "thai": (0xE00, 0xE7F), "georgian": (0x10A0, 0x10FF),
           "hangul": (0xAC00, 0xD7AF), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF)}


def _patterns() -> tuple[re.Pattern, frozenset]:
    """Runs of letters with the marks on them, and what makes them needed: marks,
    and signs that count as alphanumeric but are no letters (fractions, raised and
    circled digits), by category."""
    every = [(chr(c), unicodedata.category(chr(c))) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    signs = "".join(c for c, kind in every if kind in ("Nl", "No"))
    marks = "".join(c for c, kind in every if kind[0] == "M")
    return re.compile(rf"[^\W\d_{signs}]+(?:[{marks}]+[^\W\d_{signs}]*)*"), frozenset(signs + marks)


_PLAIN = re.compile(r"[^\W\d_]+")
_MARKED, _RARE = _patterns()


def _word(low: str) -> re.Pattern:
    """The pattern of words for a text: the plain one, many times faster, unless
    the text has marks or such signs."""
    return _PLAIN if low.isascii() or _RARE.isdisjoint(low) else _MARKED


_KEEP = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWS = np.array([a for a, _ in SCRIPTS.values()])
_HIGHS = np.array([b for _, b in SCRIPTS.values()])
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    """Runs of letters, with the marks on them, lower-cased."""
    low = (text or "").lower()
    return _word(low).findall(low)


def scripts(batch: list[str]) -> np.ndarray:
    """Index of the script of each word's first letter; the last for others."""
    first = np.fromiter((ord(w[0]) for w in batch), np.int64, len(batch))
    inside = (first[:, None] >= _LOWS) & (first[:, None] <= _HIGHS)
    return np.where(inside.any(axis=1), inside.argmax(axis=1), len(SCRIPTS))


def runs(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word position, bucket) of the letter runs of these words."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 2
    letters = np.frombuffer(("\x02" + "\x03\x02".join(batch) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    who = np.repeat(np.arange(len(batch)), sizes)
    place, bucket = [], []
    h = np.zeros(len(letters), np.uint64)
    for n in range(3):
        stop = len(letters) - n
        h = h[:stop] * _MIX + letters[n:] * np.uint64(0x100000001B3) + np.uint64(n + 1)
        same = who[:stop] == who[n:]
        if not n:  # word ends alone say nothing
            same &= letters > 3
        mixed = (h ^ (h >> np.uint64(29))) * _MIX
        place.append(who[:stop][same])
        bucket.append((mixed >> np.uint64(48))[same].astype(np.int64))
    return np.concatenate(place), np.concatenate(bucket)


def count(rows: DataFrame) -> DataFrame:
    """(lang, kind, item, n): letter runs by bucket, words, scripts."""
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                found = [w for t in part["text"] for w in words(t)]
                if not found:
                    continue
                _, bucket = runs(found)
                ids, n = np.unique(bucket, return_counts=True)
                kinds, m = np.unique(scripts(found), return_counts=True)
                own = pd.Series(found).value_counts()
                yield pd.DataFrame({
                    "lang": lang, "kind": ["run"] * len(ids) + ["script"] * len(kinds) + ["word"] * len(own),
                    "item": [*map(str, ids), *map(str, kinds), *own.index],
                    "n": np.concatenate((n, m, own.to_numpy())).astype(np.int64)})

    return rows.mapInPandas(run, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(
        F.sum("n").alias("n"))


class Model:
    """Log odds of letter runs and frequent words, and scripts, by language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        index = {x: i for i, x in enumerate(self.langs)}
        table = np.zeros((BUCKETS, len(self.langs)))
        part = counts[counts["kind"] == "run"]
        table[part["item"].astype(int), part["lang"].map(index)] = part["n"]
        self.table = self._odds(table, 0.5).astype(np.float32)
        part = counts[counts["kind"] == "word"]
        self.word_rows = {w: i for i, w in enumerate(sorted(part["item"].unique()))}
        table = np.zeros((len(self.word_rows), len(self.langs)))
        table[part["item"].map(self.word_rows).to_numpy(int), part["lang"].map(index)] = part["n"]
        self.word_odds = self._odds(table, 2.0).astype(np.float32)
        part = counts[counts["kind"] == "script"]
        use = np.zeros((len(SCRIPTS) + 1, len(self.langs)))
        use[part["item"].astype(int), part["lang"].map(index)] = part["n"]
        share = use / np.maximum(use.sum(axis=0), 1)
        allowed = share >= SCRIPT_SHARE
        # a script that no language uses leaves all of them
        allowed[~allowed.any(axis=1)] = True
        self.script_odds = np.where(allowed, 0.0, -2 * CAP).astype(np.float32)
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    @staticmethod
    def _odds(table: np.ndarray, prior: float) -> np.ndarray:
        """Log of each language's rate over the mean rate; rates are smoothed
        toward the mean by ``prior`` counts."""
        total = np.maximum(table.sum(axis=0), 1)
        mean = (table / total).mean(axis=1, keepdims=True)
        scale = total.mean()
        rate = (table * (scale / total) + prior * np.maximum(mean * scale, 1e-3)) / (scale * (1 + prior / scale))
        return np.where(mean > 0, np.log(np.maximum(rate, 1e-12)) - np.log(np.maximum(mean, 1e-12)), 0.0)

    def score(self, new: list[str]) -> np.ndarray:
        place, bucket = runs(new)
        out = np.zeros((len(new), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(place, self.table[bucket, k], len(new))
        rows = np.fromiter((self.word_rows.get(w, -1) for w in new), np.int64, len(new))
        out[rows >= 0] += self.word_odds[rows[rows >= 0]]
        # runs overlap, so their sum says the same thing about three times
        out = np.clip(out / 2, -CAP, CAP) + self.script_odds[scripts(new)]
        return out - out.max(axis=1, keepdims=True)

    def emissions(self, found: list[str]) -> np.ndarray:
        """Scores of each word; those of new words are worked out first."""
        seen = self.seen
        new = list(set(found).difference(seen))
        if len(seen) + len(new) > _KEEP:
            seen.clear()
            new = list(set(found))
        if new:
            at, to = len(seen), len(seen) + len(new)
            if to > len(self.scores):
                grown = np.empty((2 * to, len(self.langs)), np.float32)
                grown[:at] = self.scores[:at]
                self.scores = grown
            self.scores[at:to] = self.score(new)
            seen.update(zip(new, range(at, to), strict=True))
        return self.scores[np.fromiter(map(seen.__getitem__, found), np.int64, len(found))]


def viterbi(e: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: highest sum of scores less ``switch`` for
    each change of language; of equal paths the one that stays."""
    rows = e.tolist()
    best, moves = rows[0], []
    for row in rows[1:]:
        top = max(best)
        jump = top - switch
        # None: every language stays; else where a jump comes from
        moves.append(None if min(best) >= jump else (best.index(top), [b < jump for b in best]))
        best = [(b if b >= jump else jump) + x for b, x in zip(best, row, strict=True)]
    at = best.index(max(best))
    path = [at]
    for move in reversed(moves):
        if move and move[1][at]:
            at = move[0]
        path.append(at)
    return np.array(path[::-1])


def one_language(e: np.ndarray, switch: float = SWITCH) -> int | None:
    """The language of the whole path, where a bound shows that none switches:
    no stretch favours another language by more than half a switch."""
    total = e.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    gain = np.cumsum(e - e[:, top:top + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.concatenate((np.zeros((1, e.shape[1])), low[:-1]))
    return top if (gain - low).max() <= switch / 2 else None


def spans(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, stop, language) of the stretches of a text, by its words."""
    low = (text or "").lower()
    places = list(_word(low).finditer(low))
    if not places or not model.langs:
        return []
    path = viterbi(model.emissions([m[0] for m in places]))
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
    return [(places[a].start(), places[b - 1].end(), model.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def predict_one(text: str | None, model: Model) -> tuple[str, float]:
    found = words(text)
    if not found or not model.langs:
        return UNKNOWN, 0.0
    e = model.emissions(found)
    top = one_language(e)
    if top is not None:
        return model.langs[top], 1.0
    size = np.fromiter(map(len, found), np.int64, len(found))
    letters = np.bincount(viterbi(e), size, len(model.langs))
    return model.langs[int(letters.argmax())], float(letters.max() / letters.sum())


def learn(docs: DataFrame, use: Column) -> pd.DataFrame:
    """Counts of the training documents. The result is bounded: BUCKETS runs
    for each language and the WORDS most frequent words."""
    known = use & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    # at most TRAIN_ROWS ids, so they may be broadcast; no text is dealt
    chosen = docs.filter(known).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text", "lang").filter(known & F.col("text").isNotNull()).join(
        F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    got = count(rows.select("lang", "text"))
    top = got.filter("kind = 'word'").orderBy(F.desc("n"), "item", "lang").limit(WORDS)
    return got.filter("kind <> 'word'").unionByName(top).toPandas()


def predict(docs: DataFrame, counts: pd.DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bc = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(bc.value)
        for b in batches:
            got = [predict_one(t, model) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Language of every document; a fifth of the ids is held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return predict(docs, learn(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
