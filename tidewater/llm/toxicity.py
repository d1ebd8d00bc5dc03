"""Toxicity from a learnt lexicon, met through Levenshtein automata.

The lexicon is learnt from labelled documents: words, and word beginnings, that
stand in toxic documents far more often than chance allows (G-squared above the
Bonferroni line for the terms tested). The terms form a trie. The Levenshtein
automaton of every term is walked on the trie at once, as one automaton whose
states (sets of trie nodes with errors spent) are made deterministic when first
met; a word is read letter by letter and nearly always dies after a few. So a
misspelt term is found without comparing words with terms.

Each hit looks at a window around it: inside quotation marks or next to a verb
of saying it counts as quoted, else as direct. A logistic model over the counts
gives the score.

Learning is bounded: at most TRAIN_ROWS labelled documents, the first by hash
of doc_id, near copies once; at most TERMS terms. Scoring covers every word of
every text.

Defined results: null text counts as empty and gets the score of a text without
hits; labels that are null are not learnt from; without any usable label every
score is 0; a document with two labels is learnt from twice; repeated rows each
get their score; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches, words_of
from tidewater.llm.registry import register
from tidewater.operators.common import materialize

#: Bounds of what is learnt from.
TRAIN_ROWS = 20_000
TERMS = 2_000
#: Toxic documents that a term needs, and its share of toxic ones.
MIN_DOCS = 3
MIN_PRECISION = 0.2
#: Lengths of word beginnings that may be terms.
STEMS = (4, 5, 6, 7)
#: Letters that a term needs before a misspelling of it counts.
ONE_ERROR = 5
#: Context on either side: words, code points.
NEAR_WORDS, NEAR_CHARS = 5, 48
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W_]+")
_LEET = str.maketrans("0134578", "oieastb")
_QUOTES = re.compile("[\"“”„«»]")
#: Verbs of saying, in the languages of the tables.
SAYING = frozenset("said says say called calls wrote writes quote quoted quotes dit disait appelé écrit sagte sagt nannte "
                   "schrieb zitat dijo dice llamó escribió cita".split())
#: Words that address the reader.
ADDRESS = frozenset("you your youre tu te toi vous du dich dir ihr usted ustedes ti".split())
#: Verdicts and states kept in a worker before starting afresh.
_KEEP = 400_000


def with_terms(rows: DataFrame) -> DataFrame:
    """``rows`` with ``terms``: the distinct words of a text, and their
    beginnings marked by a star."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    d = rows.withColumn("words", words)
    stems = [F.transform(_longer(F.col("words"), n), _stem(n)) for n in STEMS]
    return d.withColumn("terms", F.array_distinct(F.concat("words", *stems)))


def _longer(words: Column, n: int) -> Column:
    return F.filter(words, lambda w: F.length(w) > n)


def _stem(n: int):
    return lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*"))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, text, toxic of the documents learnt from."""
    marked = labels.filter(F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # at most TRAIN_ROWS ids, so they may be broadcast; no text is dealt
    chosen = marked.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("words", words_of(F.col("text")))
    windows = F.transform(F.slice("words", F.lit(1), F.size("words") - 2), lambda w, i: F.xxhash64(
        w, F.get("words", i + 1), F.get("words", i + 2)))
    sketch = F.when(F.size("words") >= 3, F.array_min(windows)).otherwise(F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "toxic", sketch.alias("sketch"))
    return materialize(rows.dropDuplicates(["sketch", "toxic"]).drop("sketch"), "toxicity")


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Terms that mark toxic documents, stems with a star, each with its log
    ratio of toxic to other documents."""
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return {}
    seen = with_terms(train).select("toxic", F.explode_outer("terms").alias("term")).filter(
        F.col("term").isNotNull()).groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    seen = materialize(seen.filter(F.col("a") + F.col("b") >= MIN_DOCS), "terms")
    line = 2 * np.log(max(seen.count(), 2))
    base = pos / (pos + neg)
    a, n = F.col("a"), F.col("a") + F.col("b")

    def part(k, share):
        return F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)

    g2 = 2 * (part(a, base) + part(F.col("b"), 1 - base))
    good = seen.filter((a >= MIN_DOCS) & (a / n >= MIN_PRECISION)).withColumn("g2", g2).filter(F.col("g2") >= line)
    best = good.orderBy(F.desc("g2"), "term").limit(TERMS).collect()
    weight = {r["term"]: float(np.log((r["a"] + 0.5) / (pos + 1)) - np.log((r["b"] + 0.5) / (neg + 1))) for r in best}
    # a stem that one word alone brings in is that word
    words = [t for t in weight if not t.endswith("*")]
    lone = {t for t in weight if t.endswith("*") and sum(w.startswith(t[:-1]) for w in words) == 1}
    return {t: w for t, w in weight.items() if t not in lone}


class Lexicon:
    """Trie of terms with the automaton of their misspellings."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.accept: list[tuple[int, float]] = [(-1, 0.0)]  # errors that the term ending here admits, its weight
        self.stem: list[float | None] = [None]
        self.reach: list[int] = [0]  # errors that some term below admits
        for t, weight in terms.items():
            word = t.rstrip("*")
            errors = 0 if t.endswith("*") else int(len(word) >= ONE_ERROR)
            at = 0
            for c in word:
                self.reach[at] = max(self.reach[at], errors)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.accept.append((-1, 0.0))
                    self.stem.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
            self.reach[at] = max(self.reach[at], errors)
            if t.endswith("*"):
                self.stem[at] = weight
            else:
                self.accept[at] = (errors, weight)
        self._fresh()

    def _fresh(self):
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, float] | None] = []
        self.begun: list[float | None] = []
        self.seen: dict[str, tuple[int, float] | None] = {}
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """Number of the state of these (node, errors), with skipped letters."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and found.get(child, 9) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(found.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, -self.accept[n][1]) for n, e in key if e <= self.accept[n][0]]
            self.final.append((min(ends)[0], -min(ends)[1]) if ends else None)
            self.begun.append(next((self.stem[n] for n, e in key if not e and self.stem[n] is not None), None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def put(node, e):
            if e <= self.reach[node] and found.get(node, 9) > e:
                found[node] = e

        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
            put(node, e + 1)
        to = self._state(found)
        self.moves[state][c] = to
        return to

    def read(self, word: str) -> tuple[int, float] | None:
        """(errors, weight) of the term that a word is, or is one error from,
        or else of the longest stem that it begins with."""
        at, stem = self.start, None
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if not self.states[at]:
                return stem
            if self.begun[at] is not None:
                stem = (0, self.begun[at])
        end = self.final[at]
        return end if end and (not end[0] or not stem) else stem

    def verdict(self, token: str) -> tuple[int, float] | None:
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > _KEEP or len(self.states) > _KEEP:
            self._fresh()
        found = self.read(token)
        if not found and not token.isalpha():
            plain = token.translate(_LEET)
            found = self.read(plain) if plain.isalpha() else None
            found = found and (1, found[1])
        self.seen[token] = found
        return found


FEATURES = 8


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Counts of direct, quoted, misspelt and addressed hits, hits for a hundred
    words, and the largest weight of each of the first three kinds."""
    low = (text or "").lower()
    tokens = _TOKEN.findall(low)
    verdict, seen = lexicon.verdict, lexicon.seen
    found = {t: e for t in set(tokens) if (e := seen[t] if t in seen else verdict(t))}
    if not found:
        return [0.0] * FEATURES
    count, top, address = [0, 0, 0], [0.0, 0.0, 0.0], 0
    places = list(_TOKEN.finditer(low))
    for i, t in enumerate(tokens):
        if t not in found:
            continue
        near = tokens[max(0, i - NEAR_WORDS):i] + tokens[i + 1:i + 1 + NEAR_WORDS]
        m = places[i]
        marks = (_QUOTES.search(low, max(0, m.start() - NEAR_CHARS), m.start()),
                 _QUOTES.search(low, m.end(), m.end() + NEAR_CHARS))
        errors, weight = found[t]
        kind = 1 if all(marks) or not SAYING.isdisjoint(near) else 2 if errors else 0
        count[kind] += 1
        top[kind] = max(top[kind], weight)
        address += not ADDRESS.isdisjoint(near)
    rate = 100 * sum(count) / len(tokens)
    return [float(np.log1p(x)) for x in (*count, address, rate)] + top


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights, the intercept last, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _apply(rows: DataFrame, terms, columns: str, finish) -> DataFrame:
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms.value)
        for b in batches:
            x = np.array([features(t, lexicon) for t in b["text"]], float).reshape(len(b), FEATURES)
            yield finish(b, x)

    return rows.mapInPandas(run, columns)


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[dict[str, float], np.ndarray | None]:
    """Lexicon with its weights and the model's; no model where there is nothing to learn from."""
    rows = training_rows(docs, labels, learn)
    terms = learn_lexicon(rows)
    bc = rows.sparkSession.sparkContext.broadcast(terms)
    got = _apply(rows, bc, "toxic int, x array<double>", lambda b, x: pd.DataFrame(
        {"toxic": b["toxic"], "x": list(x)})).toPandas()
    if got["toxic"].nunique() < 2:
        return terms, None
    return terms, fit(np.vstack(got["x"]), got["toxic"].to_numpy(float))


def score(docs: DataFrame, terms: dict[str, float], weights: np.ndarray | None) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if weights is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    bc = docs.sparkSession.sparkContext.broadcast(terms)

    def finish(b, x):
        z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
        return pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-z))})

    return _apply(rows, bc, f"doc_id {kind}, score double", finish)


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document; a quarter of the ids is held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    terms, weights = train(docs, read(spark, sf_dir, "labels"), ~held)
    return score(docs, terms, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
