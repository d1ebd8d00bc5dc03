"""Mixing documents to target weights by soft membership.

Which domain a document belongs to is not known but for the labelled ones: a
classifier (naive Bayes over binned measures of the text and marker words,
learnt from the labels) gives each document a posterior over the domains. The
mix is then a rate for each document, at least zero, such that the expected
tokens of each domain (tokens x posterior x rate, summed) come to the targets.

The rates minimise the squared misses of the totals, each over its domain's
target, by projected gradient from rate one: a step lowers each rate by a
combination of its posteriors, and not below zero. A step needs one distributed
aggregate of a few sums, which also give the metric it is taken in
(:func:`fit`); the rate of a document then follows from its posterior and the
steps so far, so nothing but those sums leaves the executors and no rates are
carried from step to step. The steps go on until every domain is within
TOLERANCE of its target, or no step comes closer (targets that no nonnegative
rates meet); ``fit`` returns what is missed.
A rate is made whole copies: its floor, and one more with the probability of
the rest, drawn by the hash of the document.

Domains, from the labels: ``low`` (quality 0), ``toxic`` (else toxic 1),
``good``. Learning is bounded: TRAIN_ROWS labelled documents, the first by hash,
and MARKERS words for each domain.

Tokens are runs of letters and digits.

Defined results: null text counts as empty: no token, any rate leaves the
totals as they are; null labels are not learnt from; without labels the
posterior is uniform; a domain without tokens keeps its target unmet and does
not move the rates; repeated rows each get their rate; a null id draws by text;
an empty table gives an empty table; extra columns pass through ``sample``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read
from tidewater.llm.registry import register
from tidewater.operators.common import materialize

DOMAINS = ("good", "low", "toxic")
#: Share of the tokens that each domain gets in the mix, and the size of the
#: mix over that of the corpus.
TARGETS = {"good": 0.92, "low": 0.05, "toxic": 0.03}
BUDGET = 1.05
TRAIN_ROWS = 5_000
MARKERS = 64
MARKER_MIN_DOCS = 4
#: Largest miss of a domain's total, over its target, at which the steps end.
TOLERANCE = 1e-4
#: The steps also end where none lessens the squared misses by this share: targets
#: that no nonnegative rates meet.
GAIN = 1e-3
#: Upper bounds of the bins of each measure.
BINS = {
    "symbols": (0.001, 0.005, 0.02, 0.08), "upper": (0.01, 0.03, 0.08, 0.3), "digits": (0.001, 0.01, 0.05),
    "variety": (0.2, 0.4, 0.55, 0.7, 0.85), "length": (2.5, 4.5, 6.0, 8.0), "size": (8.0, 50.0, 200.0, 800.0, 3200.0),
}


def measured(docs: DataFrame, markers: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``keep``, tokens, and the bins (array of int) of each document: one for
    each of BINS, and how many markers of each domain it has, up to three."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, text.alias("text"))
    d = d.withColumn("words", F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    d = d.withColumns({"distinct": F.array_distinct("words"), "tokens": F.size("words").cast("bigint"), "chars": F.length("text")})
    every = sorted({w for ws in markers.values() for w in ws})
    known = F.array(*[F.lit(w) for w in every]) if every else F.array().cast("array<string>")
    # an empty piece stands before and after leading and trailing marks
    blank = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.col("tokens") > 1) & (F.get("words", (F.col("tokens") - 1).cast("int")) == ""), 1).otherwise(0)
    d = d.withColumns({"hits": F.array_intersect("distinct", known), "tokens": F.col("tokens") - blank})

    def without(kind):
        return F.length("text") - F.length(F.regexp_replace("text", kind, ""))

    one = F.greatest(F.col("chars"), F.lit(1))
    words = F.greatest(F.col("tokens"), F.lit(1))
    value = {
        "symbols": without("[#*$%&|<>]+") / one, "upper": without("[A-Z]+") / one,
        "digits": without("[0-9]+") / one, "variety": F.size("distinct") / words,
        "length": F.col("chars") / words, "size": F.col("tokens").cast("double"),
    }
    bins = [_bin(value[k], cuts) for k, cuts in BINS.items()]
    bins += [F.least(F.lit(3), F.size(F.array_intersect("hits", F.array(*[F.lit(w) for w in markers[c]]))))
             if markers.get(c) else F.lit(0) for c in DOMAINS]
    return d.select(*keep, F.xxhash64("text").alias("th"), "tokens", F.array(*bins).alias("bins"))


def _bin(value: Column, cuts: tuple[float, ...]) -> Column:
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, domain of the documents learnt from. At most TRAIN_ROWS
    ids, so they may be broadcast."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("good")
    chosen = known.select(F.col("doc_id").alias("_id"), domain.alias("domain")).dropDuplicates(["_id"])
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return materialize(rows.select("doc_id", "text", "domain"), "mixing")


def learn_markers(train: DataFrame) -> dict[str, list[str]]:
    """The words that tell each domain most (log ratio times its documents)."""
    size = {r["domain"]: r["count"] for r in train.groupBy("domain").count().collect()}
    total = sum(size.values())
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    seen = train.select("domain", F.explode_outer(words).alias("word")).filter(F.length("word") >= 3)
    counts = seen.groupBy("word").agg(*[F.count(F.when(F.col("domain") == c, 1)).alias(c) for c in DOMAINS])
    n = sum((F.col(c) for c in DOMAINS), F.lit(0))
    out = {}
    for c in DOMAINS:
        if not size.get(c) or size[c] == total:
            continue
        rate = (F.col(c) + 0.5) / (size[c] + 1)
        rest = (n - F.col(c) + 0.5) / (total - size[c] + 1)
        score = F.col(c) * F.log(rate / rest)
        best = counts.filter((F.col(c) >= MARKER_MIN_DOCS) & (rate > 4 * rest)).orderBy(F.desc(score), "word").limit(MARKERS)
        out[c] = [r["word"] for r in best.select("word").collect()]
    return out


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, list[str]], dict]:
    """Markers, and log likelihoods: prior by domain, and by (feature, bin)."""
    train = labelled(docs, labels)
    markers = learn_markers(train)
    # worked out once: each bin reads the whole text
    bins = materialize(measured(train, markers, ["domain"]), "training-bins")
    rows = bins.select("domain", F.posexplode("bins").alias("f", "b")).groupBy("domain", "f", "b").count().collect()
    size = {r["domain"]: r["count"] for r in bins.groupBy("domain").count().collect()}
    total = sum(size.values())
    cells = [len(c) + 1 for c in BINS.values()] + [4] * len(DOMAINS)
    prior = {c: math.log((size.get(c, 0) + 1) / (total + len(DOMAINS))) for c in DOMAINS}
    seen = {(r["domain"], r["f"], r["b"]): r["count"] for r in rows}
    return markers, {"prior": prior, "table": {c: [
        [math.log((seen.get((c, f, b), 0) + 0.5) / (size.get(c, 0) + 0.5 * k)) for b in range(k)]
        for f, k in enumerate(cells)] for c in DOMAINS}}


def posterior(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with ``p``: the posterior of each domain, in the order of
    DOMAINS."""
    logs = []
    for c in DOMAINS:
        parts = [F.get(F.array(*[F.lit(float(x)) for x in cell]), F.get("bins", F.lit(f)))
                 for f, cell in enumerate(model["table"][c])]
        logs.append(sum(parts, F.lit(model["prior"][c])))
    d = rows.withColumn("logs", F.array(*logs))
    d = d.withColumn("logs", F.transform("logs", _exp_below_max("logs")))
    return d.withColumn("p", F.transform("logs", _share("logs"))).drop("logs", "bins")


def _exp_below_max(column: str):
    return lambda x: F.exp(x - F.array_max(column))


def _share(column: str):
    return lambda x: x / F.aggregate(column, F.lit(0.0), lambda a, y: a + y)


def rate_after(steps: list[list[float]]) -> Column:
    """Rate of a document after these steps (what each domain's rate falls by)."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    log = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(log, rate, lambda r, s: F.greatest(F.lit(0.0), r - sum(
        (F.get("p", F.lit(k)) * s[k] for k in range(1, len(DOMAINS))), F.get("p", F.lit(0)) * s[0])))


def fit(rows: DataFrame, targets: dict[str, float], budget: float, tolerance: float = TOLERANCE) -> tuple[list[list[float]], list[float]]:
    """Steps of the projected gradient, and what each domain's total then misses
    its target by, over the target.

    The aggregate that sums the domains also sums tokens * p * p' over the
    documents whose rate is above zero: how a step along the posteriors moves the
    totals. Taken as the metric it makes the totals meet the targets at once
    unless rates run into zero, so a few steps do where plain ones would take
    hundreds. Where such a step does not lessen the miss, the metric is damped more and
    more towards that of a plain gradient step, which always does but at the
    least-squares fit. They end within the tolerance or there. A target of less
    than a thousandth of the mix counts as that in the miss. Domains that no
    document belongs to are left out."""
    k = range(len(DOMAINS))

    def sums(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        d = rows.select("tokens", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in k], rate.alias("r"))
        free = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        got = d.agg(*[F.sum(F.col("tokens") * F.col("r") * F.col(f"p{i}")) for i in k],
                    *[F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i in k for j in k]).first()
        got = np.array([x or 0.0 for x in got], float)
        return got[:len(DOMAINS)], got[len(DOMAINS):].reshape(len(DOMAINS), -1)

    size, metric = sums(F.lit(1.0))
    want = np.array([targets[c] for c in DOMAINS]) * budget * size.sum()
    scale = np.where(size > 0, 1.0 / np.maximum(want, max(want.sum() / 1000, 1.0)), 0.0)
    steepest = np.linalg.norm(scale[:, None] * metric * scale, 2)
    steps: list[list[float]] = []
    miss = (size - want) * scale
    while np.abs(miss).max() > tolerance:
        scaled = scale[:, None] * metric * scale
        for damping in (1e-12, 1e-4, 1e-3, 1e-2, 1e-1, 1.0):
            way = np.linalg.solve(scaled + damping * steepest * np.eye(len(DOMAINS)), miss)
            step = [float(x) for x in scale * way]
            total, new_metric = sums(rate_after([*steps, step]))
            new = (total - want) * scale
            if np.square(new).sum() < np.square(miss).sum() * (1 - GAIN):
                break
        else:
            break
        steps.append(step)
        miss, metric = new, new_metric
    return steps, [float(x) for x in miss]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, th (text hash), source, tokens, p, rate and copies of every row."""
    markers, model = learn(docs, labels)
    d = docs.select("doc_id", "text", F.col("source").alias("src"))
    rows = materialize(posterior(measured(d, markers, ["doc_id", "src"]), model), "posteriors")
    steps, _ = fit(rows, targets or TARGETS, budget)
    out = rows.withColumn("rate", rate_after(steps))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", "th"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    whole = F.floor(F.col("rate") + 1e-9)
    copies = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    return out.select("doc_id", "th", F.col("src").alias("source"), "tokens", "p", "rate", copies.cast("bigint").alias("copies"))


def sample(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it has copies, with its
    ``rate`` and the number of the ``copy``; the other columns of ``docs``."""
    columns = docs.columns
    got = mix(docs, labels, **settings).filter("copies > 0").select(
        F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "rate", "copies").dropDuplicates(["_d", "_h"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    j = packed.join(got, packed["_doc"].eqNullSafe(got["_d"]) & (packed["_th"] == got["_h"]))
    j = j.select("_row", "rate", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    extra = [c for c in ("rate", "copy") if c not in columns]
    return j.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], *extra)


@register("op4_mixing")
def op4_mixing(spark, sf_dir):
    """Posterior, rate and copies of every document for the target weights."""
    out = mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    share = [F.round(F.get("p", F.lit(k)), 6).alias(f"p_{c}") for k, c in enumerate(DOMAINS)]
    return out.select("doc_id", "source", "tokens", *share, F.round("rate", 6).alias("rate"), "copies")
