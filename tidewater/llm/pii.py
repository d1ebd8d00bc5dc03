"""Personal data and secrets: patterns propose spans, checksums confirm them,
context words adjust the score.

Each kind has a pattern; matches are leftmost and do not overlap within a kind.
Validators: octets at most 255 (ip), Luhn over 14 to 19 digits (card), digit
count (phone), mod-97 (iban), allotted number ranges (ssn). A match that fails
its validator is dropped. Every other match starts from the score of its kind;
words that speak for or against the kind, within CONTEXT code points on either
side, raise or lower it. The base kinds (email, ip, card, phone) stay whatever
their score; the others stay at THRESHOLD or more.

All of it is column expressions: the pieces that ``split`` leaves between the
matches give the positions, so a text is never compared with itself. Time is
linear in the text and in its spans.

Defined results: null text counts as empty (no spans); a null id stays null;
each row gets its own result, repeated rows included; an empty table gives an
empty table; extra columns pass through ``redact`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import read
from tidewater.llm.registry import register

#: Code points of context on either side of a match.
CONTEXT = 48
#: Score (percent) that the kinds beyond the base ones need.
THRESHOLD = 60
#: What one supporting or opposing context adds or takes (percent).
BOOST = 20
#: Elements of an array that are summed in one step.
_BLOCK = 32
#: Code points of the pieces that a text is cut into to be read off.
_PIECE = 1024


#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """The country's length, so that what follows is not taken in; where that
    does not fit, any length up to the next country and check digits."""
    countries = "|".join(c for v in IBAN_LENGTHS.values() for c in v.split())
    fixed = "|".join(
        f"(?:{v.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, v in IBAN_LENGTHS.items())
    free = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{countries})[0-9]{{2}}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{fixed}|{free})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    score: int
    support: str
    against: str
    base: bool = False


# Possessive quantifiers and the look-behinds only save backtracking: a match
# that fails from the start of a run fails from inside it as well. \G admits a
# match that starts where the one before it ended.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 90,
         r"mail|contact|write|reply|kontakt|correo|courriel", r"noreply|no-reply", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 60,
         r"\bip\b|host|server|address|login|adresse", r"version|release|section|chapter", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 80,
         r"card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", r"order|invoice|tracking|isbn", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 70,
         r"phone|tel\b|call|mobile|fax|telefon|t[eé]l[eé]phone", r"version|coordinates", True),
    Kind("iban", _iban(), "", 80,
         r"iban|account|bank|konto|compte|cuenta", r"serial|model|part number"),
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:token|secret|passw(?:or)?d|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{16,}+)", "", 80,
         r"secret|token|key|passw|credential", r"placeholder|example"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 40,
         r"ssn|social security|tax id", r"order|invoice|tracking"),
)


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """ISO 7064 check of an IBAN without spaces: remainder 1 of the number that
    its rotated characters spell, letters as 10 to 35."""
    s = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def add(acc, i):
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,score:int>>"


def _scan_before(d: DataFrame, column: str, add: Callable[[Column, Column], Column]) -> DataFrame:
    """Each array of longs (none below zero) in an array of such arrays becomes
    that of what ``add`` makes of the elements before each one, zero at first.
    Elements meet in blocks, blocks in blocks of blocks, so the work is linear
    up to a constant."""
    zero = F.lit(0).cast("bigint")

    def cut(c):
        last = F.floor((F.size(c) - 1) / _BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(c, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(c) > 0, parts).otherwise(F.array().cast("array<array<bigint>>"))

    def before(part, base):
        return F.transform(part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i), base, add))

    def sums(parts):
        return F.transform(parts, lambda x: F.aggregate(x, zero, add))

    kept = d.columns
    d = d.withColumn("_cut0", F.transform(column, cut))
    for level in (1, 2):
        d = d.withColumn("_sums", F.transform(f"_cut{level - 1}", sums)).withColumn(f"_cut{level}", F.transform("_sums", cut))
    # blocks of blocks of blocks are few: one for 32,768 elements
    d = d.withColumn("_base", F.transform("_cut2", lambda parts: before(sums(parts), zero)))
    for level in (2, 1, 0):
        # both arrays are arguments, not parts of the lambda: Spark would put an
        # array that is named once into it and work it out for every element
        d = d.withColumn("_base", F.zip_with(
            f"_cut{level}", "_base", lambda parts, base: F.flatten(F.zip_with(parts, base, before))))
    return d.select(*[F.col("_base").alias(c) if c == column else F.col(f"`{c}`") for c in kept])


def _advances(matches: str, gaps: str) -> Column:
    """Code points of each gap and the match that ends it."""
    return F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda x, g: (F.length(x) + F.length(g)).cast("bigint"))


def _spans(rank: int, kind: Kind) -> Column:
    """Confirmed spans of one kind from its matches, the gaps on both sides and
    their offsets."""
    m, g = F.col(f"m{rank}"), F.col(f"g{rank}")

    def span(c):
        x, start = c["match"], c["at"] + F.length(c["left"])
        around = F.lower(F.concat(F.right(c["left"], F.lit(CONTEXT)), F.lit(" "), F.left(c["right"], F.lit(CONTEXT))))
        score = (F.lit(kind.score) + F.when(around.rlike(kind.support), BOOST).otherwise(0)
                 - F.when(around.rlike(kind.against), BOOST).otherwise(0))
        ok = _valid(kind.name, x)
        if not kind.base:
            ok = ok & (score >= THRESHOLD)
        return F.when(ok, F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("stop"), score.alias("score")))

    n = F.size(m)
    beside = F.arrays_zip(m.alias("match"), F.slice(g, F.lit(1), n).alias("left"), F.slice(g, F.lit(2), n).alias("right"),
                          F.get("_at", F.lit(rank)).alias("at"))
    found = F.filter(F.transform(beside, span), lambda s: s.isNotNull())
    return F.when(n > 0, found).otherwise(F.array().cast(_SPAN))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column, ``_spans``: array of (start, rank, stop,
    score) by start, then kind; code points, end exclusive."""
    empty = F.array().cast("array<string>")
    t = F.coalesce(F.col(text), F.lit(""))
    has = {r: (F.contains(t, F.lit(k.needs)) if k.needs else F.lit(True)) for r, k in enumerate(KINDS)}
    d = docs.withColumns({f"m{r}": F.when(has[r], F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(empty)
                          for r, k in enumerate(KINDS)})
    d = d.withColumns({f"g{r}": F.when(F.size(f"m{r}") > 0, F.split(t, k.pattern, -1)).otherwise(empty)
                       for r, k in enumerate(KINDS)})
    ranks = range(len(KINDS))
    d = d.withColumn("_at", F.array(*[_advances(f"m{r}", f"g{r}") for r in ranks]))
    d = _scan_before(d, "_at", lambda a, x: a + x)
    d = d.withColumns({f"s{r}": _spans(r, k) for r, k in enumerate(KINDS)})
    return d.select(*[F.col(f"`{c}`") for c in docs.columns],
                    F.sort_array(F.concat(*[F.col(f"s{r}") for r in ranks])).alias("_spans"))


def _names() -> Column:
    return F.array(*[F.lit(k.name) for k in KINDS])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets;
    spans that overlap become one, named after the first. ``n_chars``, where
    present, follows the new text."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    found = spans(packed, "_text")

    # what ends before each span, and with one more element before the rest
    ends = F.transform("_spans", lambda s: s["stop"])
    found = found.withColumn("_done", F.array(F.when(F.size("_spans") > 0, F.concat(ends, F.array(F.lit(0).cast("bigint")))).otherwise(
        F.array().cast("array<bigint>"))))
    found = _scan_before(found, "_done", lambda a, x: F.greatest(a, x))
    found = found.withColumn("_pieces", F.when(F.size("_spans") > 0, F.regexp_extract_all(
        "_text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def between(a, b):
        """Text from a to b, read off the pieces that hold it."""
        first = F.floor(a / _PIECE)
        held = F.slice("_pieces", (first + 1).cast("int"), (F.ceil(b / _PIECE) - first).cast("int"))
        return F.substring(F.array_join(held, ""), (a - first * _PIECE + 1).cast("int"), (b - a).cast("int"))

    def replaced(s, at):
        rest = between(at, F.length("_text").cast("bigint"))
        new = F.concat(between(at, s["start"]), F.lit("["), F.upper(F.get(_names(), s["rank"])), F.lit("]"))
        return F.when(s.isNull(), rest).when(s["start"] >= at, new).otherwise("")

    whole = F.array_join(F.zip_with("_spans", F.get("_done", F.lit(0)), replaced), "")
    found = found.withColumn("_new", F.when(F.size("_spans") > 0, whole).otherwise(F.col("_text")))
    out = {c: F.col(f"_row.`{c}`").alias(c) for c in columns}
    out["text"] = F.col("_new").alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return found.select(*[out[c] for c in columns])


@register("op1_pii")
def op1_pii(spark, sf_dir):
    """Spans of personal data in every document: counts of the base kinds,
    digest of their spans, and all spans with their scores."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs).withColumn("base", F.filter("_spans", lambda s: s["rank"] < 4))

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", F.get(_names(), s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(rank):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("_spans").alias("spans"),
        F.array_join(F.transform("_spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
