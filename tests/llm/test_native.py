"""Operators of column expressions and joins: personal data, quality rules,
decontamination, mixing."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import QUERIES, decontaminate, mixing, pii, quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_pii_query_matches_brute_force(spark, sf_dir, documents):
    want = {}
    for i, text, *_ in documents:
        s = base_spans(text)
        n = collections.Counter(x[1] for x in s)
        want[i] = (n[0], n[1], n[2], n[3], hashlib.sha256(",".join(x[2] for x in s).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:6] for r in QUERIES["op1_pii"](spark, sf_dir).collect()}
    assert got == want and any(sum(v[:4]) for v in want.values())


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "éé +1 (988) 555-2485 and 4111 1111 1111 1111 1",
    "4111-1111-1111-1111 4785380592391139 12 34", "+1 +12 345 678 901 . +", "a@b.c " * 300, "\U0001F600 q.w+e@r-t.yy", "9" * 5000, "x" * 5000 + "@",
])
def test_pii_base_spans_of_hard_texts(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = [(r["start"], r["rank"], f"{pii.KINDS[r['rank']].name}:{r['start']}:{r['stop']}")
             for r in pii.spans(d).first()["_spans"] if r["rank"] < 4]
    assert found == base_spans(text)


def test_pii_checksums_and_context(spark):
    text = "iban GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33, 123-45-6789 but ssn: 123-45-6780"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = pii.spans(d).first()["_spans"]
    kinds = [(pii.KINDS[s["rank"]].name, text[s["start"]:s["stop"]]) for s in spans]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds and not any("33" in t for k, t in kinds if k == "iban")
    assert ("ssn", "123-45-6780") in kinds


@pytest.mark.parametrize("text", [
    "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 12345", "GB82 WEST 1234 5698 7654 32 GB", "NO93 8601 1117 947 OR 7",
    "AA11 BBBB CCCC DDDD GB82 WEST 1234 5698 7654 32 SWIFT", "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32",
])
def test_pii_iban_beside_capitals_and_numbers(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    known = ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947")
    got = [text[s["start"]:s["stop"]] for s in pii.spans(d).first()["_spans"] if pii.KINDS[s["rank"]].name == "iban"]
    assert sorted(got) == [x for x in known if x in text]


@pytest.mark.parametrize("piece", ["4111111111111111, ", "a@b.co DE89370400440532013000 10.0.0.1 é "])
def test_pii_many_spans_take_linear_time(spark, piece):
    """Four times the spans, under six times the time, found and redacted."""
    took = {}
    for n in (2_000, 2_000, 8_000):
        d = spark.createDataFrame([(1, piece * n)], "doc_id bigint, text string").coalesce(1)
        began = time.monotonic()
        found = pii.spans(d).select(F.size("_spans").alias("n"), F.element_at("_spans", -1).alias("last")).first()
        text = pii.redact(d).first()["text"]
        took[n] = time.monotonic() - began
        kinds = piece.count("@") * 2 + 1
        assert found["n"] == n * kinds
        tail = "[CARD], " if kinds == 1 else "[EMAIL] [IBAN] [IP] é "
        assert text == tail * n
    assert took[8_000] < 6 * took[2_000]


def test_pii_redacts_overlaps_and_long_gaps(spark):
    """The fold of the spans one after another, on random texts."""
    rng = random.Random(5)
    atoms = ["+49 30 1234567", "4111111111111111", "a@b.de", "10.1.2.3", "DE89 3704 0044 0532 0130 00", "é", "\U0001F600", " ", "x" * 700,
             "4111 1111 1111 1111@c.org", "+4111111111111111", "1.2.3.4@d.e"]
    rows = [(i, "".join(rng.choice(atoms) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    for r in pii.spans(d).collect():
        at, out, t = 0, [], r["text"]
        for s in r["_spans"]:
            if s["start"] >= at:
                out += [t[at:s["start"]], f"[{pii.KINDS[s['rank']].name.upper()}]"]
            at = max(at, s["stop"])
        assert got[r["doc_id"]] == "".join(out) + t[at:]


def test_pii_odd_rows(odd, none):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[9]["text"].endswith("[EMAIL]")
    assert by[6]["text"].endswith("[EMAIL] [IP]") and by[6]["n_chars"] == len(by[6]["text"])
    assert pii.redact(none).count() == 0


def quality_base(text):
    words = W.findall(text or "")
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    n, rep = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), rep,
            n < 50 or 100 * rep > 50 * n)


def test_quality_query_matches_brute_force(spark, sf_dir, documents):
    got = {r[0]: r for r in QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for i, text, *_ in documents:
        assert tuple(got[i])[1:7] == quality_base(text)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_template_lines(spark):
    """A line in many documents of a host is template there, and only there;
    copies count once, and so keep their lines."""
    body = " ".join(f"w{i}" for i in range(60))
    own = [" ".join(f"{chr(97 + i)}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) for i in range(20)]
    rows = [(i, f"Home | About 12\n{own[i]}", None, "host", 0) for i in range(20)]
    rows += [(100, f"home |  about 7\n{body} t", None, "other", 0)]
    rows += [(200 + i, f"own line\n{body} copied", None, "copies", 0) for i in range(50)]
    rows += [(300, "HOME | ABOUT 3\n" * 30, None, "host", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    j = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(j[i]["n_lost_words"] == 4 and j[i]["kept"] for i in range(20))
    assert j[100]["n_lost_words"] == 0 and all(j[200 + i]["n_lost_words"] == 0 for i in range(50))
    assert not j[300]["kept"]
    out = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert out[0]["text"] == own[0] and out[0]["n_chars"] == len(out[0]["text"]) and 300 not in out


def test_quality_counts_template_heavy_documents(spark):
    """Different documents under one long template count one by one, lose it
    and go; documents of the host without it stay."""
    template = "\n".join(" ".join(f"menu{i}x{chr(97 + k)}" for k in range(20)) for i in "abcdefghijklmnopqrst")
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    rows = [(i, (template + "\n" if i < 20 else "") + " ".join(f"{letters[i]}q{letters[k]}" for k in range(40 if i < 20 else 80)), None, "host", 0)
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    j = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all((j[i]["n_lost_words"], j[i]["kept"]) == ((400, False) if i < 20 else (0, True)) for i in range(200))


def test_quality_odd_rows(odd, none):
    j = quality.judge(odd).collect()
    assert len(j) == odd.count()
    by = collections.defaultdict(list)
    for r in j:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_words"] == 0 and not by[4][0]["kept"] and len(by[1]) == 2 and by[None][0]["kept"]
    out = quality.clean(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "2", "6", "None"]
    assert quality.judge(none).count() == 0 and quality.clean(none).count() == 0


def words5(text):
    return re.sub(r"[^\w\s]|_", "", (text or "").lower()).split()


def leaks(docs, items):
    """Best window over all starts, for every document and item."""
    out = {}
    for q, t in items:
        b = words5(t)
        ci = collections.Counter(tuple(b[i:i + 5]) for i in range(len(b) - 4))
        if not ci:
            continue
        for i, text in docs:
            w = words5(text)
            best = 0
            for a in range(max(1, len(w) - len(b) + 1)):
                v = w[a:a + len(b)]
                cw = collections.Counter(tuple(v[k:k + 5]) for k in range(len(v) - 4))
                if not ci.keys() & cw.keys():
                    continue
                inter = sum((cw & ci).values())
                best = max(best, inter / (sum(cw.values()) + sum(ci.values()) - inter))
            if best >= 0.8:
                out[i, q] = round(best, 6)
    return out


def test_decontamination_query_matches_brute_force(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = leaks([(r[0], r[1]) for r in documents], items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert got == want and want


def test_decontamination_edited_windows_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    item = [f"t{x}" for x in rng.integers(0, 500, 50)]
    noise = [f"n{x}" for x in range(400)]
    edited, twice = item[:], item[:]
    edited[0] = "changed"
    twice[20], twice[30] = "other", "words"
    docs = [(1, " ".join(noise[:100] + item + noise[100:])), (2, " ".join(noise + edited)), (3, " ".join(twice + noise)),
            (4, " ".join(item[:-1])), (5, " ".join(noise)), (6, " ".join(x.upper() + "!!" for x in item)), (7, None), (8, "")]
    items = [(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(item))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = leaks(docs, items)
    assert {k[0] for k in want} == {1, 2, 4, 6}
    for limit in (decontaminate.BROADCAST_ROWS, 4):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontaminate.matches(d, b).collect()}
        assert got == want


def test_decontamination_odd_rows(spark, odd, none):
    text = odd.filter("doc_id = 2").first()["text"]
    b = spark.createDataFrame([(1, text), (2, "word")], "item_id bigint, text string")
    out = decontaminate.drop_leaks(odd, b)
    assert out.columns == odd.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert decontaminate.matches(none, b).count() == 0
    assert decontaminate.drop_leaks(odd, b.limit(0)).count() == odd.count()


def test_simhash_of_native_form(spark):
    h = [[5], [5, 5, 3], [-1, 7, 1 << 62, -(1 << 63)], list(range(70_001))]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "id int, hashes array<bigint>")
    got = {r["id"]: r["fp"] for r in decontaminate.with_simhash(d).collect()}
    for i, x in enumerate(h):
        v = np.array(x, np.int64).view(np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int(((v >> np.uint64(b)) & np.uint64(1)).sum()) > len(x))
        assert got[i] % (1 << 64) == want


@pytest.mark.parametrize(("sf", "targets", "budget"), [
    ("/root/testdata/sf0.01", mixing.TARGETS, mixing.BUDGET), ("/root/testdata/sf0.1", mixing.TARGETS, mixing.BUDGET),
    ("/root/testdata/sf0.001", {"good": 0.8, "low": 0.15, "toxic": 0.05}, 1.0)])
def test_mixing_meets_every_target(spark, sf, targets, budget):
    """Each domain's total from the rates themselves, within 0.1 % of its own
    target, also where plain steps take hundreds."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels, targets=targets, budget=budget).select("p", "tokens", "rate", "copies").toPandas()
    p, t, rate = np.vstack(got["p"]), got["tokens"].to_numpy(float), got["rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all() and (np.abs(got["copies"] - rate) < 1).all()
    want = np.array([targets[c] for c in mixing.DOMAINS]) * budget * t.sum()
    assert (np.abs(p.T @ (t * rate) - want) <= 1e-3 * want).all()


@pytest.mark.parametrize("targets", [{"good": 0.2, "low": 0.3, "toxic": 0.5}, {"good": 0.9, "low": 0.05, "toxic": 0.05},
                                     {"good": 0.0, "low": 1.0, "toxic": 0.0}])
def test_mixing_fit_is_least_squares(spark, targets):
    """Against plain projected gradient with very many steps, also where the
    targets cannot be met (every document is mostly good)."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet((6, 1, 0.5), 60)
    t = rng.integers(1, 200, 60)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p, strict=True)], "tokens bigint, p array<double>")
    steps, miss = mixing.fit(rows, targets, 1.0)
    want = np.array([targets[c] for c in mixing.DOMAINS]) * t.sum()
    over = np.maximum(want, t.sum() / 1000)
    a = (p * t[:, None]).T / over[:, None]
    r = np.ones(60)
    step = 1 / np.linalg.norm(a / np.sqrt(t), 2) ** 2
    for _ in range(200_000):
        r = np.maximum(0, r - step * (a / t).T @ (a @ r - want / over))
    best = np.square(a @ r - want / over).sum()
    mine = np.array([x["r"] for x in rows.select(mixing.rate_after(steps).alias("r")).collect()])
    got = np.square(a @ mine - want / over).sum()
    assert (mine >= 0).all() and np.allclose(a @ mine - want / over, miss)
    assert got <= 1.05 * best + 3 * mixing.TOLERANCE ** 2


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 0), (8, 1, 1), (9, None, 0), (None, 1, 1), (99, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    got = mixing.mix(odd, labels)
    assert got.count() == odd.count()
    out = mixing.sample(odd, labels)
    assert out.columns[:len(odd.columns)] == odd.columns and out.columns[-1] == "copy"
    assert mixing.mix(odd, labels.limit(0)).count() == odd.count()
    assert mixing.mix(none, labels).count() == 0 and mixing.sample(none, labels).count() == 0
