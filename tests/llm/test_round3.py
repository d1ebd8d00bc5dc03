"""Filter audit, WARC and conversation repair."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewater.llm import QUERIES, audit, repair, warc

W = re.compile(r"[^\x20\x09-\x0D]+")


def mask_of(text, copy):
    text = text or ""
    words = W.findall(text)
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text)) + 16 * copy)


def brute_masks(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    return sorted((str(i), source or "", mask_of(text, i is not None and i > least[text or ""])) for i, text, _, source, _ in rows)


def brute_audit(masked, labels):
    out = {}
    for part in {p for _, p, _ in masked}:
        docs = [(i, m) for i, p, m in masked if p == part]
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            for i, m in docs:
                for f in order:
                    if m >> f & 1:
                        shapley[f] += 1
                        break
        for order in itertools.permutations(range(5)):
            before = 0
            for step, f in enumerate(order, 1):
                removed = [i for i, m in docs if m >> f & 1 and not m & before]
                out[part, "".join("ABCDE"[x] for x in order), step] = (
                    sum(not m & (before | 1 << f) for _, m in docs), len(removed), sum(m >> f & 1 and m & before != 0 for _, m in docs),
                    sum(m == 1 << f for _, m in docs), sum(labels.get(i, (0, 0))[0] == 1 for i in removed),
                    sum(labels.get(i, (0, 0))[1] == 1 for i in removed), shapley[f])
                before |= 1 << f
    return out


def test_audit_matches_brute_force(spark, sf_dir, documents):
    """Masks of every row, and the table of every order, from plain loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    masked = brute_masks(documents)
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in audit.masks(docs).collect()) == masked
    labels = {str(r[0]): (r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op11_filter_audit"](spark, sf_dir).collect()}
    assert got == brute_audit(masked, labels)


def test_audit_crowded_prefixes_and_hot_texts(spark):
    """Long shared prefixes, prefixes of one another, a text on a third of the
    rows and NUL bytes; ids in no order."""
    rng = random.Random(5)
    stem = "The same long opening of every page of this host. " * 60
    texts = [stem + "".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += [stem[:k] for k in (0, 1, 3000, len(stem) - 1)] + ["\0" * k for k in range(6)] + ["é" * k for k in range(9)] + [None] * 5
    texts += ["hot text"] * 200
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, None, "s" if i % 3 else None, 0) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in audit.masks(docs).collect()) == brute_masks(rows)
    to = audit.ranges(docs.selectExpr("CAST(coalesce(text, '') AS binary) AS text"), 16)
    shard = to.shard_of()
    sizes = collections.Counter(shard(t.encode()) for t in {t or "" for t in texts})
    assert list(to.cuts) == sorted(set(to.cuts)) and any(len(c) > len(stem) for c in to.cuts)
    assert max(sizes.values()) < 0.3 * sum(sizes.values()) and max(sizes) < to.shards <= 64


def test_audit_near_copies_leave_no_crowd(spark):
    """Texts that differ in one word somewhere are dealt evenly, and equal ones
    still meet."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(300)] = f"x{i % 350}"
        texts.append(" ".join(own))
    texts += [f"{rng.random()} other" for _ in range(200)] + texts[:20]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in audit.masks(docs).collect()) == brute_masks(rows)
    shard = audit.ranges(docs.selectExpr("CAST(text AS binary) AS text"), 16).shard_of()
    sizes = collections.Counter(shard(t.encode()) for t in set(texts))
    assert max(sizes.values()) < 0.15 * sum(sizes.values())


def test_radix_trie_against_a_dict():
    rng = random.Random(3)
    for _ in range(60):
        trie, want = audit.RadixTrie(), {}
        for i in rng.sample(range(1000), 80):
            text = bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) * rng.choice((1, 1, 7))
            want[text] = min(i, want.get(text, i))
            trie.insert(text, i)
        assert dict(trie.walk()) == want and len(list(trie.walk())) == len(want)


def test_audit_trie_emptied_on_the_way(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(audit, "TRIE_BYTES", 500)
    rng = random.Random(2)
    rows = sorted((bytes(rng.choice(b"abc") for _ in range(rng.randrange(4))), i) for i in range(400))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in rows[i:i + 30]], pa.binary()),
                                           "doc_id": pa.array([d for _, d in rows[i:i + 30]], pa.int64())}) for i in range(0, 400, 30)]
    out = list(audit._tries(iter(batches)))
    least = {}
    for t, i in rows:
        least[t] = min(i, least.get(t, i))
    assert len(out) > 1 and sorted(x for b in out for x in b["doc_id"].to_pylist()) == sorted(least.values())


def test_audit_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"], None, r["source"], None) for r in odd.collect()]
    assert sorted((str(r["doc_id"]), r["part"], r["mask"]) for r in audit.masks(odd).collect()) == brute_masks(rows)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(audit.masks(odd), labels).collect()}
    assert got == brute_audit(brute_masks(rows), {"1": (1, 1), "4": (None, None)})
    assert {k[0] for k in got} == {"", "a", "b"}
    assert audit.interactions(audit.masks(none), labels).count() == 0
    assert audit.interactions(audit.masks(odd), labels.limit(0)).count() == 1800


PAGES = "page_id bigint, url string, html string"


def brute_records(rows):
    least = {}
    for i, _, html in rows:
        html = html or ""
        least[html] = min((x for x in (i, least.get(html)) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), least[html or ""]
        again = first is not None and (i is None or i > first)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=str)


def read_whole(manifest):
    """The records of all archives, by a plain reader of whole files."""
    out = []
    for path in {r["path"] for r in manifest.collect()}:
        data = gzip.decompress(open(path, "rb").read())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n:n + 4] == b"\r\n\r\n"
            out.append((fields, rest[:n]))
            data = rest[n + 4:]
    return out


def test_warc_archives_and_chunks(spark, tmp_path):
    """Archives that any reader takes; payloads longer than a chunk come back
    byte for byte, in order, with running digests."""
    long = "".join(chr(0x4E00 + i % 5000) for i in range(30_000))
    rows = [(5, "http://a/1", "<p>x</p>"), (3, "http://a/2", "<p>x</p>"), (9, "http://a/3 \r\nX: é", "<p>x</p>"), (1, None, long), (2, "u", long),
            (4, "u", ""), (6, "u", None), (None, "u", "<p>x</p>"), (None, "u", "alone"), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "y" * 1000),
            (8, "u", "a" * 1000 + "b" * 24)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), chunk=1000)
    got = read_whole(manifest)
    assert sum(f["WARC-Type"] == "warcinfo" for f, _ in got) == len({r["path"] for r in manifest.collect()})
    stored = collections.Counter(b.partition(b"\r\n\r\n")[2] for f, b in got if f["WARC-Type"] == "response")
    assert stored == collections.Counter((h or "").encode() for h in {h or "" for _, _, h in rows})
    ids = [f["WARC-Record-ID"] for f, _ in got]
    assert len(ids) == len(set(ids))
    assert all(f["WARC-Refers-To"] in ids for f, _ in got if f["WARC-Type"] == "revisit")
    chunks = warc.read_chunks(spark, manifest, chunk=1000)
    by = collections.defaultdict(list)
    for r in chunks.orderBy("chunk_no").collect():
        assert len(r["data"]) <= 1000
        if r["record_type"] == "response":
            by[r["page_id"], r["header_digest"]].append(r)
    for (page, digest), parts in by.items():
        data = b""
        for n, r in enumerate(parts):
            data += bytes(r["data"])
            assert r["chunk_no"] == n and r["bytes_so_far"] == len(data) and r["last"] == (n == len(parts) - 1)
            assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert digest == parts[-1]["digest_so_far"] and (page, data) in {(i, (h or "").encode()) for i, _, h in rows}
    assert sorted((tuple(r) for r in warc.records(chunks).collect()), key=str) == brute_records(rows)
    assert warc.dangling(chunks).count() == 0
    assert sorted(r["page_id"] for r in warc.dangling(chunks.filter("NOT (record_type = 'response' AND page_id = 1)")).collect()) == [2]


def test_warc_segments_and_small_payloads(spark, tmp_path, monkeypatch):
    """Segments start at records, whatever their size; below the limit every
    payload is written out."""
    rows = [(i, "u", "abc" if i % 2 else f"page {i} " * 50) for i in range(40)]
    archives = warc._Archives(str(tmp_path))
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    for i, url, html in rows:
        warc._begin(archives, i, url, len(html), hashlib.sha1(html.encode()).hexdigest(), None)
        archives.add(html.encode())
        archives.end()
    archives.close()
    assert len(archives.done) > 10 and len({d[0] for d in archives.done}) > 1
    manifest = spark.createDataFrame(archives.done, warc.MANIFEST)
    assert sorted(r[0] for r in warc.records(warc.read_chunks(spark, manifest, with_data=False)).collect()) == list(range(40))
    monkeypatch.undo()
    pages = spark.createDataFrame(rows, PAGES)
    kinds = lambda least: collections.Counter(r["record_type"] for r in warc.records(
        warc.read_chunks(spark, warc.write_archives(pages, at_least=least))).collect())
    assert kinds(3) == {"response": 21, "revisit": 19} and kinds(4) == {"response": 40}


def test_warc_damage_is_found(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "some page " * 99)], PAGES).coalesce(1), str(tmp_path / "w"))
    path = manifest.first()["path"]
    text = gzip.decompress(open(path, "rb").read()).replace(b"some page some", b"some page sOme", 1)
    with gzip.open(path, "wb") as f:
        f.write(text)
    import os
    bad = spark.createDataFrame([(path, 0, os.path.getsize(path), 2)], warc.MANIFEST)
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_chunks(spark, bad).collect()


def test_warc_query_and_odd_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_warc"](spark, sf_dir).collect()), key=str) == brute_records(rows)
    odd = [(1, None, None), (1, None, None), (2, "u", ""), (None, None, None), (3, "u", "x"), (3, "u", "y"), (3, "u", "y"), (4, "u", "y")]
    wide = spark.createDataFrame(odd, PAGES).selectExpr("*", "7 AS size", "7 AS payload", "7 AS chunk_no", "7 AS first", "'z' AS refers_to", "1 AS sha1")
    assert sorted((tuple(r) for r in warc.records(warc.read_chunks(spark, warc.write_archives(wide))).collect()), key=str) == brute_records(odd)
    none = warc.write_archives(wide.limit(0))
    assert none.count() == 0 and warc.records(warc.read_chunks(spark, none)).count() == 0


def faults(rows):
    """(blank, duplicate, truncated) of each row, the first that applies."""
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kinds = (not words, (role, text) in seen, bool(words) and words[-1] not in ".!?")
        seen.add((role, text))
        out.append(tuple(k and not any(kinds[:i]) for i, k in enumerate(kinds)))
    return out


def every_repair(rows):
    """Least (cost, audit) over all edit sequences up to the cost of deleting
    every row, with what they say."""
    bad = faults(rows)
    found = []

    def go(i, cost, audit, said):
        if cost > 4 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)) and all(r for r, _ in said):
            found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in said)))
        for role in ("user", "assistant"):
            go(i, cost + 3, audit + "I", [*said, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            blank, dup, cut = bad[i]
            go(i + 1, cost + 4, audit + "D", said)
            if not blank and not dup:
                go(i + 1, cost + 3 * cut, audit + "K", [*said, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + 3 + 3 * cut, audit + "R", [*said, (to, text)])

    go(0, 0, "", [])
    return min(found)


def every_target(rows):
    """The same by aligning the rows with every role string of the language."""
    bad, best = faults(rows), None
    for target in ["", *("s" * s + "ua" * k for s in (0, 1) for k in range(1, len(rows) + 2))]:
        at = {(0, 0): (0, "")}
        for i in range(len(rows) + 1):
            for j in range(len(target) + 1):
                options = [at[i, j]] if (i, j) in at else []
                if j and target[j - 1] != "s" and (i, j - 1) in at:
                    options.append((at[i, j - 1][0] + 3, at[i, j - 1][1] + "I"))
                if i and (i - 1, j) in at:
                    options.append((at[i - 1, j][0] + 4, at[i - 1, j][1] + "D"))
                if i and j and (i - 1, j - 1) in at and not bad[i - 1][0] and not bad[i - 1][1]:
                    cost, audit = at[i - 1, j - 1]
                    cost += 3 * bad[i - 1][2]
                    if rows[i - 1][0][:1] == target[j - 1]:
                        options.append((cost, audit + "K"))
                    if target[j - 1] != "s":
                        options.append((cost + 3, audit + "R"))
                if options:
                    at[i, j] = min(options)
        if (len(rows), len(target)) in at:
            got = at[len(rows), len(target)]
            best = got if best is None else min(best, got)
    return best


def parsed(rows):
    talk = repair.Conversation(1)
    for i, (role, text) in enumerate(rows):
        words = text.strip(" \t\n\x0b\x0c\r")
        talk.row(i, role, text, not words, words[-1:] not in tuple(".!?"))
    return talk.result()


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", " ", "tool", ""]
    return [(rng.choice(roles), rng.choice(["One.", "Two!", "Three?", "Four", "Five .\n", " ", ""]) + rng.choice(["", "", "x."])) for _ in range(n)]


def test_repair_matches_every_edit_sequence():
    rng = random.Random(11)
    for _ in range(150):
        rows = some_rows(rng, rng.randrange(4))
        got = parsed(rows)
        cost, audit, said = every_repair(rows)
        assert got[6:] == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), rows
        assert got[2:5] == tuple(map(sum, zip(*faults(rows), strict=True))) if rows else (0, 0, 0)


def test_repair_matches_every_target():
    rng = random.Random(12)
    for _ in range(600):
        rows = some_rows(rng, rng.randrange(12))
        assert parsed(rows)[6:8] == every_target(rows), rows


def test_repair_of_a_long_conversation():
    """Rows in the tens of thousands: the stack stays as small as it was."""
    rng = random.Random(4)
    talk = repair.Conversation(1)
    for i in range(30_000):
        talk.row(i * 2, rng.choice(["user", "assistant"]), f"{i}{rng.choice('.!x')}", False, False)
        assert len(talk.parser.tops) <= 6
    got = talk.result()
    assert got[1] == 29_999 and len(got[7]) >= 30_000
    top, high = talk.parser.best(), 0
    while top:
        top, high = top.below, high + 1
    assert high <= 4


def broken(rows):
    """The damage of the contract, then each conversation in order."""
    talks = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        talks[conv] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, t in talks.items()}


def brute_result(conv, rows):
    turns = [t for t, _, _ in rows if t is not None]
    plain = [(r, t) for _, r, t in rows]
    sums = tuple(map(sum, zip(*faults(plain), strict=True))) if rows else (0, 0, 0)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(plain))
    cost, audit = every_target(plain)
    said, left = [], iter(plain)
    for edit in audit:
        role, text = next(left) if edit != "I" else (None, "")
        if edit != "D":
            said.append((role if edit == "K" else "assistant" if said and said[-1][0][:1] == "u" else "user", text))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(int, sums), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()), said


def test_repair_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r) for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()}
    talks = broken(rows)
    assert set(got) == set(talks)
    for conv, talk in talks.items():
        assert got[conv] == brute_result(conv, talk)[0]


def test_repair_odd_rows_and_messages(spark):
    rng = random.Random(8)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "a."), (1, None, "assistant", "b."), (1, 5, "user", "c?"),
            (1, 5, "user", "c?"), (1, 9, "", "d!"), (2, 0, None, None), (3, 0, "system", "Be brief."), (4, 1, "user", "word " * 60_000),
            (4, 2, "assistant", "é\U0001F600.")]
    rows += [(10 + c, t, *some_rows(rng, 1)[0]) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100 + c, c, "user", "gone?") for c in range(60)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    wide = table.selectExpr("*", "7 AS kind", "7 AS audit", "7 AS place", "7 AS blank")
    hurt = repair.damage(wide)
    verdicts = repair.repair(hurt)
    want = {c: brute_result(c, t) for c, t in broken(rows).items()}
    assert {r[0]: tuple(r) for r in verdicts.collect()} == {c: w[0] for c, w in want.items()}
    assert any(not t for t in broken(rows).values())
    said = collections.defaultdict(list)
    for r in repair.repaired(hurt, verdicts).orderBy("place").collect():
        assert r["place"] == len(said[r["conv_id"]])
        said[r["conv_id"]].append((r["role"], r["text"]))
    assert said == {c: w[1] for c, w in want.items() if w[1]}
    assert repair.repair(repair.damage(wide.limit(0))).count() == 0
