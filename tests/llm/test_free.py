"""Operators with Python inside tasks: HTML, chat, SimHash, passages, toxicity,
languages."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tidewater.llm import QUERIES, chat, html, langid, simhash, substrings, toxicity
from tidewater.llm.recompress import Stretches, anchors

W = re.compile(r"[^\x20\x09-\x0D]+")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(("body", "want"), [
    ("<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>One &amp;  two<br>three<p>Four <b>five</b>six</article><footer>f</footer>",
     "Head One & two three Four fivesix"),
    ("<div class='sidebar'>x <a>y</a></div><div><p>" + "Long text here. " * 20 + "</p><p>" + "More of it. " * 20 + "</p></div><div id=comments><p>"
     + "I say. " * 9 + "</p></div>", ("Long text here. " * 20 + "More of it. " * 20).strip()),
    ("<article><p>kept</p><form>name <input></form><aside>no</aside><div class='ad'>buy</div><p>too</article>", "kept too"),
    ("<article>cut off <p>in the mid", "cut off in the mid"), ("", ""), ("<p>a &lt;b&gt; &eacute;&#233;</p>", "a <b> éé"),
])
def test_html_main_text(body, want):
    assert html.main_text(page(body)) == want


def prose(name, n=6):
    return [f"{name} {i} " + "says a good deal more. " * (5 + i) for i in range(n)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize(("open_", "between", "close"), [
    ("<div id=content><div class=part>", "</div><div class=part>", "</div></div>"),
    ("<div id=content><div class=part>", "</div><p>Short.</p><div class=part>", "</div></div>"),
    ("<article>", "</article><article>", "</article>"),
    ("<main><div>", "</div><div>", "</div></main>"),
    ("<article><div>", "</div></article><div><div>", "</div></div>"),
])
def test_html_split_articles_and_no_article(open_, between, close):
    """Every dense branch stays, whatever the tags; lists of links do not."""
    links = "<div><ul>" + "".join(f"<li><a href=x>Go to page {i}</a></li>" for i in range(9)) + "</ul></div>"
    one, two = prose("One", 8), prose("Two")
    text = html.main_text(page(f"{links}<h1>Head</h1>{open_}{paragraphs(one)}{between}{paragraphs(two)}{close}{links}"))
    want = ["Head", *one, *(["Short."] if "Short" in between else []), *two]
    assert text == " ".join(" ".join(want).split())


def test_html_article_that_is_a_teaser():
    """An article element that holds little is not the main text."""
    body = prose("Body", 9)
    text = html.main_text(page(f"<div>{paragraphs(body)}</div><article><a href=x>Read this too</a></article>"))
    assert text == " ".join(" ".join(body).split())


def test_html_own_text_beside_dense_blocks():
    own = " ".join("The outer text goes on for long." for _ in range(40))
    body = prose("Body", 9)
    text = html.main_text(page(f"<div>{own} <b>bold</b><div>{paragraphs(body)}</div>{own}</div>"))
    assert text == " ".join(f"{own} bold {' '.join(body)} {own}".split())


@pytest.mark.parametrize(("open_", "close"), [
    ("<div class='layout with-sidebar'><article>", "</article></div>"), ("<div class='no-sidebar'><div>", "</div></div>"),
    ("<div class='page header-fixed has-menu'>", "</div>"), ("<form id=aspnetForm><div>", "</div></form>"),
    ("<form><div class=sidebar>x <a href=y>y</a></div><div>", "</div></form>"), ("<aside class=sidebar><main>", "</main></aside>"),
    ("<div class='sidebar'><div class=entry>", "</div></div>"),
])
def test_html_wrappers_are_not_furniture(open_, close):
    body = prose("Body", 9)
    nav = "<nav><a href=x>Menu</a> and more</nav><div class='cookie-banner'>We use cookies here.</div>"
    assert html.main_text(page(f"{nav}{open_}{paragraphs(body)}{close}")) == " ".join(" ".join(body).split())


@pytest.mark.parametrize("head", ["<header class='article-header'><h1>Head</h1></header>", "<div class='post-header'><h1>Head</h1></div>",
                                  "<div class=header><h1>Head</h1></div>"])
def test_html_headline_in_article_header(head):
    body = prose("Body", 4)
    replies = "<div id=comments><article class=comment><p>" + "I say that too. " * 400 + "</p></article></div>"
    assert html.main_text(page(f"<article>{head}{paragraphs(body)}</article>{replies}")) == " ".join(" ".join(["Head", *body]).split())


def test_html_footer_longer_than_the_article():
    foot = "<footer>&copy; example.com &middot; A footer that says more than the page.</footer>"
    assert html.main_text(page(f"<article><h1>Head</h1><p>Few words.</article>{foot}")) == "Head Few words."


def test_html_odd(spark, sf_dir):
    assert html.main_text(None) == "" and html.main_text("   ") == ""
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.main_text("</p></b>just <i>text") == "just text"
    rows = spark.createDataFrame([(1, None, None, 0), (None, "u", "<p>x</p>", 0), (1, "u", "<p>x</p>", 0)],
                                 "page_id bigint, url string, html string, n_chars int")
    assert sorted(r["text"] for r in html.extract(rows).collect()) == ["", "x", "x"]
    assert html.extract(rows.limit(0)).count() == 0
    got = QUERIES["op3_html_text"](spark, sf_dir).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def test_chat_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    talks = collections.defaultdict(list)
    for conv, _, role, text in rows:
        talks[conv].append((role, text or ""))
    got = {r["conv_id"]: r for r in QUERIES["op5_chat_format"](spark, sf_dir).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learnt))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_escape_is_reversible(spark):
    hard = ["</s>", "~1", "~0~1~", "<|user|>\nx</s>\n", "[INST][/INST]<s>", "<</SYS>><<SYS>>", "<|>", "|", "", None, "<</s>/s>", "\U0001F600</s>"]
    d = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(hard)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.render(chat.fold(chat.to_events(d))).first()["formatted"]
    assert chat.read_back(out) == [(t or "", t or "") for t in hard]


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [("message", 1, "user", "hi"), ("delta", 2, "assistant", "he"), ("delta", 2, None, "llo"), ("message", 3, "user", "x"),
           ("edit", 1, None, "HI"), ("delta", 2, "assistant", "new"), ("regenerate", 2, None, None), ("delta", 2, "assistant", "ag"),
           ("delta", 2, None, "ain"), ("message", 3, "user", "bye"), ("message", 4, "assistant", "gone"), ("regenerate", 4, None, None)]
    events = spark.createDataFrame([(9, i, *e) for i, e in enumerate(log)],
                                   "conv_id bigint, seq bigint, kind string, place bigint, role string, text string")
    got = [(r["role"], r["text"]) for r in chat.fold(events).orderBy("place").collect()]
    assert got == [("user", "HI"), ("assistant", "again"), ("user", "bye")]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def fingerprint(text):
    words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * ones[b] > len(shingles))


def grouped(points, radius=4):
    """Smallest id of each linked group, by all pairs."""
    ids = sorted(points)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (points[a] ^ points[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query_matches_brute_force(spark, sf_dir, documents):
    want = {r[0]: fingerprint(r[1]) for r in documents}
    got = QUERIES["op6_simhash_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == want
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(want)


@pytest.mark.parametrize(("blocks", "depth"), [(1, 3), (2, 4), (3, 6), (5, 10), (simhash.BLOCKS, None)])
def test_simhash_trees_find_every_link(spark, blocks, depth):
    """Chains and clusters at the radius, and fingerprints far apart; the full
    metric and the bit ranges alike."""
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    points = set(map(int, rng.integers(0, 1 << 63, 150, dtype=np.uint64)))
    for b in base:
        x = int(b)
        for _ in range(25):
            for bit in rng.choice(64, 4, replace=False):
                x ^= 1 << int(bit)
            points.add(x)
    fps = np.array(sorted(points), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    edges = simhash.links(df, 4, blocks, depth)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    ids = sorted(int(x) for x in fps)
    by = {i: i % (1 << 64) for i in ids}
    want = grouped(by)
    assert {i: roots.get(i, i) for i in ids} == want


def crowd(n, seed):
    """Random fingerprints, and one near copy within four bits of each 50th."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    near = fp[::50].copy()
    for k in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    return np.unique(np.concatenate((fp, near))), np.stack((fp[::50], near), axis=1)


def test_simhash_shipped_trees_cross_borders_and_cost_stays_low():
    """In the shipped setting fingerprints stand on both sides of borders, each
    planted pair meets in a leaf, and eight times the fingerprints
    take far less than eight times the distances each."""
    inner, masks = simhash.RADIUS // simhash.BLOCKS, simhash.view_masks(simhash.BLOCKS)
    assert inner >= 1
    cost = {}
    for n in (8_000, 64_000):
        fp, pairs = crowd(n, 3)
        depth = simhash.depth_for(len(fp))
        trees = simhash.fit_trees(fp[:: max(1, len(fp) // simhash.TREE_SAMPLE)][:simhash.TREE_SAMPLE], simhash.BLOCKS, depth, inner)
        met, total, stands, edges = set(), 0, 0, set()
        for mask, tree in zip(masks, trees, strict=True):
            who, leaf = simhash.route(fp, mask, tree, depth, inner)
            assert len(who) > len(fp) and len(np.unique(who)) == len(fp)
            stands += len(who)
            order = np.argsort(leaf, kind="stable")
            for shard in np.split(who[order], np.flatnonzero(np.diff(leaf[order])) + 1):
                spaces = [(mask, inner), ((1 << 64) - 1, simhash.RADIUS)]
                total += sum(len(p) ** 2 for p in simhash._parts(fp[shard], spaces))
                if n == 8_000:
                    edges |= {tuple(sorted(e)) for e in simhash.link_shard(fp[shard], simhash.RADIUS, spaces)}
        cost[n] = total / len(fp)
        if n == 8_000:
            want = {tuple(sorted(p)) for p in pairs.view(np.int64).tolist() if p[0] != p[1]}
            assert want <= edges
    assert cost[64_000] < 3 * cost[8_000] < 9_000


def test_simhash_clusters_that_a_view_cannot_split():
    """Many fingerprints equal in one view: parted by the full distance."""
    rng = np.random.default_rng(1)
    mask = simhash.view_masks(simhash.BLOCKS)[0]
    fp = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & ~np.uint64(mask))
    fp = np.unique(np.concatenate((fp, fp[:200] ^ np.uint64(1 << 40), fp[:200] ^ np.uint64(1 << 41 | 1 << 50))))
    got = dict(simhash.link_shard(fp, 4, [(mask, 1), ((1 << 64) - 1, 4)]))
    want = grouped({int(x): int(x) % (1 << 64) for x in fp.view(np.int64)})
    assert {int(x): got.get(int(x), int(x)) for x in fp.view(np.int64)} == want


def test_simhash_keeps_one_of_each_group_not_of_each_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (0, c), (None, d)]
    for _ in range(2):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
        assert got == sorted([(None, a), (None, b), (0, c), (1, d)], key=str)
        rows.reverse()


def test_simhash_odd_rows(odd, none):
    got = collections.defaultdict(list)
    for r in simhash.groups(odd).collect():
        got[r["doc_id"]].append(r)
    assert len(got[1]) == 2 and got[2][0]["component"] == 1 and got[None][0]["component"] == 1
    assert {got[i][0]["fp"] for i in (3, 4, 5)} == {0} and got[5][0]["component"] == 3
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 6, 7, 8, 9]
    assert simhash.groups(none).count() == 0 and simhash.keep_one(none).count() == 0


def pruned(rows, window=13):
    first, words = {}, {}
    for i, text in sorted(rows):
        w = words[i] = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_query_matches_brute_force(spark, sf_dir, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_substring_dedup"](spark, sf_dir).collect()}
    want = pruned([(r[0], r[1]) for r in documents])
    assert got == want and sum(v[1] for v in want.values())


@pytest.mark.parametrize(("letters", "window"), [(2, 13), (4, 13), (30, 13), (3, 5), (20, 40)])
def test_substrings_of_few_words(spark, letters, window):
    """Few distinct words make runs, ties and repeats at every offset."""
    rng = np.random.default_rng(letters)
    parts = [[f"w{x}" for x in rng.integers(0, letters, n)] for n in rng.integers(1, 90, 12)]
    rows = [(i, " ".join(w for k in rng.integers(0, 12, 4) for w in parts[k][int(rng.integers(0, 3)):])) for i in range(60)]
    rows += [(60, "w0 " * 100), (61, "w0 " * 50), (62, "w0 " * window), (63, "w0 " * (window - 1))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest())
           for r in substrings.prune(d, window).collect()}
    assert got == pruned(rows, window)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    texts = [np.concatenate((rng.integers(0, 1 << 62, n).astype(np.uint64), common, rng.integers(0, 1 << 62, 9).astype(np.uint64)))
             for n in (0, 1, 7, 30)]
    words, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    s = Stretches(words)
    start, _, anchor = anchors(words, lengths, 13, s)
    by = collections.defaultdict(set)
    for at, a in zip(start, anchor, strict=True):
        by[tuple(words[at:at + 13])].add(int(a))
    assert all(len(v) == 1 for v in by.values()) and len(by) < len(start)


def test_substring_odd_rows(odd, none):
    got = collections.defaultdict(list)
    for r in substrings.prune(odd).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert got[1] == [(120, 0)] * 2 and got[2] == [(120, 120)] and got[None] == [(120, 0)]
    assert got[3] == got[4] == got[5] == [(0, 0)] and got[6] == [(30_002, 0)]
    assert substrings.prune(none).count() == 0


def test_lexicon_finds_misspellings_like_brute_force():
    terms = {"idiot": 2.0, "moron": 1.5, "scum": 1.0, "worthless": 3.0, "lowei*": 2.5}
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = np.random.default_rng(3)
    words = ["idiot", "idoit", "idiott", "diot", "scums", "worthles", "morron", "lowei", "loweich", "lowe", "x"]
    for t in ("idiot", "moron", "worthless"):
        for _ in range(60):
            w = list(t)
            for _ in range(int(rng.integers(1, 3))):
                k = int(rng.integers(0, len(w)))
                w[k:k + int(rng.integers(0, 2))] = [chr(97 + int(rng.integers(0, 26)))] * int(rng.integers(0, 3))
            words.append("".join(w))
    for w in words:
        near = min((distance(w, t), t) for t in terms if "*" not in t and (w == t or len(t) >= toxicity.ONE_ERROR))
        want = near[0] if near[0] <= 1 else 0 if w.startswith("lowei") else 9
        got = lexicon.verdict(w)
        assert (got[0] if got else 9) == want, w
    assert lexicon.verdict("1diot")[0] == 1


def test_toxicity_query(spark):
    """Held-out accuracy, on the table large enough to learn from."""
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    hit = sum(1 for p, t in held if p and t)
    assert hit / sum(t for _, t in held) > 0.9 and hit / sum(p for p, _ in held) > 0.9


def test_toxicity_quotation_and_odd_rows(spark, odd, none):
    lexicon = toxicity.Lexicon({"idiot": 3.0})
    direct, quoted = toxicity.features("you are an idiot today", lexicon), toxicity.features('he said "what an idiot" today', lexicon)
    assert direct[0] > 0 == direct[1] and quoted[1] > 0 == quoted[0] and direct[3] > 0
    assert toxicity.features(None, lexicon) == [0.0] * toxicity.FEATURES
    rows = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, None), (99, 1)], "doc_id bigint, toxic int")
    from pyspark.sql import functions as F

    terms, weights = toxicity.train(odd, rows, F.lit(True))
    assert toxicity.score(odd, terms, weights).count() == odd.count()
    terms, weights = toxicity.train(odd, rows.limit(0), F.lit(True))
    assert weights is None and {r["score"] for r in toxicity.score(odd, terms, weights).collect()} == {0.0}
    assert toxicity.score(none, {}, None).count() == 0


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).collect()
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r["lang_pred"] == want[r["doc_id"]] for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(got) == len(want) and sum(held) / len(held) > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        e = rng.normal(0, 4, (n, k))

        def total(p, e=e):
            return sum(e[i, x] for i, x in enumerate(p)) - 5 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        paths = [()]
        for _ in range(n):
            paths = [(*p, x) for p in paths for x in range(k)]
        best = max(map(total, paths))
        assert abs(total(tuple(langid.viterbi(e, 5.0))) - best) < 1e-9
        top = langid.one_language(e, 5.0)
        if top is not None:
            assert abs(total((top,) * n) - best) < 1e-6


def test_language_spans_and_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    train = spark.createDataFrame(
        [(i, t, g) for i in range(40) for t, g in ((f"the quick house with some things {i}", "en"), (f"le la maison avec quelques choses {i}", "fr"),
                                                   ("η γλώσσα είναι", "el"))],
        "doc_id bigint, text string, lang string")
    counts = langid.learn(train, F.lit(True))
    model = langid.Model(counts)
    text = "the house with things " * 4 + "la maison avec choses " * 4
    assert [x[2] for x in langid.spans(text, model)] == ["en", "fr"]
    assert langid.predict_one("γλώσσα", model)[0] == "el"
    assert langid.predict_one("123 !", model) == ("und", 0.0) and langid.predict_one(None, model) == ("und", 0.0)
    got = langid.predict(odd, counts)
    assert got.count() == odd.count() and {r["lang_pred"] for r in got.filter("doc_id IN (3, 4, 5)").collect()} == {"und"}
    assert langid.predict(none, counts).count() == 0
    empty = langid.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize(("head", "open_"), [("<head><title>T</title><script>var a='<p>';</script>", "<body>"), ("<head><meta charset=utf-8><title>T</title>", ""),
                                             ("", ""), ("<head><style>p{}</style></head>", "<body>"), ("<head><title>T</title><svg/>", "<body><svg viewBox='0 0'/>")])
def test_html_without_the_end_of_the_head(head, open_):
    """The end tag of a head may be missing, and a foreign element may close
    itself, before and inside the article."""
    body = prose("Body", 5)
    inner = paragraphs(body[:2]) + "<svg/><math/>" + paragraphs(body[2:])
    assert html.main_text(f"<!DOCTYPE html><html>{head}{open_}<article><h1>Head</h1>{inner}</article>") == " ".join(" ".join(["Head", *body]).split())


@pytest.mark.parametrize("flood", ["<!--", "<?", "<a ", "<![CDATA[", "</", "<!x", "<", "<p title='", "<!-- -->", "<svg>"])
def test_html_floods_take_linear_time(flood):
    import time

    def seconds(n):
        t = time.perf_counter()
        html.main_text("<article><p>Some text here.</p>" + flood * (n // len(flood)) + "</article>")
        return time.perf_counter() - t
    assert seconds(400_000) < 20 * seconds(100_000) + 1


def test_html_pages_without_head_tags_give_the_same_text(spark, sf_dir):
    for (page_,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        assert html.main_text(page_.replace("</head>", "").replace("<body>", "")) == html.main_text(page_) != ""


def test_substrings_many_texts_of_one_id(spark):
    """Texts of one id are told apart: one that repeats nothing keeps all its
    words however many others, of the same id, hold repeats."""
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared)] + [(2, f"{shared} own{i} " + " ".join(f"o{i}x{j}" for j in range(5))) for i in range(1500)]
    rows += [(2, " ".join(f"u{j}" for j in range(30)))] + [(None, f"{shared} n{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = substrings.prune(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 20, 0, 1), (2, 26, 20, 1500), (2, 30, 0, 1), (None, 21, 0, 300)}


def test_language_letters_and_marks():
    assert langid.words("½ ² ① 12 Ⅳ _") == [] and langid.words("हिन्दी x²y Naïve") == ["हिन्दी", "x", "y", "naïve"]
