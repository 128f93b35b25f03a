"""The other operators against brute force, exact round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs
from pyspark.sql import functions as F

from nubila.llm import decontaminate, html_extract, langid, near_dedup, packing, queries, toxicity, warc

PATH = queries.tokenizer_path()


def brute_components(docs, size, percent):
    """Smallest id reachable over links of at least percent, all pairs compared."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    first, holders = {i: i for i in sets}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                first[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_dedup_equals_all_pairs(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_components(docs, 4, 80)
    got = queries.op4_minmax_dedup(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sum(r["kept"] for r in got) < len(docs)


def test_near_dedup_hard_groups(spark):
    """Chains, a large group around the threshold, a passage that many share, nulls, ties and repeats."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    rows, n = [], 0
    base = [word() for _ in range(120)]
    for k in range(150):
        own = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            own[p] = word()
        rows.append((n := n + 1, " ".join(own)))
    shared = [word() for _ in range(60)]
    for k in range(120):
        rows.append((n := n + 1, " ".join(shared + [word() for _ in range(20 + k % 7)])))
    chain = [word() for _ in range(200)]
    for k in range(12):
        rows.append((n := n + 1, " ".join(chain[k * 8 : k * 8 + 90])))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \t "), (n + 4, "One two"), (n + 5, "one TWO"), (n + 6, "Ä b"), (n + 7, "ä b")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, digest int")
    want = brute_components(rows, 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicate_classes(df, 4, 80).collect()}
    assert got == want
    assert len({c for i, (_, c) in got.items() if i <= 150}) < 150
    kept = near_dedup.drop_near_duplicates(df.union(df.limit(3)), 4, 80)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert near_dedup.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_dedup_repeated_ids_with_other_texts(spark):
    """Links of both texts of a repeated id are found, whatever the order of the rows."""
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    a, b = text("a"), text("b")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, text("c")), (4, text("c")), (4, None), (5, text("c") + " z")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicate_classes(df, 4, 80).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (4, 4, True), (5, 4, False)]
        kept = near_dedup.drop_near_duplicates(df, 4, 80).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == sorted([(1, a), (1, b), (4, text("c"))]) and sum(r["text"] is None for r in kept) == 1


def test_near_dedup_deals_hot_keys(spark, monkeypatch):
    """The same components where every key with more than a few rows is dealt over tasks."""
    from nubila.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(near_dedup, "HOT_LEAST", 4)
    test_near_dedup_hard_groups(spark)


def longest_first(item, doc, least):
    """Tokens of the item that tiles cover: the longest common unmarked run again and again, the whole table of runs each time."""
    item, doc = np.array(item), np.array(doc)
    used_i, used_d, covered = np.zeros(len(item), bool), np.zeros(len(doc), bool), 0
    while True:
        runs, best = np.zeros(len(doc) + 1, int), (0, 0, 0)
        for i in range(len(item)):
            same = (doc == item[i]) & ~used_d & (not used_i[i])
            runs = np.concatenate([[0], np.where(same, runs[:-1] + 1, 0)])
            top = int(runs.max())
            if top:
                j = int(runs.argmax()) - 1
                best = max(best, (top, -(i - top + 1), -(j - top + 1)))
        if best[0] < least:
            return covered
        k, i, j = best[0], -best[1], -best[2]
        used_i[i : i + k] = used_d[j : j + k] = True
        covered += k


def test_decontamination_equals_brute_force(spark, small):
    items = {r["item_id"]: decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    seeds = {i: grams(w, min(5, len(w))) for i, w in items.items() if w}
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = decontaminate.tokens(r["text"])
        own = grams(words, 5)
        for i, w in items.items():
            # Items that share no seed can't be covered.
            if w and (own & seeds[i] if len(w) >= 5 else grams(words, len(w)) & seeds[i]):
                least = min(5, len(w))
                if longest_first(w, words, least) >= 0.8 * len(w):
                    want.add((r["doc_id"], i))
    assert want and {(r["doc_id"], r["item_id"]) for r in queries.op1_decontaminate(spark, small).collect()} == want


def brute_tiles(item, doc, least):
    """Longest common unmarked run, first by place, again and again."""
    used_i, used_d, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not used_i[i + k] and not used_d[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return sorted(out)
        k, i, j = best[0], -best[1], -best[2]
        used_i[i : i + k] = [True] * k
        used_d[j : j + k] = [True] * k
        out.append((i, j, k))


def test_greedy_tiles_cover_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(1, 9, rng.integers(5, 40))
        parts = [item[a : a + rng.integers(3, 25)] for a in rng.integers(0, len(item), 4)]
        doc = np.concatenate([np.concatenate([p, rng.integers(1, 9, 2)]) for p in parts])
        for least in (3, 5):
            mine = decontaminate.greedy_tiles(item, doc, least)
            want = brute_tiles(item.tolist(), doc.tolist(), least)
            assert sorted(mine) == want
            assert longest_first(item, doc, least) == sum(k for *_, k in want)


def test_decontamination_reordered_and_edges(spark):
    words = [f"t{i}" for i in range(40)]
    bench = [(1, " ".join(words)), (2, None), (3, ""), (4, "short one"), (5, "Short, ONE!")]
    docs = [(1, " ".join(words[20:] + ["x"] + words[:20])), (2, " ".join(words[:30])), (3, None), (4, ""), (5, "a short one here"), (5, "a short one here"), (6, "z " * 60_000 + " ".join(words))]
    d, b = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b).collect())
    assert got == [(1, 1), (5, 4), (5, 4), (5, 5), (5, 5), (6, 1)]
    # The same in blocks of one item.
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, b, block_tokens=1).collect()) == got
    kept = decontaminate.drop_leaking(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), b).count() == 0
    assert decontaminate.drop_leaking(d, b.limit(0)).count() == len(docs)


def test_html_without_article_or_main_keeps_all_content():
    long = "A long sentence of the body, with commas, and a full stop at its end; it goes on. " * 6
    body, block = f"<p>{long}</p>" * 12, long.strip()
    links = "<div class=links><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>"
    blocks = html_extract.extract_blocks
    assert blocks(f"<body>{links}<div id=post><h1>Title</h1><div class=body>{body}</div></div></body>") == ["Title"] + [block] * 12
    assert blocks(f"<body><div id=post><div class=title><h1>Title</h1></div><div><div class=body>{body}</div></div></div></body>") == ["Title"] + [block] * 12
    lead, last = long[:160].strip(), long[:82].strip()
    assert blocks(f"<body>{links}<div id=post><p class=lead>{lead}</p><section>{body}</section><section><p>{last}</p></section></div></body>") == [lead] + [block] * 12 + [last]
    assert blocks(f"<body><div><section><h2>First</h2>{body}</section><section><h2>Last</h2><p>{long}</p></section></div></body>") == ["First"] + [block] * 12 + ["Last", block]
    menu = "<h3>Topics</h3><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li><li><a>Four</a></li></ul>"
    assert blocks(f"<body><div>{menu}<div><h1>Title</h1></div><div class=body>{body}</div></div></body>") == ["Title"] + [block] * 12


def brute_content(source):
    """Texts that tag-path ratios select, from Python's own parser: paths as strings, every sum by a loop over all blocks."""
    import math
    from html.parser import HTMLParser

    blocks = []

    class Reader(HTMLParser):
        stack, fresh = [], True

        def handle_starttag(self, tag, attrs):
            if tag not in html_extract.INLINE:
                self.fresh = True
            if tag in html_extract.VOID:
                return
            if tag in html_extract.CLOSES_P and any(t == "p" for t, _ in self.stack):
                while self.stack.pop()[0] != "p":
                    pass
            self.stack.append((tag, html_extract.speaks_against(dict(attrs).get("class") or "") or html_extract.speaks_against(dict(attrs).get("id") or "")))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass
            if tag not in html_extract.INLINE:
                self.fresh = True

        def handle_data(self, data):
            tags = [t for t, _ in self.stack]
            if any(t in html_extract.AWAY_TAGS or t in html_extract.RAW or t == "header" for t in tags) or not data.strip():
                return
            if self.fresh:
                blocks.append({"path": "/".join(t + "!" * a for t, a in self.stack if t not in html_extract.INLINE), "text": "", "size": 0, "marks": 0, "linked": 0})
                self.fresh = False
            size = len(" ".join(data.split()))
            blocks[-1]["text"] += data
            if "a" in tags:
                blocks[-1]["linked"] += size
            else:
                blocks[-1]["size"] += size
                blocks[-1]["marks"] += len(html_extract.PUNCTUATION.findall(data))

    reader = Reader()
    reader.stack = []
    reader.feed(source)
    main = lambda b: any(t in ("article", "main") for t in b["path"].split("/"))
    held = sum(b["size"] for b in blocks if main(b))
    marked = held > 0 and held >= sum(b["size"] for b in blocks if not main(b) and "!" not in b["path"])
    weigh = lambda b: (0.05 if "!" in b["path"] else 1) * (0.05 if marked and not main(b) else 1)
    ratio = []
    for b in blocks:
        same = [x for x in blocks if x["path"] == b["path"]]
        ratio.append((weigh(b) * sum(x["size"] for x in same) / len(same), weigh(b) * (sum(x["marks"] for x in same) + 1) / len(same)))
    smooth = lambda k, i: (ratio[max(0, i - 1)][k] + 2 * ratio[i][k] + ratio[min(len(ratio) - 1, i + 1)][k]) / 4
    fused = [smooth(0, i) * math.sqrt(smooth(1, i)) for i in range(len(ratio))]
    if not fused:
        return []
    mean = sum(fused) / len(fused)
    cut = 0.5 * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    out = []
    for b, (length, marks) in zip(blocks, ratio, strict=True):
        of_path = [weigh(b) * f for x, f in zip(blocks, fused, strict=True) if x["path"] == b["path"]]
        if min(sum(of_path) / len(of_path), weigh(b) * length * math.sqrt(marks)) >= cut * (1 - 1e-9):
            out.append(" ".join(b["text"].split()))
    return out


HARD_PAGES = [
    "<body><div class=top><a href=1>Home</a> <a href=2>About</a></div><div><h1>Title</h1><p>One long sentence of the text, with a comma; and more of it.</p><div>Log in now</div><ul><li><a href=1>Link one</a></li><li><a href=2>Link two</a></li><li>Terms</li></ul><p>Another long sentence of the text, with a comma; and more of it.</p></div></body>",
    "<body><article><h1>T</h1><p>Text of the article, quite short.</p><section id=discussion><h2>Discussion</h2><p>What the article itself says on it, at length, yes.</p></section><div class=related-work><p>Earlier work by others, cited here, with care.</p></div></article><div class=comments><p>I like it, a lot, really, very much indeed, thanks. And so on, and on, and on.</p></div></body>",
    "<body><div id=main-menu><p>Menu</p></div><table><tr><td>First cell, with text.</td><td>Second cell, with text.</td></tr></table></body>",
    "<p>only one</p>",
]


def test_html_ratios_equal_brute_force(spark, small):
    sources = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()] + HARD_PAGES
    cut = 0
    for source in sources:
        page = html_extract.parse(source)
        mine = [" ".join("".join(n.parts).split()) for n in html_extract.content_nodes(page, page.nodes)]
        assert mine == brute_content(source)
        cut += len(mine) < len(page.nodes)
    assert cut > 0.9 * len(sources)


def test_html_is_decided_by_the_ratios(spark, small, monkeypatch):
    """Results change where the threshold is switched off, and in-article sections stay whatever their names."""
    sources = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    usual = list(map(html_extract.extract_blocks, sources))
    first, second = map(html_extract.extract_blocks, HARD_PAGES[:2])
    assert first == ["Title", "One long sentence of the text, with a comma; and more of it.", "Another long sentence of the text, with a comma; and more of it."]
    assert second == ["T", "Text of the article, quite short.", "Discussion", "What the article itself says on it, at length, yes.", "Earlier work by others, cited here, with care."]
    monkeypatch.setattr(html_extract, "content_nodes", lambda page, nodes, share=0.5: nodes)
    assert sum(a != html_extract.extract_blocks(s) for a, s in zip(usual, sources, strict=True)) > 0.9 * len(sources)


def test_html_is_linear_in_hard_pages():
    import time

    for source in ("<div>" * 20_000 + "deep", '<a "' * 20_000, '<a ="' * 20_000 + ">x", '<a =">" ' * 20_000, "<!" * 50_000, "<b>" * 10_000 + "<div>" * 10_000 + "x", "<ul><li>" * 10_000 + "x"):
        began = time.perf_counter()
        html_extract.extract_blocks(source)
        assert time.perf_counter() - began < 5


def test_html_equals_the_article_of_every_page(spark, small):
    import html

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside[1])] if inside else []
        assert html_extract.extract_blocks(r["html"]) == [b for b in blocks if b]


def test_html_leaves_out_what_is_not_the_article(spark):
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site name</h1></header>
    <ul class="main-menu"><li>Home<li>About</ul><div id="cookie-notice">We use cookies, of course.</div>
    <div class="content"><h2>Title &amp; more</h2><p>First <b>pa</b>ra, with some&nbsp;words
    and text. It is long enough, yes.<p>Second one, also with text; and more words.<ul><li>x<li>y</ul><script>if (a < b) { "<p>" }</script>
    <div class="ad-box">Buy, now, cheap, things, here, okay, please.</div><form><p>Name, please: <input></form></div>
    <div class="sidebar">Links, more</div><section id="comments"><p>I like it, a lot, really, very much indeed, thanks.</p></section>
    <footer>&copy; me</footer></body></html>"""
    assert html_extract.extract_blocks(page) == ["Title & more", "First para, with some words and text. It is long enough, yes.", "Second one, also with text; and more words.", "x", "y"]
    for source, want in ((None, []), ("", []), ("plain text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<", ["<"]), ("<!-- x", []), ("<div>" * 3000 + "deep", ["deep"]), ("<p>" + "long text, " * 50_000, [("long text, " * 50_000).strip()])):
        assert html_extract.extract_blocks(source) == want
    df = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extract.extract_main_text(df).collect()
    assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows] and rows[0]["text"] == rows[1]["text"] and rows[2]["text"] == ""


def test_toxicity_query(spark, small):
    """Ranges, thresholds and held-out rows; accuracy needs more labels than this table has and is measured below."""
    rows = queries.op6_toxicity(spark, small).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count() and len({r["score"] for r in rows}) > 100


def test_toxicity_tells_unseen_texts_apart(spark):
    rng = np.random.default_rng(2)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(1500)]
    bad = [f"zq{w}xj" for w in rng.choice(words, 25)]
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        own = [str(w) for w in rng.choice(words, rng.integers(40, 200))]
        for _ in range(int(rng.integers(3, 8)) if toxic else 0):
            own.insert(int(rng.integers(len(own))), str(rng.choice(bad)))
        rows.append((i, " ".join(own), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(df, df.where("doc_id < 900").select("doc_id", "toxic"))
    # Both are dictionaries that the library trained, by their magic number.
    assert model.toxic[:4] == b"\x37\xa4\x30\xec" and b"\x37\xa4\x30\xec" in model.ordinary
    scored = toxicity.score_toxicity(df.where("doc_id >= 900"), model).collect()
    pos, neg = [r["score"] for r in scored if r["doc_id"] % 4 == 0], [r["score"] for r in scored if r["doc_id"] % 4]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc > 0.97
    # A window's distance is the difference of two compressed lengths.
    one, two = model.compressors()
    for w in toxicity.windows(rows[0][1])[:5]:
        assert toxicity.saved([w], one, two)[0] == len(one.compress(w)) - len(two.compress(w))


def test_toxicity_of_ids_with_both_labels(spark):
    """An id with both labels is toxic, whatever the order of its rows."""
    docs = spark.createDataFrame([(i, f"w{i} " * 40) for i in range(8)], "doc_id long, text string")
    for labels in ([(i, i % 2) for i in range(8)] + [(0, 1)], [(0, 1)] + [(i, i % 2) for i in range(8)]):
        found = toxicity._sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), 100, 100)
        assert {r["doc_id"] for r in found.where("toxic").collect()} == {0, 1, 3, 5, 7}


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (3, ""), (4, "x" * 300_000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, empty)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (99, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, one) == 1.0
    both = spark.createDataFrame([(1, 1), (4, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, both)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r["score"] < 0.5 for r in scored)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_packing_is_exact_and_tight(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: [*t.encode(v, add_special_tokens=False).ids, 0] for k, v in texts.items()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in queries.op7_pack(spark, small).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(ids)
    for k, want in ids.items():
        first = (len(want) - 1) % 2048 + 1
        cuts = [(0, first)] + [(a, 2048) for a in range(first, len(want), 2048)]
        assert sorted(got[k]) == [(i, a, n, zlib.crc32(np.array(want[a : a + n], "<u4").tobytes())) for i, (a, n) in enumerate(cuts)]
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [None, "", "<|endoftext|> x", "a" * 5000, " " * 3000 + "b", "é\U0001f600ß²½Ⅷ they'll 123", "same", "same", "\r\n\t x  y"]
    docs = spark.createDataFrame([(i, s, 5) for i, s in enumerate(texts)] + [(0, None, 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, PATH, max_tokens=64, keep_ids=True).collect()
    for i, s in enumerate(texts):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        flat = [x for r in mine[:: 2 if i == 0 else 1] for x in r["ids"]]
        assert flat == [*t.encode(s or "", add_special_tokens=False).ids, 0]
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 17, 200)
    bins, _ = packing.sum_of_squares(lengths, 16)
    gaps = []
    for s, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        def total(g):
            kept = [x for x in g if x > 0]
            return sum(kept.count(x) ** 2 for x in set(kept))

        options = [total(gaps[:k] + [gaps[k] - s] + gaps[k + 1 :]) for k in range(len(gaps)) if gaps[k] >= s]
        assert (b == len(gaps)) == (not options)
        if b == len(gaps):
            gaps.append(16)
        gaps[b] -= s
        assert gaps[b] >= 0 and (not options or total(gaps) == min(options))


def test_language_held_out(spark, small):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, small).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_language_edges(spark):
    rows = [(i, ("der und die das nicht " if i % 2 else "the and of to that ") * (1 + i % 5), ("de" if i % 2 else "en") if i % 7 else None) for i in range(60)]
    rows += [(90, None, "de"), (91, "", "en"), (92, "12 ½ !?", "en"), (93, "und", None), (93, "und", None), (94, "the and " * 40_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit_language_model(docs)
    got = {r["doc_id"]: r for r in langid.identify_languages(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3 and got[94]["lang_pred"] == "en" and got[1]["lang_pred"] == "de"
    none = langid.fit_language_model(docs.limit(0))
    assert none is None and {r["lang_pred"] for r in langid.identify_languages(docs, none).collect()} == {"und"}
    only = langid.fit_language_model(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify_languages(docs, only).collect()} == {"de", "und"}
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(k)
        assert min((code[a] != code[b]).sum() for a in range(k) for b in range(a)) >= (1 if k < 3 else 2)


def test_languages_without_a_limit(spark):
    """More languages than any cap would leave; each is learned."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    own = [["".join(rng.choice(letters, 4)) for _ in range(12)] for _ in range(230)]
    text = lambda k: " ".join(str(w) for w in rng.choice(own[k], 30))
    docs = spark.createDataFrame([(k * 4 + j, text(k), f"l{k:03d}") for k in range(230) for j in range(4)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs.where("doc_id % 4 < 3"))
    got = langid.identify_languages(docs.where("doc_id % 4 = 3"), model).collect()
    assert len(model.languages) == 230 and sum(r["lang_pred"] == f"l{r['doc_id'] // 4:03d}" for r in got) > 0.9 * len(got)


def test_language_sums_equal_direct_solution(spark):
    """Weights from the summed blocks are those of the ridge regression on all rows at once."""
    docs = spark.createDataFrame([(("der die das und " if i % 3 == 0 else "the and of to " if i % 3 == 1 else "el la los y ") * (1 + i % 4) + f"x{i}", ("de", "en", "es")[i % 3]) for i in range(90)], "text string, lang string")
    model = langid.fit_language_model(docs)
    rows = langid.sampled_vectors(docs, 600).collect()
    x, y = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float64), np.array([model.languages.index(r["lang"]) for r in rows])
    c, w = x - x.mean(axis=0), len(y) / 3 / np.bincount(y)[y]
    want = np.linalg.solve((c * w[:, None]).T @ c + 0.3 * np.eye(x.shape[1]), (c * w[:, None]).T @ model.code[y])
    assert np.abs(model.weights - want).max() < 1e-3


def test_warc_round_trip(spark, small):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    rows = queries.op10_warc_round_trip(spark, small).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        p = pages[r["page_id"]]
        lead = first[p]
        again = lead != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", lead if again else None)


def test_warc_frequent_payloads(spark, monkeypatch):
    """The same records where payloads with more than a few copies are dropped before the shuffle."""
    from nubila.llm import common

    rows = [(i, f"u{i}", "same page" if i % 3 else f"own {i}") for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plain = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", bytes(r["payload"] or b"")) for r in warc.read_warc(warc.write_warc(pages)).collect())
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    hot = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", bytes(r["payload"] or b"")) for r in warc.read_warc(warc.write_warc(pages)).collect())
    assert hot == plain and sum(k[1] == "response" for k in plain) == 20 + 1 + 1


def test_warc_splits_own_each_record_once(spark):
    """Payloads that hold gzip magic and whole members, read in small ranges."""
    trap = gzip.compress(b"WARC?").decode("latin-1")
    rows = [(i, f"http://a/{i} b", ("x" * (i * 37 % 900)) + trap * (i % 3) + f"{i % 11 or ''}") for i in range(200)] + [(500, None, None), (501, "u", ""), (7, "again", "same page"), (None, None, "no id")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_warc(pages)
    whole = warc.read_warc(files).collect()
    assert len(whole) == len(rows)
    for size in (1, 700, 4096):
        cut = warc.read_warc(files, split_bytes=max(size, 64)).collect()
        assert sorted((r["path"], r["offset"]) for r in cut) == sorted((r["path"], r["offset"]) for r in whole)
    want = sorted({(h or "").encode() for _, _, h in rows})
    assert sorted({bytes(r["payload"]) for r in whole if r["record_type"] == "response"}) == want
    # Any gzip reader sees the same records.
    name = files.first()["path"]
    fs, inner = warc.opened(name)
    assert isinstance(fs, pyarrow.fs.LocalFileSystem)
    assert gzip.open(inner).read().count(b"WARC/1.0\r\n") == files.first()["records"]
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0
    big = warc.read_warc(warc.write_warc(pages, least_bytes=10**6)).collect()
    assert {r["record_type"] for r in big} == {"response"}


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, small).select("doc_id").distinct().collect()}
    assert 0.6 * len(texts) < len(ids) < len(texts)
    want = brute_components([(i, texts[i]) for i in ids], 5, 80)
    assert all(c == i for i, (_, c) in want.items())
    odd = docs.limit(30).union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0)], docs.schema)).withColumn("spans", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns or set(out.columns) == set(odd.columns), name
        assert stage(spark, odd.limit(0), small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, small).count() >= 30


def test_pipeline_equals_brute_force(spark, tiny):
    """All stages on the smallest tables against plain loops; only the classifier's weights are taken from its fit."""
    import corpus_pipeline
    from test_llm_native import brute_spans, brute_terms
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    score = lambda t: model if isinstance(model, float) else model.score(t)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if score(r["text"]) < 0.5}
    whole = brute_components(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if whole[i][1] == i}
    items = [w for w in (decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()) if w]
    leaks = lambda t: any(longest_first(w, decontaminate.tokens(t), min(5, len(w))) >= 0.8 * len(w) for w in items if len(set(w) & set(decontaminate.tokens(t))) >= 0.5 * len(set(w)))
    texts = {i: t or "" for i, t in texts.items() if not leaks(t)}
    clean, order = {}, list(texts)
    for i, terms in zip(order, brute_terms([texts[i] for i in order]), strict=True):
        base = [x.split(":") for x in brute_spans(texts[i]).split(",") if x]
        kinds = ("email", "ip", "card", "phone")
        spans = sorted([(int(a), kinds.index(k), int(b), f"[{k.upper()}]") for k, a, b in base] + [(a, 9, b, "[NUMBER]" if w.isdigit() else "[TERM]") for a, b, w in terms])
        at, out = 0, ""
        for a, _, b, new in spans:
            if a >= at:
                out += texts[i][at:a] + new
            at = max(at, b)
        clean[i] = out + texts[i][at:]
    encode, want = Tokenizer.from_file(PATH), set()
    for i, t in clean.items():
        ids = [*encode.encode(t, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate([(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]):
            want.add((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, tiny).collect()]
    assert len(got) == len(want) and set(got) == want and len(texts) < docs.count()
