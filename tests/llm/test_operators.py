"""The operators against plain Python, and their edge cases."""

import hashlib
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from darkspace.llm import common, html_text, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, queries, suffix_dedup, token_counts, url_filter
from darkspace.llm.common import window_names as common_window_names
from darkspace.llm.graph import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, lang string, component long, n_words string"
rng = random.Random(4)
VOCABULARY = [f"w{k}" for k in range(40)] + ["Größe", "été", "it's", "###", "a|b"]
BASE = " ".join(rng.choice(VOCABULARY) for _ in range(120))


def documents():
    """Nulls, empty and very long texts, copies, near copies, shared passages, ties and repeated rows."""
    texts = [None, "", "  \n\t ", "one", "One", "x y z", BASE, BASE, BASE.upper(), BASE + " tail", BASE.replace("w3 ", "w33 ", 1), "é" * 200, "é" * 200 + "b", "<|endoftext|> x <|endoftext|>"]
    texts += [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["intro " + str(k) + " " + BASE[40:160] + " end " + str(k) for k in range(6)] + ["long " * 30000, "\n".join(["same line"] * 5)]
    rows = [(k, t, rng.choice(("a", "b", None, "ü")), "en", 7, "clash") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[3]]


ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, k) for k in range(70, 90)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    clean = [(a, b) for a, b in pairs if a is not None and a != b]
    expected = components({n for p in clean for n in p}, clean)
    assert got == expected
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    texts = {r[0]: shingles(r[1]) for r in ROWS}
    links = [(a, b) for a in texts for b in texts if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= percent * len(texts[a] | texts[b])]
    expected = components(texts, links)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(texts[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_near_duplicates_of_large_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 150)
    words = [f"v{k}" for k in range(90)]
    rows = []
    for k in range(60):
        own = list(words)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(90)] = f"u{rng.randrange(999)}"
        rows.append((k, " ".join(own)))
    texts = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a in texts for b in texts if a < b and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == components(texts, links)


def removed_by_hand(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        own = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for k, w in enumerate(own):
            if seen.get(w, doc_id) < doc_id:
                cover[k : k + 50] = b"\1" * 50
        for w in own:
            seen.setdefault(w, doc_id)
        spans = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out[doc_id] = (len(raw), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).hexdigest())
    return out


def test_repeats(docs):
    expected = removed_by_hand({(r[0], r[1]) for r in ROWS if r[1] is None or len(r[1]) < 100_000} | {(r[0], r[1]) for r in ROWS if r[1] and len(r[1]) >= 100_000})
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got} == expected
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs.select("doc_id", "text").dropDuplicates(["doc_id"])).collect()}
    assert all(len((left[k] or "").encode()) <= e[0] - e[1] and (e[1] or (left[k] or "") == (dict((r[0], r[1]) for r in ROWS)[k] or "")) for k, e in expected.items())


def test_suffix_array():
    for text in (b"banana" * 9, b"a" * 70, bytes(rng.randrange(3) for _ in range(400))):
        x = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        order = suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        shared = [0] + [len(os.path.commonprefix([text[a:], text[b:]])) for a, b in zip(order[:-1], order[1:])]
        assert suffix_dedup.common_prefixes(x, order, 50, lane=16).tolist() == [min(s, 50) for s in shared]


def test_memory_of_a_shard():
    text = np.random.default_rng(5).integers(97, 123, 1 << 18).astype(np.uint8).tobytes()
    shard = suffix_dedup.Shard(4)
    _, places, hashes = suffix_dedup._anchors_of([text])
    for doc_id in (7, 3):
        shard.add(doc_id, text, places, hashes, np.ones(len(places), bool))
    tracemalloc.start()
    covered, pieces = shard.solve()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert covered[0].tolist() == list(range(len(text) - 49)) and not len(covered[1]) and pieces
    assert peak < 90 * 2 * len(text)  # bytes for each byte of text that is sorted


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect()}
    for doc_id, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id] == (len((text or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(empty, path).count() == 0
    counter = token_counts.Counter(path)
    signs = "ab stmdrevl''  \n\t19!.é中　\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(700))) for _ in range(300)]
    assert counter.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS}
    per_doc, per_sequence = {}, {}
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        per_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        per_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    copies = {r[0]: sum(x[0] == r[0] for x in ROWS) for r in ROWS}
    for doc_id, parts in per_doc.items():
        assert sum(n for _, n in parts) == copies[doc_id] * len(ids[doc_id])
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all
    assert packing.pack(empty, path).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], size(r[1])) for r in ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sources = {r[0]: r[2] for r in ROWS}
    taken, target, full = {}, {}, {}
    for r in got:
        s = sources[r.doc_id]
        taken[s], target[s], full[s] = taken.get(s, 0) + r.taken, r.target, r.source_size
    assert sum(target.values()) == pytest.approx(1.5 * sum(full.values()))
    for s in taken:
        assert target[s] <= 2 * full[s] + 1e-6 and abs(taken[s] - target[s]) <= 2
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(3)).collect())
    assert mixing.mix_sources(empty).count() == 0


def test_url_filter(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    rows = [
        (1, "http://WWW.Example.com/en/x?y", "<p>", "c"), (2, "https://a.example.com/en/", None, "c"), (3, "http://x.net/es/1", "", "c"), (4, None, "<p>", "c"), (5, "no scheme", "<p>", "c"),
        (6, "http://mirror.org/a", link("http://x.net/es/1"), "c"), (7, "http://mirror.org/b", '<meta http-equiv=refresh content="0; url=http://mirror.org/a">', "c"),
        (8, "http://other.org/", link("http://b.com/"), "c"), (9, "http://third.org/q", link("http://other.org/"), "c"), (10, "http://x.net/es/1", link("http://b.com/z"), "c"), (11, "http://com", "", "c"),
    ]
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4] == ("", "", None, "allow") == got[5] and got[11][1:] == ("", None, "allow")
    assert got[6][3] == got[7][3] == "allow"  # their component holds an explicit allow, too
    assert got[8][3] == got[9][3] == "allow"
    only = [r for r in rows if r[0] in (3, 6, 7)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(only, "page_id long, url string, html string, host string")).collect()}
    assert got == {3: "block", 6: "block", 7: "block"}
    many = [("block", f"h{k}.org", "/") for k in range(300)] + [("allow", "www.h7.org", "/ok/")]
    rows = [(1, "http://www.h7.org/ok/1", None), (2, "http://www.h7.org/no", None), (3, "http://z.org/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), many).collect()}
    assert got == {1: ("www.h7.org/ok/", "allow"), 2: ("h7.org/", "block"), 3: (None, "allow")}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alias_targets(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    refresh = lambda c: f'<meta http-equiv="refresh" content="{c}">'
    cases = [
        (refresh("0; url='http://x.net/es/1'"), "x.net/es/1"), (refresh("0;URL=http://x.net/es;v=1"), "x.net/es;v=1"), (refresh("5; url='http://x.net/a;b c'; z"), "x.net/a;b c"),
        ("<meta http-equiv=refresh content='0; url=\"http://x.net/2\"'>", "x.net/2"), (refresh("0; url=&quot;/s?a=1&amp;b=2&quot;"), "a.org/s?a=1&b=2"), (refresh("30"), None),
        (link("page.html"), "a.org/p/q/page.html"), (link("?id=1"), "a.org/p/q/r.html?id=1"), (link("../x"), "a.org/p/x"), (link("../../../x/./y/.."), "a.org/x/"), (link("."), "a.org/p/q/"),
        (link("#top"), None), (link(""), None), (link("mailto:me@x"), None), (link("//b.org/z"), "b.org/z"), (link("/z"), "a.org/z"), (link("HTTPS://B.org/it's"), "b.org/it's"),
        (link("s?u=http://c.org/"), "a.org/p/q/s?u=http://c.org/"), ('<base href="/base/">' + link("y"), "a.org/base/y"), ("<BASE href='http://d.org'>" + link("y"), "d.org/y"), ("<link href=y.html rel=canonical>", "a.org/p/q/y.html"),
    ]
    pages = [(k, f"http://A.org/p/q/r.html?x={k}#f", html) for k, (html, _) in enumerate(cases)]
    got = {r.u: r.v for r in url_filter.alias_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {f"a.org/p/q/r.html?x={k}": v for k, (_, v) in enumerate(cases) if v}
    rows = [(1, "http://x.net/es/1", ""), (2, "http://m.org/a", refresh("0; url='http://x.net/es/1'")), (3, "http://m.org/b", link("a"))]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


PAGE = """<html><head><title>x</title></head><body><header class="site"><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use</div>
<article><header><h1>T &amp; U</h1><p>By A</p></header><p>One <span class="ad-slot">BUY</span>two<br>three &nbsp; four<p>Five<div class="share-buttons">Share</div><aside>rel</aside>
<ul><li>a<li>b</ul><form>mail</form><blockquote>q</blockquote><!-- c --><script>var t="</p>";</script><section class="comments"><p>reader</p></section></article><footer>&copy;</footer></body>"""


def test_html(spark):
    shared = "<div>Home and news and all the other parts of this large old web site of ours</div>"
    rows = [(1, "http://h/1", PAGE, "t"), (2, "http://h/2", None, "t"), (3, "http://h/3", "", "t"), (4, None, "<p>alone", "t"), (5, "http://h/5", "<article><p>cut <b>off", "t")]
    rows += [(10 + k, f"http://g/{k}", f"<body>{shared}<div>story {k} of {k * 7} things</div></body>", "t") for k in range(4)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1] == "T & U\nOne two three four\nFive\na\nb\nq" and got[2] == got[3] == "" and got[4] == "alone" and got[5] == "cut off"
    assert [got[10 + k] for k in range(4)] == [f"story {k} of {k * 7} things" for k in range(4)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_copies_on_a_host_of_several_shards(spark, monkeypatch):
    shared = "<div>Home and news and all the other parts of this large old web site of ours</div>"
    copy = "<div>" + " ".join(f"word{k}" for k in range(40)) + "</div>"
    rows = [(k, f"http://g/{k}", f"<body>{shared}<div>story {k} of {k * 7} things</div></body>") for k in range(12)]
    rows += [(k, f"http://g/{k}", f"<body>{shared}{copy}</body>") for k in range(20, 30)] + [(20, "http://g/20", f"<body>{shared}{copy}</body>")]
    texts = {}
    for pages in (2000, 4):  # one suffix array, and several
        monkeypatch.setattr(html_text, "SHARD_PAGES", pages)
        texts[pages] = sorted((r.page_id, r.text) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert texts[2000] == texts[4] == sorted((r[0], copy[5:-6] if r[0] >= 20 else f"story {r[0]} of {r[0] * 7} things") for r in rows)


def test_html_wide_names_and_open_heads():
    main = lambda page: "\n".join(t for z, t in html_text.blocks_of(page) if z == "main")
    story, side = "<h1>T</h1><p>story of some length</p>", "<div class='sidebar'>side</div>"
    for page in (
        f"<html><head><title>x</title><meta charset=utf-8><body><article>{story}</article>",
        f"<head><title>x</title><link rel=a><article>{story}</article>",
        f"<article class='post has-sidebar'>{story}{side}</article>",
        f"<main class='no-sidebar'>{story}</main>{side}",
        f"<article class='post comments-open'>{story}<section class='comments'><p>reader</p></section></article>",
        f"<body class='has-header menu-open'><article class='has-header'>{story}</article>",
        f"<div id='page' class='has-sidebar'>tag line<main>{story}</main>{side}</div>",
        f"<div class='no-header'><div class='comments-open'><article>{story}</article></div>{side}</div>",
        f"<main><h1>T</h1><div class='no-sidebar'><article><p>story of some length</p></article>{side}</div></main>",
        f"<main><div class='layout no-sidebar'>{story}</div></main>",
        f"<main><div class='layout no-header'>{story}</div></main>",
        f"<form action=x><nav>menu</nav><article>{story}</article><label>name</label></form>",
        f"<div class='post has-sidebar'>{story}</div>",
        f"<article>{story}</article><div class='related'><article>a teaser that is longer than the story, by far</article></div>",
    ):
        assert main(page) == "T\nstory of some length", page
    zone = lambda page: [(z, t) for z, t in html_text.blocks_of(page) if z != "drop"]
    assert zone("<body><form><div>story</div><label>name</label></form>") == [("open", "story")]
    assert zone("<head><title>x</title>alone") == [("open", "alone")]
    assert zone("<p>a story without a main part</p><div class='related'><article>teaser</article></div>") == [("open", "a story without a main part")]
    assert zone("<article class='hidden' hidden>x</article><nav><article>y</article></nav><div class='cookie-notice'>We use</div>") == []


def test_neighbours(spark):
    x = np.random.default_rng(1).standard_normal((1500, 16))
    x[700:1200] = x[3]  # a third of all rows
    rows = [(k, [float(v) for v in row], "z") for k, row in enumerate(x)] + [(2000, None, "z"), (2020, [0.0] * 16, "z"), (2040, [float("nan")] * 16, "z"), (2060, [None] * 16, "z"), (None, [1.0] * 16, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in neighbours.nearest(df, recall=0.98).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        exact = sorted((-float(x[q] @ x[k]), k) for k in range(1500) if k != q)[:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        assert all(f[2] == pytest.approx(float(x[q] @ x[f[1]]), abs=1e-9) for f in found)
        hits += sum(any(abs(f[2] + e) < 1e-9 for e, _ in exact) for f in found)
    assert hits >= 0.9 * 20 * len(got)
    few = neighbours.nearest(df.where("vec_id < 5")).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == sorted((k + 1, v) for k, (_, v) in enumerate(sorted((-float(x[0] @ x[k]), k) for k in range(1, 5))))
    assert neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_of_mixed_lengths_and_large_components(spark):
    x = np.random.default_rng(2).standard_normal((300, 8))
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000 + 20 * k, [1.0] * 5) for k in range(9)] + [(2000, [1e200, -1e200] + [0.0] * 6), (2001, [1e-300] * 8), (2002, [])] + rows[:40]
    best = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), recall=1.0).collect():
        best.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    whole = {k: np.array(v) for k, v in rows if len(v) == 8}
    assert sorted(best) == [k for k in sorted(whole) if k % 20 == 0]
    for q, found in best.items():
        exact = sorted((-float(whole[q] @ v), k) for k, v in whole.items() if k != q)
        assert [k for _, k in exact[:1]] == [k for p, k in sorted(found)][:1] and [p for p, _ in sorted(found)] == list(range(1, 21))
        assert len({k for _, k in exact[:20]} & {k for _, k in found}) >= 18


def test_neighbours_split_a_hot_slot(spark, monkeypatch):
    g = np.random.default_rng(3)
    x = np.vstack((g.standard_normal((200, 12)), g.standard_normal(12) + 0.05 * g.standard_normal((800, 12))))  # most vectors point one way
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    lists = {}
    for split in (4, 1 / 400):
        monkeypatch.setattr(neighbours, "SPLIT", split)
        lists[split] = sorted(map(tuple, neighbours.nearest(df).select("query_id", "rank", "vec_id").collect()))
    assert lists[4] == lists[1 / 400] and len(lists[4]) == 1000
    x = x.astype(np.float32).astype(float)
    hits = sum(v in np.argsort(-np.where(np.arange(1000) == q, -np.inf, x @ x[q]))[:20] for q, _, v in lists[4])
    assert hits >= 900


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(quality_rules.ledger(docs)).collect()}
    for doc_id, text, *_ in ROWS:
        words = WORD.findall(text or "")
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        from collections import Counter

        counts = Counter(grams)
        covered = {k + i for k, g in enumerate(grams) if counts[g] > 1 for i in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.ledger(empty).count() == 0
    table = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert table["few_words"].n_failed == sum(got[r[0]].n_words < 20 for r in ROWS)


def test_quality_classifier(spark, docs, empty):
    if os.path.isdir("/root/testdata/sf0.01"):
        d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
        rows = quality_classifier.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
        flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
        assert np.array_equal(quality_classifier.fit(d, labels).weights, quality_classifier.fit(d, flipped).weights)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(docs, none)
    assert quality_classifier.score(docs, model).count() == len(ROWS) and quality_classifier.score(empty, model).count() == 0


def test_quality_classifier_without_unlabelled_rows(spark):
    good = lambda k: " ".join(f"plain words of text number {k} go on like this" for _ in range(1 + k % 3))
    bad = lambda k: "### $$$ BUY | NOW & WIN *** " * (2 + k % 3) + str(k)
    d = spark.createDataFrame([(k, bad(k) if k % 2 else good(k)) for k in range(200)], "doc_id long, text string")
    labels = d.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality_classifier.score(d, quality_classifier.fit(d, labels)).collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in rows) >= 190
    rows = quality_classifier.score(d, quality_classifier.fit(d, labels.where("quality = 0"))).collect()
    assert all(r.predicted == 1 for r in rows)  # nothing labelled 1: a constant model, as fit says


def test_pu_prior_and_risk():
    g = np.random.default_rng(0)
    width = quality_classifier.SHAPES + 256
    good, bad = g.normal(0, 0.005, (900, width)), g.normal(0, 0.005, (300, width))
    good[:, 0] += g.normal(0, 0.1, 900)
    bad[:, 0] += 1 + g.normal(0, 0.1, 300)
    mixed = np.vstack((good[450:], bad))
    assert 0.5 < quality_classifier.estimate_prior(good[:450], mixed) < 0.7
    model = quality_classifier.train(good[:450], mixed)
    assert (model.scores(bad) < 0.5).mean() > 0.95 and (model.scores(good[450:]) >= 0.5).mean() > 0.95


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[k], 6)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in records)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    expected = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs, kept = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert tuple(docs.columns) == pipeline.COLUMNS, name
        kept.append({r.doc_id: r for r in docs.collect()})
    good, unique, cut, mixed = kept
    texts = {k: shingles(r.text) for k, r in good.items()}
    links = [(a, b) for a in texts for b in texts if a < b and texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    assert set(unique) == set(components(texts, links).values())
    expected = removed_by_hand([(k, r.text) for k, r in unique.items()])
    assert set(cut) == set(unique) and all(len(r.text.encode()) <= expected[k][0] - expected[k][1] and r.n_chars == len(r.text) for k, r in cut.items())
    assert set(mixed) <= set(cut)
    assert pipeline.run(spark, DIR).count() > 0


def test_pipeline_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline as pipeline

    other = "an entirely different text of a few words more"
    rows = [(None, BASE, "en", "a", 1), (None, BASE, "en", "b", 1), (None, None, None, None, None), (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1)]
    rows += [(3, other + " z", "en", "a", 1), (3, other + " b", "fr", "b", 1), (3, other + " b", "fr", "a", 1), (4, None, "en", "a", 0), (4, None, None, "a", 0)]
    rows += [(5, None, "en", "a", 0), (5, "one of its own kind entirely here", "en", "a", 0)]
    expected = rows[:4] + [rows[7], rows[9], rows[10]]
    for k in (1, 3, 7):
        docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, lang string, source string, n_chars long").repartition(k)
        got = pipeline.near_copies(spark, docs, "")
        assert tuple(got.columns) == pipeline.COLUMNS and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def twins():
    """Two different words of 1024 bytes whose polynomial hashes modulo 2**64 agree for any odd base."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    from tokenizers import Tokenizer

    one, two = twins()
    rows = [(0, one), (1, two), (2, f"{one} {two}"), (3, f"{two} {one}"), (4, " ".join([one, *"abcdefg", two, *"abcdefg"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [(r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 85).orderBy("doc_id").collect()] == [(len(shingles(t)), k) for k, t in rows]
    assert [r.n_repeat_words for r in quality_rules.ledger(docs).orderBy("doc_id").collect()] == [0] * 5
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert [r.n_tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for _, t in rows]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for got, (_, text) in zip(packing.Encoder(path).encode([t.encode() for _, t in rows]), rows, strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    for names in (common.Names(), common.Hashes()):
        assert len({tuple(html_text._stream([t.encode()], names)[0].tolist()) for _, t in rows}) == len(rows)


def test_token_counts_of_runs_cuts_and_other_files(monkeypatch, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [s * n for s in ("a", "-", " ", "=", "\n", "ab", "the", "é", "'s", "中。") for n in (1, 2, 3, 7, 50, 129, 400)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x20, 0x3000), 97 + rng.randrange(4)))) for _ in range(300)) for _ in range(200)]
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.Counter(path)
    assert counter.counts(texts).tolist() == expected
    monkeypatch.setattr(token_counts, "LONG", 40)  # long texts go some characters at a time
    monkeypatch.setattr(token_counts, "STATES_KEPT", 500)
    monkeypatch.setattr(token_counts, "MEMORY", 100)
    assert counter.counts(texts).tolist() == expected
    file = json.load(open(path, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": file["model"] | {"ignore_merges": True}}, {"model": file["model"] | {"merges": file["model"]["merges"] * 2}}):
        (tmp_path / "other.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            token_counts.Counter(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing.Encoder(path)


def test_bins_are_harmonic():
    sizes = [rng.choice((3, 17, 40, 90, 300, 700, 1400, 3000, 4096, 5000, 20_000)) + rng.randrange(9) for _ in range(3000)]
    bins = packing.Bins(2, 4096)
    for k, n in enumerate(sizes):
        bins.add(k, np.arange(n, dtype="<u4"))
        assert sum(len(r) for r in bins.waiting.values()) <= sum(range(128)) + 4096 // 3
    bins.end()
    starts, offsets = {}, {}
    for doc_id, start, length, crc, total, sequence, offset in bins.done:
        assert crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes()) and total == sizes[doc_id] and sequence >> 36 == 2
        starts.setdefault(doc_id, []).append((start, length))
        assert offset == offsets.get(sequence, 0)
        offsets[sequence] = offset + length
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(starts[k]):
            assert start == at
            at += length
        assert at == n
    assert all(n & n - 1 == 0 for n in offsets.values()) and sum(n != 4096 for n in offsets.values()) <= 12
    cut = [k for k, n in enumerate(sizes) if n <= 4096 and len(starts[k]) > 1]
    assert len(cut) <= sum(n == 4096 for n in offsets.values())  # a bin cuts one document at most


def test_long_texts_in_parts(monkeypatch):
    texts = [(r[1] or "").encode() for r in ROWS]
    whole = [quality_rules.measure(texts)[m].tolist() for m in quality_rules.MEASURES], [s.tolist() for s in near_dedup.shingle_sets(texts)], [e.tolist() for t in texts for e in packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode([t])]
    monkeypatch.setattr(common, "LONG", 30)
    assert whole == ([quality_rules.measure(texts)[m].tolist() for m in quality_rules.MEASURES], [s.tolist() for s in near_dedup.shingle_sets(texts)], [e.tolist() for t in texts for e in packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode([t])])


def test_window_names():
    for width in (1, 2, 5, 8):
        values = np.array([rng.randrange(3) for _ in range(300)])
        names = common_window_names(values, width).tolist()
        runs = [tuple(values[k : k + width].tolist()) for k in range(len(values) - width + 1)]
        assert len(names) == len(runs) and len(set(zip(names, runs))) == len(set(names)) == len(set(runs))


def test_risk_is_least_and_not_negative():
    g = np.random.default_rng(1)
    width = quality_classifier.SHAPES + 256
    for shift, n in ((0.05, 300), (1.0, 60)):
        good, bad = g.normal(0, 0.05, (2 * n, width)), g.normal(0, 0.05, (n, width))
        bad[:, :5] += shift
        positive, unlabelled = quality_classifier.Moments.of(good[:n]), quality_classifier.Moments.of(np.vstack((good[n:], bad)))
        halves = quality_classifier.Moments.of(good[: n // 2]) + quality_classifier.Moments.of(good[n // 2 : n])
        assert halves.n == positive.n and np.allclose(halves.products, positive.products)
        (of_p, mean_p), (of_u, mean_u), ridge = positive.means(), unlabelled.means(), quality_classifier._ridge(unlabelled, n)

        def parts(w, prior=0.5):
            wrong = lambda x, m, side: 1 + side * 2 * m @ w + w @ x @ w
            return prior * wrong(of_p, mean_p, -1), wrong(of_u, mean_u, 1) - prior * wrong(of_p, mean_p, 1)  # noqa: B023

        def risk(w):
            first, rest = parts(w)  # noqa: B023
            return first + max(0.0, rest) + w @ ridge @ w  # noqa: B023

        w, rest = quality_classifier.minimise(positive, unlabelled, 0.5)
        assert rest >= -1e-9 and parts(w)[1] == pytest.approx(rest, abs=1e-9)
        best = risk(w)
        for size in (1e-4, 1e-2, 0.3):
            assert all(risk(w + size * g.standard_normal(width + 1)) >= best - 1e-9 for _ in range(50))


def test_quality_classifier_edge_cases(spark, empty):
    rows = [(k, ("plain words of text go on like this " * (1 + k % 4)) if k % 3 else "### $$$ BUY | NOW *** " * (2 + k % 5)) for k in range(300)]
    rows += [(None, None), (None, "some words"), (7, rows[7][1]), (7, rows[7][1]), (400, ""), (401, "long text " * 200_000), (402, " \n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as quality").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(7, 1), (7, None), (None, 1), (8, 0), (8, 1)], "doc_id long, quality int")
    out = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(out) == len(rows) and sum(r.predicted == (r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 300) >= 290
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 7}) == 1
    model = quality_classifier.fit(empty, labels)
    assert quality_classifier.score(empty, model).count() == 0 and quality_classifier.score(docs, model).where("predicted = 0").count() == 0
    positives = labels.where("quality = 1")
    flipped = positives.union(labels.where("quality = 0 and doc_id != 8").withColumn("quality", (0 * labels.doc_id).cast("int") - 5)).union(labels.where("doc_id = 8"))
    assert np.array_equal(quality_classifier.fit(docs, labels).weights, quality_classifier.fit(docs, flipped).weights)  # negatives teach nothing


def test_repeated_runs_by_brute_force(monkeypatch):
    monkeypatch.setattr(html_text, "RUN", 4)
    for _ in range(40):
        streams = [np.array([rng.randrange(2, 5) for _ in range(rng.randrange(14))], np.int64) for _ in range(rng.randrange(1, 9))]
        streams += [streams[0].copy(), streams[0].copy()]
        different = {tuple(s.tolist()) for s in streams}
        having = {}
        for s in different:
            for w in {s[k : k + 4] for k in range(len(s) - 3)}:
                having[w] = having.get(w, 0) + 1
        for found, least in zip(html_text.repeated(streams), (2, max(html_text.MANY, html_text.SHARE * len(different)))):
            for s, hit in zip(streams, found, strict=True):
                expected = [any(0 <= a <= len(s) - 4 and having[tuple(s[a : a + 4].tolist())] >= least for a in range(k - 3, k + 1)) for k in range(len(s))]
                assert hit.tolist() == expected


def test_html_shards_by_brute_force(spark, monkeypatch):
    run = html_text.RUN
    words = [" ".join(f"w{k}{rng.randrange(3)}" for _ in range(rng.randrange(2, 7))) for k in range(5)]
    pages = []
    for k in range(40):
        blocks = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(4))]
        pages.append((k, f"http://h{k % 2}/{k}", "".join(f"<p>{b}" for b in blocks)))
    pages += [pages[3], (50, "http://h1/3", pages[3][2]), (51, None, None), (None, "http://h0/x", f"<p>{words[0]} {words[1]} {words[2]}")]
    tokens = {}
    for k, url, page in pages:
        own = []
        for _, text in html_text.blocks_of(page or ""):
            own += ["|", *text.split()]
        tokens[k, url] = ((url or "://").split("/")[2], tuple(own))
    hosts = {}
    for host, own in set(tokens.values()):
        for w in {own[a : a + run] for a in range(len(own) - run + 1)}:
            hosts[host, w] = hosts.get((host, w), 0) + 1
    expected = []
    for k, url, _ in pages:
        host, own = tokens[k, url]
        hit = [any(0 <= a <= len(own) - run and hosts[host, own[a : a + run]] > 1 for a in range(c - run + 1, c + 1)) for c in range(len(own))]
        lines, at = [], 0
        while at < len(own):
            end = next((c for c in range(at + 1, len(own)) if own[c] == "|"), len(own))
            inner = hit[at + 1 : end]
            if not all(inner):
                runs, c = list(inner), 0
                while c < len(inner):
                    d = c
                    while d < len(inner) and inner[d]:
                        d += 1
                    runs[c:d] = [d - c >= run - 1] * (d - c)
                    c = max(d, c + 1)
                inner = runs
            kept = [w for w, gone in zip(own[at + 1 : end], inner) if not gone]
            lines += [" ".join(kept)] if kept else []
            at = end
        expected.append((str(k), "\n".join(lines)))
    assert sum(len(t) for _, t in expected) < sum(len(" ".join(w for w in own if w != "|")) for _, own in tokens.values()) * 0.8  # much is shared
    for size in (2000, 5):
        monkeypatch.setattr(html_text, "SHARD_PAGES", size)
        got = [(str(r.page_id), r.text) for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()]
        assert sorted(got) == sorted(expected)


def test_html_templates_in_articles(spark):
    note = "<div class='x7'>" + " ".join(f"note{k}" for k in range(20)) + "</div>"
    licence = " ".join(f"licence{k}" for k in range(20))
    story = lambda k: " ".join(f"s{k}x{j}" for j in range(30))
    rows = [(k, f"http://a/{k}", f"<article><h1>T{k}</h1><p>{story(k)}</p><p>{licence}</p>{note}<p>end {k}</p></article>") for k in range(12)]
    rows += [(k, f"http://b/{k}", f"<nav>n{k}</nav><article><p>{story(0)}</p></article>") for k in range(20, 30)]  # copies of an article
    rows += [(40, "http://a/long", f"<article><p>{'very long text ' * 100_000}</p>{note}</article>"), (3, "http://a/3", rows[3][2])]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T{k}\n{story(k)}\n{licence}\nend {k}" for k in range(12)) and all(got[k] == story(0) for k in range(20, 30))
    assert got[40] == " ".join(["very long text"] * 100_000)


def test_html_names_of_main_elements():
    main = lambda page: "\n".join(t for z, t in html_text.blocks_of(page) if z == "main")
    for tag in ('main class="with-sidebar"', 'article class="post comments-open"', 'article id="share-price-news"', 'article class="comments"', "div role=main id='related'"):
        assert main(f"<body><nav>menu</nav><{tag}><p>The story.</p></{tag.split()[0]}><div class='comments'>mine</div>") == "The story.", tag
    assert main("<div id='share-price-news'><article><p>The story.</p></article></div>") == "The story."
    assert [t for z, t in html_text.blocks_of("<div id='share-price-news'><p>The story.</p></div>") if z == "open"] == ["The story."]


def test_empty_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == suffix_dedup.remove_repeats(empty).count() == suffix_dedup.without_repeats(empty).count() == 0
    assert quality_classifier.keep_quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == mixing.repeat_documents(empty).count() == 0


def test_folder_of_checkpoints(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(Frame())


def test_partitions_grow_with_bytes(spark):
    sizes = [10**9, 30 * 10**9, 10**12, 10**14]
    tasks = [common.partitions_for(spark, n) for n in sizes]
    assert tasks == sorted(tasks) and all(n / t < 260e6 for n, t in zip(sizes, tasks)) and sizes[1] / tasks[1] < 40e6 and common.partitions_for(spark, 0) == common.shuffle_partitions(spark)


def test_alias_tags(spark):
    pages = [
        '<link rel="x canonical" href="/1">', "<link href=/2 rel='canonical y'>", "<link rel=canonical href=/3/>", '<LINK REL="Canonical" HREF="&#x2F;4&amp;a=&#233;">', '<link rel="canonical" href="&sol;5&quest;x&equals;1">',
        '<!-- <link rel="canonical" href="/no"> -->', '<script>var a = \'<link rel="canonical" href="/no">\';</script>', '<link rel="canonical-x" href="/no"><link rel="nocanonical" href="/no">',
        '<style>x</style><link rel="canonical" href="/9"><!-- open <link rel="canonical" href="/no">', '<link data-rel="canonical" href="/no">', "<template><meta http-equiv=refresh content='0;url=/no'></template>",
        "<meta http-equiv=refresh content='0;url=/12?q=&amp;quot;'>",
    ]
    got = {r.u: r.v for r in url_filter.alias_edges(spark.createDataFrame([(k, f"http://a.org/p{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    expected = ["a.org/1", "a.org/2", "a.org/3/", "a.org/4&a=é", "a.org/5?x=1", None, None, None, "a.org/9", None, None, "a.org/12?q=&quot;"]
    assert got == {f"a.org/p{k}": v for k, v in enumerate(expected) if v}


def test_aliases_by_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        hosts = ["x.org", "y.net", "www.example.com", "example.com", "z.net"]
        urls = [f"{r.choice(hosts)}{r.choice(('/', '/es/', '/en/', '/fr/q'))}{k}" for k in range(60)]
        pages, links = [], []
        for k in range(120):
            u, html = r.choice(urls), "<p>"
            if r.random() < 0.5:
                v = r.choice(urls)
                html += f'<link rel="canonical" href="http://{v}">' if r.random() < 0.5 else f'<meta http-equiv="refresh" content="0;url=https://{v}#x">'
                links.append((u, v))
            pages.append((k, f"http://{u}", html))
        pages += [pages[0], (500, None, html), (501, "http://x.org/" + "long/" * 20_000, None), (None, "http://y.net/es/", "")]

        def judged(url):
            host, path = url.split("/", 1)
            best = None
            for verdict, h, p in url_filter.RULES:
                if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p) and (best is None or len(h + p) > len(best[1] + best[2])):
                    best = verdict, h, p
            return best and (best[1] + best[2], best[0])

        groups = components({n for p in links for n in p}, [p for p in links if p[0] != p[1]])
        decisions = {}
        for n, g in groups.items():
            if judged(n):
                decisions.setdefault(g, set()).add(judged(n)[1])
        expected = []
        for page_id, url, _ in pages:
            own = judged(url.split("://")[1]) if url else None
            group = decisions.get(groups.get(url.split("://")[1] if url else None), set())
            expected.append((page_id, own[0] if own else None, own[1] if own else "block" if group == {"block"} else "allow"))
        got = [(x.page_id, x.rule, x.verdict) for x in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)


def mixed_by_hand(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """Times that each document is taken whole: (doc_id, text, source) in order of hash up to the source's left-over words."""
    from fractions import Fraction

    size = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    target, rest, free = {}, Fraction(share) * sum(total.values()), set(sources)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = Fraction(most) * total[s]
        rest, free = rest - sum(target[s] for s in full), free - full
    out = {}
    for s in sources:
        base = int(target[s] // total[s]) if total[s] else 0
        left = round(float(target[s] - base * total[s]))
        own = sorted((int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16), k) for k, _, x in rows if x == s)
        at = 0
        for _, k in own:
            if not size[k]:
                out[k] = 1
            elif at + size[k] <= left:
                out[k] = base + 1
            else:
                out[k] = base + (at < left and 2 * (left - at) >= size[k])
            at += size[k]
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_pipeline_stages_by_hand(spark):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = pipeline.quality(spark, docs, DIR)
    judged = quality_classifier.score(docs, quality_classifier.fit(docs.select(*pipeline.COLUMNS), labels))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.where("predicted = 1").collect())
    few = docs.select(*pipeline.COLUMNS).where("doc_id % 3 = 0").cache()  # a fixture: the stage's input is what it is given
    rows = [(r.doc_id, r.text, r.source) for r in few.collect()]
    mixed = pipeline.source_mix(spark, few, DIR).cache()
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    expected = mixed_by_hand(rows)
    assert {k: times.get(k, 0) for k in expected} == expected
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t, _ in rows}
    covered, ends = {}, {}
    for p in pipeline.sequences(spark, mixed, DIR).collect():
        own = whole[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and p.doc_tokens == len(whole[p.doc_id])
        for k in range(p.start, p.start + p.length):
            covered[p.doc_id, k] = covered.get((p.doc_id, k), 0) + 1
        ends[p.sequence_id] = ends.get(p.sequence_id, 0) + p.length
    assert covered == {(d, k): times[d] for d in times for k in range(len(whole[d]))} and all(n <= 4096 for n in ends.values())


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, keys string, component long, size long, kept string, label string"
    rows = [(None, None, None, None, None, "x", 1, 2, "y", "z"), (1, "", "en", "a", 0, "x", 1, 2, "y", "z"), (2, BASE, "en", "a", 1, "x", 1, 2, "y", "z"), (2, BASE, "en", "a", 1, "x", 1, 2, "y", "z"), (3, BASE + " more", "en", None, 1, None, None, None, None, None), (4, "long " * 50_000, "en", "b", 1, "x", 1, 2, "y", "z")]
    some, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0, name
        out = stage(spark, some, DIR)
        assert name == "packing" or tuple(out.columns) == pipeline.COLUMNS
        assert out.count() > 0, name
    assert {r.doc_id for r in pipeline.near_copies(spark, some, DIR).collect()} == {None, 1, 2, 4}
    assert {r.doc_id for r in pipeline.repeated_passages(spark, some, DIR).collect()} == {None, 1, 2, 3, 4}
    cut = {r.doc_id: r for r in pipeline.repeated_passages(spark, some, DIR).collect()}
    assert cut[2].text == BASE and cut[3].text != BASE + " more" and cut[3].n_chars == len(cut[3].text) and cut[None].text is None


def test_both_sides_of_plan_switches_agree(spark, docs, monkeypatch):
    urls = [(k, f"http://{h}/{p}", None) for k, (h, p) in enumerate((h, p) for h in ("www.example.com", "x.net", "org", "a.b.com") for p in ("en/1", "es/", "fr/x", ""))]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    shared = "<div>" + " ".join(f"all{k}" for k in range(20)) + "</div>"
    sites = spark.createDataFrame([(k, f"http://h{k % 3}/{k}", f"{shared}<div>story {k}</div>") for k in range(30)], "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "SHARD_PAGES", 4)
    runs = [lambda: url_filter.filter_urls(pages).collect(), lambda: mixing.mix_sources(docs).collect(), lambda: html_text.extract_text(sites).collect()]
    before = [sorted(map(str, run())) for run in runs]
    for module, name in ((url_filter, "INLINE_RULES"), (mixing, "BROADCAST_SOURCES"), (html_text, "BROADCAST_HOSTS")):
        monkeypatch.setattr(module, name, 0)
    assert [sorted(map(str, run())) for run in runs] == before
