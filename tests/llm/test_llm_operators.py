"""The corpus operators against plain re-computations, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import bpe, chat, decontaminate, html_main, jaccard, quality, registry, search, sharding, urls
from threadmill.llm.common import ALNUM_SEPARATORS, SPACE_SEPARATORS, Words, byte_values, row_chunks, separator_mask, text_buffer
from threadmill.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, row long"
LONG = "word%d " * 0 + " ".join(f"w{i}" for i in range(30_000))
TEXTS = [
    None, "", " ", "a", "Two words", "Released under the MIT License. Thanks.", "This is the GNU Lesser General Public License, version 2.1", "mit license apache license mit license",
    "Été à la plage — naïve 日本語 words", LONG, "the the the the " * 50, "Two words", "licensed under cc by-nc 4.0", "SPDX-License-Identifier: Apache-2.0",
]


def lower_az(text: str | None) -> str:
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1, 0.5, 7, 3) for i, t in enumerate(TEXTS)] + [(None, "Two words", "en", None, None, None, None, None), (3, "a", "en", "s", 1, 0.1, 1, 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- words ---------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é日 \n.,-", max_size=12)), max_size=8))
def test_words_have_the_places_of_the_pattern(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    found = Words(raw, offsets, separator_mask(ALNUM_SEPARATORS), byte_values(lower=True))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    got = [(int(t), lower_az(bytes(raw[a:b]).decode())) for t, a, b in zip(found.text, found.start, found.end)]
    assert got == want
    by_word = {}
    for (_, w), h in zip(want, found.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_row_chunks_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 100, 101, 300])
    assert row_chunks(offsets, 50) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert row_chunks(np.array([0]), 50) == []


# --- op2 -----------------------------------------------------------------------------------------


def brute_bm25(rows, every, k):
    bags = [Counter(words(t)) for _, t in rows]
    n, average = len(rows), sum(sum(b.values()) for b in bags) / len(rows)
    df = Counter(w for b in bags for w in b)
    out = set()
    for q, (i, _) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = []
        for (j, _), bag in zip(rows, bags):
            length = sum(bag.values())
            s = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * length / average)) for w in bags[q] if w in bag), 6)
            if s > 0:
                scores.append((-s, j is None, j or 0))
        out |= {(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize(("shard", "block"), [(4096, 1 << 24), (70, 3000)])
def test_search_equals_brute_force(spark, shard, block):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(f"t{int(x)}" for x in random.zipf(1.3, random.integers(0, 40)) if x < 500)) for i in range(400)] + [(None, "t1 t2"), (5, None), (9, ""), (20, "t1 t499")]
    found = search.top_k(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=5, every=20, block_bytes=block, shard_documents=shard)
    got = {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()}
    assert {(q, k, s) for q, k, _, s in got} == {(q, k, s) for q, k, _, s in brute_bm25(rows, 20, 5)}
    assert {x for x in got if x[0] != 20} == {x for x in brute_bm25(rows, 20, 5) if x[0] != 20}


@pytest.mark.parametrize("shard", [4096, 70])
def test_search_for_words_of_all_documents(spark, shard):
    rows = [(i, "the and " + ("rare " if i in (20, 7) else "") + "filler " * (i % 3)) for i in range(1, 400)] + [(400, "the")]
    found = search.top_k(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=5, every=20, shard_documents=shard)
    assert {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()} == brute_bm25(rows, 20, 5)


def long_near_copies():
    """Two families of long near copies, whose scores are very close to each other."""
    random = np.random.default_rng(8)
    rows = []
    for f in range(2):
        base = [f"{'ab'[f]}{i}" for i in range(18_000)] if f else [f"a{i}" for i in range(9_000)] + [f"b{i}" for i in range(9_000)]
        for _ in range(14):
            copy = list(base)
            for at in random.integers(0, len(copy), 3):
                copy[at] = f"x{int(random.integers(0, 50))}"
            rows.append((len(rows) + 1, " ".join(copy)))
    return [(20, " ".join([f"a{i}" for i in range(9_000)] + [f"b{i}" for i in range(18_000)])), *[r for r in rows if r[0] != 20], *[(100 + i, f"a1 b2 word{i}") for i in range(30)]]


@pytest.mark.parametrize(("shard", "words_"), [(4096, 1 << 30), (7, 60_000)])
def test_search_of_long_texts_is_exact(spark, shard, words_):
    rows = long_near_copies()
    found = search.top_k(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), k=10, every=20, shard_documents=shard, shard_words=words_)
    assert {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()} == brute_bm25(rows, 20, 10)


@pytest.mark.parametrize(("matrix", "rare"), [(1 << 20, 30_000), (0, 1), (4 * 300 * 3, 500)])
def test_search_with_a_bounded_matrix_and_few_postings_at_once(monkeypatch, matrix, rare):
    """A matrix for none, three or all of the frequent terms; rare terms of one query, or some, at a time."""
    monkeypatch.setattr(search, "_MATRIX_BYTES", matrix)
    monkeypatch.setattr(search, "_RARE_AT_ONCE", rare)
    random = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{int(x)} d{i}" for x in random.zipf(1.3, 20))) for i in range(300)]
    bags = [Counter(t.split()) for _, t in rows]
    names = sorted(set().union(*bags))
    words = [names.index(w) for bag in bags for w in bag.elements()]
    parts = [(np.repeat(np.arange(300), [bag.total() for bag in bags]), np.array(words, np.uint64))]
    row = search._shard_row(0, [i for i, _ in rows], parts)
    df = Counter(w for bag in bags for w in bag)
    weight = {w: math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) for w in names}
    asked = [sorted(names.index(w) for w in bags[i]) for i in range(0, 300, 20)]
    block = search.QueryBlock(np.arange(0, 300, 20), np.cumsum([len(x) for x in asked]), np.array(sum(asked, []), np.uint64), np.array([weight[names[x]] for own in asked for x in own]))
    shard = search.Shard(row, len(words) / 300)
    assert 4 * 300 * len(shard.fast) <= matrix
    got = {(int(block.query[i]), s) for i, own in shard.search(block, np.zeros(15), 5) for s, _ in sorted(own, reverse=True)[:5]}
    assert got == {(q, s) for q, _, _, s in brute_bm25(rows, 20, 5)}


def test_search_of_nothing(empty):
    assert search.top_k(empty).count() == 0


# --- op3 -----------------------------------------------------------------------------------------


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], sharding.N_SHARDS)
        if r["doc_id"] is not None and r["doc_id"] != 3:
            t = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert sharding.shard_documents(empty).count() == 0


# --- op4 -----------------------------------------------------------------------------------------


def corpus(n, seed=5):
    random = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        plain = " ".join("".join(random.choice(list("etaoinshr"), random.integers(2, 8))) for _ in range(random.integers(5, 300))).capitalize() + "."
        bad = i % 3 == 0
        rows.append((i, plain.upper().replace(" ", "!! ") if bad and i % 2 else " ".join(w + "###" for w in plain.split()) if bad else plain))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_classifier_learns_and_is_the_same_anywhere(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows + [(None, None), (1000, ""), (1000, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (7777, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == 403
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.repartition(7), marks).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in got)


def test_held_out_rows_are_not_learnt_from(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lied = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    scores = [{r["doc_id"]: r["score"] for r in quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, lied)]
    assert scores[0] == scores[1]


def test_classifier_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


def plain_passages(text):
    """A text's passages as bytes: 64 words each, the first one with what stands before, each up to the next one's first word."""
    raw = (text or "").encode()
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    cuts = [0, *starts[64::64], len(raw)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def plain_features(passage):
    kinds = [sum(b in signs for b in passage) for signs in quality._KINDS.values()]
    high = sum(b >= 128 for b in passage)
    shares = [x / max(1, len(passage)) for x in (*kinds, len(passage) - sum(kinds) - high, high)]
    w = re.findall(rb"[^\x20\x09-\x0D]+", passage)
    n, lengths = max(1, len(w)), [len(x) for x in w]
    mean = sum(lengths) / n
    odd = lambda b: b < 128 and not any(b in signs for signs in quality._KINDS.values())
    extra = [
        mean / 10, math.sqrt(max(0, sum(x * x for x in lengths) / n - mean * mean)) / 10, len(set(w)) / n, sum(x[0] in quality._KINDS["upper"] for x in w) / n, sum(odd(x[-1]) for x in w) / n,
        sum(x <= 3 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, sum(a == b for a, b in zip(w, w[1:])) / n, math.log1p(len(w)) / 5,
    ]
    return shares + extra


def plain_score(model, passages):
    """Gated attention over the passages of one text, one number at a time."""
    w = {k: v.tolist() for k, v in model.w.items()}
    dot = lambda x, m: [sum(a * row[j] for a, row in zip(x, m)) for j in range(len(m[0]))]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    encoded, energy = [], []
    for passage in passages:
        x = [(f - m) / s for f, m, s in zip(plain_features(passage), model.mean.tolist(), model.scale.tolist())]
        h = [math.tanh(v + b) for v, b in zip(dot(x, w["W"]), w["b"])]
        encoded.append(h)
        energy.append(sum(math.tanh(a) * sigmoid(b) * c for a, b, c in zip(dot(h, w["V"]), dot(h, w["U"]), w["a"])))
    weights = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(a * h[j] for a, h in zip(weights, encoded)) / sum(weights) for j in range(len(encoded[0]))]
    return sigmoid(min(30, max(-30, sum(z * c for z, c in zip(pooled, w["c"])) + w["d"][0])))


def test_scores_equal_a_plain_recomputation(spark):
    rows, labels = corpus(120)
    rows += [(500 + i, t) for i, t in enumerate(TEXTS)] + [(600, "é日 " * 700), (601, " \n a b  a a b! \t")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_on_labels(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    for i, text in rows[::5] + rows[120:]:
        assert got[i] == pytest.approx(plain_score(model, plain_passages(text)), abs=1e-4), (text or "")[:80]


def test_gradients_lower_the_loss():
    random = np.random.default_rng(2)
    passages = random.integers(1, 6, 60)
    x = random.normal(size=(passages.sum(), quality.N_FEATURES)).astype(np.float32)
    labels = np.array([float(part[:, 0].max() > 1) for part in np.split(x, np.cumsum(passages)[:-1])])
    model = quality.fit_model(x, passages, labels)
    assert ((model.score(x, passages) > 0.5) == labels).mean() > 0.9


# --- op5 -----------------------------------------------------------------------------------------


def brute_hits(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                named.add(i)
    return len(w), len(hit), len(named), sorted(str(i) for i in named if i is not None)


def contamination_case(spark):
    random = np.random.default_rng(11)
    text = lambda n: " ".join(f"v{int(x)}" for x in random.integers(0, 6, n))
    items = [(i, text(int(random.integers(0, 25)))) for i in range(30)] + [(50, "v1 v2 v3"), (51, "v1"), (52, None), (53, ""), (54, "v1 v2 v3"), (60, "Naïve, Words!"), (None, "v2 v2"), (None, "v5 v5 v5"), (70, text(400)), (71, text(200) + " v0" * 300)]
    rows = [(i, text(int(random.integers(0, 60)))) for i in range(60)] + [(100 + i, f"x {t} y") for i, t in items if t and i is not None] + [(200, None), (201, ""), (None, "v1"), (202, "naïve words"), (203, text(5000)), (203, "v1 v1")]
    return items, rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS _found", "8 AS _row"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("limit", "piece"), [(decontaminate.SHARD_BYTES, decontaminate.PIECE_WORDS), (8000, 50), (3000, 1)])
def test_decontamination_equals_brute_force(spark, limit, piece):
    items, rows, docs, bench = contamination_case(spark)
    got = decontaminate.find_contamination(docs.repartition(3), bench, keep=["doc_id", "_found", "_row"], shard_bytes=limit, piece_words=piece).collect()
    want = Counter((i, *map(str, brute_hits(t, items))) for i, t in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["n_items"]), str(r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and (r["_found"], r["_row"]) == (7, 8) for r in got)
    assert all(a["end"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:]))


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([("b/10", "one two"), ("a b", "three")], "item_id string, text string")
    assert decontaminate.find_contamination(docs, bench).first()["items"] == ["a b", "b/10"]
    with pytest.raises(ValueError, match="n_hit"):
        decontaminate.find_contamination(docs, bench, keep=["doc_id", "n_hit"])


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, none).collect()} == {0}
    assert decontaminate.find_contamination(empty, none).count() == 0


# --- op6 -----------------------------------------------------------------------------------------

ARTICLE = """<html><head><title>no</title><script>var a="</p><p>no";</script></head><body class="article-page"><header><h1>Site</h1><p>no such line in the text</p></header>
<nav><ul><li><a href=/a>no</a></li></ul></nav><div id="cookie-notice"><p>no, we use cookies to make this site better for all of you.</p></div>
<article><h1>A &amp; B</h1><p><b>First   line<br>of&nbsp;the <i>text</i>.<p>Second, <a href=x>linked</a> one.</p><div class="ad">no</div><ul><li>one</li><li>two</li></ul><p>x</p>
<form><p>no</p></form><section class="comments"><p>no, this is what a reader says about the text at some length.</p></section></article><aside><p>no</p></aside><footer>&copy; no</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(ARTICLE) == "A & B\n\nFirst line of the text.\n\nSecond, linked one.\n\none\n\ntwo\n\nx"
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav><a>x</a></nav>") == ""
    assert html_main.main_text("<p>open <p>tags &lt;b&gt;<!-- never closed") == "open\n\ntags <b>"


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='post category-legal'><p>Words of the law, as they are.</p></div>", "Words of the law, as they are."),
    ("<article><p>One.</p><div class='story-share-of-market'><p>Two words and more.</p></div></article>", "One.\n\nTwo words and more."),
    ("<div class='legal'><article><h1>On law</h1><p>All of it is here.</p></article></div>", "On law\n\nAll of it is here."),
    ("<body class='no-sidebar has-ads'><p>Text of a page without any part, long enough to be read.</p></body>", "Text of a page without any part, long enough to be read."),
    ("<article><p>One of two.</p><form><p>Your name</p><form></form><input></form><p>Two of two.</p></article>", "One of two.\n\nTwo of two."),
    ("<article><p>One of two.</p><div hidden><div>no</div><p>no</p></div><p hidden>no<p>Two of two.</p><div style='display: none'>never closed", "One of two.\n\nTwo of two."),
    ("<article><p>Text of it.</p><div class='related-posts'><p>Another story that you may like to read.</p></div><div class='entry-comments'><p>I have read all of it, thank you.</p></div></article>", "Text of it."),
])
def test_names_weigh_but_do_not_decide(page, want):
    assert html_main.main_text(page) == want


def test_large_and_deep_pages_take_time_in_proportion():
    n = 50_000
    pages = {
        "flat": "<article>" + "".join(f"<p>some words {i} of it" for i in range(n)), "deep": "<article>" + "<div>" * n + "<p>In the depth of it.</p>" + "</div>" * n, "inline": "<article><p>In the depth of it." + "<b>" * n + "</i>" * n,
        "forum": "<article>" + "".join(f"<div class='post'><div class='author'><a>u{i}</a></div><p>short text {i}</p></div>" for i in range(n // 2)), "tags": "<article><p>In the depth of it.</p>" + "<a " * n,
    }
    began = time.process_time()
    texts = {k: html_main.main_text(p) for k, p in pages.items()}
    assert time.process_time() - began < 15
    assert texts["flat"].count("\n\n") == n - 1 and texts["deep"] == texts["inline"] == "In the depth of it." and f"short text {n // 2 - 1}" in texts["forum"] and texts["tags"].startswith("In the depth")


@pytest.mark.parametrize("part", [
    '<ol class="commentlist"><li>Nice words about all of this, thank you.</li></ol>', '<div role="complementary"><p>Other things that you may like to read today.</p></div>', '<div class="adsbygoogle">Buy this now, it is good.</div>',
    '<div id="sideBar2"><p>See also this and that and more of it.</p></div>', '<div class="site-header"><p>The best site of them all, every day.</p></div>', '<p hidden>Not to be seen by any reader of it.</p>',
    '<select><option>one of these<option>another of these</select>', '<style>p { content: "no words here at all" }</style>', '<noscript>Please turn on the scripts of your browser.</noscript>', '<!-- a comment with quite a few words in it -->',
])
def test_parts_that_are_no_article(part):
    page = f"<body>{part}<div class='site-content'><h1>Head</h1><p>First words of the text itself.</p>{part}<p>Last words of the text itself.</p></div>{part}</body>"
    assert html_main.main_text(page) == "Head\n\nFirst words of the text itself.\n\nLast words of the text itself."


@settings(max_examples=250, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9), st.data())
def test_minimum_cut_is_minimal(excess, data):
    n = len(excess)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 6)).filter(lambda e: e[0] != e[1]), max_size=20))
    cost = lambda side: sum(max(0, x) for x, s in zip(excess, side) if not s) + sum(max(0, -x) for x, s in zip(excess, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])
    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html_main.minimum_cut(excess, edges)) == pytest.approx(best, abs=1e-6)


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = html_main.extract_main_text(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, len(html_main.main_text(ARTICLE))]
    assert html_main.extract_main_text(pages.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/pdiv&;#x\"'= -!ab", max_size=60))
def test_any_markup_is_read(page):
    text = html_main.main_text(page)
    assert text == "\n\n".join(" ".join(b.split()) for b in text.split("\n\n")) and html.unescape("") == ""


# --- op7 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.tokenizer_file())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aab  \n'sthe", max_size=80), st.sampled_from(["<|endoftext|>", "x<|endoftext|>y", "<|endof", LONG[:5000], "a" * 3000])), max_size=6))
def test_bpe_equals_the_library(tokenizer, vocabulary, texts):
    ids, sizes = bpe.Encoder(vocabulary).encode(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == want
    for own in want:
        assert bpe.decode_ids(np.array(own, np.int64), vocabulary) == tokenizer.decode(own, skip_special_tokens=False)


def test_many_places_and_single_places_give_the_same(vocabulary, monkeypatch):
    pieces = [f" {a}{b}{c}".encode() for a in ("the", "in", "er", "tion") for b in ("re", "an", "on", "") for c in ("ing", "ed", "s", "tion")] * 3
    at_once = [x.tolist() for x in bpe.merge_pieces(pieces, vocabulary)]
    monkeypatch.setattr(bpe, "_MANY", 1 << 30)
    assert at_once == [x.tolist() for x in bpe.merge_pieces(pieces, vocabulary)]


def test_a_small_memory_changes_nothing(vocabulary):
    small, large = bpe.Encoder(vocabulary, remember=0), bpe.Encoder(vocabulary)
    for texts in (["one two"], ["two three", "one"], [], [""]):
        assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in large.encode(texts)]


def test_bpe_rows(docs, empty, tokenizer):
    got = bpe.round_trip(docs, bpe.tokenizer_file()).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            text = TEXTS[r["doc_id"]] or ""
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty, bpe.tokenizer_file()).count() == 0
    apart = bpe.decode_documents(bpe.encode_documents(docs, bpe.tokenizer_file()), bpe.tokenizer_file())
    assert sorted(r["decoded"] for r in apart.collect()) == sorted([t or "" for t in TEXTS] + ["Two words", "a"])


# --- op8 -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|>/s[]INST\\-n im_endar\n", max_size=40), st.one_of(st.none(), st.text(alphabet="user\n\\<|>", max_size=8)))
def test_a_turn_is_read_back(text, role):
    segment, start, end, _ = chat.format_turn(role, [{"kind": "text", "text": text}], chat.PartVisitor())
    assert chat.read_turn(segment) == (role or "", text)
    assert chat.unescape(segment[start:end]) == text
    body = segment[start:end]
    assert not any(c in body for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see "}, {"kind": "image", "ref": "a.png", "width": 56, "height": 29}, None, {"kind": "audio", "ref": "b", "seconds": 2.0}, {"kind": "document", "ref": "c", "pages": 3}, {"text": None}]
    segment, start, end, attachments = chat.format_turn("user", parts, chat.PartVisitor())
    assert segment[start:end] == "see <|image_1|><|audio_2|><|document_3|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("image", "a.png", 4), ("audio", "b", 50), ("document", "c", 3072)]
    with pytest.raises(ValueError, match="unknown kind"):
        chat.format_turn("user", [{"kind": "video"}], chat.PartVisitor())


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "<s>"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    all_turns = chat.with_probe(turns)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(all_turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["turns_sha256"] == sha("assistant\n<s>\n\n\n") and got[2]["loss_chars"] == 3
    assert (got[3]["n_turns"], got[3]["loss_sha256"]) == (2, sha("xx")) and got[None]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == sha("</s>[INST] ok [/INST]")
    assert chat.read_back(chat.format_conversations(turns.where("false").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).count() == 0


# --- op9 -----------------------------------------------------------------------------------------


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (lower_az(m[1]), m[2]) if m else ("", "")


def plain_site(host):
    """(site, domain, suffix) with suffixes of two labels."""
    site = host.rsplit("@", 1)[-1]
    site = re.sub(r":[0-9]*\Z", "", site)
    site = (site[1:-1] if site[:1] == "[" and site[-1:] == "]" else site).rstrip(".")
    if ":" in site or re.fullmatch(r"[0-9]+(\.[0-9]+){3}", site):
        return site, site, "ip"
    parts = site.split(".")
    k = 2 if len(parts) >= 2 and ".".join(parts[-2:]) in urls.SUFFIXES else 1
    return site, ".".join(parts[-k - 1 :]), ".".join(parts[-k:])


def brute_verdicts(pages, outcomes):
    """Verdict of each url without rules: counts by site, domain and suffix, level by level."""
    labels = {i: (n, g) for i, n, g in outcomes}
    counts = {}
    for i, u in pages:
        n, g = labels.get(i, (0, 0)) if i is not None else (0, 0)
        key = plain_site(plain_url(u)[0])
        counts[key] = tuple(map(sum, zip(counts.get(key, (0, 0)), (n, g))))

    def level(groups):  # key -> n, good, prior mean
        seen = [(n, g / n, min(max(m, 0.001), 0.999)) for n, g, m in groups.values() if n]
        k, total = len(seen), sum(n for n, _, _ in seen)
        chi = sum(n * (r - m) ** 2 / (m * (1 - m)) for n, r, m in seen)
        room = total - sum(n * n for n, _, _ in seen) / total - (k - 1) if total else 0
        rho = max((chi - (k - 1)) / room, 1e-4) if room > 0 else 1e-4
        strength = min(max(1 / rho - 1, urls.MIN_STRENGTH), urls.MAX_STRENGTH)
        return {key: (strength * min(max(m, 0.001), 0.999) + g, strength * (1 - min(max(m, 0.001), 0.999)) + n - g) for key, (n, g, m) in groups.items()}

    def summed(key_of):
        out = {}
        for key, c in counts.items():
            out[key_of(key)] = tuple(map(sum, zip(out.get(key_of(key), (0, 0)), c)))
        return out

    n, g = (sum(c[x] for c in counts.values()) for x in (0, 1))
    by_suffix = level({k: (*c, (g + 1) / (n + 2)) for k, c in summed(lambda x: x[2]).items()})
    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    by_domain = level({k: (*c, mean(by_suffix[k[1]])) for k, c in summed(lambda x: x[1:]).items()})
    by_site = level({k: (*c, mean(by_domain[k[1:]])) for k, c in counts.items()})
    upper = {k: mean((a, b)) + urls.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) for k, (a, b) in by_site.items()}
    return {u: "block" if upper[plain_site(plain_url(u)[0])] < urls.LEAST_RATE else "allow" for _, u in pages}


URLS = [None, "", "no scheme", "http://A.example.org/en/1?x", "http://example.org/es/", "http://org", "https://x.org/", "http://b.com/de/1", "http://c.com/fr#f", "http://c.com/fr/a", "ftp://h://x", "http://notexample.org/en/1", "http://co.uk/a", "http://q.example.org/en/19", "http://me:pw@Bad.net:8080/", "http://10.0.0.1/x", "http://10.0.0.2:80/x", "http://[::1]:80/", "http://bad.net./", "http://a.b.co.uk/", "http://bad.net\n/x"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_urls(spark, seed):
    random = np.random.default_rng(seed)
    hosts = ["bad.net", "a.bad.net", "b.bad.net", "good.net", "x.good.net", "one.co.uk", "two.co.uk", "a.one.co.uk", "10.0.0.1", "10.0.0.1:99", "u@good.net", "z.museum"]
    pages = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://bad.net/")] + [(100 + i, f"http://{random.choice(hosts)}/{i}") for i in range(300)]
    bad = lambda u: "bad" in (u or "") or "10.0" in (u or "")
    outcomes = [(i, 1 + int(random.integers(0, 3)), 0) if bad(u) and random.random() < 0.9 else (i, 2, 2) for i, u in pages if i is not None and i != 3 and random.random() < 0.6]
    marked = spark.createDataFrame(outcomes, "page_id long, n long, good long")
    frame = spark.createDataFrame([(*r, 1, 2) for r in pages], "page_id long, url string, site int, n int")
    by_method = brute_verdicts(pages, outcomes)
    assert {by_method[u] for _, u in pages if "bad.net/" in (u or "")} == {"block"} and "allow" in by_method.values()
    got = urls.judge_urls(frame, marked).collect()
    assert len(got) == len(pages)
    want = Counter()
    for i, u in pages:
        host, path = plain_url(u)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else by_method[u]] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert urls.judge_urls(frame.where("false"), marked).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(frame, marked.where("false")).where("rule IS NULL").collect()} == {"allow"}


def test_of_equally_long_rules_the_last_one_counts(spark):
    pages = spark.createDataFrame([(None, "http://a.b/cd")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, n long, good long")
    rules = [("a.b", "/cd", "block"), ("a.b", "/c", "allow"), ("b", "/cd", "allow"), ("a.b", "/cd", "allow")]
    assert tuple(urls.judge_urls(pages, none, rules=rules).select("rule", "verdict").first()) == ("a.b/cd", "allow")
    assert tuple(urls.judge_urls(pages, none, rules=rules[::-1]).select("rule", "verdict").first()) == ("a.b/cd", "block")


def test_public_suffixes_of_the_caller(spark):
    sites = ["a.b.c.ck", "www.ck", "x.www.ck", "ck", "p.q.kobe.jp", "city.kobe.jp", "u.city.kobe.jp", "a.com", "1.2.3.4"]
    listed = ("*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp")
    from pyspark.sql import functions as F

    domain, suffix = urls.registered_domain(F.col("s"), listed)
    got = {r["s"]: (r["d"], r["x"]) for r in spark.createDataFrame([(s,) for s in sites], "s string").select("s", domain.alias("d"), suffix.alias("x")).collect()}
    assert got == {
        "a.b.c.ck": ("b.c.ck", "c.ck"), "www.ck": ("www.ck", "ck"), "x.www.ck": ("www.ck", "ck"), "ck": ("ck", "ck"), "p.q.kobe.jp": ("p.q.kobe.jp", "q.kobe.jp"),
        "city.kobe.jp": ("city.kobe.jp", "kobe.jp"), "u.city.kobe.jp": ("city.kobe.jp", "kobe.jp"), "a.com": ("a.com", "com"), "1.2.3.4": ("1.2.3.4", "ip"),
    }


def test_reputation_shrinks_to_the_domain(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.good.net/") for i in range(40)] + [(100 + i, f"http://h{i % 4}.bad.net/") for i in range(40)] + [(900, "http://new.bad.net/"), (901, "http://new.good.net/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)], "page_id long, n long, good long")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, outcomes, rules=()).collect()}
    assert got[900]["reputation"] < 0.2 < 0.8 < got[901]["reputation"]
    assert (got[100]["verdict"], got[0]["verdict"], got[901]["verdict"]) == ("block", "allow", "allow")


# --- op10 ----------------------------------------------------------------------------------------


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), d if not sets[i] else least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, n_base=12):
    random = np.random.default_rng(seed)
    rows = []
    for b in range(n_base):
        base = [f"k{int(x)}" for x in random.integers(0, 40, int(random.integers(1, 120)))]
        for _ in range(int(random.integers(1, 14))):
            copy = list(base)
            for _ in range(int(random.integers(0, 5))):
                copy[int(random.integers(0, len(copy)))] = f"k{int(random.integers(0, 60))}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE"), (None, "one"), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 60, 3), (1, 90, 4)])
def test_jaccard_equals_brute_force(spark, n, percent, seed):
    rows = near_copies(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, percent)


def one_large_group(seed):
    """Copies of one text that differ more and more, a chain of texts, and a phrase in every text."""
    random = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for at in random.integers(0, 60, int(random.integers(0, 4))):
            copy[at] = f"x{int(random.integers(0, 9))}"
        rows.append((len(rows), " ".join(copy)))
    for i in range(40):
        rows.append((len(rows), " ".join(f"c{j}" for j in range(i, i + 50))))
    rows += [(len(rows) + i, " ".join(["all", "rights", "reserved", "by", "law", f"y{i}", f"z{i % 7}"])) for i in range(60)] + [(1000, rows[3][1]), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize(("n", "percent", "slots", "hot", "compared"), [(3, 90, (8, 100, 2000), 5000, 2000), (3, 90, (64, 30, 500), 20, 2000), (1, 80, (3, 200, 100_000), 5, 3), (5, 80, (64, 1, 1), 1, 0), (2, 70, (64, 30_000, 4_000_000), 2, 1)])
def test_groups_in_slots_give_the_same(spark, monkeypatch, n, percent, slots, hot, compared):
    import functools

    monkeypatch.setattr(jaccard, "tie_candidates", functools.partial(jaccard.tie_candidates, most=compared))
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 2)
    rows = one_large_group(n) + [(2000 + (i or 0), t) for i, t in near_copies(7)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent, deal=jaccard.Slots(*slots), hot_texts=hot)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_components(rows, n, percent)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=12).map(sorted), min_size=2, max_size=10, unique_by=tuple), st.sampled_from([50, 80, 90]), st.data())
def test_look_up_finds_what_connects_labels(sets, percent, data):
    k = data.draw(st.integers(1, len(sets) - 1))
    labels = [int(x) for x in data.draw(st.lists(st.integers(0, 4), min_size=len(sets), max_size=len(sets)))]
    found = jaccard.look_up(*[[np.array(s, np.uint64) for s in part] for part in (sets[:k], sets[k:])], labels, percent)
    one, two = jaccard.Union(5), jaccard.Union(5)
    for a, b in found:
        one.join(a, b)
    for i in range(k):
        for j in range(k, len(sets)):
            if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j])):
                two.join(labels[i], labels[j])
    assert [one.find(x) for x in range(5)] == [two.find(x) for x in range(5)]


def test_frequent_ngrams_in_the_order_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", 2)
    test_jaccard_equals_brute_force(spark, 3, 90, 1)


def test_jaccard_rows(docs, empty):
    assert jaccard.jaccard_components(docs).count() == docs.count()
    assert jaccard.jaccard_components(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=12).map(sorted), min_size=1, max_size=9, unique_by=tuple), st.sampled_from([50, 80, 90]))
def test_prefix_tree_equals_all_pairs(sets, percent):
    union = jaccard.join_sets([np.array(s, np.uint64) for s in sets], percent)
    plain = jaccard.Union(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)):
                plain.join(i, j)
    assert [union.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 1 << 62), min_size=1, max_size=80), st.data(), st.sampled_from([80, 90]))
def test_sketch_never_parts_similar_sets(a, data, percent):
    b = set(a) - set(data.draw(st.lists(st.sampled_from(sorted(a)), max_size=6))) | set(data.draw(st.lists(st.integers(0, 1 << 62), max_size=6)))
    if not b or 100 * len(a & b) < percent * len(a | b):
        return
    sketch = lambda s: int.from_bytes(jaccard.parity_sketch(np.array(sorted(s), np.uint64), percent), "little")
    assert jaccard.may_link(len(a), sketch(a), len(b), sketch(b), percent)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges or [(None, None)], "a long, b long")).collect()}
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_a_long_chain_is_one_component(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 201


# --- registry and pipeline -----------------------------------------------------------------------


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_of_nulls_and_nothing(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, predicted string, n_hit int"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "some words", None, None, None, "x", 1), (None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, "x", 1), (1, "", "en", "s", 0, "x", 1), (2, "word " * 30_000, "en", "s", 5, "x", 1)]
    for given_, n in ((spark.createDataFrame(rows, kind), 4), (spark.createDataFrame([], kind), 0)):
        docs = given_
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == corpus_pipeline.COLUMNS
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == n


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(150)
    passage = " ".join(f"p{i}" for i in range(30))
    good = [r for r in rows if r[0] % 3]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(good[:10])] + [(2000, passage), (2001, f"{good[0][1]} extra"), (good[3][0], good[3][1]), (3000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS predicted").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    judged = {r["doc_id"]: r["predicted"] for r in quality.classify(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    kept = list(dict.fromkeys(r for r in rows if judged[r[0]] == 1))
    survivors = {d for d, _, c in brute_components(kept, 5, 80) if d == c}
    assert got == {d for d, t in kept if d in survivors and not brute_hits(t, [(1, passage)])[1]}
    assert 2000 not in got and not got & set(range(1000, 1010))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
