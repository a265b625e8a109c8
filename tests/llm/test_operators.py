"""Each operator on odd rows and on an empty table, and against brute force."""

import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantweave.llm import components, decontaminate, extract, langid, maxent, nearjoin, neighbours, packing, sharding, signature_tree, tokenfiles, toxicity
from quantweave.llm.shared import shared_dir

from .test_text import plain


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- packing, token files, sharding -----------------------------------------------------------


def test_pack_is_whole_and_gapless(odd_docs, no_docs, library):
    got = rows(packing.pack(odd_docs, length=64))
    spots = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    at = 0
    for start, n in spots:
        assert start == at and n > 0 and start // 64 == (start + n - 1) // 64
        at += n
    want = Counter()
    for d in odd_docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        want[(d.doc_id, len(ids))] += len(ids)
    have = Counter()
    for r in got:
        have[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert want == have
    blank = [r for r in got if r["doc_id"] in (0, 1, 2)]
    assert len(blank) == 3 and all(r["ids_crc32"] == crc([1]) for r in blank)
    assert packing.pack(no_docs).count() == 0


def test_token_files_round_trip(odd_docs, no_docs, library, spark):
    uri = shared_dir(spark)
    tokenfiles.write(odd_docs, uri)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows(tokenfiles.digests(tokenfiles.read(tokenfiles.lookup(odd_docs.select("doc_id"), uri), uri))))
    want = Counter()
    for d in odd_docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        want[(d.doc_id, len(ids), crc(ids))] += 1
    assert got == want
    unknown = spark.createDataFrame([(x,) for x in range(10**6, 10**6 + 200)], "doc_id long")
    assert tokenfiles.lookup(unknown, uri).count() == 0
    assert tokenfiles.round_trip(no_docs, spark).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    slots = tokenfiles.Slots(tokenfiles.build_hash(keys))
    assert sorted(slots.of(keys)) == list(range(len(keys)))
    assert len(tokenfiles.Slots(tokenfiles.build_hash(keys[:0])).of(keys[:3])) == 3


def test_shards_follow_the_key(odd_docs, no_docs, spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = rows(sharding.shard(many))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    moved = sum(r["grown_shard"] == 24 for r in got)
    assert 640 < moved < 960
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) < 1.35 * min(counts.values())
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    odd = rows(sharding.shard(odd_docs))
    assert len(odd) == odd_docs.count()
    assert {(r["size"], r["text_crc32"]) for r in odd if r["doc_id"] == 0} == {(8, 0)}
    assert sharding.shard(no_docs).count() == 0


def test_a_weight_moves_rows_only_into_its_shard(spark):
    keys = spark.range(4000)
    old = sharding.layout(12)
    new = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in old]
    both = keys.select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect()
    assert all(r.b in (r.a, 5) for r in both) and any(r.a != 5 == r.b for r in both)


def test_movement_is_confined_to_changed_subtrees(spark):
    keys = spark.range(30000)
    old = sharding.layout(24)
    place = {x.shard: (x.region, x.rack) for x in old}

    def moves(**weights):
        new = [sharding.Leaf(x.region, x.rack, x.shard, weights.get(f"s{x.shard}", x.weight)) for x in old]
        both = keys.select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).where("a <> b").collect()
        return [(r.a, r.b) for r in both]

    same_rack = [s for s in place if place[s] == place[0]]
    shifted = moves(**{f"s{same_rack[0]}": 0.5, f"s{same_rack[1]}": 1.5})
    assert shifted and all({a, b} <= set(same_rack) for a, b in shifted)
    same_region = next(s for s in place if place[s][0] == place[0][0] and place[s][1] != place[0][1])
    racks = moves(s0=0.5, **{f"s{same_region}": 1.5})
    assert racks and all(place[a][0] == place[b][0] == place[0][0] for a, b in racks)
    grown = moves(s0=3.0)
    # across regions only into the one that grew, within it only into the rack that grew
    assert all(place[b][0] == place[0][0] for a, b in grown)
    assert all(place[b] == place[0] for a, b in grown if place[a][0] == place[b][0])
    assert all(b == 0 for a, b in grown if place[a] == place[b])


def test_shares_are_those_of_the_weights(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 2.0), sharding.Leaf(0, 1, 2, 3.0), sharding.Leaf(1, 0, 3, 6.0)]
    counts = {r.s: r["count"] for r in spark.range(24000).select(sharding.place(F.col("id"), tree).alias("s")).groupBy("s").count().collect()}
    for x in tree:
        assert counts[x.shard] == pytest.approx(2000 * x.weight, rel=0.08)


def test_the_tree_decides_and_growth_only_adds(spark):
    keys = spark.range(5000)
    flat = [sharding.Leaf(s, 0, s) for s in range(24)]
    both = keys.select(sharding.place(F.col("id"), flat).alias("a"), sharding.place(F.col("id"), sharding.layout(24)).alias("b")).collect()
    assert sum(r.a != r.b for r in both) > 2500
    assert sharding.grown(sharding.layout(24)) == sharding.layout(25) and sharding.grown(sharding.layout(25)) == sharding.layout(26)
    for n in (5, 23, 24):
        grown = keys.select(sharding.place(F.col("id"), sharding.layout(n)).alias("a"), sharding.place(F.col("id"), sharding.grown(sharding.layout(n))).alias("b")).collect()
        assert all(r.b in (r.a, n) for r in grown) and any(r.b == n for r in grown)


# --- joins -----------------------------------------------------------------------------------


def brute_components(texts, k, least):
    sets = {}
    for d, t in texts:
        w = plain(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common * least.denominator >= least.numerator * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(seed, docs=160, bases=12):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, rng.integers(3, 150))) for _ in range(bases)]
    passage = list(rng.choice(vocab, 60))
    out = []
    for d in range(docs):
        w = list(base[int(rng.integers(bases))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if rng.random() < 0.2:
            w = w + passage
        out.append((d, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,block", [(1, 1 << 21), (2, 400)])
def test_link_components_is_brute_force(spark, seed, block):
    texts = near_copies(seed)
    least = Fraction(85, 100)
    got = rows(nearjoin.link_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, least, block))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 4, least)


def test_crowded_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "HOT", 5)
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 60, 5)]
    texts = [(i, t) for i, t in enumerate(["same text of some words"] * 20 + near + [" ".join(base)] + ["other words here now", None, ""])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(nearjoin.link_components(df))}
    assert got == brute_components(texts, 4, Fraction(85, 100))


def test_link_components_of_odd_rows(odd_docs, no_docs):
    got = rows(nearjoin.link_components(odd_docs))
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (0, 1, 2))
    assert by[6]["component_id"] == by[5]["component_id"] == by[7]["component_id"] == 5
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == 1 and by[4]["component_id"] == 4
    assert by[None]["component_id"] is None
    assert nearjoin.link_components(no_docs).count() == 0


def test_prefix_keys_never_lose_a_pair():
    rng = np.random.default_rng(5)
    least = Fraction(85, 100)
    rank = rng.integers(0, 5, nearjoin.COUNTERS).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(rng.integers(0, max(1, n // 7) + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not signature_tree.similar(signature_tree.overlap(a, b), len(a), len(b), least):
            continue
        keys = [set(nearjoin.prefix_keys(x, rank, least).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
        assert nearjoin.overlap_bound(nearjoin.bitmap(a), nearjoin.bitmap(b), len(a), len(b)) >= signature_tree.overlap(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (2000, 1000)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 2000: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def test_decontamination(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(900)]
    item = lambda n: list(rng.choice(vocab, n))
    items = [item(int(n)) for n in (14, 20, 33, 59, 40, 3)]
    changed = list(items[3])
    changed[30] = "other"
    far = list(items[4])
    for i in range(0, 40, 4):
        far[i] = "other"
    docs = [(0, item(60)), (1, item(30) + items[0] + item(10)), (2, items[1]), (3, item(7) + changed + item(50)), (4, far), (5, [w.upper() for w in items[2]]), (6, item(9) + items[5] + item(9)), (7, items[3][:-4])]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "  ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontaminate.matches(table, bench))}
    assert set(got) == {(1, 0), (2, 1), (3, 3), (5, 2), (6, 5), (7, 3)}
    assert got[(1, 0)]["start"] == 30 and got[(1, 0)]["similarity"] == 1 and got[(1, 0)]["n_words"] == 14
    assert got[(3, 3)]["similarity"] == pytest.approx(50 / 60)
    assert decontaminate.matches(odd_docs, bench).count() == 0
    assert decontaminate.matches(no_docs, bench).count() == 0
    assert decontaminate.matches(table, bench.limit(0)).count() == 0


def test_near_copies_of_items_are_found(spark, monkeypatch):
    """Items with random words changed, down to a weighted similarity of 0.8, at random places of texts."""
    monkeypatch.setattr(decontaminate, "STRETCH", 11)
    rng = np.random.default_rng(31)
    vocab = [f"v{i}" for i in range(4000)]
    items = [list(rng.choice(vocab, int(n))) for n in rng.integers(25, 80, 60)]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    docs, planted = [], []
    for d in range(300):
        k = int(rng.integers(0, 60))
        changed = list(items[k])
        for at in rng.integers(0, len(changed), int(rng.integers(0, 3))):
            changed[int(at)] = "new" + str(d)
        a, b = bag(items[k]), bag(changed)
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            planted.append((d, k))
        docs.append((d, " ".join([*rng.choice(vocab, int(rng.integers(0, 90))), *changed, *rng.choice(vocab, int(rng.integers(0, 90)))])))
    found = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")))}
    assert len(planted) > 150
    assert len(found & set(planted)) >= 0.99 * len(planted)
    # whatever else is found holds a window that is similar, not just any text
    texts = dict(docs)
    for d, k in found - set(planted):
        w, n = texts[d].split(), len(items[k])
        a = bag(items[k])
        assert max(sum((a & (b := bag(w[i : i + n]))).values()) / sum((a | b).values()) for i in range(len(w) - n + 1)) >= 0.8


# --- search ---------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype("float32")
    x[100:160] = x[100]  # many copies
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (None, [1.0] * 16), (950, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in rows(neighbours.nearest(df, F.col("vec_id") % 50 == 0, points=150)):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len(set(best.tolist()) & {v for v, _ in got[q].values()})
        for v, score in got[q].values():
            assert score == pytest.approx(float(unit[v] @ unit[q]), abs=1e-12)
    assert hits / 60 >= 0.9
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    assert 950 not in got
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, F.col("vec_id") % 50 == 0).count() == 2


def _brute_nearest(data, queries, k=5):
    """Cosines in extended precision, whatever the size of the components."""
    v = {}
    for i, x in data:
        x = np.asarray(x, np.float64)
        x = (x / np.abs(x).max()).astype(np.longdouble)
        v.setdefault(i, []).append(x / np.sqrt((x * x).sum()))
    out = {}
    for q in queries:
        best = {i: max(float((a * b).sum()) for a in v[q] for b in v[i]) for i in v if i != q}
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 13), x[0]))[:k]
    return out


def test_nearest_of_repeated_and_huge_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    rng = np.random.default_rng(14)
    data = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((400, 12)) + 4 * rng.standard_normal((8, 12))[rng.integers(0, 8, 400)])]
    data += [(0, data[0][1])] * 3 + [(50, data[7][1]), (1000, (np.array(data[3][1]) * 1e200).tolist()), (1001, (np.array(data[3][1]) * 1e-200).tolist()), (1050, [1.0] * 12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in rows(neighbours.nearest(df, F.col("vec_id") % 50 == 0, points=30)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = _brute_nearest(data, [i for i in dict(data) if i % 50 == 0])
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert len({v for _, v, _ in mine}) == 5
        hits += len({v for v, _ in best} & {v for _, v, _ in mine})
    assert hits / (5 * len(want)) >= 0.9
    assert {3, 1001} <= {v for _, v, _ in got[1000]}


# --- pages ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div><aside>Side</aside><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text &lt;x&gt; a &#233;<p>Second<br>line<script>var t="</p>";</script><!-- c --></p><ul><li>one<li>two</ul>
<form><label>Name</label></form><div class="advert">Ad text</div><section class="comments"><p>Nice post</p></section></article><footer>&copy; me</footer></body></html>"""


def test_extract(spark):
    data = [(1, "http://a.example.com/1", PAGE), (2, "http://a.example.com/2", None), (3, None, ""), (4, "::bad", "plain text & more"), (5, "x", "<p>cut &am"), (6, "x", "<article><p>open <b>tag"), (1, "http://a.example.com/1", PAGE)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("kinds", F.lit("k"))
    got = rows(extract.extract(df))
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7
    assert text[1] == "Head & line\nFirst bold text <x> a é\nSecond line\none\ntwo"
    assert text[2] == text[3] == ""
    assert (text[4], text[5], text[6]) == ("plain text & more", "cut &am", "open tag")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract.extract(df.limit(0)).count() == 0


def test_host_boilerplate_without_an_article(spark):
    bar = "<div>Subscribe to our weekly letter and never miss any news again</div>"
    data = [(i, f"http://h.example.com/{i}", f"<body>{bar}<div>story number {i} tells of matter {i * 7} and ends with point {i * i}</div></body>") for i in range(6)]
    data.append((9, "http://other.example.com/9", f"<body>{bar}</body>"))
    got = {r["page_id"]: r["text"] for r in rows(extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert got[3] == "story number 3 tells of matter 21 and ends with point 9"
    assert got[9].startswith("Subscribe")


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body class="home no-sidebar"><p>A real text</p></body>', "A real text"),
        ('<article class="post comments-open"><p>A real text</p></article>', "A real text"),
        ('<html class="search"><body id="social"><main class="widget"><h1 class="notice">Head</h1><p>A text</p></main></body></html>', "Head\nA text"),
        ('<article><p>One</p><section id="discussion"><h2 id="related-work">Related work</h2><p>Two</p></section></article>', "One\nRelated work\nTwo"),
        ('<article><p>One</p><div id="comments"><p>Reader one says</p><p>Reader two says</p></div></article>', "One"),
        ('<article><p>One</p><ul class="comment-list"><li>First!</li></ul><div class="user-comments"><p>Second</p></div></article>', "One"),
        ('<article><p>One</p><div class="discussion"><p>I disagree</p><p>So do I</p></div><p>Two</p></article>', "One\nTwo"),
        ('<article><p>One</p><div class="discussion"><h2>Discussion</h2><p>The results agree</p></div></article>', "One\nDiscussion\nThe results agree"),
        ('<article><p>One</p><div class="notice">You have two free articles left</div><p>Two</p></article>', "One\nTwo"),
        ('<article><p>One <span class="ad">Buy <b>now</b></span> two</p><p>Three<span style="display: none">hidden</span> four</p></article>', "One two\nThree four"),
        ('<article><p>One</p></article><div class="post-comments"><p>Reader</p></div><article class="teaser"><p>Read on</p></article>', "One"),
        ('<article><p>One <span class="share">50 %</span> <em class="search">two</em></p></article>', "One 50 % two"),
        ('<div class="post-comments"><p>Reader</p></div><div><p>A text of its own</p></div>', "A text of its own"),
        ('<article><p>One</p><div class="related"><a href="/x">Other page</a></div><div class="comments"><p>Nice</p></div></article><div class="main-nav">Go</div>', "One"),
        ('<div class="sidebar">Side</div><div class="no-sidebar">A text</div>', "A text"),
    ],
)
def test_names_alone_drop_no_text(page, text):
    assert "\n".join(t for k, t in extract.blocks(page) if k < 2) == text


def _prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_repeated_text_of_articles(spark):
    rng = np.random.default_rng(5)
    notice, short, phrase = _prose(rng, 30), "Read more of us", _prose(rng, 8)
    own = [_prose(rng, 80) for _ in range(8)]
    page = lambda *parts: "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"
    data = [(i, f"http://h.example.com/{i}", page(f"{own[i]} {phrase} end{i}", f"tail{i} {notice}", short, *(["See also"] if i < 3 else []))) for i in range(8)]
    # near copies of one text, on a host with other pages
    base = _prose(rng, 200).split()
    data += [(20 + i, f"http://n.example.com/{i}", page(" ".join([*base[: 9 * i], f"new{i}", *base[9 * i + 1 :]]))) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in rows(extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")))}
    for i in range(8):
        assert got[i] == "\n".join([f"{own[i]} {phrase} end{i}", f"tail{i}", *(["See also"] if i < 3 else [])])
        assert got[20 + i].split() == [*base[: 9 * i], f"new{i}", *base[9 * i + 1 :]]


@pytest.mark.parametrize("seed", range(8))
def test_repeated_runs_are_brute_force(monkeypatch, seed):
    """Random token streams over few words, in two groups, against a loop over all windows; every page is a content."""
    monkeypatch.setattr(extract, "_contents", lambda words, left, starts: np.arange(len(starts), dtype=np.uint64))
    rng = np.random.default_rng(seed)
    shared = [list(rng.integers(0, 40, 30)) for _ in range(3)]
    pages, kinds, group = [], [], np.sort(rng.integers(0, 2, 40))
    for _ in group:
        blocks = []
        for _ in range(rng.integers(0, 4)):
            words = list(rng.integers(0, 4000, rng.integers(1, 40)))
            if rng.random() < 0.5:
                at, run = rng.integers(0, len(words) + 1), shared[rng.integers(0, 3)]
                words[at:at] = run[rng.integers(0, 6) :]
            blocks.append(" ".join(map(str, words)))
            kinds.append(int(rng.random() < 0.5))
        pages.append(blocks)
    got = extract.clean(pa.array(pages, pa.list_(pa.string())), np.array(kinds, np.uint8), group)
    kind = iter(kinds)
    windows, of, contents = {}, [], {0: set(), 1: set()}
    for p, blocks in enumerate(pages):
        of.append([next(kind) for _ in blocks])
        if blocks:
            contents[group[p]].add(p)
        for b in blocks:
            w = b.split(" ")
            for i in range(len(w) - extract.LONG + 1):
                windows.setdefault((group[p], tuple(w[i : i + extract.LONG])), set()).add(p)
    for p, blocks in enumerate(pages):
        want = []
        for b, k in zip(blocks, of[p]):
            w, total = b.split(" "), len(contents[group[p]])
            gone = set()
            for i in range(len(w) - extract.LONG + 1):
                n = len(windows[group[p], tuple(w[i : i + extract.LONG])])
                if n >= extract.CONTENTS and n >= total * (extract.ELSEWHERE if k else extract.IN_ARTICLE):
                    gone.update(range(i, i + extract.LONG))
            left = " ".join(x for i, x in enumerate(w) if i not in gone)
            want += [left] if left else []
        assert got[p] == "\n".join(want)


def test_a_large_host_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(extract, "PAGES", 20)
    rng = np.random.default_rng(6)
    notice = _prose(rng, 25)
    data = [(i, "http://www.big.example.com/x", f"<article><p>{_prose(rng, 40)}</p><p>{notice}</p></article>") for i in range(130)]
    got = rows(extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert len(got) == 130 and all(len(r["text"].split()) == 40 for r in got)


@pytest.mark.parametrize("pages", [4, 16, 512])
def test_how_a_host_is_dealt_changes_no_text(spark, monkeypatch, pages):
    """Runs about the least shares, with many copies and near copies, against the whole host in one piece."""
    rng = np.random.default_rng(11)
    runs = [_prose(rng, 20) for _ in range(12)]
    bodies = [_prose(rng, 30).split() for _ in range(60)]
    data = []
    for i in range(240):
        body = list(bodies[min(int(rng.integers(0, 120)), 59)])
        if i % 3:
            body[int(rng.integers(0, 30))] = f"near{i % 7}"
        own = [f"<p>{' '.join(body)}</p>"] + [f"<p>{r}</p>" for k, r in enumerate(runs) if rng.random() < (k + 1) / 40] + ["<p>Read more</p>"] * int(rng.random() < 0.52)
        data.append((i, f"http://{'h' if i % 12 else 'small'}.example.com/x", ("<article>" if i % 2 else "<body>") + "".join(own)))
    monkeypatch.setattr(extract, "PAGES", pages)
    got = {r["page_id"]: r["text"] for r in rows(extract.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)))}
    made = [[b for b in extract.blocks(h) if b[0] < 2] for _, _, h in data]
    group = np.array(["small" in u for _, u, _ in data], int)
    whole = extract.clean(pa.array([[t for _, t in m] for m in made], pa.list_(pa.string())), np.array([k for m in made for k, _ in m], np.uint8), group)
    assert [got[i] for i in range(240)] == whole
    assert sum(w != "\n".join(t for _, t in m) for w, m in zip(whole, made)) > 20


# --- models ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    plain_words = [a + b for a in "ka lo mi ra te su po ne".split() for b in "ba do fi gu la".split()]
    docs, labels = [], []
    for i in range(600):
        toxic = int(rng.random() < 0.25)
        w = list(rng.choice(plain_words, 60))
        if toxic:
            for at in rng.integers(0, 60, 3):
                w[int(at)] = "zorgle" + str(rng.choice(["", "s", "n", "mi"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled, odd_docs, no_docs, spark):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    got = rows(toxicity.score(docs, labels, F.col("doc_id") % 5 != 0))
    held = [r for r in got if r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    odd = rows(toxicity.score(odd_docs, labels, F.lit(True)))
    assert len(odd) == odd_docs.count()
    assert len({r["score"] for r in odd if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.score(no_docs, labels, F.lit(True)).count() == 0
    assert len(rows(toxicity.score(docs, labels.limit(0), F.lit(True)))) == docs.count()
    model = toxicity.fit(docs, labels)
    assert toxicity.keep_ordinary(odd_docs, model).columns == odd_docs.columns


def test_language_model_counts_and_normalisation(labelled, odd_docs, no_docs):
    docs, _ = labelled
    texts = {r.doc_id: plain(r.text) + [None] for r in docs.collect()}
    seen = Counter(w for d, ws in texts.items() if d % 7 for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = {r["doc_id"]: r for r in rows(maxent.score(docs, F.col("doc_id") % 7 != 0))}
    for d in (0, 7, 1, 2, 14, 77):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(texts[d]), sum(seen[w] > 0 for w in texts[d]), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in texts[d]))
    held = [d for d in got if d % 7 == 0]
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held) - 0.1 * sum(len(texts[d]) for d in held)
    odd = rows(maxent.score(odd_docs, F.coalesce(F.col("doc_id") != 3, F.lit(True))))
    assert len(odd) == odd_docs.count() and all(np.isfinite(r["score"]) for r in odd)
    assert {r["n_tokens"] for r in odd if r["doc_id"] in (0, 1, 2)} == {1}
    assert maxent.score(no_docs, F.lit(True)).count() == 0
    assert len(rows(maxent.score(odd_docs, F.lit(False)))) == odd_docs.count()


def test_probabilities_sum_to_one(labelled, spark):
    """Over all classes and over the slots of each by the trained softmaxes, and over the words of slot 0 and its symbol for words not met."""
    docs, _ = labelled
    letters = "bcdfghklmnprst"
    many = " ".join(a + b + c + "o" for a in letters for b in letters for c in letters)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, many)], "doc_id long, text string"))
    stored = maxent.count(docs)
    counts = maxent.summary(stored)
    keyed = docs.where("doc_id < 80").select(F.xxhash64("doc_id").alias("key"), "text")
    model = maxent.train(keyed, counts, 1)
    assert np.abs(model.weights).max() > 0 and np.abs(model.inner).max() > 0
    tokens = maxent.Tokens(maxent.Words(pa.array([r.text for r in docs.where("doc_id < 5").collect()])), counts)
    total = np.zeros(len(tokens.tail))
    for slot in range(maxent.SLOTS):
        tokens.slot = np.full(len(total), slot)
        total += 10 ** maxent._slot_scores(model, tokens)[tokens.tail]
    assert len(total) and total == pytest.approx(np.ones(len(total)), abs=1e-4)
    total = np.zeros(len(tokens.cls))
    for c in range(maxent.CLASSES):
        tokens.cls = np.full(len(total), c)
        total += 10 ** maxent._class_scores(model, tokens)
    assert total == pytest.approx(np.ones(len(total)), abs=1e-4)
    alone = np.concatenate([counts.head, counts.slotted]).view(np.int64).tolist()
    rest = stored.where("kind = 0").where(~F.col("word").isin(alone)).groupBy("tail_class").agg(F.sum(F.col("n") - maxent.DISCOUNT).alias("met")).collect()
    assert rest
    for r in rest:
        c = r.tail_class
        assert (r.met + maxent.DISCOUNT * counts.rest_v[c]) / counts.slot_n[c, 0] == pytest.approx(1)


def test_history_beats_the_base_on_held_out_texts(spark):
    """Texts whose next word mostly follows from the one before."""
    rng = np.random.default_rng(12)
    names = [a + b for a in "ka lo mi ra te su".split() for b in "ba do fi gu la".split()]
    after = rng.permutation(len(names))
    docs = []
    for d in range(420):
        at, words = int(rng.integers(0, len(names))), []
        for _ in range(60):
            words.append(names[at])
            at = int(after[at]) if rng.random() < 0.8 else int(rng.integers(0, len(names)))
        docs.append((d, " ".join(words)))
    got = rows(maxent.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 7 != 0))
    held = [r for r in got if r["doc_id"] % 7 == 0]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / tokens > 0.2


def test_language_identification(spark, odd_docs, no_docs):
    english, german = "the house and the garden with a tree and this was", "das haus und der garten mit einem baum und dies war nicht"
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.permutation((english if i % 2 else german).split())), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    page = lambda lang, text: f'<html lang="{lang}"><body><article><p>{text}</p></article></body></html>'
    data = [(i, f"http://{'a.example.com' if i % 2 else 'b.example.de'}/{i}", page("en-US" if i % 2 else "de", english if i % 2 else german)) for i in range(40)]
    data += [(100, "http://b.example.de/x", page("de", "12345")), (101, None, None), (102, "http://a.example.com/y", page("", "the tree"))]
    got = {r["page_id"]: r for r in rows(langid.identify_pages(spark.createDataFrame(data, "page_id long, url string, html string"), model))}
    assert all(got[i]["language"] == ("en" if i % 2 else "de") for i in range(40))
    assert got[100]["language"] == "de" and got[100]["text_language"] is None
    assert got[101]["language"] is None and got[101]["confidence"] == 0
    assert got[102]["language"] == "en" and got[102]["declared"] is None
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2})
    assert langid.keep_identified(no_docs, langid.fit(no_docs)).count() == 0


def test_short_texts_stay_and_gibberish_goes(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the house and a garden with this tree re. was", "de": "das haus und der garten mit de. einem baum nicht"}
    docs = [(i, " ".join(rng.permutation(words[lang].split() * 200)), lang, lang, 1) for i in range(200) for lang in [("en", "de")[i % 2]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    model = langid.fit(spark.createDataFrame(docs, schema))
    more = [(900, "Re.", None, "en", 1), (901, "A.", None, "en", 1), (902, "De.", None, "de", 1), (903, "das Haus!", None, None, 1), (904, "12 345.", None, "en", 1), (905, "qxq jzvk wqpx zzkj vvxq qkzj xxwv pqzx", None, "en", 1)]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(docs + more, schema), model).collect()}
    assert kept == {*range(200), 900, 901, 902, 903}


def test_every_label_is_a_language(spark):
    """More labels than are scored or counted at a time; each text goes to its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": " ".join(letters[(i + j) % 26] + letters[(i * 7 + j * 3) % 26] + letters[(i // 26 * 11 + j) % 26] for j in range(40)) for i in range(70)}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(words.items())] + [(None, None, "l00"), (1, "abc", None), (2, "", "l01")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == sorted(words)
    scores, _, _ = model.scores(pa.array(list(words.values())))
    assert scores.shape == (70, 70) and (scores.argmax(1) == np.arange(70)).all()
    # plain counting of one language's trigrams
    n = len("".join(words["l05"].split()))
    assert model.count[model.language == 5].sum() == n
    dense = np.hstack([model.logs(a) for a in range(0, 70, langid.TOGETHER)])
    assert np.allclose(np.exp(dense).sum(0), 1)


def test_the_smallest_id_is_an_id(spark):
    least = -(2**63)
    docs = spark.createDataFrame([(least, "one two"), (None, "three"), (None, "four five"), (0, "six"), (2**63 - 1, "seven")], "doc_id long, text string")
    uri = shared_dir(spark)
    tokenfiles.write(docs, uri)
    got = Counter(r["doc_id"] for r in rows(tokenfiles.lookup(docs.select("doc_id"), uri)))
    assert got == Counter({least: 1, None: 2, 0: 1, 2**63 - 1: 1})
    assert [r["doc_id"] for r in rows(tokenfiles.lookup(docs.select("doc_id").where("doc_id < 0"), uri))] == [least]
    starts = sorted((r["start"], r["n"]) for r in rows(tokenfiles.lookup(docs.select("doc_id"), uri)))
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(5)]


def test_a_lost_index_file_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string")
    uri = shared_dir(spark)
    tokenfiles.write(docs, uri)
    for p in Path(uri.removeprefix("file://")).glob("index-*.mph"):
        p.unlink()
    with pytest.raises(Exception, match="index-00000"):
        tokenfiles.lookup(docs.select("doc_id"), uri).collect()


def test_one_id_may_fill_several_shards(spark):
    docs = spark.createDataFrame([(7, f"text number {i}") for i in range(400)], "doc_id long, text string")
    uri, together = shared_dir(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, "false")  # else so little goes to one task
    try:
        tokenfiles.write(docs, uri)
    finally:
        spark.conf.unset(together)
    found = rows(tokenfiles.lookup(docs.select("doc_id"), uri))
    assert len(found) == 400 and len({r["shard"] for r in found}) > 1
    assert len({r["start"] for r in found}) == 400
