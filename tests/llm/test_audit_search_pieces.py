"""Filter audit, ranked search and SentencePiece ids against brute force, SQL and the library."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quantweave.llm import audit, lexical, pieces, queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not SF.is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, str(SF))
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


# --- filter audit ---------------------------------------------------------------------------


def _audited(docs, labels):
    def fails(row, x):
        i, text, _ = row
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if x == "E":
            return i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
        }[x]

    out, total = {}, Counter()
    for o in map("".join, permutations("ABCDE")):
        left = {s or "": [r for r in docs if (r[2] or "") == (s or "")] for _, _, s in docs}
        start = {s: list(rows) for s, rows in left.items()}
        for step, x in enumerate(o, 1):
            for s, rows in left.items():
                gone = [r for r in rows if fails(r, x)]
                again = [r for r in start[s] if fails(r, x) and r not in rows]
                alone = [r for r in start[s] if [y for y in "ABCDE" if fails(r, y)] == [x]]
                left[s] = [r for r in rows if not fails(r, x)]
                lost = [sum(any(k is not None and k == r[0] and lab[i] == 1 for k, *lab in labels) for r in gone) for i in (0, 1)]
                out[s, o, step] = [len(left[s]), len(gone), len(again), len(alone), *lost]
                total[s, x] += len(gone)
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_counts_as_filters_applied_one_by_one(spark):
    rng = random.Random(5)
    texts = [None, "", "A", "a b a a a", "x# y", "Many Words Here " * 70, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "é" * 300]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["s", "t", None])) for i in range(40)]
    docs = list(dict.fromkeys(docs))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1)]
    got = audit.audit(spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n int, mask string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())) == _audited(docs, labels)


def test_audit_counts_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "same", "s"), (1, "same", "s"), (2, "same", "s"), (1, "other", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (first.kept, first.removed) == (3, 1)


def test_audit_of_nothing_and_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.audit(no_docs, labels).count() == 0
    assert audit.audit(odd_docs, labels.limit(0)).groupBy("part").count().orderBy("part").collect()[0]["count"] == 600


# --- ranked search --------------------------------------------------------------------------


def _ranked(docs, items, k):
    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    held = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (i, c, size) in enumerate(held):
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        out += [(item, r, None if lacks else i, -s) for r, (s, lacks, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def many_docs():
    rng = random.Random(11)
    words = [f"t{i}" for i in range(60)]
    texts = [" ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 40))) for _ in range(700)]
    docs = [(rng.choice([i, i, i, None, 3]), t) for i, t in enumerate(texts)] + [(10_000 + i, texts[0]) for i in range(200)]
    items = [(i, ", ".join(rng.sample(words, rng.randint(0, 12)))) for i in range(25)] + [(3, None), (None, "T1 t59-T40"), (3, "nowhere"), (7, "É")]
    return [*docs, (-5, "É É t1"), (None, None)], items


def test_search_ranks_as_brute_force(spark, many_docs):
    docs, items = many_docs
    frame = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id long, text string, score double, n int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(frame, asked)
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items, 10)


def test_search_takes_queries_in_blocks(spark, many_docs, monkeypatch):
    docs, items = many_docs
    monkeypatch.setattr(lexical, "QUERIES", 7)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items, 3)


@pytest.mark.parametrize("short", [1, 8, 10_000])
def test_walk_skips_and_still_finds_the_best(short):
    rng = np.random.default_rng(2)
    size, vocabulary = 3000, 30
    lists = [np.flatnonzero(rng.random(size) < 1 / (1 + t)) for t in range(vocabulary)]
    terms, docs = np.repeat(np.arange(vocabulary), [len(x) for x in lists]), np.concatenate(lists)
    gain = rng.integers(0, 50, len(docs)) * (1 + terms) ** 2
    block = lexical.Postings(size, terms, docs, gain, vocabulary)
    ids, lacks = rng.permutation(size).astype(np.int64), np.zeros(size, bool)
    for query in (np.arange(vocabulary), np.array([0, 29]), np.array([], int), np.array([3])):
        totals = np.bincount(docs[np.isin(terms, query)], gain[np.isin(terms, query)], size).astype(np.int64)
        best = lexical.Best(10)
        scored = lexical.rank(block, ids, lacks, query, best, short=short, step=64)
        want = [(s, i) for s, i in sorted(zip(-totals, ids, strict=True)) if s < 0][:10]
        assert list(zip(-best.scores, best.ids, strict=True)) == want
        if len(query) == vocabulary and short == 10_000:
            assert scored < size / 2


def test_gains_stay_exact_beyond_64_bits():
    got = lexical.gains(np.array([7]), np.array([0]), np.array([3]), np.array([10**8]), 10**11, 5 * 10**13)
    m = 10 + (90 * 10**8 * 10**11) // (5 * 10**13)
    assert got.tolist() == [7 * (3 * 10**9 // (3000 + 8 * m))]


def test_search_of_nothing_and_of_odd_rows(spark, odd_docs, no_docs):
    asked = spark.createDataFrame([(1, "the mat"), (2, "one")], "item_id long, text string")
    assert lexical.search(no_docs, asked).count() == 0
    assert lexical.search(odd_docs, asked.limit(0)).count() == 0
    found = lexical.search(odd_docs, asked).where("item_id = 2").orderBy("rank").collect()
    assert [r.doc_id for r in found] == [3, 4]


# --- SentencePiece ids ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.piece_path())


def _odd_texts():
    rng = random.Random(3)
    parts = ["a", "b", "e", "n", "t", "h", " ", "  ", "▁", "\n", "\t", "\0", "é", "日本", "😀", "\u0301", "in", "the", "ing", "0", "<s>", "<0x0A>", "İ", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(20, 60))) for _ in range(300)]
    return [*texts, "", " ", "x" * 20_000, " " * 300, "ab" * 5000, "the end of it\n" * 3000]


def test_ids_and_texts_are_the_librarys(library):
    texts, coder = _odd_texts(), pieces.pieces(pieces.piece_path())
    ids, bounds = coder.encode(pa.array(texts))
    data, cut = coder.decode(ids, bounds)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert [data[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)] == library.decode(want)


def test_any_ids_decode_as_in_the_library(library):
    rng, coder = random.Random(4), pieces.pieces(pieces.piece_path())
    lists = [[rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(200, 258), 28705, rng.randint(259, 31999)]) for _ in range(rng.randint(0, 8))] for _ in range(1500)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    data, cut = coder.decode(np.array([i for x in lists for i in x]), bounds)
    assert [data[a:b].decode() for a, b in zip(cut, cut[1:], strict=False)] == [library.decode(x) for x in lists]


def test_neighbours_decide_as_merging_does():
    """Random small vocabularies, equal ranks included: the table's tokens are those of merging pair by pair."""
    rng = random.Random(6)
    for _ in range(150):
        letters = "abc"[: rng.randint(1, 3)]
        names = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 12))}
        rank = {p: float(rng.randint(1, 6)) for p in names} | {c: 0.0 for c in letters}
        ids = {p: i for i, p in enumerate(rank)}
        table = pieces.Table(rank, ids)
        for _ in range(20):
            now = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
            text = "".join(now)
            while len(now) > 1:
                best, at = min((rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False)))
                if best == math.inf:
                    break
                now[at : at + 2] = [now[at] + now[at + 1]]
            assert table.tokens(text) == [ids[p] for p in now]


def test_encode_decode_and_digests_agree(spark, odd_docs, no_docs, library):
    coded = pieces.encode(odd_docs)
    back = pieces.decode(coded)
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True)) for r in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in coded.collect()), key=str) == want
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, library.decode(x)) for i, x in want), key=str)
    digest = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for i, x in want), key=str)
    assert sorted(map(tuple, pieces.round_trip(odd_docs).collect()), key=str) == digest
    assert pieces.round_trip(no_docs).count() == pieces.encode(no_docs).count() == pieces.decode(pieces.encode(no_docs)).count() == 0
    empty = pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert [r.text for r in empty] == ["", ""]
