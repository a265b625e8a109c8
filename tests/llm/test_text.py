"""Words, shingles, token ids: against plain Python and the library."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantweave.llm import ids, packing
from quantweave.llm.words import Words, shingles, slices

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é  .,\t\n\x0b\x1c'<|>", max_size=25)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    words = Words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        own = plain(t)
        got = words.hash[words.bounds[i] : words.bounds[i + 1]].tolist()
        assert len(own) == len(got)
        for w, h in zip(own, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_shingles(k):
    texts = ["a b c a b c", "a b", "", None, "a b c a", "c a b"]
    value, bounds = shingles(Words(pa.array(texts)), k)
    names = {}
    for i, t in enumerate(texts):
        w = plain(t)
        own = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
        got = value[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(got)
        for s, h in zip(own, got, strict=True):
            assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 700_000, None, "b" * 3_000_000, "c"])], names=["text"])
    assert sum(len(s) for s in slices(batch)) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    coder = ids.encoder(packing.tokenizer_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got, bounds = coder.column(pa.array(texts, pa.string()), 2)
    for i, t in enumerate(texts):
        assert got[bounds[i] : bounds[i + 1]].tolist() == [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_ids_of_special_names_and_full_tables(monkeypatch):
    coder = ids.encoder(packing.tokenizer_path())
    odd = ["<|endoftext|> x", "<|ENDOFTEXT|> x", "don't 's Word. a,b .", "ΑΣ Σ\x1c x", "́abc", "é " * 50]
    got, bounds = coder.column(pa.array(odd), 2)
    for i, t in enumerate(odd):
        assert got[bounds[i] : bounds[i + 1]].tolist() == [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2]
    small = ids.Encoder(packing.tokenizer_path())
    small.pool = np.zeros(40, small.dtype)  # begins anew again and again
    for turn in range(3):
        texts = [f"word{turn}a other{turn} thing{i}" for i in range(9)]
        got, bounds = small.column(pa.array(texts), 2)
        for i, t in enumerate(texts):
            assert got[bounds[i] : bounds[i + 1]].tolist() == [*small.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_gradient_step_adds_up_the_rows_of_a_feature():
    import numpy as np

    from quantweave.llm import maxent

    rng = np.random.default_rng(3)
    start, bias = rng.normal(size=(8, 3)).astype(np.float32), np.zeros(3, np.float32)
    cell, features = rng.integers(0, 3, 50), [rng.integers(0, 8, 50)]
    weights, seen = start.copy(), np.ones(8, np.float32)
    maxent._step(weights, bias, seen, cell, features, 0.1)
    p = np.exp(start[features[0]])
    p /= p.sum(axis=1, keepdims=True)
    slope = np.zeros((8, 3))
    np.add.at(slope, features[0], p - np.eye(3)[cell])
    assert np.allclose(weights, start - 0.1 * slope / np.sqrt(1 + (slope**2).mean(axis=1, keepdims=True)), atol=1e-5)


def test_sums_of_a_features_rows_are_those_of_a_loop():
    import numpy as np

    from quantweave.llm import maxent

    rng = np.random.default_rng(4)
    top = (1 << maxent.ROWS_LOG2) - 1
    for feature in (rng.integers(0, 9, 1000), rng.zipf(1.3, 4096) % (top + 1), np.full(77, top), np.arange(50)[::-1], np.array([5])):
        p = rng.normal(size=(len(feature), 4)).astype(np.float32)
        whole = np.zeros((top + 1, 4))
        np.add.at(whole, feature, p.astype(np.float64))
        at, sums = maxent._row_sums(p, feature)
        assert at.tolist() == np.unique(feature).tolist()
        assert np.allclose(sums, whole[at], atol=1e-4)
