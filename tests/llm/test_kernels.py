import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scholarlake.llm.langid import SEGMENT, forward_backward
from scholarlake.llm.near_dedup import shingle_sets, sketches
from scholarlake.llm.paths import sliding_min
from scholarlake.llm.toxicity import LabelModel
from scholarlake.llm.words import Words, mix, slices, windows

TEXT = st.text(alphabet="aAbÉé \t\n\x0b. 😀", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=8))
def test_words_split_as_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [[x.encode() for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [w.word(i) for i in range(len(flat))] == flat
    hashes = w.hash.tolist()
    assert all((flat[i] == flat[j]) == (hashes[i] == hashes[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_hashes_do_not_depend_on_place_or_slice():
    rng = np.random.RandomState(0)
    texts = [" ".join(f"w{rng.randint(500)}" for _ in range(rng.randint(0, 60))) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])
    whole = Words(batch.column(1))
    parts = [Words(p.column(1)) for p in slices(batch, limit=700)]
    assert len(parts) > 10 and np.array_equal(np.concatenate([p.hash for p in parts]), whole.hash)
    h, inside = windows(whole.hash, whole.first, 5)
    own = np.concatenate([windows(p.hash, p.first, 5)[0][windows(p.hash, p.first, 5)[1]] for p in parts])
    assert np.array_equal(h[inside], own)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_sliding_min(x, width):
    got = sliding_min(np.array(x, np.uint64), width)
    assert got.tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_sketches_fill_and_estimate():
    rng = np.random.RandomState(1)
    sets = [np.unique(mix(rng.randint(0, 1 << 60, n).astype(np.uint64))) for n in (1, 2, 5, 40, 500)]
    base = mix(np.arange(1000, dtype=np.uint64))
    sets += [base[:900], base[100:], base[:0]]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = sketches(np.concatenate(sets), offsets, 200)
    assert (s[:-1] != np.iinfo(np.uint64).max).all() and (s[-1] == np.iinfo(np.uint64).max).all()
    assert abs((s[5] == s[6]).mean() - 0.8) < 0.1
    again = sketches(np.concatenate([sets[3], sets[5]]), np.array([0, 40, 940]), 200)
    assert np.array_equal(again[0], s[3]) and np.array_equal(again[1], s[5])


def test_shingles_of_short_texts():
    w = Words(pa.array(["a b", "a", "", "b a", "a  b", "a b c"]), lower=True)
    elements, offsets = shingle_sets(w, 3)
    sets = [elements[offsets[i] : offsets[i + 1]].tolist() for i in range(6)]
    assert [len(s) for s in sets] == [1, 1, 0, 1, 1, 1] and sets[0] == sets[4] != sets[3] and sets[0] != sets[1]


def test_forward_backward_equals_enumeration():
    rng = np.random.RandomState(2)
    count = np.array([1, 0, 4, 6])
    first = np.concatenate([[0], np.cumsum(count)])
    scores, trans = rng.randn(first[-1], 3), np.exp(rng.randn(3, 3))
    got = forward_backward(scores, first, count, trans)[0]
    for i, n in enumerate(count):
        total = np.zeros((n, 3))
        for labels in np.ndindex(*([3] * n)) if n else ():
            # Every label may start: the message into a chain is even.
            p = sum(trans[s, labels[0]] for s in range(3)) * np.exp(sum(scores[first[i] + t, labels[t]] for t in range(n)))
            for a, b in zip(labels, labels[1:]):
                p *= trans[a, b]
            for t in range(n):
                total[t, labels[t]] += p
        if n:
            assert np.allclose(got[first[i] : first[i + 1]], total / total.sum(axis=1, keepdims=True))


def test_forward_backward_does_not_see_segments():
    rng = np.random.RandomState(3)
    n = 3 * SEGMENT + 7
    scores, trans = rng.randn(n, 4), np.exp(rng.randn(4, 4))
    a = forward_backward(scores, np.array([0, n]), np.array([n]), trans)[0]
    e, f, b = np.exp(scores), np.zeros((n, 4)), np.ones((n, 4))
    v = np.ones(4)
    for t in range(n):
        v = (v @ trans) * e[t]
        v /= v.sum()
        f[t] = v
    for t in range(n - 2, -1, -1):
        b[t] = trans @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    assert np.allclose(a, f * b / (f * b).sum(axis=1, keepdims=True))


def test_label_model_shares_the_weight_of_correlated_voters():
    rng = np.random.RandomState(4)
    y = (rng.rand(3000) < 0.2).astype(int)
    one, two = (rng.rand(3000) < np.where(y, 0.6, 0.02)), (rng.rand(3000) < np.where(y, 0.5, 0.02))
    votes = np.stack([one, one, one, two], axis=1).astype(float)
    n, silent = np.array([y.sum(), (1 - y).sum()]), ~votes.any(axis=1)
    model = LabelModel.of(y @ votes, votes.sum(0), np.array([y[silent].sum(), (1 - y)[silent].sum()]), n, 0.2, votes.T @ votes)
    weight = 1 / model.shared.sum(axis=1)
    assert weight[3] > 0.9 and weight[:3].max() < 0.5
    q = model.posterior(votes)
    assert q[(y == 1) & (one | two)].mean() > 0.8 and q[~(one | two)].mean() < 0.2
