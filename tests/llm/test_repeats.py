import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholarlake.llm.substring_dedup import substring_dedup
from scholarlake.llm.suffix_dedup import sort_strings, suffix_dedup
from scholarlake.llm.suffixes import prefix_groups, suffix_array

SCHEMA = "doc_id long, text string, block int, step int, n_words long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1) for i, t in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_sorts(values):
    text = np.array(values, np.int64)
    assert suffix_array(text).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_prefix_groups():
    text = np.frombuffer(b"abcabcabd", np.uint8)
    order = np.array([s for s in suffix_array(text.astype(np.int64)) if s <= 6])
    groups = prefix_groups(text, order, 3)
    same = {}
    for s, g in zip(order, groups):
        same.setdefault(g, set()).add(bytes(text[s : s + 3]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({bytes(text[i : i + 3]) for i in range(7)})


def test_sort_strings_equals_brute_force():
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 15))) for _ in range(40)]
    doc = np.array([rng.randrange(30) for _ in rows])
    low, _ = sort_strings(np.array([rng.randrange(3) for _ in rows], np.uint64) * np.uint64(0) + np.uint64(5), doc, np.array([len(r) for r in rows]), np.frombuffer(b"".join(rows), np.uint8), 6)
    best = {}
    for r, d in zip(rows, doc):
        for k in range(len(r) - 5):
            best[r[k : k + 6]] = min(best.get(r[k : k + 6], d), d)
    assert low.tolist() == [best[r[k : k + 6]] for r in rows for k in range(len(r) - 5)]


def removed_by_windows(sequences, width):
    """{position in the list: mask of tokens to remove}; sequences: (doc_id, tokens)."""
    first = {}
    for i, s in sequences:
        for k in range(len(s) - width + 1):
            w = tuple(s[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - width + 1):
            if first[tuple(s[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append(gone)
    return out


def corpus(seed, n=60, shared_len=(60, 200)):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(rng.randrange(*shared_len))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            s = list(shared[0] if i % 3 == 0 else rng.choice(shared))
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = word()
            lo = rng.randrange(0, 20)
            words += s[lo : len(s) - rng.randrange(0, 10)] + [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i * 7 % 61, rng.choice([" ", "  ", "\n"]).join(words)))
    # Pairs that no third document shares, so that some lie within one block.
    for i in range(200, 224, 2):
        pair = " ".join(word() for _ in range(rng.randrange(60, 90)))
        rows += [(i, pair), (i + 1, pair)]
    rows += [(100, None), (101, ""), (102, "the " * 400), (103, "the " * 300), (104, "a b " * 90 + "x"), (105, "a b " * 200), (106, rows[0][1]), (107, "é" * 200), (108, "é" * 150 + "z")]
    return rows


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    for (i, words), gone in zip(split, removed_by_windows(split, 50)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i].n_words, got[i].n_removed) == (len(words), sum(gone)), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert got[i].kept_text == kept and sum(s.end - s.start for s in got[i].spans) == sum(gone)
    assert len(got) == len(rows) and sum(r.n_removed for r in got.values()) > 1000


@pytest.mark.parametrize("seed", [2, 3])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed, n=40, shared_len=(10, 40))
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, rows)).collect()}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for (i, data), gone in zip(raw, removed_by_windows(raw, 50)):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall("1+", "".join("01"[g] for g in gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), sum(gone), runs), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(got[i].kept) == kept
    assert len(got) == len(rows) and sum(r.n_removed for r in got.values()) > 1000


def test_repeats_of_empty_tables_null_ids_and_repeated_rows(spark):
    long = "q w e r t y u i o p " * 12
    for op in (substring_dedup, suffix_dedup):
        assert op(frame(spark, [])).collect() == []
        got = op(frame(spark, [(None, long), (4, long), (4, long), (5, "s")])).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in got) == [(False, 4, True), (False, 4, True), (False, 5, False), (True, 0, False)]


def test_even_ids_follow_spark(spark):
    from pyspark.sql import functions as F

    from scholarlake.llm.blocks import even_ids, partition_of

    ids = np.arange(2000, dtype=np.int32)
    got = spark.range(2000).select(F.expr("pmod(hash(cast(id as int)), 51)").alias("p")).collect()
    assert partition_of(ids, 51).tolist() == [r.p for r in got]
    assert sorted(partition_of(even_ids(211), 211).tolist()) == list(range(211))


def test_one_phrase_in_every_document(spark):
    """A minimizer that all documents hold, each in other surroundings, among which some repeat."""
    rng = random.Random(21)
    phrase = " ".join(f"p{i}" for i in range(30))
    around = [" ".join(f"a{rng.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(150):
        before, after = (rng.choice(around) if rng.random() < 0.5 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
        rows.append((i, f"{before} {phrase} {after}"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        assert got[i] == (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
