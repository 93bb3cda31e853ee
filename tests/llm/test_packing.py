import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholarlake.llm.packing import Packer, best_fit, filled, pack
from scholarlake.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, length long, sequence_id string"
UNITS = ["a", "B", "ß", "É", "σ", "Σ", "İ", "ǅ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'", "'s", "'T", ".", ",", "<|", "<|endoftext|>", "<", "̸", "̈", "é", "12", "½", "中", "😀", "_", "\x00", "µ", "the", "Ing", "÷", "ſ"]


def brute_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_whole_text():
    tokenizer, words, rng = Tokenizer.from_file(PATH), WordIds(PATH), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(UNITS, k=rng.randint(0, 12)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == brute_ids(tokenizer, text)[:-1], repr(text)
    long = " ".join("".join(rng.choices("abcdeü.,", k=rng.randint(1, 9))) for _ in range(300_000))
    assert np.frombuffer(words.ids(long), "<u4").tolist() == brute_ids(tokenizer, long)[:-1]


def naive_best_fit(lengths, capacity):
    free, windows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(free)) if free[w] >= lengths[i]]
        if fits:
            w = min(fits, key=lambda w: free[w])
        else:
            w = len(free)
            free.append(capacity)
            windows.append([])
        free[w] -= lengths[i]
        windows[w].append(i)
    return windows


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 2048])
def test_best_fit_is_the_plain_one_and_filling_leaves_no_padding(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        got = best_fit(lengths, capacity)
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in naive_best_fit(lengths, capacity))
        seen, sizes = defaultdict(list), []
        for window in filled([[(i, 0, lengths[i]) for i in w] for w in got], capacity):
            n = sum(length for _, _, length in window)
            sizes.append(n)
            assert n == capacity or n & (n - 1) == 0
            for item, start, length in window:
                assert length > 0
                seen[item] += range(start, start + length)
        assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
        assert len(sizes) <= len(got) + capacity.bit_length()


def check(rows, texts, capacity):
    """Whole contract: rows of (doc_id, start, length, crc, doc_tokens, sequence_id, offset) against the texts by id."""
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids, at = brute_ids(tokenizer, text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_pack_edges(spark):
    rng = random.Random(2)
    texts = {1: None, 2: "", 3: " \n\t", 4: "word " * 9000, 5: "x" * 30_000, 6: "a<|endoftext|>b", 7: "Same, text.", 8: "Same, text."}
    texts |= {i: " ".join("".join(rng.choices("abcdeü", k=5)) for _ in range(rng.randint(0, 300))) for i in range(9, 60)}
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts.items()], SCHEMA)
    check(pack(docs, capacity=256).collect(), texts, 256)
    check(pack(docs.repartition(7)).collect(), texts, 2048)
    assert pack(docs.limit(0)).collect() == []
    again = pack(spark.createDataFrame([(None, "a b", "x", 1, "y")] * 2 + [(1, "a b", "x", 1, "y")] * 2, SCHEMA)).collect()
    assert sum(r["length"] for r in again) == 12 and {r["doc_tokens"] for r in again} == {3}


def test_scopes_are_flushed(monkeypatch):
    monkeypatch.setattr("scholarlake.llm.packing.SCOPE_TOKENS", 500)
    packer, rows = Packer(64, 1 << 40), []
    for i in range(100):
        rows += packer.add(i, np.arange(i % 70 + 1, dtype="<u4").tobytes())
    assert packer.held < 500
    rows += packer.flush()
    assert sum(r[2] for r in rows) == sum(i % 70 + 1 for i in range(100)) and min(r[5] for r in rows) == 1 << 40


def test_query_over_whole_table(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["op12_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs}, 2048)
