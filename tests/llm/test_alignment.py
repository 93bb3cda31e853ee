import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scholarlake.llm import alignment
from scholarlake.llm.alignment import Pair, align, words_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, grp string, n long, scope string"
UNITS = ["a", "B", "ß", "É", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "᠎", "'", "'s", "'T", ".", ",", "<|endoftext|>", "<s>", "<0x41>", "̈", "é", "12", "½", "中", "😀", "_", "\x00", "the", "Ing", "ſ", "...", " "]


def brute(texts):
    """Both encodings of whole texts, all pairs of occurrences tested for equal ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {}
    rest = 256
    for i in range(256):
        if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174:
            letters[chr(i)] = i
        else:
            letters[chr(rest)] = i
            rest += 1
    byte = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        whole = b"" if not text else (" " + text).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba, bb = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [byte(b.id_to_piece(i)) for i in ib]
        if b"".join(ba) != whole or b"".join(bb) != whole:
            ia, ib, ba, bb = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(ba), ends(bb)
        pairs = [(x, y) for x, e in zip(ia, ea) for y, f in zip(ib, eb) if e == f]
        cuts, at, groups = sorted(set(ea) & set(eb)), 0, []
        for cut in cuts:
            groups.append(",".join(str(x) for x, e in zip(ia, ea) if at < e <= cut) + "|" + ",".join(str(y) for y, f in zip(ib, eb) if at < f <= cut))
            at = cut
        docs.append((len(ia), len(ib), groups, pairs))
        counts.update(pairs)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    return [(na, nb, len(g), len(p), sum(counts[q] == top[q[1]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, p in docs]


def got(spark, rows):
    found = align(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)).collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, r))


def expected(rows):
    return sorted(((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows]))), key=lambda r: (r[0] is None, r))


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " "), (4, "  x "), (5, "a▁b"), (6, "same text, twice"), (7, "same text, twice"), (7, "same text, twice"), (None, "x"), (None, "x"), (8, "\x00"), (9, "x" * 3000), (10, "trailing "), (11, "two  spaces  ")]
    rows += [(i, "".join(rng.choices(UNITS, k=rng.randint(1, 12)))) for i in range(20, 400)]
    rows += [(i, " ".join("".join(rng.choices("etaoinüß.,", k=rng.randint(1, 12))) for _ in range(60))) for i in range(400, 440)]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []


def test_scopes_and_tables_may_be_small(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 40)
    monkeypatch.setattr(alignment, "TABLE_WORDS", 10)
    text = "some words, and  more of\nthem   that go on for longer than one slice of text does here "
    words = [w for part in words_of(text) for w in part]
    assert " ".join(words) == text and sum(1 for _ in words_of(text)) > 1
    monkeypatch.setattr(alignment, "SCOPE_GROUPS", 5)
    pair = Pair(A, B)
    for number in range(3):
        scope = alignment.Scope(pair, number)
        assert scope.row(1, text)[2:6] == tuple(brute([text])[0][i] for i in (0, 1, 2, 6))
        assert scope.full and sum(r[-1] for r in scope.dictionary()) == brute([text])[0][2]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_over_whole_table(spark, sf):
    import __spark_entry__

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    kept = [(i, t) for i, t in rows if len(t) < 3000]
    found = __spark_entry__.queries()["op11_alignment"](spark, f"/root/testdata/{sf}").collect()
    assert len(found) == len(rows)
    own = {r[0]: (r[1], r[2], r[3], r[4], r[7]) for r in found}
    for (i, _), r in zip(kept, brute([t for _, t in kept])):
        assert own[i] == (*r[:4], r[6])
    assert sum(r[6] for r in found) > 0
