import hashlib
import random
import re

import pytest

from scholarlake.llm import near_dedup as near
from scholarlake.llm.exact_dedup import GraceTable, drop_copies, exact_dedup
from scholarlake.llm.near_dedup import drop_near_copies, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "d") for i, t in rows], SCHEMA)


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[1]
        out.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\r\n"), (6, "é x"), (7, "éx"), (8, "x" * 300_000), (9, " " + "x" * 300_000), (10, "a b"), (11, "ab "), (12, "a b")]


def test_exact_dedup_edges(spark):
    got = exact_dedup(frame(spark, ROWS))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == exact_brute(ROWS)
    assert exact_dedup(frame(spark, [])).collect() == []


def test_exact_dedup_spills_and_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else f"word {rng.randrange(200)} " * 40) for i in range(900)]
    got = exact_dedup(frame(spark, rows).repartition(5), table_bytes=5_000, fanout=3)
    assert sorted(map(tuple, got.collect())) == exact_brute(rows)


def test_exact_dedup_null_id_and_repeated_rows(spark):
    rows = [(None, "q q"), (5, "qq"), (5, "qq"), (None, "z")]
    got = sorted(map(tuple, exact_dedup(frame(spark, rows)).drop("text_sha256").collect()), key=repr)
    assert got == sorted([(None, None, 3, True), (5, None, 3, False), (5, None, 3, False), (None, None, 1, True)], key=repr)
    assert sorted((r.text for r in drop_copies(frame(spark, rows)).collect())) == ["q q", "z"]


def test_grace_table_compares_content_and_recurses():
    deep = GraceTable(budget=3_000, fanout=2, hasher=lambda digest, level: GraceTable.hashed(digest, level) & ~0xFFFF)
    want = {}
    for i in range(500):
        content = b"%d" % (i % 83) * 20
        deep.add(hashlib.sha256(content).digest(), content, i, i, 1)
        want[content] = want.get(content, 0) + 1
    rows = list(deep.drain())
    assert deep.spilled and {r[1]: r[4] for r in rows} == want and len(rows) == 83
    collide = GraceTable(hasher=lambda digest, level: 7)
    collide.add(b"1", b"one", 3, 1, 1)
    collide.add(b"2", b"two", 3, 2, 1)
    assert len(list(collide.drain())) == 2
    with pytest.raises(ValueError):
        same = GraceTable()
        same.add(b"1", b"one", 3, 1, 1)
        same.add(b"1", b"two", 3, 2, 1)


def test_drop_copies_keeps_columns(spark):
    docs = frame(spark, ROWS)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    want = {r[0] for r in exact_brute(ROWS) if r[3]}
    assert {r.doc_id for r in left.collect()} == want


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def near_brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_corpus(seed=5, n=240):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 20, 60, 120]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(base[0] if i % 3 == 0 else base[rng.randrange(25)])
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 12, len(w) // 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "É a"), (905, "é a"), (906, "w1 " * 30_000), (907, "a b"), (908, "b a"), (909, " \t")]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_equals_brute_force(spark, width):
    rows = near_corpus()
    got = near_dedup(frame(spark, rows), width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == near_brute(rows, width, 80)


def test_near_dedup_empty_and_null_ids(spark):
    assert near_dedup(frame(spark, [])).collect() == []
    got = near_dedup(frame(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 2, None, True), (2, 2, 2, True), (2, 2, 2, True)], key=repr)


def test_drop_near_copies(spark):
    docs = frame(spark, near_corpus(n=60))
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in near_brute(near_corpus(n=60), 5, 80) if r[3]}


def test_drop_copies_keeps_columns_that_clash(spark):
    rows = [(1, "a b", 10, "x", 5), (2, "ab", 11, "y", 6), (3, None, 12, "z", 7), (None, "c", 13, "w", 8), (4, "c", 14, "v", 9), (1, "a b", 15, "u", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha long, id string, row long")
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["__sha"], r["id"], r["row"]) for r in left.collect()) == [(10, "x", 5), (12, "z", 7), (14, "v", 9), (15, "u", 4)]


def test_turns_of_the_sweep_read_few_rows(spark, monkeypatch):
    """Random copies at the edge of the threshold: turns with pivots find what brute force finds, and late rows without a partner are not read again."""
    rng = random.Random(8)
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.055 else f"y{rng.randrange(10**6)}" for w in base)) for i in range(150)]
    read, real = [], near.unsettled
    monkeypatch.setattr(near, "SWEEP_PAIRS", 0)
    monkeypatch.setattr(near, "unsettled", lambda cells, roots: (read.append(cells.count()), real(cells, roots))[1])
    got = near_dedup(frame(spark, rows), width=2)
    assert sorted(map(tuple, got.collect())) == near_brute(rows, 2, 80)
    assert len(read) > 1 and read[1] < 400
