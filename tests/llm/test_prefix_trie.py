import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from scholarlake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, rank long, lcp string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            name = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            convs[c].append((t is not None, t or 0, name, (r, x)))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = lambda key: len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, own in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(own) - 1) * words(key)
    out = []
    for key, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), children[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def got(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    found = P.prefix_trie(P.rebuilt(P.ordered_turns(df)))
    assert found.columns == COLUMNS
    return sorted(str(tuple(r)) for r in found.collect())


def conversations(rng, n, turns, texts, gap=1):
    return [(c * gap, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, turns))]


def test_kernels():
    rng = random.Random(1)
    for _ in range(300):
        values = [rng.randint(-1, 4) for _ in range(rng.randint(1, 40))]
        left, right = P.nearest_smaller(values)
        for i, v in enumerate(values):
            assert left[i] == max([j for j in range(i) if values[j] < v], default=-1)
            assert right[i] == min([j for j in range(i + 1, len(values)) if values[j] < v], default=len(values))
        levels, a = P.sparse(np.array(values)), rng.randrange(len(values))
        b = rng.randint(a + 1, len(values))
        assert P.least_of(levels, np.array([a]), np.array([b]))[0] == min(values[a:b])


@pytest.mark.parametrize("block", [1, 5, 64])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = conversations(rng, 90, 5, ["a b", "c", "", "d  e\tf"])
    rows += [(1000 + i, t, "user", "same one") for i in range(40) for t in range(3)]
    rows += [(2000, t, "user", "deep") for t in range(30)] + [(2001, t, "user", "deep") for t in range(25)]
    rows += [(-5, 0, None, None), (-5, None, "user", "first"), (-5, 0, None, None), (-7, 1, "x", "tie"), (-7, 1, "x", "tied"), (None, 0, "user", "lost")]
    assert got(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert got(spark, []) == []
    for rows in ([(3, 0, "u", "x y")], [(c, 0, "u", "x") for c in range(60)], [(41, 0, "u", "x"), (61, 0, "u", "y")], [(5, None, None, None)]):
        assert got(spark, rows) == brute(rows)


def test_query_over_whole_table(spark):
    import __spark_entry__

    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = __spark_entry__.queries()["op13_prefix_trie"](spark, "/root/testdata/sf0.01")
    assert sorted(str(tuple(r)) for r in found.collect()) == brute([tuple(r) for r in table.collect()])
