import random

import pytest

from scholarlake.operators import catalog, trees

SCHEMA = "key string, parent string, api_ord long, name string, num_items long"


def brute(rows):
    """{key: (depth, pre, size)} of what is reachable from a root."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1] is not None, r[1] or "", r[3], r[4])):
        if r[0] is not None:
            first.setdefault(r[0], r)
    below = {}
    for r in first.values():
        below.setdefault(r[1] if r[1] in first else None, []).append(r)
    out, stack = {}, [(r, 0) for r in sorted(below.get(None, []), key=lambda r: (r[2], r[0]), reverse=True)]
    order = []
    while stack:
        r, depth = stack.pop()
        out[r[0]] = [depth, len(order), 1]
        order.append(r)
        stack += [(x, depth + 1) for x in sorted(below.get(r[0], []), key=lambda r: (r[2], r[0]), reverse=True)]
    for r in reversed(order):
        if r[1] in out:
            out[r[1]][2] += out[r[0]][2]
    return {k: tuple(v) for k, v in out.items()}


def numbers(spark, rows):
    found = trees.numbered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len({r.key for r in found})
    return {r.key: (r.depth, r.pre, r["size"]) for r in found}


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_intervals_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    rng = random.Random(block)
    rows = [(f"k{i}", rng.choice([None, "gone", *[f"k{j}" for j in range(i)]] if i % 9 else [f"k{rng.randint(0, 59)}"]), rng.randint(0, 5), f"n{i}", i) for i in range(60)]
    rows += [("k3", "k4", 9, "again", 0), ("k3", None, -1, "first", 0), (None, "k1", 0, "no key", 0), ("self", "self", 0, "s", 0), ("c1", "c2", 0, "c", 0), ("c2", "c1", 0, "c", 0), ("under", "c1", 0, "u", 0)]
    want = brute(rows)
    assert numbers(spark, rows) == want and len(want) > 5 and "under" not in want
    assert numbers(spark, []) == {}


def test_repeated_keys_and_circles(spark):
    rows = [("a", None, 0, "A", 0), ("b", "a", 1, "B", 0), ("b", "a", 2, "B again", 0), ("c", "b", 3, "C", 0), ("d", "c", 4, "D", 0), ("x", "y", 5, "X", 0), ("y", "x", 6, "Y", 0), ("z", "y", 7, "Z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.key, r.name, r.depth) for r in catalog.tree(df).collect()) == [("a", "A", 0), ("b", "B", 1), ("c", "C", 2), ("d", "D", 3)]
    assert [r.line for r in catalog.listing(df).orderBy("ord").collect()] == ["A", "  B", "    C", "      D"]
    assert sorted(r.key for r in catalog.descendants(df, "b").collect()) == ["b", "c", "d"]
    assert sorted(r.key for r in catalog.descendants(df, "x").collect()) == ["x", "y", "z"]


def test_a_chain_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 1000)
    n = 5000
    assert numbers(spark, [(f"k{i}", f"k{i - 1}" if i else None, 0, "n", 0) for i in range(n)]) == {f"k{i}": (i, i, n - i) for i in range(n)}


def test_rows_of_nodes_are_not_broadcast(spark, monkeypatch):
    """Only the starts of `ranked`, a row a partition, may pass through the driver."""
    plans, real = [], trees.written
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (trees, catalog):
        monkeypatch.setattr(module, "written", lambda df: (seen(df), real(df))[1])
    monkeypatch.setattr(trees, "BLOCK", 10)
    df = spark.createDataFrame([(str(i), str((i - 1) // 3) if i else None, i, "n", 0) for i in range(100)], SCHEMA)
    out = catalog.tree(df, paths=True)
    seen(out)
    want = lambda i: (want((i - 1) // 3) if i else []) + [str(i)]
    assert {r.key: r.path for r in out.collect()} == {str(i): want(i) for i in range(100)}
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 8 and all("shiftright" in line for line in joins)
