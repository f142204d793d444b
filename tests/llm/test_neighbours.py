"""Nearest neighbours against brute force; the factor trades recall only downwards from exact."""

import math

import numpy as np

from tarsia.llm.neighbours import Leaves, Tree, in_order, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    ok = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)), key=lambda x: (x[0], x[1]), reverse=True):
        ok[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in sorted(set(queries) & set(ok)):
        s = sorted((-in_order(ok[q][None], v[None])[0], i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [float("inf")] * 8), (2006, [1.0, 2.0]), (None, rows[1][1]), (3, rows[3][1]), (2008, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    want = brute(rows, [i for i, _ in rows if i is not None and (i % 20 == 0 or i == 2006)], 20)
    for shard in (8000, 90):
        got = nearest(df, df.where("vec_id % 20 = 0 or vec_id = 2006"), k=20, shard=shard).collect()
        assert sorted(map(tuple, got)) == want


def test_leaves_rule_shards_out():
    """Clustered vectors: few leaves are within the k-th distance, and none that holds a neighbour is left out."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 5)) * 20
    x = np.concatenate([c + r.normal(size=(300, 5)) for c in centres])
    top = Leaves(x[::7], 16)
    rows, leaves = top.reached(x, None)
    home = leaves[np.argsort(rows)]
    q = x[::50]
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, 1)[:, :10]
    rows, leaves = top.reached(q, np.sqrt(np.take_along_axis(d, near, 1)[:, -1]) + 1e-9)
    reached = set(zip(rows.tolist(), leaves.tolist(), strict=True))
    assert all((i, home[j]) in reached for i in range(len(q)) for j in near[i])
    assert top.count == 16 and len(rows) < 6 * len(q)


def test_recall_below_one(spark):
    """Relaxed pruning misses some neighbours, never more than a tenth at 0.8, and never gives a wrong score."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 8)) * 4
    rows = [(i, (centres[i % 20] + r.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = nearest(df, df.where("vec_id % 20 = 0"), k=10, factor=0.8, shard=200).collect()
    want = {(q, v): s for q, _, v, s in brute(rows, [i for i, _ in rows if i % 20 == 0], 10)}
    hits = [x for x in got if (x.query_id, x.vec_id) in want]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(want[x.query_id, x.vec_id] == x.score for x in hits)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nearest(df, df).count() == 0


def test_factor():
    r = np.random.default_rng(1)
    x, q = r.normal(size=(3000, 6)), r.normal(size=(50, 6))
    tree = Tree(x, 32)
    exact, d = tree.search(q, 10)
    assert tree.looked < 0.7 * len(x) * len(q)
    want = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), 1)[:, :10]
    assert all(set(a) == set(b) for a, b in zip(exact, want, strict=True))
    near, _ = Tree(x, 32).search(q, 10, factor=0.7)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, want, strict=True)]) > 0.8


def test_many_distinct_ties(spark):
    """Small integers and one-hot vectors: hundreds of distinct vectors tie with the k-th."""
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-1, 2, size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, [float(i % 8 == j) for j in range(8)]) for i in range(80)]
    r.shuffle(ids := np.arange(len(rows)))
    rows = [(int(n), v) for n, (_, v) in zip(ids, rows, strict=True)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    assert sorted(map(tuple, got)) == brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
