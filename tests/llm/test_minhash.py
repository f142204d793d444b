"""MinHash components against brute force, with parameters that send pairs through every path."""

import random

import numpy as np
import pytest

from tarsia.llm import minhash
from tarsia.llm.minhash import minhash_components, shingles, signature

SCHEMA = "doc_id long, text string, sig string, comp long, key long"


def brute(rows, words=4, percent=80):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def made(seed, n):
    """Copies, near copies around the threshold, families that share passages, chains, short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(100)]
    rows, chain = [], [word() for _ in range(60)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = word()
        elif kind == 1:
            w = passage + [word() for _ in range(r.choice([5, 20, 26, 40]))]
        elif kind == 2:
            chain = list(chain)
            chain[r.randrange(len(chain))] = word()
            w = chain
        elif kind == 3:
            w = [word() for _ in range(r.randrange(9))]
        elif kind == 4:
            w = base
        else:
            w = [word() for _ in range(r.randrange(5, 80))]
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " \t".join(w)))
    return rows


def check(spark, rows, extra=(), **how):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in [*rows, *extra]], SCHEMA)
    got = minhash_components(df, **how).collect()
    assert len(got) == len(rows) + len(extra)
    want = brute(rows, how.get("words", 4), how.get("percent", 80))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want


def test_production_parameters(spark):
    check(spark, made(1, 330), extra=[(None, "a b c d e"), (None, None)])


def test_large_buckets_in_blocks(spark, monkeypatch):
    """No bucket is small: components meet as such, and large buckets get longer signatures, then blocks."""
    monkeypatch.setattr(minhash, "SKETCH", 1)
    paths = set()
    between = minhash._Search.between
    monkeypatch.setattr(minhash._Search, "between", lambda self, meet, large: (paths.update({"meet"} if not meet.isEmpty() else ()), paths.update({"large"} if not large.isEmpty() else ()), between(self, meet, large))[-1])
    check(spark, made(2, 240), few=2, block=13)
    assert paths == {"meet", "large"}


@pytest.mark.parametrize(("block", "levels"), [(5, {"1", "2"}), (100, {"1"})])
def test_large_buckets_get_longer_signatures_only_beyond_a_few_blocks(spark, monkeypatch, block, levels):
    monkeypatch.setattr(minhash, "SKETCH", 1)
    made_at, large_at, buckets = set(), set(), minhash._Search.buckets

    def seen(self, rows, name):
        meet, large = buckets(self, rows, name)
        made_at.add(name)
        large_at.update({name} if not large.isEmpty() else ())
        return meet, large

    monkeypatch.setattr(minhash._Search, "buckets", seen)
    check(spark, made(2, 390), few=2, block=block)
    assert made_at == levels and "1" in large_at


def test_other_parameters(spark):
    check(spark, made(3, 150), words=2, percent=90)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " tail"), (9, "a b c d"), (10, "A b C d"), (-5, "one two"), (11, "À b c d e"), (12, "à b c d e")]
    check(spark, rows)
    assert minhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, "x y z w v"), (3, "q q q q q q")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_components(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (3, 2, 3, True)]


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_minima_agree_as_often_as_sets_are_similar(share):
    r = np.random.default_rng(1)
    fns = minhash.functions(1)
    agree = []
    for _ in range(60):
        u = r.integers(0, 2**64, 400, np.uint64)
        k = int(400 * share)
        own = (400 - k) // 2
        x, y = np.sort(np.r_[u[:k], u[k : k + own]]), np.sort(np.r_[u[:k], u[k + own :]])
        agree.append((signature(x, fns) == signature(y, fns)).mean())
    assert abs(np.mean(agree) - share) < 0.02


def test_shingles_are_sets_of_words():
    assert len(shingles("a b c d e a b c d", 4)) == 5 and len(shingles("a b", 4)) == 1 and len(shingles(None, 4)) == 0
    assert (shingles("A b C d", 4) == shingles("a B c D", 4)).all()
