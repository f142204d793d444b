"""The set-similarity join against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarsia.llm import jaccard
from tarsia.llm.jaccard import MARK, PAIR, SEGMENTS, _meet, _parts, _round2, _set_key, _sign, band_of, jaccard_components, shingles

SCHEMA = "doc_id long, text string, lang string, class_id string"


def brute(rows):
    sets, texts = {}, {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        texts[doc] = text
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, s in sets.items():
        for t in s:
            where.setdefault(t, []).append(d)
    for d, s in sets.items():
        count = {}
        for t in s:
            for o in where[t]:
                if o < d:
                    count[o] = count.get(o, 0) + 1
        for o, both in count.items():
            if 100 * both >= 75 * (len(s) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(spark, rows, extra=()):
    df = spark.createDataFrame([(d, t, None, "x") for d, t in [*rows, *extra]], SCHEMA)
    got = jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows)
    assert len(got) == len(rows) + len(extra)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want


def made(seed, n=400):
    """Copies, near copies around the threshold, shared passages of many lengths, short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            t = [word() for _ in range(r.randrange(0, 12))]
        elif kind == 1:
            t = list(base)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = word()
        elif kind == 2:
            t = passage + [word() for _ in range(r.randrange(0, 40))]
        elif kind == 3:
            t = [word() for _ in range(r.randrange(0, 30))] + passage[: r.randrange(5, 60)]
        elif kind == 4 and rows:
            t = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if t:
                    t[r.randrange(len(t))] = word()
        elif kind == 5 and rows:
            t = (rows[r.randrange(len(rows))][1] or "").split() + [word()] * r.randrange(0, 6)
        elif kind == 6:
            t = base[r.randrange(30) :] + [word() for _ in range(r.randrange(10))]
        else:
            t = [word() for _ in range(r.randrange(5, 200))]
        rows.append((i + 7, r.choice([" ", "\n", "\t "]).join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    check(spark, made(seed))


def test_nulls_ties_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (9, "x " * 3000), (10, "x " * 2999)]
    check(spark, rows, extra=[(4, "A b"), (None, "A b")])
    check(spark, [])


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute(rows)


def across_edge(seed, large=60, small=20):
    """Near copies of 96 shingles and more and, below the band edge at 96, variants of them around the threshold."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(104)]
    rows = []
    for i in range(large + small):
        t = list(base)
        if i < large:
            for _ in range(r.randrange(1, 4)):
                t[r.randrange(len(t))] = word()
        else:
            t = t[: r.randrange(93, 100)]
            for at in r.sample(range(4, len(t) - 4, 9), r.randrange(1, 4)):
                t[at] = word()
        rows.append((i, " ".join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_large_group_across_a_band_edge(spark, seed):
    check(spark, across_edge(seed))


def test_round2_across_a_band_edge():
    """The larger document is open with all segments frequent, the smaller one settles by its unshared segments."""
    settled = 0
    for seed in range(200):
        r = random.Random(seed)
        base = [f"w{r.randrange(10**6)}" for _ in range(106)]
        other = list(base[:96])
        for at in r.sample(range(8, 85, 9), 1):
            other[at] = f"v{seed}-{at}"
        large, small = " ".join(base), " ".join(other)
        x, y = shingles(small), shingles(large)
        both = len(np.intersect1d(x, y))
        band = band_of(len(x))
        assert band_of(len(y)) == band + 1 and 4 * both >= 3 * (len(x) + len(y) - both)
        low = []
        for s in (x, y):
            seg, _, _, total, _ = _parts(s, band)
            low.append(_sign(total, seg, band).astype(np.uint32))
        assert len(low[1]) <= SEGMENTS[band]
        shared = np.intersect1d(*low).tobytes()
        rows = [{"doc_id": 1, "text": small, "k1": _set_key(x), "comp": 1, "own": [shared], "lower": None}, {"doc_id": 2, "text": large, "k1": _set_key(y), "comp": 2, "own": None, "lower": [low[1].tobytes()]}]
        rows = pa.RecordBatch.from_pylist(rows)
        found = [f for b in _meet(True, _round2(1, iter([rows]))) for f in b.to_pylist()]
        marked = {f["a"] for f in found if f["kind"] == MARK}
        settled += 1 not in marked
        assert marked >= {1, 2} or (1, 2) in {(f["a"], f["b"]) for f in found if f["kind"] == PAIR}
    assert settled


def simulated(texts, comp):
    """Candidates of the three rounds, and documents with their sizes and infrequent tokens that are left for comparison."""
    row = lambda d, t, **more: {"doc_id": d, "text": t, "k1": _set_key(shingles(t)), "comp": comp[d], **more}
    run = lambda by_choice, emit, rows: [f for b in _meet(by_choice, emit(1, iter([pa.RecordBatch.from_pylist(rows)]))) for f in b.to_pylist()] if rows else []
    size = {d: len(shingles(t)) for d, t in texts.items()}
    first = run(False, jaccard._round1, [row(d, t) for d, t in texts.items()])
    bad, short = {}, {}
    for f in first:
        if f["kind"] != PAIR:
            bad.setdefault((f["a"], f["b"] & 1), []).extend([f["s"]] if f["s"] else [])
            if f["kind"] == jaccard.SHORT:
                short[f["a"], f["b"] & 1] = (f["b"] >> 1) - 1
    open_ = {k: v for k, v in bad.items() if sum(map(len, v)) / 4 > short.get(k, jaccard.SLACK[band_of(size[k[0]]) - k[1]])}
    hard = sorted({d for d, _ in open_})
    second = run(True, _round2, [row(d, texts[d], own=open_.get((d, 0)), lower=open_.get((d, 1))) for d in hard])
    left = sorted({f["a"] for f in second if f["kind"] == MARK})
    third = run(False, jaccard._round3, [row(d, texts[d]) for d in left])
    often = dict.fromkeys(left, 0)
    for f in third:
        if f["kind"] == MARK:
            often[f["a"]] += len(f["s"]) // 4
    pairs = {(f["a"], f["b"]) for f in first + second + third if f["kind"] == PAIR}
    return pairs, {d: size[d] - often[d] for d in left}, hard


@pytest.mark.parametrize("frequent", [1, 2, 5])
def test_rounds_lose_no_pair(monkeypatch, frequent):
    """Each similar pair of two components is a candidate or left for comparison, however few holders make a segment frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    seen = [0, 0, 0]
    for seed in range(12):
        texts = dict(made(seed, 150) if seed % 3 else across_edge(seed, 40, 20))
        texts = {d: t for d, t in texts.items() if len(shingles(t)) > 2}
        sets = {d: frozenset(shingles(t).tolist()) for d, t in texts.items()}
        comp = {d: min(e for e in sets if sets[e] == sets[d]) if seed % 2 else d for d in sets}
        pairs, rare, hard = simulated(texts, comp)
        similar = [(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        for a, b in similar:
            if (a, b) not in pairs:
                most = (len(sets[a]) + len(sets[b])) // 7
                assert a in rare and b in rare and rare[a] + rare[b] <= most, (seed, a, b)
        seen = [n + len(x) for n, x in zip(seen, (similar, hard, rare), strict=True)]
    assert all(seen)


def brute_links(rows):
    sets = {d: frozenset(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) for d, t in rows}
    classes = set(sets.values())
    return {d: sum(o != s and 100 * len(s & o) >= 75 * len(s | o) for o in classes) for d, s in sets.items()}


def test_number_of_links(spark, monkeypatch):
    """Three alike, chains that aren't, exact copies, and a large group cut into blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    r = random.Random(9)
    rows = across_edge(5, 40, 15)
    for start in (100, 200):
        t = [f"t{start}-{i}" for i in range(60)]
        for i in range(6):
            rows.append((start + i, " ".join(t)))
            if i != 2:
                t[7 * i + 5] = f"u{start}-{i}-{r.randrange(100)}"
    three = [f"three{i}" for i in range(80)]
    rows += [(300 + i, " ".join([*three, f"end{i}"])) for i in range(3)]
    df = spark.createDataFrame([(d, t, None, "x") for d, t in rows], SCHEMA)
    got = {x.doc_id: x.n_links for x in jaccard_components(df).collect()}
    assert got == brute_links(rows)
    assert [got[300 + i] for i in range(3)] == [2, 2, 2]
