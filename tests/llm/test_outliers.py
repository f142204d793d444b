"""Counts against a plain reading of the contract; the robust test on made outliers."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarsia.llm.common import scratch
from tarsia.llm.outliers import CORE, FLOOR, STATS, estimate, reject_outliers, statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\n", " ", "\x1c", "|", "a b a b a b a b "]), max_size=60))
def test_counts(parts):
    assert statistics("".join(parts)) == brute("".join(parts))


def test_outliers(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randrange(60, 300))), "en", "s1" if i % 2 else None) for i in range(400)]
    rows += [(1000, " ".join(f"#$%&*{i}" * 9 for i in range(100)), "en", "s1"), (1001, "a b", "en", "s1"), (1002, None, None, None), (1003, "", "xx", "tiny"), (1003, "x " * 50, "xx", "tiny")]
    got = {}
    for x in reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert sum(map(len, got.values())) == len(rows)
    assert not got[1000][0].kept and not got[1000][0].base_failed
    assert got[1001][0].base_failed and got[1002][0].base_failed and all(x.base_failed for x in got[1003])
    assert all(got[i][0].kept for i in range(400))


def test_empty(spark):
    assert reject_outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_words string")).count() == 0


def test_one_statistic_alone(spark):
    """Repeated words short of the base rule, or symbols, reject a text in a group that has none of them."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(r.randrange(60, 300)), "en", "s1") for i in range(400)]
    rows += [(1000, " ".join([*[text(12)] * 4, text(150)]), "en", "s1"), (1001, text(150) + " |" * 30, "en", "s1")]
    got = {x.doc_id: x for x in reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(not got[i].kept and not got[i].base_failed for i in (1000, 1001))
    assert all(got[i].kept for i in range(400))


def concentrated(x, seed):
    """The smallest log determinant that plain concentration finds from many random starts, and its centre."""
    r = np.random.default_rng(seed)
    keep = int(np.ceil(CORE * len(x)))
    best = (np.inf, None)
    for _ in range(60):
        some = x[r.choice(len(x), len(STATS) + 1, replace=False)]
        for _ in range(30):
            m, c = some.mean(0), np.cov(some.T, bias=True) + FLOOR
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            some = x[np.argsort(d)[:keep]]
        best = min(best, (float(np.linalg.slogdet(np.cov(some.T, bias=True) + FLOOR)[1]), some.mean(0).tolist()))
    return best


def test_estimate_against_random_starts(spark):
    """Correlated rows with a fifth of outliers in one place: the centre is found, and the refit isn't drawn to them."""
    r = np.random.default_rng(3)
    a = r.normal(size=(5, 5))
    good = r.normal(size=(800, 5)) @ a + 4
    x = np.vstack([good, 0.1 * r.normal(size=(200, 5)) + 30])
    want, centre = concentrated(x, 1)
    rows = spark.createDataFrame([("a", *map(float, v)) for v in x] + [("b", *map(float, v)) for v in x + 7], ["g", *STATS])
    for few in (True, False):
        path = scratch(spark, "mcd")
        got = {m.g: m for m in estimate(rows, path, few).collect()}
        best = {m.g: m for m in spark.read.parquet(f"{path}/best").collect()}
        assert abs(best["a"].logdet - want) < 0.05
        assert np.abs(np.array(best["a"].mean) - centre).max() < 0.2 and np.abs(np.array(best["b"].mean) - 7 - centre).max() < 0.2
        assert np.abs(np.array(got["a"].mean) - good.mean(0)).max() < 0.3


def test_small_groups_are_judged_by_their_language(spark):
    """A junk source of few rows in a language with a large clean one, and a language of few rows."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(r.randrange(60, 300)), "en", "large") for i in range(400)]
    rows += [(1000 + i, text(100) + " |" * 90, "en", "junk") for i in range(20)] + [(2000 + i, text(120), "fr", "few") for i in range(5)] + [(3000, text(100) + " #" * 90, None, None)]
    kept = {x.doc_id: x.kept for x in reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and not kept[3000]
    assert all(kept[i] for i in range(400)) and all(kept[2000 + i] for i in range(5))
