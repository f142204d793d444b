"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tarsia.llm import spelling
from tarsia.llm.spelling import spelling_variants

SCHEMA = "doc_id long, text string, word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97, letters=5, least=3, times=2):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= letters and n >= least}
    close = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()}


def made(seed, docs=60):
    r = random.Random(seed)
    base = ["".join(r.choices("aeilnorst", k=r.randint(4, 9))) for _ in range(40)] + ["caffè", "naïveté", "straße", "Ærø×xy", "señor", "Àlacarte"]
    rows = []
    for i in range(docs):
        words = []
        for w in r.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=120):
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeisté") + w[k:], w[:k] + r.choice("aeist") + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


def check(spark, rows, **how):
    got = spelling_variants(spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA), **how).collect()
    want = brute(rows, **how)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    return want


@pytest.mark.parametrize("every", [97, 5])
def test_all_pairs(spark, every):
    want = check(spark, made(every), every=every)
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert any(f is not None and root != f for f, root, *_ in want.values())


def test_pieces_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TOGETHER", 3)
    monkeypatch.setattr(spelling, "near_words", lambda words, path, of=spelling.near_words: of(words, path, block=4))
    check(spark, made(7), letters=3, least=1)


def test_odd_rows(spark):
    long = "a" * 70_000
    rows = [(None, "casette casette casetta casetta"), (1, None), (2, ""), (3, "12 ×÷ 34"), (4, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]}"), (5, "casetta"), (5, "casetta"), (6, "listen silent enlist tinsel inlets listen silent enlist tinsel inlets listen silent enlist tinsel inlets")]
    check(spark, rows)
    check(spark, rows, least=1)
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_go_to_the_first_word(spark):
    text = " ".join(["barca"] * 6 + ["carca"] * 6 + ["darca"] * 3)
    want = check(spark, [(1, text)])
    assert want["darca"][0] == "barca" and want["darca"][3] == 2 and want["barca"][0] is None


def test_one_edit():
    words = ["abcde", "abde", "abXde", "abcdef", "xabcde", "abdce", "abcd", "aaaa", "aaa"]
    length = np.array([len(w) for w in words])
    letters = np.zeros((len(words), length.max()), np.uint8)
    for row, w in zip(letters, words, strict=True):
        row[: len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    keep = (length[i] == length[j]) | (length[i] + 1 == length[j])
    i, j = i[keep], j[keep]
    assert spelling.one_edit(letters, length, i, j).tolist() == [near(words[a], words[b]) for a, b in zip(i, j, strict=True)]
