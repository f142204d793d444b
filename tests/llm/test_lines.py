"""Line dedup against a plain reading of the contract, whatever the batches and fan-out."""

import random

import pytest

from tarsia.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, lang string"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = {}
    for i, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(i)
    out = []
    for doc, text in rows:
        kept = []
        cut = (text or "").split("\n")
        for x in cut:
            own = holders.get(key(x), [])
            last = max((rows[i][0] for i in own if rows[i][0] is not None), default=None)
            if len(own) < 3 or doc == last:
                kept.append(x)
        out.append((doc, "\n".join(kept), len(cut), len(cut) - len(kept)))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "clash", "x") for d, t in rows], SCHEMA)
    got = lines.dedup_lines(df, **more)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == brute(rows)


def made():
    r = random.Random(3)
    pool = [f"Some shared line with the number {i} é" for i in range(12)] + ["short", "", "  ", "exactly twenty chars"]
    dress = lambda x: r.choice(["", " ", "\t"]) + r.choice([str.upper, str.lower, str])(x) + r.choice(["", "\r", " "])
    return [(i, "\n".join(dress(r.choice(pool)) if r.random() < 0.6 else f"own line of document {i} {r.random()}" for _ in range(r.randrange(8)))) for i in range(60)]


@pytest.mark.parametrize("batches", [1, 7])
def test_brute_force(spark, batches):
    check(spark, made(), batches=batches)


def test_edges(spark):
    x = "a line of twenty-one ch"
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (4, x), (5, f"{x}\n{x}"), (6, x), (6, x), (None, x), (8, "y" * 100_000 + "\n" + x)])
    check(spark, [(None, x), (None, x), (None, x)])
    check(spark, [])
