"""Hard negatives against scores of all pairs, and the bounds against the scores."""

import math

import numpy as np
import pytest

from tarsia.llm.hard_negatives import Codes, hard_negatives, rotation

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, v string, dim int"


def brute(rows, anchors, scale=256, positives=5, negatives=3):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def clean(rows):
        best = {}
        for i, v, label in rows:
            if i is not None and label is not None and usable(v):
                x = ([math.floor(scale * c) for c in v], label)
                best[i] = min(best.get(i, x), x)
        return best

    table, out = clean(rows), []
    for a, (q, label) in clean(anchors).items():
        score = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, (v, _) in table.items() if i != a and len(v) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if table[i][1] == label][:positives]:
            fit = [i for i in order if table[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:negatives])]
    return sorted(out)


def run(spark, rows, anchors, **how):
    df = lambda rs: spark.createDataFrame([(i, v, label, "x", "y", 3) for i, v, label in rs], SCHEMA)
    got = hard_negatives(df(rows), df(anchors), **how).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize(("dim", "seed"), [(16, 1), (3, 2), (70, 3)])
def test_all_pairs(spark, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    rows = [(int(i), (centres[i % 6] + 0.8 * r.standard_normal(dim)).tolist(), int(i % 4)) for i in range(260)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(12)]  # ties
    anchors = [x for x in rows if x[0] % 9 == 0]
    assert run(spark, rows, anchors, shard=50, block=7) == brute(rows, anchors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.6, 0.1], 1), (4, None, 1), (5, [1.0, nan], 1), (6, [inf, 0.0], 1), (7, [1.0, None], 1), (8, [0.5, 0.0], None), (None, [0.7, 0.0], 1), (9, [0.0, 0.0], 1), (10, [0.0, 0.0], 0), (3, [0.7, 0.1], 1), (11, [1.0], 1), (12, [], 1), (13, [], 0), (14, [0.7, 0.0], 2), (15, [0.7, 0.0], 3), (16, [-1.0, 0.0], 0)]
    assert run(spark, rows, rows) == brute(rows, rows)
    assert run(spark, rows, []) == [] and run(spark, [], rows) == [] and run(spark, [], []) == []


def test_repeated_rows_count_once(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.8, 0.0], 1)]
    assert run(spark, rows * 3, rows[:1] * 2) == [(1, 2, 1, 3, 65536, 52224)]


def test_large_components_are_scored_exactly(spark):
    rows = [(1, [1.5e5, 1.25], 0), (2, [1.5e5, 2.25], 0), (3, [1.2e5, 3.75], 1)]
    assert run(spark, rows, rows[:1]) == brute(rows, rows[:1])


@pytest.mark.parametrize("dim", [1, 5, 64, 130])
def test_bounds_hold_scores(dim):
    r = np.random.default_rng(dim)
    x = np.floor(256 * r.standard_normal((300, dim)))
    x[0] = 0
    q = np.floor(256 * r.standard_normal((20, dim)))
    q[1] = 0
    turn = rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    low, high = Codes(x, turn).bounds(q @ turn)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    trivial = 2 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
    assert dim == 1 or (high - low).mean() < 0.8 * trivial.mean()
