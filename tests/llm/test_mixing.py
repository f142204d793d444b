"""Mixing: targets by repeated resharing, taken words near them, reruns alike."""

import random

import pytest

from tarsia.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if rest * weight[s] / w > 2 * sizes[s]}
        if not full:
            return out | {s: rest * weight[s] / w for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
        rest -= sum(out[s] for s in full)
        free -= full
    return out


def made(n=900):
    r = random.Random(9)
    return [(i, " ".join("w" * r.randrange(1, 4) for _ in range(int(r.lognormvariate(3, 1)))), r.choice(["a"] * 6 + ["b", "c", "é", "Z", None])) for i in range(n)]


@pytest.mark.parametrize("block", [20_000, 40])
def test_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = made()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr)
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for doc, source, size, _, _, copies, t in got:
        assert size == len((rows[doc][1] or "").split()) and 0 <= copies <= 2 and t == copies * size
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + t
    want = targets(sizes)
    for _, source, _, source_size, target, _, _ in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source])
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(12, 0.01 * want[s]), s
    assert got == sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "u v", "b"), (5, "w " * 50_000, "c")]
    got = mixing.mix_sources(spark.createDataFrame([(*r, None) for r in rows], SCHEMA)).collect()
    assert len(got) == 6 and sum(r.taken for r in got if r.size == 0) == 0
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
