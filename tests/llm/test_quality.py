"""The classifier on held-out labels, its inputs, and odd input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tarsia.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    assert scored.columns == [*docs.columns, "score", "predicted"]
    rows = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # labels of held-out rows are never seen
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, flipped) == model


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", None), (2, "y " * 100_000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    assert 0 < model.prior < 1
    assert quality.score_quality(docs, model).count() == 4 and quality.score_quality(docs.limit(0), model).count() == 0


def test_order_partitions_and_clashing_columns(spark):
    """The model depends on rows alone; columns named like its own don't disturb it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, group=40, steps=20)
    more = docs.withColumns({"y": F.lit(1), "key": F.lit("k"), "quality": F.lit(0), "grp": F.lit(3), "idx": F.lit(0)})
    again = quality.fit_quality(more.orderBy(F.rand()).repartition(7), labels.withColumn("text", F.lit("z")).repartition(3), group=40, steps=20)
    assert again == model
    assert quality.fit_quality(docs, labels, unlabelled=50, group=40, steps=5).prior > 0


def test_gradient():
    """The minimiser's risk against plain arithmetic, with and without the part that is kept from below zero."""
    r = np.random.default_rng(2)
    x_p, x_u = r.normal(1, 1, (60, 3)), r.normal(0, 1, (80, 3))
    loss = lambda f: np.log(1 + np.exp(-f))

    def risk(w, b, prior):
        f_p, f_u = x_p @ w + b, x_u @ w + b
        return prior * loss(f_p).mean() + max(0, loss(-f_u).mean() - prior * loss(-f_p).mean())

    for prior in (0.2, 0.5, 0.8):
        w, b = quality.nn_pu(x_p.astype(np.float32), x_u.astype(np.float32), prior, steps=800, decay=0.0)
        least = risk(w, b, prior)
        near = min(risk(w + d[:3], b + d[3], prior) for d in r.normal(0, 0.3, (300, 4)))
        assert least < risk(np.zeros(3), 0.0, prior) and least < near + 0.02


def test_estimated_prior():
    r = np.random.default_rng(3)
    for share in (0.5, 0.85):
        n = int(2000 * share)
        good, bad = r.normal(1.2, 1, (800 + n, 6)).astype(np.float32), r.normal(-1.2, 1, (2000 - n, 6)).astype(np.float32)
        assert abs(quality.estimated_prior(good[:800], np.r_[good[800:], bad]) - share) < 0.1


def test_risk_is_kept_from_below():
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 1, (400, 5)).astype(np.float32), r.normal(-1, 1, (400, 5)).astype(np.float32)
    w, b = quality.nn_pu(good[:200], np.r_[good[200:], bad[:200]], 0.5)
    assert ((bad[200:] @ w + b) < 0).mean() > 0.85 and ((good @ w + b) > 0).mean() > 0.85
