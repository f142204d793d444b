"""Hard negatives by rotated one-bit codes with stored alignment.

A random rotation spreads each vector over its components, of which a row keeps the signs,
its norm and how well the vector of signs is aligned with it. The anchors are rotated too
and their components rounded to four bits, so that the inner product of an anchor with a
code is a few popcounts. What the code and the rounding leave out is bounded by
Cauchy-Schwarz: with x/|x| = a c + sqrt(1 - a^2) e, e a unit vector orthogonal to the code
c, and the anchor q = q' + r,

    <q, x>/|x| lies within sqrt(1 - a^2) sqrt(|q'|^2 - <q', c>^2) + |r| of a <q', c>.

The bounds are certain, not likely: a row is scored, in integers, unless its interval shows
that it cannot be among the rows asked for. Results are therefore exact.

Anchors against rows is a grid: blocks of anchors meet shards of rows, one pair in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch

#: Rows of a shard, anchors of a block, anchors whose intervals are held at once.
SHARD, BLOCK, TOGETHER = 8192, 2048, 64
LEVELS = 16
#: Room for rounding in the bounds, times the norms.
ROUNDING = 1e-9


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Codes:
    """What is kept of rows: signs, norm, alignment."""

    def __init__(self, x: np.ndarray, turn: np.ndarray) -> None:
        y = x @ turn
        self.dim = x.shape[1]
        self.norm = np.sqrt((x * x).sum(1))
        self.bits = _words(y > 0)
        self.ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        # <c, y>/|y| with c the signs over sqrt(dim)
        self.align = np.abs(y).sum(1) / (np.where(self.norm > 0, self.norm, 1) * np.sqrt(max(self.dim, 1)))
        self.align = np.minimum(self.align, 1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each rotated anchor with each row."""
        low = q.min(1, initial=0)
        step = (q.max(1, initial=0) - low) / (LEVELS - 1)
        level = np.where(step[:, None] > 0, np.rint((q - low[:, None]) / np.where(step > 0, step, 1)[:, None]), 0).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * level
        left = np.sqrt(((q - rounded) ** 2).sum(1))
        square = (rounded * rounded).sum(1)
        common = np.zeros((len(q), len(self.norm)), np.int64)
        for j in range(LEVELS.bit_length() - 1):
            plane = _words((level >> j) & 1)
            for w in range(plane.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(np.int64) << j
        # sum over components of +-(low + step * level)
        signed = step[:, None] * (2 * common - level.sum(1, dtype=np.int64)[:, None]) + low[:, None] * (2 * self.ones - self.dim)
        s = signed / np.sqrt(max(self.dim, 1))
        spread = np.sqrt(np.maximum(1 - self.align**2, 0)) * np.sqrt(np.maximum(square[:, None] - s * s, 0)) + left[:, None]
        room = ROUNDING * np.sqrt((q * q).sum(1))[:, None] * self.norm + ROUNDING
        middle, spread = self.align * s * self.norm, spread * self.norm + room
        return middle - spread, middle + spread


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with one anchor."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1]
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    return (whole * np.array([int(c) for c in q], object)).sum(1).astype(np.int64)


def _matrix(v: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(e, np.float64) for e in v.to_list()])
    return x if x.shape[1] else np.zeros((len(x), 1))


def _at_least(values: np.ndarray, k: int) -> float:
    """The k-th largest, or no bound."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _cell(pick: Callable, columns: list[str], _key: tuple, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """One block of anchors against one shard of rows."""
    out: list[tuple] = []
    if len(rows) and len(anchors):
        rows = rows.sort_values("vec_id")
        x, q = _matrix(rows["v"]), _matrix(anchors["v"])
        turn = rotation(x.shape[1])
        codes, turned = Codes(x, turn), q @ turn
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for at in range(0, len(q), TOGETHER):
            low, high = codes.bounds(turned[at : at + TOGETHER])
            for i in range(len(low)):
                out += pick(anchors.iloc[at + i], low[i], high[i], ids, labels, lambda of, to=q[at + i]: _exact(x[of], to))
    return pd.DataFrame(out, columns=columns)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _positives(k: int, anchor: pd.Series, low, high, ids, labels, score) -> list[tuple]:
    same = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
    same = same[high[same] >= _at_least(low[same], k)]
    s = score(same)
    return [(anchor["vec_id"], int(ids[same[b]]), int(s[b])) for b in _best(ids[same], s, k)]


def _negatives(k: int, least: int, most: int, anchor: pd.Series, low, high, ids, labels, score) -> list[tuple]:
    other = np.flatnonzero(labels != anchor["label"])
    low, high = low[other], high[other]
    # of each positive: the scores allowed, and the rows whose intervals leave them a chance
    chances = []
    for p in anchor["positives"]:
        s = int(p["score"])
        start, end = -(-least * s // 100), most * s // 100
        if start > end:
            continue
        sure = low[(low >= start) & (high <= end)]
        chances.append((p, start, end, np.flatnonzero((high >= max(start, _at_least(sure, k))) & (low <= end))))
    if not chances:
        return []
    some = np.unique(np.concatenate([c for *_, c in chances]))
    exact = np.zeros(len(other), np.int64)
    exact[some] = score(other[some])
    out = []
    for p, start, end, c in chances:
        c = c[(exact[c] >= start) & (exact[c] <= end)]
        out += [(anchor["vec_id"], int(p["id"]), int(p["score"]), int(ids[other[c[b]]]), int(exact[c[b]])) for b in _best(ids[other[c]], exact[c], k)]
    return out


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are integer inner products. An anchor's
    positives are the ``positives`` other rows of its label with the highest scores; for
    each, the ``negatives`` rows of other labels with the highest scores from ``least`` to
    ``most`` hundredths of the positive's are returned, ranked from 1. Ties go to the
    smaller id. A negative positive score allows none, one of zero those that score zero.

    Rows without an id, label or vector, or with a null or non-finite component, take no part; zero
    vectors do. Of rows that repeat an id, the one with the smallest vector counts, then
    the smallest label. Only vectors of the anchor's length are compared. Scores must fit
    a long. Empty tables give an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    path = scratch(spark, "negatives")

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
        v = v.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * float(scale)).cast("double")).alias("v"))
        return v.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.label", "x.v", F.size("x.v").alias("dim"))

    x = save(clean(rows), f"{path}/rows")
    q = save(clean(anchors), f"{path}/anchors")

    def pieces(df: DataFrame, each: int, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") / each).cast("int").alias(name))

    grid = save(pieces(x, shard, "shards").join(pieces(q, block, "blocks"), "dim"), f"{path}/grid")

    def met(q: DataFrame, pick: Callable, schema: str) -> DataFrame:
        place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = x.join(grid, "dim").select("dim", place("shards").alias("shard"), every("blocks").alias("block"), "vec_id", "label", "v")
        right = q.join(grid, "dim").select("dim", every("shards").alias("shard"), place("blocks").alias("block"), *[c for c in q.columns if c != "dim"])
        key = ["dim", "shard", "block"]
        columns = [c.split()[0] for c in schema.split(", ")]
        return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(partial(_cell, pick, columns), schema)

    def first(found: DataFrame, by: list[str], score: str, then: str, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), then))).where(F.col("rank") <= k)

    found = save(met(q, partial(_positives, positives), "anchor_id long, id long, score long"), f"{path}/positives")
    best = first(found, ["anchor_id"], "score", "id", positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    found = met(save(q.join(best, "vec_id"), f"{path}/asked"), partial(_negatives, negatives, least, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = first(save(found, f"{path}/negatives"), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
