"""Quality classifier learnt from positive and unlabelled documents.

The features of a text are the frequencies of pairs of neighbouring character classes
over the whole text, and how often a word repeats the one before. A linear model minimises
the non-negative unbiased risk: trusted positives, unlabelled web text and an estimated
share of positives in it stand in for the negatives, whose labels are never used.

All unlabelled texts take part: they are dealt by a hash to groups, each group estimates
the share and minimises the risk with some of the positives, and the model is the mean of
the groups' models. Only the positives are a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, save, scratch, slices

#: A document is accepted from this score on.
ACCEPT = 0.3
#: The share of positives that estimates start from, and that stands where none is possible.
PRIOR = 0.7
#: Groups' models that are added up at once.
TOGETHER = 256


def _classes() -> np.ndarray:
    """A class for each byte: letters, capitals, digits, blanks, marks by themselves, lead and other bytes of longer characters."""
    c = np.zeros(256, np.int32)
    n = 1
    for group in (range(97, 123), (10,), (9, 11, 12, 13, 32), range(65, 91), range(48, 58), *((b,) for b in range(33, 127) if not chr(b).isalnum()), range(128, 192), range(192, 256)):
        if group == range(97, 123):
            for b in group:
                c[b] = n
                n += 1
            continue
        for b in group:
            c[b] = n
        n += 1
    return c


CLASS = _classes()
N = int(CLASS.max()) + 1
#: Pairs of classes, and the share of words that repeat the word before.
DIM = N * N + 1


def frequencies(text: str | None) -> np.ndarray:
    """The features of a text: shares of class pairs, and of words equal to the one before."""
    raw = f"\n{text or ''}\n".encode("utf-8", "surrogatepass")
    c = CLASS[np.frombuffer(raw, np.uint8)]
    out = np.bincount(c[:-1] * N + c[1:], minlength=DIM) / (len(c) - 1)
    words = raw.split()
    out[-1] = sum(map(eq, words, words[1:])) / max(1, len(words))
    return out


FEATURES = "key long, idx binary, val binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key and text: the square roots of the features that aren't zero, in half precision."""
    for whole in batches:
        for b in slices(whole):
            idx, val = [], []
            for t in b.column("text"):
                x = frequencies(t.as_py())
                i = np.flatnonzero(x)
                idx.append(i.astype(np.uint16).tobytes())
                val.append(np.sqrt(x[i]).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["key", "idx", "val"])


def _matrix(idx: list[bytes], val: list[bytes]) -> np.ndarray:
    x = np.zeros((len(idx), DIM), np.float32)
    for row, (i, v) in enumerate(zip(idx, val, strict=True)):
        x[row, np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float16)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def nn_pu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 200, rate: float = 0.02, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss (full-batch Adam).

    risk = prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]); where the second
    part would fall below zero, the step climbs it instead.
    """
    w, b = np.zeros(x_p.shape[1], np.float32), 0.0
    m = v = np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        f_p, f_u = x_p @ w + b, x_u @ w + b
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        d_pos, d_neg_p, d_neg_u = -(1 - _sigmoid(f_p)) * prior / len(f_p), -prior * _sigmoid(f_p) / len(f_p), _sigmoid(f_u) / len(f_u)
        d_p, d_u = (d_pos + d_neg_p, d_neg_u) if negative >= 0 else (-d_neg_p, -d_neg_u)
        g = np.append(d_p.astype(np.float32) @ x_p + d_u.astype(np.float32) @ x_u + decay * w, d_p.sum() + d_u.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
    return w, b


def estimated_prior(x_p: np.ndarray, x_u: np.ndarray, rounds: int = 2, steps: int = 40) -> float:
    """The share of positives among unlabelled rows.

    Half of the positives fit a model, and the share is then the mean score of the
    unlabelled rows, from PRIOR on in a few rounds. It is never more than the least ratio
    of unlabelled to other positive rows beyond any of the middle margins of the latter,
    which only positives among the unlabelled would reach as often.
    """
    prior = PRIOR
    if len(x_p) < 20 or len(x_u) < 20:
        return prior
    for _ in range(rounds):
        w, b = nn_pu(x_p[::2], x_u, prior, steps)
        f_p, f_u = np.sort(x_p[1::2] @ w + b), x_u @ w + b
        at = f_p[[len(f_p) * n // 10 for n in range(1, 6)]]
        tails = (f_u[:, None] >= at).mean(0) / (f_p[:, None] >= at).mean(0)
        prior = float(np.clip(min(_sigmoid(f_u).mean(), tails.min()), 0.02, 0.98))
    return prior


@dataclass(frozen=True)
class Model:
    """Feature weights with scaling folded in, bias and the prior that was estimated."""

    weights: list[float]
    bias: float
    prior: float

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(self.weights)
        for whole in batches:
            for b in slices(whole):
                out = []
                for t in b.column(0):
                    out.append(float(_sigmoid(w @ np.sqrt(frequencies(t.as_py())) + self.bias)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "__score"])


#: Margins are made steeper by so much at most: separable groups would have no end. The margin that scores a half stays.
STEEP = 3.0


def calibrated(f_p: np.ndarray, f_u: np.ndarray, prior: float, steps: int = 30) -> tuple[float, float]:
    """Slope and shift of margins that minimise the unbiased risk, which in two dimensions is convex (Newton)."""
    a, c = 1.0, 0.0
    z = np.c_[f_u, np.ones(len(f_u))].astype(float)
    goal = prior * np.array([f_p.mean(), 1.0])
    for _ in range(steps):
        q = _sigmoid(z @ (a, c))
        g = z.T @ q / len(z) - goal
        h = (z * (q * (1 - q))[:, None]).T @ z / len(z) + 1e-4 * np.eye(2)
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, c = a - d[0], c - d[1]
    if a <= 0:
        return 1.0, 0.0
    less = min(1.0, STEEP / a)
    return float(less * a), float(less * c)


def _fit(positives: list[tuple[bytes, bytes]], group: int, steps: int):
    """One group's model, its scaling folded in; ``positives`` are taken in turn by the groups."""

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["key", "idx", "val"], kind="stable")
        number = int(df["grp"].iat[0])
        x_u = _matrix(df["idx"].to_list(), df["val"].to_list())
        n = min(len(positives), group)
        mine = [positives[(number * n + i) % len(positives)] for i in range(n)]
        x_p = _matrix([m[0] for m in mine], [m[1] for m in mine])
        mean, scale = x_u.mean(0), x_u.std(0) + np.float32(1e-4)
        x_u, x_p = (x_u - mean) / scale, (x_p - mean) / scale
        prior = estimated_prior(x_p, x_u)
        w, b = nn_pu(x_p, x_u, prior, steps)
        a, c = calibrated(x_p @ w + b, x_u @ w + b, prior)
        w, b = a * w.astype(float) / scale, a * b + c
        return pd.DataFrame({"grp": [number], "n": [1], "model": [[*w, b - w @ mean, prior]]})

    return fit


def _added(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("grp")
    return pd.DataFrame({"grp": [int(df["grp"].iat[0]) // TOGETHER], "n": [int(df["n"].sum())], "model": [np.sum(np.stack(df["model"].to_list()), 0).tolist()]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int | None = None, group: int = 2000, steps: int = 150) -> Model:
    """Fit on the labels of rows that aren't held out.

    positives: trusted positives (quality 1) that are used at most, chosen by a hash of the
    id. unlabelled: about so many documents stand for web text, chosen by a hash; None for
    all that aren't held out. group: unlabelled documents that one model is fitted on.

    The model depends on the rows alone, not on their order or partitions. Rows with a null
    id are unlabelled text; null labels are ignored; of labels that repeat an id the
    largest counts, and rows that repeat an id are all used. Null and empty texts have
    features as well. Without positives or documents every score is that of the prior.
    Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chance = F.xxhash64(F.lit("fit"), "doc_id")
    good = good.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id", "left_semi")
    good = save(good.select("doc_id", chance.alias("key")).orderBy("key", "doc_id").limit(positives), f"{path}/trusted")
    web = docs.where(~held_out(F.col("doc_id"))).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    n = web.count()
    if unlabelled is not None and unlabelled < n:
        web = web.where(F.pmod(F.xxhash64(F.lit("web"), "key"), F.lit(1 << 30)) < int(unlabelled / n * (1 << 30)))
        n = unlabelled
    groups = max(1, round(n / group))
    none = Model([0.0] * DIM, float(np.log(PRIOR / (1 - PRIOR))), PRIOR)
    with batches_of(spark, 1000):
        trusted = docs.join(F.broadcast(good), "doc_id").select("key", "text").mapInArrow(_features, FEATURES)
        # no more rows than positives, but for repeated ids
        sample = [(bytes(r.idx), bytes(r.val)) for r in trusted.orderBy("key", "idx", "val").limit(positives).collect()]
        if not sample:
            return none
        x = web.mapInArrow(_features, FEATURES).withColumn("grp", F.pmod("key", F.lit(groups)))
        schema = "grp long, n long, model array<double>"
        models = save(x.groupBy("grp").applyInPandas(_fit(sample, group, steps), schema), f"{path}/models")
    level = 0
    while groups > 1:
        level, groups = level + 1, -(-groups // TOGETHER)
        models = save(models.groupBy(F.floor(F.col("grp") / TOGETHER)).applyInPandas(_added, schema), f"{path}/models-{level}")
    row = models.first()
    if row is None:
        return none
    *weights, bias, prior = (np.array(row.model) / row.n).tolist()
    return Model(weights, bias, prior)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1) and predicted (1 from a score of 0.3 on).

    Null and empty texts have a score as well. Repeated rows, extra columns and empty
    tables pass; columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    first = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = T.StructType([*first.schema.fields, T.StructField("__score", T.DoubleType())])
    scored = first.mapInArrow(model.scores, schema)
    return scored.select(*docs.columns, F.col("__score").alias("score"), (F.col("__score") >= ACCEPT).cast("int").alias("predicted"))

