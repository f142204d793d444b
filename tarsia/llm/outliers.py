"""Quality rules with a robust multivariate outlier test.

Statistics of each text are transformed, and for each language and source a minimum
covariance determinant estimate of their centre and scatter is made over all rows: from
two starts, concentration steps refit mean and covariance to the 3/4 of the rows that are
nearest, which never enlarges the determinant, until it stays. Of the two the one of the
smaller determinant is taken and refit once more to all rows that are near by it. Rows too
far from the centre by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import save, scratch, slices

WINDOW = 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Transformed statistics and the spread below which a difference isn't taken seriously.
#: log words; log word length; log of 1 + symbols, repeated lines, repeated words a hundred words
STATS = {"t1": 0.5, "t2": 0.05, "t3": 0.2, "t4": 0.2, "t5": 0.3}
P = len(STATS)
#: Rows of the estimate's core, and the median of chi-squared with P degrees of freedom.
CORE, MEDIAN = 0.75, 4.3515
#: A row is rejected beyond the distance that so large a share of a normal sample would
#: exceed: the 0.9999 quantile of chi-squared with P degrees of freedom, or if the group's own
#: distances spread more, their median plus TAIL standard deviations, taken from the half to CORE.
FAR, TAIL, QUARTILE = 25.745, 3.719, 0.6745
#: The refit takes rows within the 0.975 quantile of chi-squared.
REFIT = 12.8325
#: Groups of fewer rows are judged by all rows of their language, or if these are too few, by all.
LEAST = 100
#: Concentration ends when no group's log determinant changes by more than this, at the latest after so many steps.
SETTLED, STEPS = 1e-3, 10
#: The floor of the scatter, below which a difference isn't taken seriously.
FLOOR = np.diag(np.square(list(STATS.values())))
#: So many groups' estimates are broadcast; beyond it rows are joined to them by a shuffle, each group in SALT parts.
BROADCAST_GROUPS, SALT = 20_000, 64


def repeat_words(raw: bytes) -> int:
    """Words that lie in windows of eight words found twice or more in the text."""
    words = raw.split()
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (code[i : n + i] ^ (code[i : n + i] >> np.uint64(29)))
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(raw.split()), chars, sum(map(text.count, "#*$%&|<>")), dup, repeat_words(raw)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            cols = list(zip(*[statistics(t.as_py()) for t in b.column(3)], strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "lang", "source", *COUNTS])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


MODEL = "g string, start int, mean array<double>, inverse array<double>, logdet double"


def _model(g: str, start: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    scatter = scatter + FLOOR
    return g, start, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each group to its centre and inverse scatter; a floor keeps flat statistics from counting."""
    for df in frames:
        rows = []
        for row in df.itertuples():
            m = np.array(row.s, float) / row.n
            rows.append(_model(row.g, row.start, m, np.array(row.q, float).reshape(P, P) / row.n - np.outer(m, m)))
        yield pd.DataFrame(rows, columns=["g", "start", "mean", "inverse", "logdet"])


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each group two starts at its medians: statistics by themselves, and with the correlations of their squeezed values."""
    for df in frames:
        rows = []
        for row in df.itertuples():
            centre, wide = np.array(row.centre, float), 1.4826 * np.array(row.spread, float)
            m = np.array(row.s, float) / row.n
            z = np.array(row.q, float).reshape(P, P) / row.n - np.outer(m, m)
            sd = np.sqrt(np.maximum(z.diagonal(), 1e-12))
            corr = z / np.outer(sd, sd)
            np.fill_diagonal(corr, 1.0)
            rows += [_model(row.g, 0, centre, np.diag(wide**2)), _model(row.g, 1, centre, corr * np.outer(wide, wide))]
        yield pd.DataFrame(rows, columns=["g", "start", "mean", "inverse", "logdet"])


def _sums(of: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), F.array(*[F.sum(x) for x in of]).alias("s"), F.array(*[F.sum(x * y) for x in of for y in of]).alias("q")]


def _beside(few: bool, rows: DataFrame, per: DataFrame, *more: str) -> DataFrame:
    """Rows with what their group has; of many groups, each group's rows go to SALT tasks."""
    if few:
        return rows.join(F.broadcast(per), ["g", *more])
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*STATS), F.lit(SALT)).cast("int"))
    return dealt.join(per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["g", "salt", *more]).drop("salt")


def estimate(parts: DataFrame, path: str, few: bool = True) -> DataFrame:
    """(g, mean, inverse, logdet, half, upper): the estimate of each group of rows (g and STATS), and quantiles of its distances.

    few: the groups' estimates may be broadcast. Else each group's rows are dealt to SALT
    tasks, so that a group of very many rows isn't one task's work.
    """
    cols = [F.col(t) for t in STATS]

    beside = partial(_beside, few)
    centre = save(parts.groupBy("g").agg(F.array(*[F.percentile_approx(t, 0.5, 1000) for t in STATS]).alias("centre")), f"{path}/centre")
    spread = [F.percentile_approx(F.abs(t - F.col("centre")[i]), 0.5, 1000) for i, t in enumerate(cols)]
    at = save(beside(parts, centre).groupBy("g").agg(F.first("centre").alias("centre"), F.array(*spread).alias("spread")), f"{path}/spread")
    squeezed = [F.tanh((t - F.col("centre")[i]) / (1.4826 * F.col("spread")[i] + F.lit(floor))) for i, (t, floor) in enumerate(zip(cols, STATS.values(), strict=True))]
    start = beside(parts, at).groupBy("g").agg(F.first("centre").alias("centre"), F.first("spread").alias("spread"), *_sums(squeezed))
    model = save(start.mapInPandas(_starts, MODEL), f"{path}/model-0")
    for i in range(1, STEPS + 1):
        near = beside(parts, model).select("g", "start", *STATS, _distance().alias("d"))
        cut = near.groupBy("g", "start").agg(F.percentile_approx("d", CORE, 1000).alias("cut"))
        core = beside(near, cut, "start").where("d <= cut").groupBy("g", "start").agg(*_sums(cols))
        before, model = model, save(core.mapInPandas(_estimates, MODEL), f"{path}/model-{i}")
        moved = model.join(before.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved <= SETTLED:
            break
    best = model.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
    best = save(best, f"{path}/best")
    half = beside(parts, best).groupBy("g").agg(F.percentile_approx(_distance(), 0.5, 1000).alias("half"))
    near = beside(parts, save(best.join(half, "g"), f"{path}/half")).where(_distance() * _scale() <= REFIT)
    final = save(near.groupBy("g").agg(F.lit(0).alias("start"), *_sums(cols)).mapInPandas(_estimates, MODEL), f"{path}/final")
    at = beside(parts, final).groupBy("g").agg(F.percentile_approx(_distance(), [0.5, CORE], 1000).alias("at"))
    return save(final.join(at, "g").select("g", "mean", "inverse", "logdet", F.col("at")[0].alias("half"), F.col("at")[1].alias("upper")), f"{path}/estimate")


def _scale() -> Column:
    """To the distance of the median row of a normal sample; flat groups have hardly any spread, there the floor counts."""
    return MEDIAN / F.greatest("half", F.lit(1.0))


def _distance() -> Column:
    d = [F.col(t) - F.col("mean")[i] for i, t in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(P):
            total = total + d[i] * d[j] * F.col("inverse")[i * P + j]
    return total


def reject_outliers(docs: DataFrame, far: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, distance, kept.

    distance: squared Mahalanobis distance from the group's centre, scaled so that the
    median row of the group is as far as that of a normal sample. Rows farther than far are
    rejected, by default those in the group's tail of probability 0.0001. Rows that fail
    the base rules are neither estimated from nor kept.

    Null and empty texts have no words and fail. Null languages and sources are groups of
    their own. Repeated rows count and are returned as often as they come; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "outliers")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    stats = save(docs.mapInArrow(_measured, schema), f"{path}/stats")
    hundred = lambda c: F.log1p(100.0 * F.col(c) / F.col("n_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stats.withColumns({"base_failed": failed, "t1": F.log(F.col("n_words") + F.lit(1.0)), "t2": F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1))), "t3": hundred("n_symbols"), "t4": hundred("n_dup_lines"), "t5": hundred("n_repeat_words")})

    fine = stats.where("not base_failed")
    # groups that are too small to be estimated are judged by larger ones, which hold all rows of a language, or all
    size = fine.groupBy("lang", "source").agg(F.count("*").alias("n"))
    tag = lambda c: F.when(F.col(c).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(c)))
    per = size.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    both = save(size.join(per, F.col("lang").eqNullSafe(F.col("l"))), f"{path}/sizes")
    alone, by_lang = F.col("n") >= LEAST, F.col("n_lang") >= LEAST
    count, some_lost = both.agg(F.count("*"), F.max(~alone & ~by_lang)).first()
    own = F.concat_ws("\x1f", tag("lang"), tag("source"))
    g = F.when(alone, own).when(by_lang, tag("lang")).otherwise("*")
    pools = F.array_compact(F.array(F.when(alone, own), F.when(by_lang & (F.col("least") < LEAST), tag("lang")), F.lit("*" if some_lost else None)))
    groups = both.select(F.col("lang").alias("l"), F.col("source").alias("s"), g.alias("g"), pools.alias("pools"))
    few = count <= BROADCAST_GROUPS
    fine = fine.join(F.broadcast(groups) if few else groups, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    fine = save(fine.select("doc_id", *COUNTS, *STATS, "g", "pools"), f"{path}/fine")

    model = estimate(fine.select(F.explode("pools").alias("g"), *STATS), path, few)
    near = _beside(few, fine, model)
    scale = _scale()
    middle = F.sqrt(F.col("half") * scale)
    own = F.pow(middle + TAIL * (F.sqrt(F.col("upper") * scale) - middle) / QUARTILE, 2)
    cut = F.greatest(F.lit(FAR), own) if far is None else F.lit(float(far))
    judged = near.withColumns({"distance": _distance() * scale, "cut": cut})
    judged = judged.select("doc_id", *COUNTS, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= F.col("cut")).alias("kept"))
    rest = stats.where("base_failed").select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.union(rest)
