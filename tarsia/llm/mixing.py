"""Mixing sources to target weights by balanced sampling with the cube method.

Each document is to be taken target / source size times: the whole part of that for
certain, the rest with that probability. The flight phase moves these probabilities
through the null-space of two constraints, the number of documents and of words, until
all but three documents of a block are decided. What blocks leave, with a
few documents of all sizes, is merged by a tree and moved on; fifteen documents of a source at most are
left to the landing phase.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch

#: Documents of a block.
BLOCK = 20_000
#: Blocks whose rests are merged into one at each step of the tree.
MERGE = 256
#: So many documents, of sizes that halve, stay out of a source's flight for the landing, and so many of a block are handed on.
LANDING, HANDED_ON = 12, 6
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each source of (source, size) rows.

    Sources by code point, null last, take the weights in turn and share ``share`` of all
    sizes; targets stop at ``most`` times the source's size, and the excess is shared anew
    by weight. One row a source goes through the windows here.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    total = total.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    # water-filling: sources by the level at which they are full; those before the first
    # that doesn't fill up stop at their cap
    up = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = total.withColumns({"all": share * F.sum("source_size").over(every), "ws": F.sum("w").over(every), "c0": F.coalesce(F.sum("cap").over(up), F.lit(0.0)), "w0": F.coalesce(F.sum("w").over(up), F.lit(0))})
    total = total.withColumn("open", (F.col("all") - F.col("c0")) / (F.col("ws") - F.col("w0")))
    water = F.max(F.when(F.col("level") > F.col("open"), F.col("open"))).over(every)
    return total.select("source", "source_size", "source_docs", F.when(F.col("level") > F.col("open"), F.least("cap", F.col("w") * water)).otherwise(F.col("cap")).alias("target"))


def _flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities until at most three are fractional; both totals stay."""
    p = p.copy()
    live = [i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE]
    draws = rng.random(len(p) + 3)
    hand, k = [], 0
    for step in range(len(draws)):
        while len(hand) < 3 and k < len(live):
            hand.append(live[k])
            k += 1
        if len(hand) < 3:
            break
        a, b, c = hand
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u, strict=True) if v)
        by = up if draws[step] * (up + down) < down else -down
        rest = []
        for i, v in zip(hand, u, strict=True):
            q = p[i] + by * v
            p[i] = 0.0 if q < EDGE else 1.0 if q > 1 - EDGE else q
            if 0 < p[i] < 1:
                rest.append(i)
        hand = rest
    return p


def _landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide what is left, all ways being tried, so that the words and then the documents come nearest."""
    left = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, docs = ways @ size[left] - p[left] @ size[left], ways.sum(1) - p[left].sum()
    p = p.copy()
    p[left] = ways[np.argmin(np.abs(words) + 0.01 * np.abs(docs))]
    return p


def _spread(size: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of sizes that halve from the largest on: their sums come near any number of words."""
    free = np.ones(len(size), bool)
    for k in range(min(n, len(size))):
        rows = np.flatnonzero(free)
        free[rows[np.argmin(np.abs(size[rows] - size.max() / 2**k))]] = False
    return np.flatnonzero(~free)


def _moved(seed: int, last: bool):
    def move(df: pd.DataFrame) -> pd.DataFrame:
        # large documents first; some stay out of the flight, and are what the landing is left with
        df = df.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size, p = df["size"].to_numpy(float), df["p"].to_numpy(float)
        out = _spread(size, LANDING if last else HANDED_ON)
        fly = np.setdiff1d(np.arange(len(df)), out)
        p[fly] = _flight(p[fly], size[fly], np.random.default_rng([seed, len(df), int(size.sum())]))
        df["p"] = _landing(p, size) if last else p
        return df

    return move


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text; copies: how often the mix takes the document; taken: words so
    taken, copies counted. Each source's taken words differ from its target by at most a
    few of its smallest documents. Reruns over the same rows agree.

    Null and empty texts have size 0 and are never taken. A null source is a source of its
    own, after all others. Equal rows are exchangeable; null ids are allowed. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "mixing")
    size: Column = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sizes = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), f"{path}/sizes")
    targets = save(source_targets(sizes, weights, share, most), f"{path}/targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    blocks = F.ceil(F.col("source_docs") / BLOCK)
    rows = rows.withColumns({"base": F.when(F.col("size") > 0, F.floor(rate + EDGE)).otherwise(0).cast("long"), "rate": rate})
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.col("base"))).otherwise(0.0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), blocks).cast("long"))
    rows = save(rows.select("doc_id", "source", "size", "source_size", "target", "base", "p", "block"), f"{path}/level-0")
    schema = rows.schema
    done, level = [rows.where(f"p <= {EDGE}").withColumn("p", F.lit(0.0))], 0
    rows = rows.where(f"p > {EDGE}")
    most_blocks = int(targets.agg(F.max(F.ceil(F.col("source_docs") / BLOCK))).first()[0] or 1)
    while True:
        last = most_blocks == 1
        level += 1
        out = save(rows.groupBy("source", "block").applyInPandas(_moved(seed, last), schema), f"{path}/level-{level}")
        done.append(out.where("p = 0 or p = 1"))
        if last:
            break
        rows = out.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / MERGE))
        most_blocks = -(-most_blocks // MERGE)
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("long")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
