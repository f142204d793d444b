"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors get one more component, so that all lie on a sphere around the queries' plane and
the largest inner product is the smallest distance. A tree halves its vectors by their
distance from a vantage point. With d the query's distance from it, r the radius of the
half and t the distance of the k-th neighbour so far, the triangle inequality rules the
other half out if |d - r| > t; ``factor`` relaxes that to |d - r| > factor * t. At 1 the
search is exact, below it is faster.

A small tree over a bounded sample deals the vectors to leaves, and each leaf is a shard
or several. Each shard's tree is built once and stored; vectors are shuffled once. Queries
go to their own leaf first, and with the distance of the k-th found there to those other
leaves that the same inequality leaves open.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, save, scratch

#: Vectors of a shard, queries of a block, vectors of a tree's leaf.
SHARD, BLOCK, LEAF = 8000, 2000, 256
#: Vectors that the tree over the leaves is fitted on, and leaves, at most; leaves beyond a shard's size are cut by hash.
SAMPLE, LEAVES = 20_000, 1024
#: Queries searched at once.
TOGETHER = 500
#: Squared distances by matrix product are within this of those by scores added up in order, times the squared norms.
ROUNDING = 1e-9


class Tree:
    """A vantage-point tree over the rows of a matrix."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        #: Distances computed by searches.
        self.looked = 0
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from the first stands at the rim, where distances differ most
        far = rows[np.argmax(((self.x[rows] - self.x[rows[0]]) ** 2).sum(1))]
        d = np.sqrt(((self.x[rows] - self.x[far]) ** 2).sum(1))
        r = np.median(d)
        inner = d < r
        if not inner.any() or inner.all():
            return rows
        return far, r, d[inner].max(), self._grow(rows[inner]), self._grow(rows[~inner])

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, cap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances of the k nearest of each query (-1 and inf where fewer); cap: squared
        distances beyond which nothing is looked for."""
        best = np.full((len(q), k), np.inf)
        rows = np.full((len(q), k), -1)
        norm_q, norm_x = (q * q).sum(1), (self.x * self.x).sum(1)
        cap = np.full(len(q), np.inf) if cap is None else cap

        def bound(at: np.ndarray) -> np.ndarray:
            return factor * np.sqrt(np.minimum(best[at].max(1), cap[at]))

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                self.looked += len(at) * len(node)
                d = np.maximum(norm_q[at, None] + norm_x[node][None] - 2 * q[at] @ self.x[node].T, 0)
                both = np.concatenate((best[at], d), 1)
                which = np.concatenate((rows[at], np.broadcast_to(node, d.shape)), 1)
                top = np.argpartition(both, k - 1, 1)[:, :k]
                best[at], rows[at] = np.take_along_axis(both, top, 1), np.take_along_axis(which, top, 1)
                return
            point, r, inside_to, inside, outside = node
            d = np.sqrt(np.maximum(((q[at] - self.x[point]) ** 2).sum(1), 0))
            near = d < r
            t = bound(at)
            visit(inside, at[near & (d - inside_to <= t)])
            visit(outside, at[~near])
            t = bound(at)
            visit(outside, at[near & (r - d <= t)])
            visit(inside, at[~near & (d - inside_to <= t)])

        visit(self.root, np.arange(len(q)))
        return rows, best

    def within(self, q: np.ndarray, square: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of all pairs whose squared distance is at most the query's."""
        found_q, found_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        norm_q, norm_x = (q * q).sum(1), (self.x * self.x).sum(1)
        t = factor * np.sqrt(square)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                i, j = np.nonzero(norm_q[at, None] + norm_x[node][None] - 2 * q[at] @ self.x[node].T <= square[at, None])
                found_q.append(at[i])
                found_x.append(node[j])
                return
            point, r, inside_to, inside, outside = node
            d = np.sqrt(np.maximum(((q[at] - self.x[point]) ** 2).sum(1), 0))
            visit(inside, at[(d < r) | (d - inside_to <= t[at])])
            visit(outside, at[(d >= r) | (r - d <= t[at])])

        visit(self.root, np.arange(len(q)))
        return np.concatenate(found_q), np.concatenate(found_x)


def in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * x[:, i]
    return total


class Leaves:
    """A vantage-point tree over a sample, whose leaves are numbered."""

    def __init__(self, x: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.count = 0
        self.root = self._grow(x, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        """Nodes by their place in the list, leaves by the complement of their number."""
        if leaves > 1 and len(x) > 1:
            far = x[np.argmax(((x - x[0]) ** 2).sum(1))]
            d = np.sqrt(((x - far) ** 2).sum(1))
            r = float(np.median(d))
            inner = d < r
            if inner.any() and not inner.all():
                at = len(self.nodes)
                self.nodes.append((far, r, 0, 0))
                self.nodes[at] = (far, r, self._grow(x[inner], leaves - leaves // 2), self._grow(x[~inner], leaves // 2))
                return at
        self.count += 1
        return ~(self.count - 1)

    def reached(self, x: np.ndarray, t: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves within t of each row; without t, the leaf that each lies in."""
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def visit(node: int, at: np.ndarray) -> None:
            if not len(at):
                return
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), ~node))
                return
            point, r, inside, outside = self.nodes[node]
            d = np.sqrt(((x[at] - point) ** 2).sum(1))
            visit(inside, at[d < r] if t is None else at[d - r <= t[at]])
            visit(outside, at[d >= r] if t is None else at[r - d <= t[at]])

        visit(self.root, np.arange(len(x)))
        return np.concatenate(rows), np.concatenate(leaves)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """With one more component, so that all have the length of the longest."""
    return np.c_[x, np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(tops: dict[int, Leaves], factor: float | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (first columns: v, dim, most) with its leaf, or with factor its leaves within the column square but for home."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.take(pa.array(np.flatnonzero(dims == dim)))
            x, most = _matrix(part.column("v")), part.column("most").to_numpy()
            if (top := tops.get(int(dim))) is None:
                rows, leaves = np.arange(len(x) if factor is None else 0), np.zeros(len(x) if factor is None else 0, np.int64)
            elif factor is None:
                rows, leaves = top.reached(np.c_[x, np.zeros(len(x))] if "vec_id" in b.schema.names else _lifted(x, most[0]), None)
            else:
                rows, leaves = top.reached(np.c_[x, np.zeros(len(x))], factor * np.sqrt(part.column("square").to_numpy()))
                other = leaves != part.column("leaf").to_numpy()[rows]
                rows, leaves = rows[other], leaves[other]
            part = part.take(pa.array(rows))
            if "leaf" in part.schema.names:
                part = part.drop_columns(["leaf"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves.astype(np.int32))], [*part.schema.names, "leaf"])


def _grown(df: pd.DataFrame) -> pd.DataFrame:
    """A shard's tree over its distinct vectors, with their ids and the length of the longest of all."""
    df = df.sort_values("first", kind="stable")
    x, most = np.stack(df["v"].to_list()), float(df["most"].iat[0])
    named = [np.asarray(i, np.int64) for i in df["ids"]]
    stored = pickle.dumps((Tree(_lifted(x, most)), x, named, most), protocol=5)
    return pd.DataFrame({"dim": df["dim"].iloc[:1], "leaf": df["leaf"].iloc[:1], "salt": df["salt"].iloc[:1], "tree": [stored]})


FOUND = "query_id long, vec_id long, score double"


def _searched(k: int, factor: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns asked (vec_id, v, square) and tree: each query's k nearest of the shard."""
    for b in batches:
        for asked, stored in zip(b.column("asked"), b.column("tree"), strict=True):
            tree, x, named, most = pickle.loads(stored.as_py())
            rows = asked.values
            q, ids, square = _matrix(rows.field("v")), rows.field("vec_id").to_numpy(), rows.field("square").to_numpy()
            for at in range(0, len(q), TOGETHER):
                to = at + TOGETHER
                yield from _ranked(k, factor, tree, x, named, most, q[at:to], ids[at:to], square[at:to])


def _ranked(k: int, factor: float, tree: Tree, x: np.ndarray, named: list[np.ndarray], most: float, q: np.ndarray, q_ids: np.ndarray, square: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest of the distinct vectors x, whose ids are named, by score and then vec_id."""
    count = np.array([len(n) for n in named])

    def picked(i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.repeat(in_order(np.broadcast_to(q[i], (len(near), q.shape[1])), x[near]), count[near])
        pick = np.concatenate([named[n] for n in near]) if len(near) else np.empty(0, np.int64)
        other = pick != q_ids[i]
        return pick[other], score[other]

    wide = np.c_[q, np.zeros(len(q))]
    rows, _ = tree.search(wide, min(len(x), k + 1), factor, square)
    # all that score as much as the k-th so far, of which the smallest ids count
    norm = (q * q).sum(1) + most * most
    square = square.copy()
    for i in range(len(q)):
        score = picked(i, rows[i][rows[i] >= 0])[1]
        if len(score) >= k:
            square[i] = min(square[i], max(norm[i] - 2 * np.partition(score, -k)[-k], 0) + ROUNDING * norm[i])
    found_q, found_x = tree.within(wide, square, factor)
    order = np.argsort(found_q, kind="stable")
    found_x, cut = found_x[order], np.searchsorted(found_q[order], np.arange(len(q) + 1))
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(len(q)):
        pick, score = picked(i, found_x[cut[i] : cut[i + 1]])
        top = np.lexsort((pick, -score))[:k]
        for column, v in zip(out, (np.full(len(top), q_ids[i]), pick[top], score[top]), strict=True):
            column.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _top(most: float, leaves: int):
    return lambda df: pd.DataFrame({"top": [pickle.dumps(Leaves(_lifted(np.stack(df["v"].to_list()), most), leaves), protocol=5)]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product for each query but itself.

    Ties go to the smaller vec_id. With factor 1 the result is exact; below it neighbours
    may be missed, and scores stay exact. ``shard``: about how many distinct vectors a
    tree holds. The tree over the leaves is fitted on at most 20,000 vectors, the first by
    a hash of their values; every vector is indexed.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows with a null id. Rows that repeat an id count as one, the smallest vector by
    component order. Only vectors of the query's length are compared. Empty tables give an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "neighbours")

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return v.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))

    # of equal vectors, only so many with the smallest ids can be among the nearest
    same = Window.partitionBy("v").orderBy("vec_id")
    x = clean(vectors).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    x = x.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumns({"first": F.col("ids")[0], "dim": F.size("v")})
    x = save(x, f"{path}/distinct")
    norm = F.aggregate("v", F.lit(0.0), lambda n, c: n + c * c)
    dims = save(x.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("most")), f"{path}/dims")
    # lengths with more vectors than a shard holds: no more of them than shards
    tops = {}
    for row in dims.where(F.col("n") > shard).collect():
        sample = x.where(F.col("dim") == row.dim).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v")
        tops[row.dim] = pickle.loads(sample.groupBy().applyInPandas(_top(row.most, min(LEAVES, -(-row.n // shard))), "top binary").first().top)

    def leaf(df: DataFrame, by: float | None = None) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "leaf")
        return df.mapInArrow(partial(_dealt, tops, by), f"{schema}, leaf int")

    at = ["dim", "leaf"]
    x = save(leaf(x.join(dims.select("dim", "most"), "dim").select("v", "dim", "most", "ids", "first")), f"{path}/dealt")
    salts = save(x.groupBy(*at).agg(F.ceil(F.count("*") / shard).cast("int").alias("salts")), f"{path}/salts")
    x = x.join(salts, at).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))
    trees = save(x.groupBy(*at, "salt").applyInPandas(_grown, "dim int, leaf int, salt int, tree binary"), f"{path}/trees")

    def search(q: DataFrame, name: str) -> DataFrame:
        """q: vec_id, v, dim, most, square, leaf."""
        q = save(q, f"{path}/{name}-queries")
        blocks = q.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        q = q.join(blocks, at).join(salts, at).select("vec_id", "v", "square", *at, F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), every)
        packs = q.groupBy(*at, "salt", "block").agg(F.collect_list(F.struct("vec_id", "v", "square")).alias("asked"))
        with batches_of(spark, 4):
            return save(packs.join(trees, [*at, "salt"]).select("asked", "tree").mapInArrow(partial(_searched, k, factor), FOUND), f"{path}/{name}")

    asked = clean(queries).withColumn("dim", F.size("v")).join(dims.select("dim", "most"), "dim").select("v", "dim", "most", "vec_id", F.lit(float("inf")).alias("square"))
    asked = save(leaf(asked), f"{path}/asked")
    found = search(asked, "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if tops:
        # the distance of the k-th so far, with room for rounding
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score")
        both = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("norm", norm + F.col("most") * F.col("most"))
        square = F.coalesce(F.greatest(F.col("norm") - 2 * F.col("score"), F.lit(0.0)) + ROUNDING * F.col("norm"), F.lit(float("inf")))
        found = found.union(search(leaf(both.select("v", "dim", "most", "vec_id", square.alias("square"), "leaf"), factor), "others"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
