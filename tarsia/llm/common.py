"""Helpers shared by the corpus operators: scratch tables, Arrow iteration, components.

Every intermediate table lies below the folder that the session names in
``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with large values are handed on in slices of about this many bytes.
SLICE_BYTES = 32 << 20
#: The characters that separate words, as in every contract of this package.
SPACE = " \t\n\r\x0b\x0c"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tarsia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While tables are written inside, Arrow batches hold at most so many rows: for rows of large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch of large rows into runs of about ``most`` bytes."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= most:
        yield batch
        return
    step = max(1, int(n * most // batch.nbytes))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def partitions_for(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """Shuffle partitions so that each holds about ``each`` rows, and no fewer than the session asks for, as long as they hold ``least`` rows."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // least)), -(-rows // each), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers (wraps on overflow)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Edges that are contracted at once.
EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, smallest node it reaches by them), in chunks: what hubs add to a chunk stays small."""

    def star(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        low = np.arange(len(nodes))
        while True:
            m = np.minimum(low[x], low[y])
            new = low.copy()
            np.minimum.at(new, low[x], m)
            np.minimum.at(new, low[y], m)
            np.minimum.at(new, x, m)
            np.minimum.at(new, y, m)
            new = new[new]
            if (new == low).all():
                break
            low = new
        far = low != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[low[far]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield star(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))
            held, rows = [], 0
    if rows:
        yield star(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1)))


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches; nodes without edges are absent.

    Edges are contracted to stars within chunks first. Then alternating large-star and
    small-star steps; each round is one written table, nothing is gathered on the driver
    but a count and a checksum.
    """
    n = edges.count()
    near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    e = save(near.coalesce(max(1, -(-n // EDGES))).mapInArrow(_forest, "a long, b long"), f"{path}/edges-0")
    seen = None
    for i in range(1, rounds + 1):
        if n <= EDGES:
            break  # one chunk held them all
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = save(small.union(low.select("a", F.col("m"))).where("a > b").distinct(), f"{path}/edges-{i}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
