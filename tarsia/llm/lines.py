"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, save, scratch

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWERED)


class RunStore:
    """Sorted runs of (h1, h2, n, last) by level: a batch is a run of level 0.

    A run is a table bucketed and sorted by its hash, so looking a batch up in the runs
    and merging runs are merge joins and merge aggregations of buckets, without another
    shuffle of what is stored. ``fanout`` runs of a level are compacted into one run of
    the next. n: documents that hold the line; last: the largest id among them.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.recurring: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def absorb(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2, doc): one row for each document and line key."""
        new = self._write(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")))
        batch = self.spark.table(new)
        # lines that no run holds yet can only recur within the batch; the others recur
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run), ["h1", "h2"], "left_anti")
        flagged = batch.select("h1", "h2", "n").join(fresh.select("h1", "h2", F.lit(True).alias("fresh")), ["h1", "h2"], "left")
        self.recurring.append(self._write(flagged.where("fresh is null or n > 1").select("h1", "h2")))
        self.levels = self.levels or [[]]
        self.levels[0].append(new)
        self.compact()

    def _merged(self, runs: list[str]) -> DataFrame:
        df = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).select("h1", "h2", F.col("n").alias("n_"), F.col("last").alias("last_"))
            df = df.join(other, ["h1", "h2"], "full_outer")
            df = df.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("last", "last_").alias("last"))
        return df

    def compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(self._merged(level)))
                level.clear()

    def frequent(self, documents: int) -> DataFrame:
        """(h1, h2, n, last) of the lines that at least so many documents hold."""
        again = self.spark.table(self.recurring[0])
        for r in self.recurring[1:]:
            again = again.join(self.spark.table(r), ["h1", "h2"], "full_outer")
        return self._merged(self.runs()).join(again, ["h1", "h2"], "left_semi").where(F.col("n") >= documents)


def dedup_lines(docs: DataFrame, documents: int = 3, chars: int = 20, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text without its repeated lines, and n_lines and n_dropped.

    A line's key is the line without blanks at both ends, with A-Z lowered. Keys of at
    least ``chars`` code points that at least ``documents`` rows hold lose all their lines
    but those in the row with the largest id. Other lines stay, in order, joined by \\n.

    Null texts count as empty: one empty line, kept. Each row is a document: repeated rows
    count each, and all rows with the largest id keep the line. A null id is smaller than
    any other. An empty table gives an empty result. Other columns pass through; ones
    named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    path = scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)

    def hashes(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    keys = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.filter(F.transform(cut, hashes), lambda h: h.isNotNull()))).alias("h"))
    keys = keys.select("h.h1", "h.h2", "doc", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch"))
    keys.write.partitionBy("batch").parquet(f"{path}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{path}/keys")
    store = RunStore(spark, path)
    for i in range(batches):
        store.absorb(keys.where(F.col("batch") == i).select("h1", "h2", "doc"))
    often = save(store.frequent(documents).select("h1", "h2", "last"), f"{path}/often")
    hits = keys.join(often, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__hits"))
    hits = save(hits, f"{path}/hits")
    for run in store.runs() + store.recurring:
        spark.sql(f"DROP TABLE IF EXISTS {run}")
    named = docs.withColumns({"__lines": cut})
    got = named.join(hits.withColumnRenamed("doc", "__doc"), F.col(id_col).eqNullSafe(F.col("__doc")), "left")
    kept = F.when(F.col("__hits").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.coalesce(F.array_contains(F.col("__hits"), hashes(x)), F.lit(False))))
    got = got.withColumns({"__kept": kept}).withColumns({text_col: F.array_join("__kept", "\n"), "n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")})
    return got.select(*docs.columns, "n_lines", "n_dropped")
