"""An inverted index of trigrams for searching terms inside of names, keywords and categories.

Postings (bucket, gram, id) are written as Parquet, partitioned by a hash of the gram and
sorted by it, so a search reads the few row groups of the grams it asks for. A term is
looked up by its rarest grams; what the postings leave is checked against the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieve import CANDIDATES, asked_terms, holds_term

GRAM, RAREST = 3, 3
FIELDS = ("name", "search_keywords", "category")
POSTINGS, SIZES = "bucket int, gram string, id string", "bucket int, gram string, n long"


def _grams(c: Column) -> Column:
    """All runs of three characters of the lower-cased text."""
    c = F.lower(F.coalesce(c, F.lit("")))
    at = F.when(F.length(c) >= GRAM, F.sequence(F.lit(1), F.length(c) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(c, i, F.lit(GRAM)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class TermIndex:
    """A written index. ``buckets`` grows with the products: about one for each hundred megabytes of postings."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    @classmethod
    def build(cls, products: DataFrame, path: str, buckets: int = 8) -> TermIndex:
        """Index the products' texts below ``path``, a folder that driver and executors share.

        A gram that most products hold is spread over several files of its bucket: rows
        are dealt by range of gram and id.
        """
        grams = F.array_distinct(F.concat(*[_grams(F.col(f)) for f in FIELDS]))
        rows = products.where("id is not null").select(F.explode(grams).alias("gram"), "id").withColumn("bucket", _bucket(F.col("gram"), buckets))
        dealt = rows.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        index = cls(products.sparkSession, path, buckets)
        sizes = index.postings.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        sizes.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/sizes")
        return index

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def _of(self, table: DataFrame, grams: list[str]) -> DataFrame:
        """Rows of some grams: partitions and row groups without them aren't read."""
        at = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), self.buckets).alias("b")).distinct()
        return table.where(F.col("bucket").isin([r.b for r in at.collect()]) & F.col("gram").isin(grams))

    def rarest(self, terms: list[str]) -> dict[str, list[str] | None]:
        """Of each term its rarest grams; none for a term that is too short to have one, an empty list if nothing holds it."""
        grams = {t: list(dict.fromkeys(t.lower()[i : i + GRAM] for i in range(len(t) - GRAM + 1))) for t in terms}
        every = sorted({g for gs in grams.values() for g in gs})
        if not every:
            return dict.fromkeys(terms)
        sizes = self._of(self.spark.read.schema(SIZES).parquet(f"{self.path}/sizes"), every)
        n = {r.gram: r.n for r in sizes.collect()}  # at most as many as the terms have characters
        return {t: None if not gs else sorted(gs, key=lambda g: (n[g], g))[:RAREST] if all(g in n for g in gs) else [] for t, gs in grams.items()}

    def ids(self, terms: list[str]) -> DataFrame | None:
        """(id) of the products that may hold one of the terms; None if a term is too short for the index."""
        grams = self.rarest(terms)
        if any(g is None for g in grams.values()):
            return None
        found = [self._of(self.postings, g).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(g)).select("id") for g in grams.values() if g]
        return reduce(DataFrame.union, found).distinct() if found else self.postings.select("id").limit(0)

    def candidates(self, products: DataFrame, terms: list[str], categories: list[str] = (), limit: int = CANDIDATES) -> DataFrame:
        """What ``retrieve.candidates`` gives for these terms; ``products`` are those of the index.

        Terms of fewer than three characters have no gram: with one of them all products are looked at.
        """
        terms = asked_terms(terms)
        if not terms:
            return products.limit(0)
        ids = self.ids(terms)
        rows = products if ids is None else products.join(ids, "id", "left_semi")
        if categories:
            rows = rows.where(F.col("category").isin(*categories))
        return rows.where(holds_term(terms)).orderBy("name", "id").limit(min(CANDIDATES, limit))
