"""The corpus pipeline: reject poor documents, drop repeated lines and near copies, mix sources, pack.

Every stage works on all that the one before kept, and each is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsia.llm.common import save, scratch, table
from tarsia.llm.jaccard import jaccard_components
from tarsia.llm.lines import dedup_lines
from tarsia.llm.mixing import mix_sources
from tarsia.llm.packing import pack_documents
from tarsia.llm.quality import fit_quality, score_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], *names: str) -> DataFrame:
    """What an operator keeps, with the columns of ``docs`` even where it has columns of these names itself."""
    own = {c: f"__own_{c}" for c in names if c in docs.columns}
    back = {v: k for k, v in own.items()}
    return operator(docs.withColumnsRenamed(own)).drop(*own).withColumnsRenamed(back).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, doesn't reject.

    Null and empty texts have a score too. Equal rows fare alike; columns of any name pass.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _aside(docs, lambda d: score_quality(d, model).where("predicted = 1"), "score", "predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more hold; n_chars follows.

    Null texts become empty; no document goes. Equal rows count as documents of their own.
    """
    return _aside(docs, lambda d: dedup_lines(d).withColumn("n_chars", F.length("text").cast("long")), "n_lines", "n_dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that names the group.

    Of rows that repeat an id and its text one stays. Rows without an id or words all stay.
    """
    gone = jaccard_components(docs, count_links=False).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs.doc_id == gone["__gone"], "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")).count().where("count > 1").select("__id", "__text")
    again = save(again, scratch(spark, "repeated"))
    if again.isEmpty():
        return kept
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows are known by a hash of all their columns, so repeated and null ids do no harm; of
    equal rows one stands for all that the mix takes of them. Texts without words go.
    """
    name = F.xxhash64(*docs.columns)
    mixed = mix_sources(docs.select(name.alias("__row"), "text", "source"), id_col="__row")
    taken = mixed.groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").alias("__n"), F.count("*").alias("__rows")).where("__n > 0")
    taken = save(taken, scratch(spark, "taken"))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__copy")).select(*docs.columns)

    named = docs.withColumn("__name", name)
    one = repeated(named.join(taken.where("__rows = 1"), F.col("__name") == F.col("__row")))
    more = taken.where("__rows > 1")
    return one if more.isEmpty() else one.union(repeated(named.join(more, F.col("__name") == F.col("__row")).dropDuplicates(docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null and empty texts are one token."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learning, balanced sampling and tokenizing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    path = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{path}/{i}")
    return docs
