"""Tables for looking up a few keys: sorted by the key, with a bloom filter of it in each row group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: so much is read for a key that is there, at least.
ROW_GROUP = 8 << 20


def write_keyed(rows: DataFrame, path: str, key: str, then: tuple[str, ...] = (), row_group: int = ROW_GROUP) -> None:
    """Write rows as Parquet for lookups by ``key``.

    Rows are dealt by ranges of the key, and of the columns of ``then`` within it, so a key
    with very many rows lies in several files. Minimum and maximum rule out row groups of
    other ranges, the filter those that lack a key within their range.
    """
    order = [key, *then]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(row_group)).mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, schema: str, key: str, values: list[str]) -> DataFrame:
    """Rows of the keys asked for, which reach the scan as a filter."""
    return spark.read.schema(schema).parquet(path).where(F.col(key).isin(sorted(set(values))))
