"""Lookups by key read few row groups."""

from pyspark.sql import functions as F

from tarsia.sources.keyed import lookup, write_keyed

SCHEMA = "product_id string, store_id string, price double"


def read(df):
    """Rows that the scan has handed on, and those found."""
    plan = df._jdf.queryExecution().executedPlan()
    n = df._jdf.collectToPython() and plan.collectLeaves().head().metrics().get("numOutputRows").get().value()
    return n, df.count()


def test_few_row_groups_are_read(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.format_string("p%06d", F.col("id") * 2 % (n // 4)).alias("product_id"), (F.col("id") % 7).cast("string").alias("store_id"), F.rand(1).alias("price"))
    path = f"file://{tmp_path}/keyed"
    write_keyed(rows, path, "product_id", then=("store_id",), row_group=64 << 10)
    there, found = read(lookup(spark, path, SCHEMA, "product_id", ["p000010", "p000010"]))
    assert found == rows.where("product_id = 'p000010'").count() > 0 and there < n // 10
    # within the range of a row group, but in none: the filter says so
    gone, none = read(lookup(spark, path, SCHEMA, "product_id", ["p000011"]))
    assert none == 0 and gone == 0
    plan = lookup(spark, path, SCHEMA, "product_id", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(product_id, [a,b])]" in plan


def test_hot_keys_lie_in_several_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 < 3, "hot").otherwise(F.col("id").cast("string")).alias("product_id"), F.col("id").cast("string").alias("store_id"), F.lit(1.0).alias("price"))
    path = f"file://{tmp_path}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        write_keyed(rows, path, "product_id", then=("store_id",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = lookup(spark, path, SCHEMA, "product_id", ["hot"])
    assert got.count() == 30_000
    assert spark.read.parquet(path).where("product_id = 'hot'").select(F.input_file_name().alias("f")).distinct().count() > 1
