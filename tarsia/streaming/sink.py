"""The write path as a sink for streams: listings in, catalog tables updated, bad rows set aside.

Tables lie below one folder as Parquet, partitioned by a bucket of their key. A batch reads
and rewrites only the buckets that its keys fall into. It is computed once, from the tables
before it, into a staged copy; publishing that copy can be repeated, so a batch that is
replayed, or was cut off at any point, leaves what one run of it leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.predicates import blank, number
from ..functions.text import canonical_key
from ..operators.ingest import add_stores, merge_products, upsert_offers
from ..sources.catalog import HISTORY, OFFERS, PRODUCTS, STORES, Catalog

#: What a listing brings, as text; the names of a batch's columns.
LISTING = ("name", "category", "store_name", "store_website", "image_url", "search_keywords", "current_price", "old_price", "product_url", "availability", "condition", "listing_type", "data_confidence", "checked_at", "ord")
TABLES = {
    "products": (PRODUCTS, ("category", "canonical_key")),
    "stores": (STORES, ("name",)),
    "offers": (OFFERS, ("product_id", "store_id")),
}
LOGS = {"history": HISTORY, "quarantine": "row string, reason string"}
COMMITS = "state string, batch long"


def fault(row: dict[str, Column]) -> Column:
    """Why a listing can't be saved, null where it can."""
    price = number(row["current_price"])
    return (
        F.when(blank(row["name"]), "missing_name")
        .when(blank(row["category"]), "missing_category")
        .when(blank(row["store_name"]), "missing_store")
        .when(canonical_key(F.coalesce(F.nullif(row["search_keywords"], F.lit("")), row["name"])) == "", "missing_key")
        .when(price.isNull(), "bad_price")
        .when(price <= 0, "price_not_positive")
        .when(~blank(row["old_price"]) & number(row["old_price"]).isNull(), "bad_old_price")
        .when(row["checked_at"].isNotNull() & F.try_to_timestamp(row["checked_at"]).isNull(), "bad_time")
    )


class OfferSink:
    """``spark.readStream...writeStream.foreachBatch(sink)``. ``path`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- tables ---------------------------------------------------------------------------

    def _read(self, name: str, schema: str, more: str = "") -> DataFrame:
        """A table, empty before its first write."""
        whole = schema + (f", {more}" if more else "")
        try:
            return self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)

    def table(self, name: str) -> DataFrame:
        return self._read(name, TABLES[name][0], "bucket int").drop("bucket") if name in TABLES else self._read(name, LOGS[name], "batch long")

    def catalog(self) -> Catalog:
        return Catalog(self.table("products"), self.table("stores"), self.table("offers"), self.table("history").drop("batch"))

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(self.buckets)).cast("int")

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket(name).alias("b")).distinct().collect())  # no more than buckets

    def _part(self, name: str, buckets: list[int]) -> DataFrame:
        return self._read(name, TABLES[name][0], "bucket int").where(F.col("bucket").isin(buckets)).drop("bucket")

    # -- batches ----------------------------------------------------------------------------

    def _is(self, state: str, batch: int) -> bool:
        return not self._read("commits", COMMITS).where((F.col("batch") == batch) & (F.col("state") == state)).isEmpty()

    def _mark(self, state: str, batch: int) -> None:
        self.spark.createDataFrame([(state, batch)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self._is("published", batch_id):
            return
        if not self._is("staged", batch_id):
            self._stage(batch, batch_id)
            self._mark("staged", batch_id)
        self._publish(batch_id)
        self._mark("published", batch_id)

    def _stage(self, batch: DataFrame, batch_id: int) -> None:
        at = f"{self.path}/staged/{batch_id}"

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{at}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{at}/{name}")

        have = set(batch.columns)
        row = {c: (F.col(c) if c in have else F.lit(None)).cast("string") for c in LISTING}
        judged = put("rows", batch.select(*[c.alias(n) for n, c in row.items()], F.to_json(F.struct("*")).alias("row")).withColumn("reason", fault({c: F.col(c) for c in LISTING})))
        put("quarantine", judged.where("reason is not null").select("row", "reason"))
        order = F.coalesce(F.col("ord").try_cast("long"), F.lit(0))
        good = judged.where("reason is null").drop("row", "reason").withColumns({
            "current_price": number(F.col("current_price")), "old_price": number(F.col("old_price")), "checked_at": F.try_to_timestamp("checked_at"), "search_keywords": F.coalesce(F.nullif("search_keywords", F.lit("")), "name"),
            "image_url": F.nullif("image_url", F.lit("")), "ord": F.struct(order.alias("o"), F.xxhash64(*LISTING).alias("h")),
        })
        good = put("good", good.withColumn("canonical_key", canonical_key(F.col("search_keywords"))))
        products = put("products", merge_products(self._part("products", self._touched("products", good)), good.drop("canonical_key")).select(*_names(PRODUCTS)))
        named = good.select(F.col("store_name").alias("name"))
        stores = put("stores", add_stores(self._part("stores", self._touched("stores", named)), good).select(*_names(STORES)))
        rows = good.join(products.select(F.col("id").alias("product_id"), "category", "canonical_key"), ["category", "canonical_key"]).join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_name")
        rows = put("keyed", rows)
        offers, history = upsert_offers(self._part("offers", self._touched("offers", rows)), rows)
        put("offers", offers.select(*_names(OFFERS)))
        fields = {f.name: f.dataType for f in T.StructType.fromDDL(HISTORY)}
        first = F.xxhash64("product_id", "store_id", "checked_at", "price")
        history = history.withColumns({"id": F.concat(F.lit(f"{batch_id}-"), F.hex(first)), "ord": F.lit(batch_id).cast("long")})
        put("history", history.select(*[F.col(c).cast(t).alias(c) if c in history.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()]))

    def _publish(self, batch_id: int) -> None:
        """Put the staged rows in place: whole buckets of tables, and the batch's own partition of logs."""
        at = f"{self.path}/staged/{batch_id}"
        for name, (schema, _) in TABLES.items():
            rows = self.spark.read.schema(schema).parquet(f"{at}/{name}").withColumn("bucket", self._bucket(name))
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        for name, schema in LOGS.items():
            rows = self.spark.read.schema(schema).parquet(f"{at}/{name}").withColumn("batch", F.lit(batch_id).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
