"""The catalog's relations, and their view over star-schema tables.

products (id, name, category, image_url, search_keywords, canonical_key, brand), stores
(id, name, website), offers (one row a product and store), history (one row an observed
price, with ``ord``, a total order of arrival).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import blank
from ..functions.text import canonical_key

PRODUCTS = "id string, name string, category string, image_url string, search_keywords string, canonical_key string, brand string"
STORES = "id string, name string, website string"
OFFERS = "id string, product_id string, store_id string, current_price double, old_price double, product_url string, availability string, condition string, listing_type string, data_confidence string"
HISTORY = "id string, product_id string, store_id string, price double, checked_at timestamp, condition string, listing_type string, data_confidence string, ord long"

#: Arrival of a line item; the keys alone aren't unique.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")


@dataclass
class Catalog:
    products: DataFrame
    stores: DataFrame
    offers: DataFrame
    history: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> Catalog:
        """Native tables: one Parquet table each below ``folder``."""
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
        return cls(read("products", PRODUCTS), read("stores", STORES), read("offers", OFFERS), read("history", HISTORY))

    @classmethod
    def from_rows(cls, spark: SparkSession, products: list = (), stores: list = (), offers: list = (), history: list = ()) -> Catalog:
        """Dictionaries with any of the columns; absent ones are null."""

        def frame(rows: list, schema: str) -> DataFrame:
            names = [part.split()[0] for part in schema.split(", ")]
            return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

        history = [{"ord": i} | r for i, r in enumerate(history)]
        return cls(frame(products, PRODUCTS), frame(stores, STORES), frame(offers, OFFERS), frame(history, HISTORY))

    @cached_property
    def columns(self) -> dict[str, list[str]]:
        return {n: getattr(self, n).columns for n in ("products", "stores", "offers", "history")}


class StarCatalog(Catalog):
    """Parts are products, suppliers are stores, line items are observed prices."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        part, supplier, items = read("part"), read("supplier"), read("lineitem")
        products = part.select(
            F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("image_url"),
            F.concat_ws(" ", "p_brand", "p_type").alias("search_keywords"), canonical_key(F.col("p_name")).alias("canonical_key"), F.col("p_brand").alias("brand"),
        )
        stores = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("website"))
        full = F.col("l_extendedprice") / F.col("l_quantity")
        confidence = F.when(F.col("l_returnflag") == "N", "alta").when(F.col("l_returnflag") == "A", "media").otherwise("bassa")
        history = items.select(
            F.col("l_partkey").cast("string").alias("product_id"), F.col("l_suppkey").cast("string").alias("store_id"), (full * (1 - F.col("l_discount"))).alias("price"), full.alias("list_price"),
            F.col("l_shipdate").alias("checked_at"), F.when(F.col("l_linestatus") == "O", "new").otherwise("used").alias("condition"), F.lit(None).cast("string").alias("listing_type"),
            confidence.alias("data_confidence"), F.struct(*ARRIVAL).alias("ord"),
        )
        last = history.groupBy("product_id", "store_id").agg(F.max_by(F.struct("price", "list_price", "condition", "listing_type", "data_confidence"), "ord").alias("x"))
        offers = last.select(
            F.concat_ws("-", "product_id", "store_id").alias("id"), "product_id", "store_id", F.col("x.price").alias("current_price"), F.col("x.list_price").alias("old_price"), F.lit(None).cast("string").alias("product_url"),
            F.lit("available").alias("availability"), "x.condition", "x.listing_type", "x.data_confidence",
        )
        super().__init__(products, stores, offers, history.drop("list_price"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Incoming listings from a JSON file: a list, or an object with a list of candidates."""
    df = spark.read.option("multiLine", True).json(path)
    if "candidates" in df.columns:
        return df.select(F.explode("candidates").alias("c")).select("c.*")
    if df.columns in ([], ["_corrupt_record"]):
        raise ValueError("expected a list of candidates or an object that holds one")
    return df


def by_ids(df: DataFrame, ids: list[str | None], id_col: str = "id") -> DataFrame:
    """Rows of the ids asked for, once each, in the order asked for; blank ids are ignored."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(list(ids),)], "ids array<string>").select(F.posexplode("ids").alias("pos", "want")).where(~blank(F.col("want")))
    asked = asked.groupBy("want").agg(F.min("pos").alias("pos"))
    # the ids asked for reach the scan before rows that repeat an id are reduced
    some = df.join(F.broadcast(asked.select(F.col("want").alias(id_col))), id_col, "left_semi")
    rows = some.groupBy(id_col).agg(F.max(F.struct(*[c for c in df.columns if c != id_col])).alias("r"))
    return rows.join(F.broadcast(asked), rows[id_col] == asked["want"]).orderBy("pos").select(id_col, "r.*")


def offers_of(offers: DataFrame, ids: DataFrame) -> DataFrame:
    """Offers of the products in ``ids`` (id), cheapest first within a product."""
    return offers.join(ids.select(F.col("id").alias("product_id")).distinct(), "product_id", "left_semi").orderBy("product_id", F.asc_nulls_last("current_price"), "id")

