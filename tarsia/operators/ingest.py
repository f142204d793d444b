"""The write path: products, stores and offers by key, and a history row only when a price changes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import sellable_listing
from ..functions.text import canonical_key
from ..sources.catalog import Catalog


def price_changes(log: DataFrame, keys: tuple[str, ...] = ("product_id", "store_id"), order: str = "ord") -> DataFrame:
    """Rows of a full log at which the price differs from the row before of their key; exact, first rows included."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag("price").over(w)
    rows = log.withColumns({"previous_price": prev, "__n": F.row_number().over(w)})
    return rows.where((F.col("__n") == 1) | ~F.col("previous_price").eqNullSafe(F.col("price"))).drop("__n")


def merge_products(products: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get or insert by category and canonical key. Keywords are overwritten, an image is filled in only if there is none.

    Several incoming rows of a key count in their order (``ord``); ids of new products
    derive from the key.
    """
    key = canonical_key(F.coalesce("search_keywords", "name"))
    new = incoming.withColumn("canonical_key", key).groupBy("category", "canonical_key").agg(F.min_by("name", "ord").alias("n_name"), F.max_by("search_keywords", "ord").alias("n_keywords"), F.min_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("ord"))).alias("n_image"))
    both = products.join(new, ["category", "canonical_key"], "full_outer")
    fresh = F.col("id").isNull()
    return both.select(
        F.coalesce("id", F.md5(F.concat_ws("\x1f", "category", "canonical_key"))).alias("id"), F.coalesce("name", "n_name").alias("name"), "category", F.coalesce(F.nullif("image_url", F.lit("")), "n_image").alias("image_url"),
        F.coalesce("n_keywords", F.when(~fresh, F.col("search_keywords"))).alias("search_keywords"), "canonical_key", F.col("brand") if "brand" in products.columns else F.lit(None).cast("string").alias("brand"),
    )


def add_stores(stores: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stores whose exact name isn't known yet are added; known ones stay as they are."""
    new = incoming.groupBy(F.col("store_name").alias("name")).agg(F.min("store_website").alias("website")).join(stores, "name", "left_anti")
    return stores.unionByName(new.select(F.md5("name").alias("id"), "name", "website"))


def upsert_offers(offers: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers after, history rows to append) for rows product_id, store_id, price, ord and offer fields.

    Rows of one key are applied in order: each is compared with the one before it, the
    first with the stored price. A first sight is a change.
    """
    keys = ["product_id", "store_id"]
    stored = offers.select(*keys, F.col("current_price").alias("stored"), F.lit(True).alias("known"))
    rows = incoming.join(stored, keys, "left")
    w = Window.partitionBy(*keys).orderBy("ord")
    n, prev = F.row_number().over(w), F.lag("current_price").over(w)
    rows = rows.withColumns({"n": n, "prev": F.when(n == 1, F.col("stored")).otherwise(prev)})
    first_sight = (F.col("n") == 1) & F.col("known").isNull()
    changed = rows.where(first_sight | ~F.col("prev").eqNullSafe(F.col("current_price")))
    history = changed.select(*keys, F.col("current_price").alias("price"), "checked_at", "condition", "listing_type", "data_confidence")
    fields = [c for c in offers.columns if c not in (*keys, "id")]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*fields), "ord").alias("x")).select(F.concat_ws("-", *keys).alias("new_id"), *keys, "x.*")
    kept = offers.join(last, keys, "left_anti")
    ids = offers.select(*keys, "id")
    now = last.join(ids, keys, "left").withColumn("id", F.coalesce("id", "new_id")).select(*offers.columns)
    return kept.unionByName(now), history


def save_batch(catalog: Catalog, batch: DataFrame) -> Catalog:
    """One batch of listings through products, stores and offers; the catalog after it."""
    products = merge_products(catalog.products, batch)
    stores = add_stores(catalog.stores, batch)
    key = canonical_key(F.coalesce("search_keywords", "name"))
    rows = batch.withColumn("canonical_key", key)
    rows = rows.join(products.select(F.col("id").alias("product_id"), "category", "canonical_key"), ["category", "canonical_key"]).join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_name")
    offers, history = upsert_offers(catalog.offers, rows)
    old = catalog.history
    full = history.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in old.columns if c not in history.columns}).select(*old.columns)
    return replace(catalog, products=products, stores=stores, offers=offers, history=old.unionByName(full))


def import_listings(catalog: Catalog, listings: DataFrame, min_feedback: float = 98.0) -> Catalog:
    """Marketplace listings (a batch with condition, buying_options, seller_feedback_percentage): those that may be sold, saved."""
    return save_batch(catalog, listings.where(sellable_listing(min_feedback)))
