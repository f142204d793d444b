"""Offers joined to stores and reduced to the best of each product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import number, usable_offer
from ..functions.prices import discount_pct

UNKNOWN_STORE = "negozio sconosciuto"


def with_store(offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Each offer with its store's name and website; an unknown store has a default name."""
    return offers.join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("website").alias("store_website")), "store_id", "left").withColumn("store_name", F.coalesce("store_name", F.lit(UNKNOWN_STORE)))


def best_offers(offers: DataFrame, stores: DataFrame, strict_availability: bool = False) -> DataFrame:
    """The cheapest usable offer of each product (lowest id on ties), and how many were considered.

    The minimum is taken before the join, so stores meet one row a product.
    """
    usable = offers.where(usable_offer(strict_availability)).withColumn("price", number(F.col("current_price")))
    best = usable.groupBy("product_id").agg(
        F.min_by(F.struct("id", "store_id", "price", number(F.col("old_price")).alias("old_price"), "product_url", "availability", "data_confidence"), F.struct("price", "id")).alias("o"), F.count("*").alias("offers_checked")
    )
    return with_store(best.select("product_id", "o.*", "offers_checked"), stores)


def offer_records(products: DataFrame, offers: DataFrame, stores: DataFrame, budget: float | None = None) -> DataFrame:
    """Products that have a usable offer, with the best one and its discount."""
    best = best_offers(offers, stores).withColumnRenamed("id", "offer_id")
    rows = products.withColumnRenamed("id", "product_id").join(best, "product_id").withColumn("discount_pct", discount_pct(F.col("old_price"), F.col("price")))
    return rows if budget is None else rows.where(F.col("price") <= budget)
