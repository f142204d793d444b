"""Collections: which shops and categories to ask for, a pass over them, and passes at an interval.

A pass searches, finds product pages, extracts products and saves them through the sink.
Without ``execute`` it only says what it would do.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import RETAILERS, Retailer, discover, extract_products, search_items, search_query
from .sink import OfferSink

CATEGORIES = ("smartphone", "cuffie", "laptop", "tv", "desktop", "casse_audio")
LIMIT = 30

#: From the URLs of products (product_url) to their pages (url, html, markdown, search_title).
Scrape = Callable[[DataFrame], DataFrame]


@dataclass
class Summary:
    retailer: str
    categories: list[str]
    executed: bool
    errors: list[str] = field(default_factory=list)


def retailers_of(asked: str = "all") -> list[str]:
    if asked == "all":
        return list(RETAILERS)
    if asked not in RETAILERS:
        raise ValueError(f"unknown retailer: {asked}")
    return [asked]


def categories_of(asked: str = "all", allowed: tuple[str, ...] = CATEGORIES) -> list[str]:
    """Of a list separated by commas, all if it is empty or says so."""
    names = [] if not asked or asked == "all" else [c.strip() for c in asked.split(",") if c.strip()]
    if unknown := sorted(set(names) - set(allowed)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return names or list(allowed)


def save_found(found: DataFrame, shop: Retailer, name: str, category: str, scrape: Scrape, sink: OfferSink, batch_id: int, limit: int) -> None:
    """Products of search rows (pass, query_ord, payload, ...) into the sink; discards and failed searches are set aside there too."""
    urls = discover(search_items(found.where("payload is not null")), shop, limit)
    products = extract_products(scrape(urls), shop, category)
    listed = products.where("discard_reason is null").select("name", "category", F.lit(name).alias("store_name"), F.lit(shop.site).alias("store_website"), "image_url", F.col("price").alias("current_price"), "old_price", "product_url", "availability", F.lit("new").alias("condition"), F.lit("retail_online").alias("listing_type"), "data_confidence")
    sink(listed, batch_id)


def run_once(spark: SparkSession, source: str, scrape: Scrape, sink: OfferSink, retailer: str = "all", categories: str = "all", limit: int = LIMIT, execute: bool = False, first_batch: int = 0) -> list[Summary]:
    """One pass over shops and categories; a category that fails does not end the pass."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    summaries, batch = [], first_batch
    for name in retailers_of(retailer):
        summary = Summary(name, categories_of(categories), execute)
        for category in summary.categories if execute else ():
            try:
                found = _searched(spark.read, source, spark, RETAILERS[name], category).load()
                save_found(found, RETAILERS[name], name, category, scrape, sink, batch, limit)
            except Exception as e:  # noqa: BLE001  whatever a shop's pages make fail, the others are collected
                summary.errors.append(f"{name} {category}: {e}")
            batch += 1
        summaries.append(summary)
    return summaries


def _searched(reader, source: str, spark: SparkSession, shop: Retailer, category: str):
    query = spark.range(1).select(search_query(F.lit(category.replace("_", " ")), shop)).first()[0]
    return reader.format(source).option("queries", json.dumps([query]))


def run_loop(spark: SparkSession, source: str, scrape: Scrape, sink: OfferSink, retailer: str, category: str, checkpoint: str, interval_hours: float, limit: int = LIMIT, poll: str | None = None) -> StreamingQuery:
    """Passes at an interval until the query is stopped. Each pass is a batch of the stream, known by its number, so one that is repeated after a failure changes nothing."""
    if interval_hours <= 0:
        raise ValueError("interval_hours must be positive")
    shop = RETAILERS[retailer]
    seconds = interval_hours * 3600
    passes = _searched(spark.readStream, source, spark, shop, category).option("intervalSeconds", str(seconds)).load()

    def save(found: DataFrame, batch_id: int) -> None:
        save_found(found, shop, retailer, category, scrape, sink, batch_id, limit)

    return passes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=poll or f"{seconds} seconds").start()
