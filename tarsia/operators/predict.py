"""Buy, wait or monitor: statistics of each product's price series at a store, and the decision on its offer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import number, usable_history
from ..functions.prices import rounded
from ..sources.catalog import Catalog

KEYS = ("product_id", "store_id")
MIN_POINTS = 3
#: The order of a series: time, unknown times first, then arrival.
EARLIEST = "0001-01-01 00:00:00"


def when() -> Column:
    return F.struct(F.coalesce(F.col("checked_at").cast("timestamp"), F.lit(EARLIEST).cast("timestamp")).alias("t"), F.col("ord"))


def latest_points(history: DataFrame, keys: tuple[str, ...] = KEYS, recent: int = 3) -> DataFrame:
    """(*keys, price): the last few prices of each series.

    The limit of the rank is applied before the shuffle as well (WindowGroupLimit, Partial), so
    of a series only so many rows leave each task, and no task sorts a whole one.
    """
    rows = history.select(*keys, number(F.col("price")).alias("price"), when().alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))
    return rows.withColumn("rn", rank).where(F.col("rn") <= recent).drop("rn", "at")


def series_stats(history: DataFrame, keys: tuple[str, ...] = KEYS, recent: int = 3) -> DataFrame:
    """Per series: points, min, max and mean price, first and last, mean of the last few, spread and trust.

    All but the mean of the last few are aggregates that combine before their shuffle; the
    last few are limited before theirs. Both are dealt by the keys, so they join in place.
    """
    price = number(F.col("price"))
    rows = history.select(*keys, price.alias("price"), F.col("data_confidence"), when().alias("at"))
    stats = rows.groupBy(*keys).agg(
        F.count("price").alias("points"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.avg("price").alias("mean"),
        F.min_by("price", "at").alias("first"),
        F.max_by("price", "at").alias("last"),
        F.stddev_pop("price").alias("spread"),
        F.count_if(F.col("data_confidence") == "alta").alias("trusted"),
    )
    last = latest_points(history, keys, recent).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.avg("price").alias("recent"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return stats.join(last, same, "left").drop(*[f"__{k}" for k in keys])


def trend(points: Column, first: Column, last: Column) -> Column:
    change = (last - first) / first * 100
    return F.when((points < 2) | first.isNull() | (first <= 0), "unknown").when(change <= -3, "falling").when(change >= 3, "rising").otherwise("stable")


def volatility_pct(points: Column, spread: Column, mean: Column) -> Column:
    return F.when((points >= 2) & (mean > 0), spread / mean * 100)


def data_quality(points: Column, trusted: Column, min_points: int = MIN_POINTS) -> Column:
    return F.when(points < min_points, "insufficient").when((points >= 8) & (trusted / points >= 0.5), "strong").otherwise("usable")


def recommendation(price: Column, availability: Column, points: Column, low: Column, mean: Column, recent: Column, direction: Column, min_points: int = MIN_POINTS) -> Column:
    """The decision ladder, on unrounded values."""
    return (
        F.when(price.isNull() | F.coalesce(F.lower(availability) == "out_of_stock", F.lit(False)) | (F.coalesce(points, F.lit(0)) < min_points), "insufficient_data")
        .when((price <= low * 1.03) | (price <= mean * 0.92), "buy_now")
        .when((price >= mean * 1.08) & (price >= low * 1.15), "wait")
        .when((direction == "falling") & (price > recent), "wait")
        .otherwise("monitor")
    )


def predict(catalog: Catalog, product_id: str | None = None, category: str | None = None, limit: int | None = None, include_low_confidence: bool = False, min_points: int = MIN_POINTS) -> DataFrame:
    """One row an offer of a known product, with the statistics that its recommendation rests on."""
    offers, products = catalog.offers, catalog.products
    if product_id is not None:
        offers, products = offers.where(F.col("product_id") == product_id), products.where(F.col("id") == product_id)
    if category is not None:
        products = products.where(F.col("category") == category)
    usable = catalog.history.where(usable_history(include_low=include_low_confidence))
    if product_id is not None:
        usable = usable.where(F.col("product_id") == product_id)
    stats = series_stats(usable)
    price = number(F.col("current_price"))
    rows = (
        offers.select("id", *KEYS, price.alias("price"), "availability")
        .join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "category"), "product_id")
        .join(catalog.stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_id", "left")
        .join(stats, list(KEYS), "left")
    )
    rows = rows.withColumn("direction", trend(F.col("points"), F.col("first"), F.col("last")))
    rows = rows.withColumn("recommendation", recommendation(F.col("price"), F.col("availability"), F.col("points"), F.col("low"), F.col("mean"), F.col("recent"), F.col("direction"), min_points))
    known = F.col("recommendation") != "insufficient_data"
    quality = F.when(known, data_quality(F.col("points"), F.col("trusted"), min_points)).otherwise("insufficient")
    shown = lambda c: rounded(F.when(known, c), 2)
    out = rows.select(
        *KEYS, "product_name", "category", F.coalesce("store_name", F.lit("negozio sconosciuto")).alias("store_name"), rounded(F.col("price"), 2).alias("current_price"), "recommendation",
        F.when(quality == "strong", "alta").when(quality == "usable", "media").otherwise("bassa").alias("confidence"), F.coalesce("points", F.lit(0)).alias("history_points"),
        shown(F.col("low")).alias("history_min"), shown(F.col("high")).alias("history_max"), shown(F.col("mean")).alias("history_avg"), shown(F.col("recent")).alias("recent_avg"),
        F.when(known, F.col("direction")).otherwise("unknown").alias("trend"), shown(volatility_pct(F.col("points"), F.col("spread"), F.col("mean"))).alias("volatility_pct"), quality.alias("data_quality"),
        "id",
    )
    return out.orderBy("product_id", "store_id", "id").limit(limit).drop("id") if limit is not None else out.drop("id")


def price_context(catalog: Catalog, product_id: str | None = None) -> DataFrame:
    """Per product over all stores: usable points, lowest, highest, mean and latest price."""
    h = catalog.history if product_id is None else catalog.history.where(F.col("product_id") == product_id)
    h = h.where(usable_history()).select("product_id", number(F.col("price")).alias("price"), when().alias("at"))
    return h.groupBy("product_id").agg(F.count("price").alias("points"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"), F.max_by("price", "at").alias("latest"))


def as_json(predictions: DataFrame) -> DataFrame:
    """Each prediction as one JSON object, with nulls for what is unknown."""
    return predictions.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("prediction"))


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a fixed-width table."""
    got = [[("-" if v is None else str(v)) for v in r] for r in df.limit(rows).collect()]
    width = [max([len(c), *(len(r[i]) for r in got)]) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, got)])
