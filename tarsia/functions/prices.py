"""Prices and timestamps from text, and the arithmetic of prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import number


def gate_price(c: Column) -> Column:
    """An incoming price: with both marks dots are thousands, else a comma is the decimal mark."""
    s = F.replace(F.replace(F.trim(c.cast("string")), F.lit("€"), F.lit("")), F.lit(" "), F.lit(""))
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return number(F.when(F.contains(s, F.lit(",")) & F.contains(s, F.lit(".")), eu).otherwise(F.replace(s, F.lit(","), F.lit("."))))


def page_price(c: Column, dot_thousands: bool = False, least: float = 5.0, most: float = 5000.0) -> Column:
    """A price on a page, null outside of the range. ``dot_thousands``: 1.299 is 1299."""
    s = F.regexp_replace(c.cast("string"), r"[^\d,.]", "")
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    value = F.when(comma & dot, eu).when(comma, F.replace(s, F.lit(","), F.lit(".")))
    if dot_thousands:
        whole = s.rlike(r"^\d{1,3}\.\d{3}$") | (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))) > 1)
        value = value.when(whole, F.replace(s, F.lit("."), F.lit("")))
    price = number(value.otherwise(s))
    return F.when(price.between(least, most), price)


def timestamp(c: Column) -> Column:
    """ISO text as a timestamp, UTC where it names no zone; null where it isn't one."""
    return c.cast("string").try_cast("timestamp")


def observed_at(checked: Column, created: Column | None = None) -> Column:
    checked = F.nullif(checked.cast("string"), F.lit(""))
    return timestamp(checked if created is None else F.coalesce(checked, created.cast("string")))


def discount_pct(old: Column, new: Column) -> Column:
    """Null unless both are there and the old price is higher."""
    return F.when((old != 0) & (new != 0) & (old > new), (old - new) / old * 100)


def price_component(price: Column, low: Column, high: Column) -> Column:
    """70 for the lowest of a result, 0 for the highest; 35 where all are equal."""
    return F.when(price.isNull(), 0.0).when(high <= low, 35.0).otherwise((high - price) / (high - low) * 70)


def confidence_points(c: Column) -> Column:
    return F.when(c == "alta", 20).when(c == "media", 10).otherwise(0)


def rounded(c: Column, digits: int) -> Column:
    """Half up by plain double arithmetic, which every engine does alike."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def money(c: Column) -> Column:
    return F.when(c.isNull(), "prezzo non disponibile").otherwise(F.format_string("€%.2f", c))
