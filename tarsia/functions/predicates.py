"""Null discipline and usability of catalog rows, as boolean columns.

Three notions of "missing" are in use and kept apart: null or empty, blank after trimming,
and falsy. Quality filters let a missing value pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of an observation that counts, besides a missing one.
TRUSTED = ("alta", "media")
#: Availability that rules an offer out.
UNAVAILABLE = ("out_of_stock", "out of stock", "non disponibile", "esaurito", "unavailable")


def missing(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def blank(c: Column) -> Column:
    """Null or nothing but blanks."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def falsy(c: Column) -> Column:
    """Null, empty, or zero."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return (s == "") | F.coalesce(s.try_cast("double") == 0, F.lit(False)) & ~s.rlike(r"\s")


def one_of_or_missing(c: Column, *allowed: str) -> Column:
    return F.coalesce(c, F.lit("")).isin("", *allowed)


def number(c: Column) -> Column:
    """The value as a double; null where it isn't one, NaN included."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def usable_history(include_low: bool = False, positive: bool = False) -> Column:
    """An observation that statistics may use: trusted, new, retail, with a price (above zero if ``positive``)."""
    price = number(F.col("price"))
    ok = price.isNotNull() & one_of_or_missing(F.col("condition"), "new") & one_of_or_missing(F.col("listing_type"), "retail_online")
    if not include_low:
        ok = ok & one_of_or_missing(F.col("data_confidence"), *TRUSTED)
    return F.coalesce(ok & (price > 0) if positive else ok, F.lit(False))


def usable_offer(strict_availability: bool = False) -> Column:
    """An offer that may be shown.

    By default availability is compared after normalising, in which an underscore becomes a
    blank: so ``out_of_stock`` is compared as two blanks-separated words and passes, while
    the Italian phrases don't. ``strict_availability`` compares the trimmed lower-case text
    and needs a price above zero.
    """
    a = F.lower(F.trim(F.coalesce(F.col("availability"), F.lit(""))))
    price = number(F.col("current_price"))
    blocked = a.isin(*UNAVAILABLE) if strict_availability else F.trim(F.regexp_replace(a, r"[^a-z0-9]+", " ")).isin("non disponibile", "esaurito", "unavailable")
    ok = price.isNotNull() & ~blocked & one_of_or_missing(F.col("data_confidence"), *TRUSTED) & one_of_or_missing(F.col("condition"), "new")
    return F.coalesce(ok & (price > 0) if strict_availability else ok, F.lit(False))


def sellable_listing(min_feedback: float = 98.0) -> Column:
    """A marketplace listing that is new, at a fixed price, from a well-rated seller."""
    feedback = number(F.col("seller_feedback_percentage"))
    return F.coalesce(F.contains(F.lower(F.col("condition")), F.lit("new")) & F.array_contains("buying_options", "FIXED_PRICE") & (feedback >= min_feedback), F.lit(False))
