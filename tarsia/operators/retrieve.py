"""Bounded retrieval of candidate products, by category, by term, or by their offers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import number, usable_offer
from ..functions.prices import discount_pct

CANDIDATES, TERMS, OFFER_ROWS, OFFER_PRODUCTS = 300, 12, 200, 80


def asked_terms(terms: list[str]) -> list[str]:
    """Distinct terms that may be searched for, cleaned, at most twelve."""
    return [t for t in dict.fromkeys(map(clean_term, terms)) if t][:TERMS]


def clean_term(term: str | None) -> str:
    """A term as ``text.search_term`` cleans a column of them."""
    return " ".join(re.sub(r"[^\w\s-]|_", " ", term or "").split())


def holds_term(terms: list[str]) -> Column:
    escape = lambda t: t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = [F.coalesce(F.ilike(F.col(c), F.lit(f"%{escape(t)}%")), F.lit(False)) for t in terms for c in ("name", "search_keywords", "category")]
    return reduce(lambda a, b: a | b, hit)


def candidates(products: DataFrame, categories: list[str] = (), terms: list[str] = (), limit: int = CANDIDATES) -> DataFrame:
    """Products of the categories whose name, keywords or category hold one of the terms, by name and id.

    With neither categories nor terms there are none.
    """
    terms = asked_terms(terms)
    if not categories and not terms:
        return products.limit(0)
    rows = products
    if categories:
        rows = rows.where(F.col("category").isin(*categories))
    if terms:
        rows = rows.where(holds_term(terms))
    return rows.orderBy("name", "id").limit(min(CANDIDATES, limit))


def ordered_union(*groups: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows of the groups in order, each id where it comes first. Groups are bounded, so one task numbers them."""
    numbered = [g.withColumns({"__src": F.lit(i), "__ord": F.row_number().over(Window.orderBy("name", id_col))}) for i, g in enumerate(groups)]
    rows = reduce(lambda a, b: a.unionByName(b), numbered)
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(id_col).orderBy("__src", "__ord"))).where("__rn = 1")
    return first.orderBy("__src", "__ord").drop("__src", "__ord", "__rn")


def offer_first(offers: DataFrame, mode: str, budget: float | None = None, rows: int = OFFER_ROWS, products: int = OFFER_PRODUCTS) -> DataFrame:
    """(product_id, pos): products by their offers, for questions that name no product.

    ``discount``: of the offers with the highest old price, those usable by discount.
    ``budget``: of the cheapest offers within the budget, those usable by price. In both
    the row limit comes before the check of usability; that order is part of the result.
    """
    price, old = number(F.col("current_price")), number(F.col("old_price"))
    seen = offers.withColumns({"__p": price, "__o": old})
    if mode == "discount":
        some = seen.where((F.col("__p") > 0) & (F.col("__o") > 0)).orderBy(F.desc("__o"), "__p", "id").limit(rows)
        some = some.where(usable_offer(strict_availability=True)).withColumn("__d", discount_pct(F.col("__o"), F.col("__p"))).where("__d > 0")
        order = [F.desc("__d"), F.asc("__p"), F.asc("id")]
    elif mode == "budget":
        some = seen.where((F.col("__p") > 0) & (F.col("__p") <= budget)).orderBy("__p", "id").limit(rows).where(usable_offer(strict_availability=True))
        order = [F.asc("__p"), F.asc("id")]
    else:
        raise ValueError(f"mode is discount or budget, not {mode}")
    ranked = some.withColumn("__rn", F.row_number().over(Window.orderBy(*order)))  # of at most ``rows`` rows
    first = ranked.groupBy("product_id").agg(F.min("__rn").alias("__rn")).orderBy("__rn").limit(products)
    return first.select("product_id", F.row_number().over(Window.orderBy("__rn")).alias("pos"))
