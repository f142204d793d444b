"""Scores of products and offers for a parsed question, ranking and cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.prices import confidence_points, price_component
from ..functions.text import has_term, search_blob, search_text, similar_key
from ..plans.intent import Question, normalized

CARDS = 6


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def with_blob(products: DataFrame) -> DataFrame:
    """Adds what scores look at: ``blob`` (name, keywords and category, normalised) and ``plain`` (name)."""
    return products.withColumns({"blob": search_blob(F.col("name"), F.col("search_keywords"), F.col("category")), "plain": search_text(F.col("name"))})


def category_matches(category: str) -> Column:
    own = search_text(F.col("category"))
    aliases = [a for a in map(normalized, vocab.CATEGORIES.get(category, ())) if a not in vocab.WEAK_ALIASES]
    return own.isin(category, *vocab.CATEGORY_FALLBACKS.get(category, ())) | _any([has_term(F.col("blob"), a) for a in aliases])


def brand_matches(brand: str) -> Column:
    return _any([F.contains(F.col("blob"), F.lit(a)) for a in vocab.BRANDS.get(brand, (normalized(brand),))])


def need_matches(need: str) -> Column:
    return F.lit(True) if need == "cheap" else _any([F.contains(F.col("blob"), F.lit(a)) for a in vocab.NEEDS.get(need, ())])


def exact_score(q: Question) -> Column:
    """Points for a product that holds all tokens of a question about one product."""
    tokens = q.query_tokens
    if not tokens or not q.names_product:
        return F.lit(0)
    needed = [t for t in tokens if t not in vocab.GENERIC] or list(tokens)
    phrase = " ".join(needed)
    score = F.lit(1000 + 100 * len(needed)) + F.when(F.contains(F.col("blob"), F.lit(phrase)), 500).otherwise(0) + F.when(F.contains(F.col("plain"), F.lit(phrase)), 300).otherwise(0) + F.when(F.startswith(F.col("plain"), F.lit(phrase)), 150).otherwise(0)
    return F.when(_all([has_term(F.col("blob"), t) for t in needed]), score).otherwise(0)


def product_score(q: Question) -> Column:
    """How well a product answers; 0 rules it out."""
    blob = F.col("blob")
    score = exact_score(q).cast("double")
    zero = F.lit(False)
    if q.category:
        zero = zero | ~category_matches(q.category)
        score = score + 90
    if q.brand:
        if q.specific:
            zero = zero | ~brand_matches(q.brand)
        score = score + F.when(brand_matches(q.brand), 130).otherwise(0)
    if q.specific and q.required:
        zero = zero | ~_all([has_term(blob, t) for t in q.required])
        score = score + 120 * len(q.required)
    matched = F.lit(False)
    for t in q.search_tokens:
        points = 85 if t in q.model_terms else 70 if t in q.product_keywords else 45 if t in q.needs else 35
        matched = matched | F.contains(blob, F.lit(t))
        score = score + F.when(has_term(blob, t), points).when(F.contains(blob, F.lit(t)), 18).otherwise(0)
    phrase = " ".join(t for t in q.product_keywords if t not in vocab.GENERIC)
    in_name = F.contains(F.col("plain"), F.lit(phrase)) if phrase else F.lit(False)
    query = normalized(q.query)
    score = score + F.when(in_name, 180).when(F.contains(F.col("plain"), F.lit(query)) if query else F.lit(False), 120).otherwise(0)
    for need in q.needs:
        score = score + F.when(need_matches(need), 55).otherwise(0)
    if q.keywords and not q.category and not q.brand:
        zero = zero | ~matched
    return F.when(zero, 0.0).otherwise(score)


def rank_products(products: DataFrame, q: Question, limit: int) -> DataFrame:
    """Products by score, then text. Where the question's brand is found, only that brand stays.

    If nothing scores: none for a question about one product, else the category's products,
    else all if there is a budget. Which of these holds is decided in the plan by one
    aggregate over the scored rows.
    """
    rows = with_blob(products).withColumn("score", product_score(q))
    brand = brand_matches(q.brand) if q.brand else F.lit(False)
    # fallbacks as tiers: 3 brand and score, 2 score, 1 fallback
    fallback = F.lit(False)
    if not q.specific:
        fallback = category_matches(q.category) if q.category else F.lit(q.budget is not None)
    tier = F.when((F.col("score") > 0) & brand, 3).when(F.col("score") > 0, 2).when(fallback, 1).otherwise(0)
    rows = rows.withColumn("tier", tier).where("tier > 0")
    best = rows.agg(F.max("tier").alias("best"))
    rows = rows.join(F.broadcast(best), F.col("tier") == F.col("best"))
    score = F.when(F.col("tier") > 1, F.col("score")).otherwise(F.lit(20.0 if q.category else 1.0))
    return rows.withColumn("score", score).drop("tier", "best").orderBy(F.desc("score"), "blob", "id").limit(limit)


def record_score(q: Question) -> Column:
    """Points of a product with its best offer; needs columns score, price, low, high and the offer's."""
    by_price = q.sort_preference in ("lowest_price", "discount")
    score = F.col("score") + price_component(F.col("price"), F.col("low"), F.col("high")) * (1.0 if by_price else 0.35)
    if q.budget is not None:
        room = 25 - (q.budget - F.col("price")) / max(q.budget, 1) * 20
        score = score + F.when(F.col("price") <= q.budget, 50 + F.greatest(F.lit(0.0), room)).otherwise(-250)
    d = F.coalesce("discount_pct", F.lit(0.0))
    discounted = q.intent == "discount_ranking" or q.sort_preference == "discount"
    score = score + (F.least(F.lit(160.0), d * 2.5) if discounted else F.least(F.lit(65.0), d * 1.2))
    score = score + confidence_points(F.col("data_confidence")) + F.least(F.lit(25), F.col("offers_checked") * 5)
    score = score + F.when(search_text(F.col("availability")) == "available", 15).otherwise(0)
    return score + 20 if q.intent == "when_to_buy" else score


def rank_records(records: DataFrame, q: Question) -> DataFrame:
    """Records by score, then price, then text; alike ones once unless one product was asked for.

    Lowest and highest price come from one aggregate, joined as a single row.
    """
    ends = records.agg(F.min("price").alias("low"), F.max("price").alias("high"))
    rows = records.crossJoin(F.broadcast(ends)).withColumn("ranking_score", record_score(q))
    order = [F.desc("ranking_score"), F.asc_nulls_last("price"), F.asc("blob"), F.asc("product_id")]
    if not q.specific:
        rows = dedupe_similar(rows, order)
    return rows.orderBy(*order)


def dedupe_similar(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each name key, in the given order."""
    keyed = rows.withColumn("name_key", similar_key(F.col("name")))
    return keyed.withColumn("__rn", F.row_number().over(Window.partitionBy("name_key").orderBy(*order))).where("__rn = 1").drop("__rn")


def cards(records: DataFrame, limit: int = CARDS) -> DataFrame:
    """The twelve fields that a client gets, of the first records."""
    pct = F.col("discount_pct")
    reason = F.concat_ws(", ", F.when(pct > 0, F.format_string("sconto del %.0f%%", pct)), F.when(F.col("data_confidence").isNotNull() & (F.col("data_confidence") != ""), F.concat(F.lit("dati con affidabilità "), F.col("data_confidence"))))
    names = ("product_id", "name", "category", "image_url", "store_name", "price", "old_price", "discount_pct", "product_url", "availability", "data_confidence")
    return records.limit(limit).select(*names, F.when(reason == "", "miglior prezzo trovato").otherwise(reason).alias("reason"))


def rerank(cards_df: DataFrame, ids: list[str], reasons: dict[str, str] | None = None, limit: int = CARDS) -> DataFrame:
    """Cards in the order of the ids given, then the others as they were (column pos); reasons may be replaced."""
    spark = cards_df.sparkSession
    asked = spark.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "want string, at int")
    said = spark.createDataFrame(list((reasons or {}).items()), "about string, said string")
    rows = cards_df.join(F.broadcast(asked), F.col("product_id") == F.col("want"), "left").join(F.broadcast(said), F.col("product_id") == F.col("about"), "left")
    rows = rows.withColumn("reason", F.coalesce("said", "reason")).orderBy(F.asc_nulls_last("at"), "pos").limit(limit)
    return rows.drop("want", "at", "about", "said")
