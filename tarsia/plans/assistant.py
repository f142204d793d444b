"""A question, from text to cards: one plan of candidates, scores, best offers and ranking."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.offers import offer_records
from ..operators.predict import predict, price_context
from ..operators.rank import CARDS, cards, rank_products, rank_records, rerank, with_blob
from ..operators.retrieve import candidates, offer_first
from ..sources.catalog import Catalog
from . import answers
from .intent import Interpreter, Question, parse, refine

ENOUGH_CATEGORY, ENOUGH_BRAND = 20, 5


@dataclass
class Answer:
    """Cards, a sentence, and how they were come by."""

    question: Question
    text: str
    cards: list[dict]
    diagnostics: dict


def bounded(products: DataFrame, q: Question) -> DataFrame:
    """Candidates by category and by term, each once."""
    a, b = candidates(products, categories=list(q.categories)), candidates(products, terms=list(q.search_terms))
    return a.unionByName(b).dropDuplicates(["id"])


def sufficient(found: DataFrame, q: Question, limit: int) -> bool:
    """Whether the bounded candidates will do; one small count."""
    least = 1 if q.specific else min(limit, ENOUGH_CATEGORY if q.category else ENOUGH_BRAND)
    return found.limit(least).count() >= least


def ranked_products(cat: Catalog, q: Question, diagnostics: dict | None = None) -> DataFrame:
    """The products that the question's plan looks at.

    Bounded candidates are ranked if there are enough, else all products. A question for
    discounts or a budget that names nothing is driven by offers if it finds no candidates.
    """
    d = {} if diagnostics is None else diagnostics
    limit, mode, found = q.limit, q.offer_first, bounded(cat.products, q)
    if mode is None:
        if not sufficient(found, q, limit):
            d["fallback"], found = "full scan", cat.products
        return rank_products(found, q, limit)
    ranked = rank_products(found, q, limit)
    if not ranked.isEmpty():
        return ranked
    d["offer_first"] = mode
    ids = offer_first(cat.offers, mode, q.budget).withColumnRenamed("product_id", "id")
    some = cat.products.join(F.broadcast(ids), "id")  # at most OFFER_PRODUCTS
    ranked = rank_products(some.drop("pos"), q, limit)
    if not ranked.isEmpty():
        return ranked
    if mode == "discount" and not some.isEmpty():
        return with_blob(some.orderBy("pos")).withColumn("score", F.lit(0.0)).drop("pos").limit(limit)
    d["fallback"] = "full scan"
    return with_blob(cat.products).withColumn("score", F.lit(0.0)) if mode == "discount" else rank_products(cat.products, q, limit)


def ranked_records(cat: Catalog, q: Question, diagnostics: dict | None = None) -> DataFrame:
    """Products with their best offers, best first."""
    products = ranked_products(cat, q, diagnostics)
    return ranked_records_of(cat, q, products.limit(1) if q.intent == "when_to_buy" else products)


def ranked_records_of(cat: Catalog, q: Question, products: DataFrame) -> DataFrame:
    records = offer_records(products, cat.offers, cat.stores, q.budget)
    if q.intent == "discount_ranking":
        records = records.where("discount_pct > 0")
    return rank_records(records, q)


def answer(cat: Catalog, text: str, interpreter: Interpreter | None = None, ranking: list[str] | None = None, reasons: dict[str, str] | None = None, outside: str | dict | None = None) -> Answer:
    """Answer a question. An interpreter may refine it; a ranking and reasons from outside may reorder the cards.

    ``outside``: a reply as JSON or an object, with answer_title, answer_summary, product_ids
    and product_reasons; what it holds that can't be shown is left out.
    """
    q = refine(text, parse(text), interpreter)
    diagnostics: dict = {"intent": q.intent, "category": q.category, "brand": q.brand, "budget": q.budget, "specific": q.specific, "fallback": None, "offer_first": None, "candidates": 0, "cards": 0, "stores": 0}
    if q.intent == "unknown":
        return Answer(q, answers.text_of(q, text, 0, 0), [], diagnostics)
    products = ranked_products(cat, q, diagnostics).limit(max(q.limit, 1))
    diagnostics["candidates"] = found = products.count()
    if q.intent == "when_to_buy":
        products = products.limit(1)
    top = cards(ranked_records_of(cat, q, products), 2 * CARDS)
    rows = [r.asDict() for r in top.collect()]
    said = answers.tolerant_json(outside) if isinstance(outside, str | bytes) else outside
    known = {r["product_id"] for r in rows}
    if isinstance(said, dict):
        ranking = ranking or [i for i in said.get("product_ids") or [] if isinstance(i, str)]
        reasons = (reasons or {}) | answers.outside_reasons(said, known)
    if ranking and not q.specific and rows:
        spark = cat.products.sparkSession
        frame = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], T.StructType([*top.schema.fields, T.StructField("pos", T.IntegerType())]))
        safe = {k: r for k, v in (reasons or {}).items() if (r := answers.outside_reason(v))}
        rows = [r.asDict() for r in rerank(frame, ranking, safe).drop("pos").collect()]
    n, rows = len(rows), rows[:CARDS]
    stores = {r["store_name"] for r in rows if r["store_name"]}
    diagnostics |= {"cards": len(rows), "stores": len(stores)}
    if q.intent == "when_to_buy" and found and not q.specific:
        first = products.first()
        best = rows[0] if rows else None
        context = price_context(cat, first["id"]).first()
        p = predict(cat, product_id=first["id"]).where(F.col("store_name") == best["store_name"]).first() if best else None
        return Answer(q, answers.timing(first["name"], best, context.asDict() if context else None, p.asDict() if p else None), rows, diagnostics)
    spoken = None if q.specific or not rows else answers.outside_text(said, q, len(rows))
    spoken = spoken or answers.text_of(q, text, found, n)
    if rows and not q.specific:
        spoken = f"{spoken}\n{answers.honesty(stores, found)}"
    return Answer(q, spoken, rows, diagnostics)


def payload(a: Answer) -> dict:
    """As JSON can hold it."""
    return {"question": asdict(a.question), "answer": a.text, "products": a.cards, "diagnostics": a.diagnostics}
