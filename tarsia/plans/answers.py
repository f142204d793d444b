"""What is said to a question: one text for each intent, with what the data can and can't tell.

The texts are fixed values of ``vocab``; here they are chosen and filled in. All inputs are
the few rows of an answer.
"""

from __future__ import annotations

import json

from ..functions import vocab
from .intent import Question

MIN_POINTS, CARDS_SHOWN, FEW = 3, 6, 3
REASON, ANSWER = 140, 260


def price_text(value: float | None) -> str:
    """As ``prices.money`` writes a column of them."""
    return vocab.NO_PRICE if value is None else f"€{value:.2f}"


def category_label(category: str | None) -> str:
    return vocab.CATEGORY_LABELS.get(category, "prodotti")


def query_label(q: Question) -> str:
    """The product that a question names, as it is written."""
    tokens = [t for t in q.search_tokens if t not in vocab.GENERIC] or list(q.search_tokens)
    return " ".join(vocab.TOKEN_LABELS.get(t, t.upper() if t.isdigit() else t.capitalize()) for t in tokens[:4])


def honesty(stores: set[str] | None = None, products: int | None = None, points: int | None = None) -> str:
    """How far the data reach: stores compared, products found, observations of the price."""
    notes = []
    if stores is not None:
        if stores:
            notes.append(vocab.ONE_STORE.format(store=next(iter(stores))) if len(stores) == 1 else vocab.SEVERAL_STORES.format(n=len(stores)))
        if products is not None and products <= FEW:
            notes.append(vocab.FEW_PRODUCTS)
    if points is not None and points < MIN_POINTS:
        notes.append(vocab.THIN_HISTORY)
    return " ".join(notes) or vocab.REAL_DATA


def reason_of(p: dict) -> str:
    """Why a prediction recommends what it does."""
    if p["recommendation"] == "buy_now":
        return vocab.REASONS["low"]
    if p["recommendation"] == "wait":
        far = p["current_price"] >= p["history_avg"] * 1.08 and p["current_price"] >= p["history_min"] * 1.15
        return vocab.REASONS["high" if far else "falling"]
    return vocab.REASONS["plain"]


def timing(product: str, best: dict | None, context: dict | None, prediction: dict | None) -> str:
    """When to buy a product: best offer (store_name, price), context over all stores (points, low, mean), prediction at the best offer's store."""
    points = context["points"] if context else 0
    fill = {"product": product or vocab.NO_NAME, "points": points, "note": honesty(points=points), "follow_up": vocab.FOLLOW_UP}
    if points < MIN_POINTS:
        return vocab.TOO_LITTLE_HISTORY.format(best=vocab.BEST_NOW.format(store=best["store_name"], price=price_text(best["price"])) if best else "", **fill)
    if best is None or prediction is None or prediction["recommendation"] == "insufficient_data":
        return vocab.NO_FORECAST.format(**fill)
    return vocab.FORECAST.format(
        recommendation=prediction["recommendation"], store=best["store_name"], price=price_text(best["price"]), reason=reason_of(prediction), low=price_text(context["low"]), mean=price_text(context["mean"]), confidence=prediction["confidence"], **fill
    )


def text_of(q: Question, question: str, products: int, records: int) -> str:
    """The text for so many products found and offers to show; ``timing`` says more for questions of when to buy."""
    if q.intent == "unknown":
        return vocab.NOT_UNDERSTOOD.format(categories=vocab.AVAILABLE_CATEGORIES)
    if not products:
        hint = f" nella categoria {category_label(q.category)}" if q.category else ""
        return vocab.NO_PRODUCTS.format(hint=hint, query=q.query or question, categories=vocab.AVAILABLE_CATEGORIES, follow_up=vocab.FOLLOW_UP)
    if q.specific:
        return vocab.SPECIFIC[min(records, 2)]
    if not records:
        return vocab.NO_OFFERS.format(follow_up=vocab.FOLLOW_UP)
    n = min(records, CARDS_SHOWN)
    if q.intent == "discount_ranking" or q.sort_preference == "discount":
        return vocab.DISCOUNTS
    if q.budget is not None:
        return vocab.UNDER_BUDGET.format(n=n, budget=price_text(q.budget))
    return vocab.IN_CATEGORY.format(n=n, category=category_label(q.category)) if q.category else vocab.FOUND.format(n=n)


def concise(q: Question, cards: int) -> str:
    """A text that names no price, for when one from outside may not be shown."""
    budget = f" sotto {price_text(q.budget)}" if q.budget else ""
    title = vocab.CONCISE.get(q.intent) or vocab.CONCISE_ELSE.format(category=category_label(q.category) if q.category else "risultati", budget=budget, n=cards)
    return f"{title}\n{vocab.CONCISE_SUMMARY}"


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[: most - 3].rstrip()}..."


def outside_text(said: object, q: Question, cards: int) -> str | None:
    """A title and summary from outside; prices aren't taken from there, and nothing is where there is no title."""
    if not isinstance(said, dict):
        return None
    title, summary = (" ".join(str(said.get(k) or "").split()) for k in ("answer_title", "answer_summary"))
    if not title:
        return None
    text = f"{title}\n{summary}" if summary else title
    return concise(q, cards) if "€" in text else _cut(text, ANSWER)


def outside_reason(reason: object) -> str | None:
    """A reason from outside, without blanks too many; none that names a price or isn't text."""
    text = " ".join(reason.split()) if isinstance(reason, str) else ""
    return None if not text or "€" in text else _cut(text, REASON)


def outside_reasons(said: object, known: set[str]) -> dict[str, str]:
    """product_id to reason, of products that were asked about; the last of a product counts."""
    rows = said.get("product_reasons") if isinstance(said, dict) else None
    pairs = ((r.get("product_id"), outside_reason(r.get("reason"))) for r in rows or [] if isinstance(r, dict))
    return {p: r for p, r in pairs if isinstance(p, str) and p in known and r}


def tolerant_json(text: str | bytes | None) -> object:
    """What a text holds as JSON, None where it holds none."""
    try:
        return json.loads(text) if text else None
    except (ValueError, TypeError):
        return None
