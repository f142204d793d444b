"""Questions in Italian to a structured form, by rules. Runs on the driver: it yields literals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from ..functions import vocab

INTENT_NAMES = (*vocab.INTENTS, "best_under_budget", "category_recommendation", "product_search", "unknown")
SORT_NAMES = ("relevance", *vocab.SORTS)


def normalized(text: object) -> str:
    """As search_text, for one value."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", "" if text is None else str(text)) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", plain.lower().replace("€", " euro ")).split())


def _unique(items) -> tuple[str, ...]:
    return tuple(dict.fromkeys(items))


def _holds(text: str, term: str) -> bool:
    return f" {term} " in f" {text} "


def _best(text: str, table: dict[str, tuple[str, ...]]) -> str | None:
    """The entry whose aliases occur most: phrases weigh 3, words 2; the first of equals."""
    score = {k: sum(3 if " " in a else 2 for a in map(normalized, aliases) if _holds(text, a)) for k, aliases in table.items()}
    top = max(score, key=score.get)
    return top if score[top] else None


def keywords_of(text: str) -> tuple[str, ...]:
    return _unique(t for t in text.split() if t not in vocab.STOPWORDS and not t.isdigit() and len(t) > 1)


@dataclass(frozen=True)
class Question:
    """A question as the plans use it."""

    intent: str
    query: str = ""
    text: str = ""
    category: str | None = None
    budget: float | None = None
    keywords: tuple[str, ...] = ()
    brand: str | None = None
    product_keywords: tuple[str, ...] = ()
    model_terms: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    sort_preference: str = "relevance"

    @cached_property
    def query_tokens(self) -> tuple[str, ...]:
        said = normalized(" ".join((self.query, *(self.product_keywords or self.keywords))))
        return _unique(t for t in said.split() if t not in vocab.STOPWORDS and (len(t) > 1 or t.isdigit()))

    @cached_property
    def names_product(self) -> bool:
        """The words name one product: a known phrase or product, or a brand with something that isn't generic."""
        tokens = self.query_tokens
        said = normalized(" ".join((self.query, *(self.product_keywords or self.keywords))))
        if not tokens:
            return False
        if any(p in said for p in vocab.PRODUCT_PHRASES) or any(t in vocab.SINGLE_PRODUCTS for t in tokens):
            return True
        return any(t in vocab.PRODUCT_BRANDS for t in tokens) and any(t not in vocab.PRODUCT_BRANDS and t not in vocab.GENERIC for t in tokens)

    @cached_property
    def search_tokens(self) -> tuple[str, ...]:
        said = (*self.product_keywords, *self.model_terms, *self.keywords, *self.needs)
        return _unique(t for s in said for t in normalized(s).split() if t not in vocab.STOPWORDS)

    @cached_property
    def required(self) -> tuple[str, ...]:
        return tuple(t for t in self.search_tokens if (t not in vocab.GENERIC or t in vocab.MODELS) and t not in vocab.NEEDS)

    @cached_property
    def specific(self) -> bool:
        """About one product rather than a kind of product."""
        if self.category == "tv" and "tv_ps5" in self.needs:
            return False
        return self.names_product or bool(self.model_terms and (self.brand or self.product_keywords)) or (len(self.required) >= 2 and bool(self.brand))

    @property
    def search_terms(self) -> tuple[str, ...]:
        """Terms for bounded retrieval: what was named, then aliases of brand, needs and category, and synonyms."""
        phrase = " ".join(self.product_keywords)
        out = [phrase, *self.product_keywords, *self.model_terms, *self.keywords, *vocab.BRANDS.get(self.brand, ())]
        for n in self.needs:
            out += vocab.NEEDS.get(n, ())
        out += [s for k in self.keywords for s in vocab.SYNONYMS.get(k, ())]
        out += vocab.CATEGORIES.get(self.category, ())
        return tuple(t for t in _unique(map(normalized, out)) if len(t) > 1)

    @property
    def categories(self) -> tuple[str, ...]:
        return _unique((self.category, *vocab.CATEGORY_FALLBACKS.get(self.category, ()))) if self.category else ()

    @property
    def offer_first(self) -> str | None:
        """How offers may drive a question that names no category, brand or product."""
        if self.category or self.brand or self.specific:
            return None
        return "discount" if self.intent == "discount_ranking" else "budget" if self.intent == "best_under_budget" and self.budget is not None else None

    @property
    def limit(self) -> int:
        """How many candidates the plan ranks."""
        by = {"discount_ranking": 160, "best_under_budget": 160 if self.category or self.keywords else 300, "cheapest_offer": 40, "category_recommendation": 40}
        n = by.get(self.intent, 5)
        return max(20, n) if self.specific else n


def intent_of(text: str, category: str | None, budget: float | None, keywords: tuple[str, ...]) -> str:
    for intent, triggers in vocab.INTENTS.items():
        if any(t in text for t in triggers):
            return intent
    if budget is not None:
        return "best_under_budget"
    if category and any(t in text for t in vocab.RECOMMEND):
        return "category_recommendation"
    if any(t in text for t in vocab.SEARCH):
        return "product_search"
    if category and not keywords:
        return "category_recommendation"
    return "product_search" if keywords or category else "unknown"


def sort_of(text: str, intent: str) -> str:
    for name, triggers in vocab.SORTS.items():
        if any(t in text for t in triggers):
            return name
    return {"discount_ranking": "discount", "cheapest_offer": "lowest_price", "best_under_budget": "lowest_price", "when_to_buy": "timing"}.get(intent, "relevance")


def parse(question: str | None) -> Question:
    text = normalized(question)
    category, brand = _best(text, vocab.CATEGORIES), _best(text, vocab.BRANDS)
    found = next((m for p in vocab.BUDGETS if (m := re.search(p, text))), None)
    budget = float(found[1]) if found else None
    keywords = keywords_of(text)
    intent = intent_of(text, category, budget, keywords)
    needs = tuple(n for n, aliases in vocab.NEEDS.items() if any(_holds(text, normalized(a)) for a in aliases))
    if category == "tv" and brand == "sony" and "sony" not in keywords:
        brand = None
    need_words = {w for n in needs for a in vocab.NEEDS[n] for w in normalized(a).split()}
    named = [k for k in keywords if not (k in need_words and k not in vocab.PRODUCT_BRANDS) and not (k in vocab.GENERIC and k not in vocab.MODELS)]
    return Question(
        intent=intent, query=" ".join(keywords), text=text, category=category, budget=budget, keywords=keywords, brand=brand, product_keywords=tuple(named[:8]),
        model_terms=tuple(k for k in keywords if k in vocab.MODELS or re.search(r"\d", k)), needs=needs, sort_preference=sort_of(text, intent),
    )


#: Takes a question and its rule-based form, returns fields to override or None.
Interpreter = Callable[[str, Question], dict | None]


def refine(question: str, base: Question, interpreter: Interpreter | None) -> Question:
    """Overlay what an interpreter says, field by field, each only if valid. Any failure keeps the rules' form."""
    if interpreter is None:
        return base
    try:
        said = interpreter(question, base)
    except Exception:  # noqa: BLE001  the interpreter is optional and outside of our control
        return base
    if not isinstance(said, dict):
        return base
    words = lambda v: _unique(k for x in v for k in keywords_of(normalized(x)))[:8] if isinstance(v, list) else ()
    new: dict = {}
    for field, allowed in (("intent", INTENT_NAMES), ("category", vocab.CATEGORIES), ("brand", vocab.BRANDS), ("sort_preference", SORT_NAMES)):
        if said.get(field) in allowed:
            new[field] = said[field]
    try:
        budget = float(said.get("budget_max", said.get("budget")))
        if 0 < budget <= 50_000:
            new["budget"] = budget
    except (TypeError, ValueError):
        pass
    if query := normalized(said.get("query")):
        new["query"] = query
    for field in ("keywords", "product_keywords", "model_terms"):
        if got := words(said.get(field)):
            new[field] = got
    if "keywords" not in new and "query" in new and (got := keywords_of(new["query"])):
        new["keywords"] = got
    if isinstance(said.get("needs"), list) and (got := tuple(n for n in said["needs"][:8] if isinstance(n, str) and n in vocab.NEEDS)):
        new["needs"] = got
    return replace(base, **new)
