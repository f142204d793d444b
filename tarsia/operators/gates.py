"""Quality gates for incoming listings: reject and warning codes for each row, and counts over a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.prices import gate_price
from ..functions.text import gate_text, tokens_for_gate, within

TOO_SHORT, TOO_LONG = 8, 120
STORAGE = r"(?i)\b\d+(?:[,.]\d+)?\s*(?:gb|tb)\b"
SCREEN = "(?i)\\b\\d{1,3}(?:[,.]\\d+)?\\s*(?:\"|”|″|'{1,2}|pollici|inch)\\b"
#: Which columns may hold a field, the first that isn't empty counts.
FIELDS = {
    "name": ("name", "title", "product_name"),
    "store": ("store", "store_name", "store_id", "retailer", "source"),
    "price": ("current_price", "price", "sale_price"),
    "old_price": ("old_price", "list_price"),
    "url": ("product_url", "url", "link"),
    "category": ("category", "category_key", "product_category"),
    "image": ("image_url", "image", "thumbnail"),
    "availability": ("availability", "stock_status"),
}


def first_present(df: DataFrame, field: str) -> Column:
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in FIELDS[field] if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normal_category(category: Column) -> Column:
    """The category an alias stands for: the whole text, else the first alias among its words."""
    text = gate_text(category)
    whole = reduce(lambda w, kv: w.when(text == kv[0], kv[1]), list(vocab.GATE_CATEGORIES.items())[1:], F.when(text == "smartphone", "smartphone"))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    inside = [F.when(F.contains(padded, F.lit(f" {a} ")), c) for a, c in vocab.GATE_CATEGORIES.items()]
    return F.coalesce(whole, *inside)


def _array(*c: Column) -> Column:
    return F.array_compact(F.array(*c))


def title_quality(name: Column) -> Column:
    """length, token_count, too_short, too_long, generic, and what the title says beside the product."""
    title = F.trim(F.coalesce(name, F.lit("")))
    text, tokens = gate_text(title), tokens_for_gate(title)
    brands = within(tokens, vocab.GATE_BRANDS)
    models = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isin(*vocab.GATE_FAMILIES) | t.rlike(r"\d"))))
    meaningful = F.filter(tokens, lambda t: ~t.isin(*vocab.GATE_GENERIC, *vocab.GATE_NOISE))
    storage = F.transform(F.regexp_extract_all(title, F.lit(STORAGE), F.lit(0)), lambda s: F.lower(F.replace(s, F.lit(" "), F.lit(""))))
    screen = F.transform(F.regexp_extract_all(title, F.lit(SCREEN), F.lit(0)), F.lower)
    words = F.filter(tokens, lambda t: t.isin(*vocab.GATE_VARIANTS, *vocab.GATE_COLOURS, *vocab.GATE_BUNDLES))
    editions = _array(*[F.when(F.contains(text, F.lit(f"{e} edition")), f"{e}_edition") for e in ("disc", "digital")])
    noise = _array(*[F.when(F.contains(text, F.lit(n)), n) for n in sorted(vocab.GATE_NOISE)])
    return F.struct(
        F.length(title).alias("length"),
        F.size(tokens).alias("token_count"),
        ((F.length(title) < TOO_SHORT) | (F.size(tokens) < 2)).alias("too_short"),
        (F.length(title) > TOO_LONG).alias("too_long"),
        ((F.size(tokens) > 0) & (F.size(meaningful) <= 1) & (F.size(brands) == 0) & (F.size(models) == 0)).alias("generic"),
        noise.alias("retailer_noise_terms"),
        F.array_sort(F.array_distinct(F.concat(storage, screen, words, editions))).alias("important_differentiators"),
        brands.alias("brand_tokens"),
        models.alias("model_tokens"),
    )


def evaluate(candidates: DataFrame, require_store: bool = True) -> DataFrame:
    """Each candidate with ``title``, codes, severity, confidence, risk and a summary."""
    got = {f: first_present(candidates, f) for f in FIELDS}
    rows = candidates.withColumns({f"__{f}": c for f, c in got.items()})
    rows = rows.withColumns({"__p": gate_price(F.col("__price")), "__o": gate_price(F.col("__old_price")), "normalized_category": normal_category(F.col("__category")), "title": title_quality(F.col("__name"))})
    has = lambda f: F.col(f"__{f}").isNotNull()
    t, cat = F.col("title"), F.col("normalized_category")
    reject = _array(
        F.when(~has("name"), "missing_name"),
        F.when(~has("store"), "missing_store") if require_store else F.lit(None).cast("string"),
        F.when(~has("price"), "missing_price").when(F.col("__p").isNull() | (F.col("__p") <= 0), "invalid_price"),
        F.when(~has("url"), "missing_url"),
        F.when(~has("category"), "missing_category"),
    )
    cautious = F.coalesce(cat.isin(*vocab.GATE_CAUTIOUS), F.lit(False))
    differs = F.size(t["important_differentiators"]) > 0
    risk = F.when(cautious | t["generic"], "high").when(differs | ((F.size(t["brand_tokens"]) == 0) & (F.size(t["model_tokens"]) == 0)), "medium").otherwise("low")
    rows = rows.withColumns({"discard_reasons": reject, "matching_risk": risk})
    warn = _array(
        F.when(has("category") & cat.isNull(), "unknown_category"),
        F.when(F.col("__o") < F.col("__p"), "old_price_lower_than_current_price"),
        F.when(~has("image"), "missing_image"),
        F.when(~has("availability"), "missing_availability"),
        F.when(t["too_short"], "title_too_short"),
        F.when(t["too_long"], "title_too_long"),
        F.when(t["generic"], "generic_title"),
        F.when(cautious, "category_high_matching_complexity"),
        F.when(differs, "important_differentiators_detected"),
        F.when(F.arrays_overlap(t["important_differentiators"], F.array(*map(F.lit, vocab.GATE_BUNDLES))), "possible_bundle_or_condition_variant"),
        F.when(F.col("matching_risk") != "low", "needs_matching_review"),
    )
    rows = rows.withColumns({"warnings": warn, "accepted": F.size("discard_reasons") == 0})
    clean = F.size("warnings") == 0
    serious = F.arrays_overlap("warnings", F.array(*map(F.lit, ("generic_title", "unknown_category", "category_high_matching_complexity"))))
    rows = rows.withColumns({
        "severity": F.when(~F.col("accepted"), "CRITICAL").when(clean, "OK").otherwise("WARNING"),
        "confidence": F.when(~F.col("accepted"), "low").when(clean, "high").when((F.col("matching_risk") == "high") | serious, "low").otherwise("medium"),
    })
    what = F.coalesce(cat, F.lit("no known category"))
    summary = F.when(~F.col("accepted"), F.concat(F.lit("Rejected: "), F.array_join("discard_reasons", ", "))).when(clean, F.concat(F.lit("Accepted for "), what)).otherwise(F.concat(F.lit("Accepted for "), what, F.lit(" with warnings, matching risk "), F.col("matching_risk")))
    return rows.withColumn("summary", summary).drop(*[f"__{f}" for f in FIELDS], "__p", "__o")


def summarize(results: DataFrame) -> DataFrame:
    """Counts (kind, value, n): totals, reject codes, warnings, categories and confidence, from one pass."""
    tag = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    tags = F.concat(
        F.array(tag(F.lit("total"), F.lit("")), tag(F.when(F.col("accepted"), "accepted").otherwise("rejected"), F.lit("")), tag(F.lit("category"), F.coalesce("normalized_category", F.lit("unknown"))), tag(F.lit("confidence"), F.col("confidence"))),
        F.when(F.size("warnings") > 0, F.array(tag(F.lit("with_warnings"), F.lit("")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        F.transform("discard_reasons", lambda r: tag(F.lit("reason"), r)),
        F.transform("warnings", lambda r: tag(F.lit("warning"), r)),
    )
    return results.select(F.explode(tags).alias("t")).groupBy("t.kind", "t.value").agg(F.count("*").alias("n"))


def average_confidence(results: DataFrame) -> DataFrame:
    """One row: none, low, medium or high over the batch."""
    points = F.avg(F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1))
    return results.agg(points.alias("p")).select(F.when(F.col("p").isNull(), "none").when(F.col("p") >= 2.5, "high").when(F.col("p") >= 1.6, "medium").otherwise("low").alias("average_confidence"))


def dry_run(candidates: DataFrame, examples: int = 5) -> dict:
    """What would become of listings: counts, average confidence, and the first rejected ones and ones with warnings.

    Nothing but counts and that many examples reaches the driver.
    """
    results = evaluate(candidates)
    counts: dict[str, dict[str, int]] = {}
    for r in summarize(results).orderBy("kind", F.desc("n"), "value").collect():
        counts.setdefault(r.kind, {})[r.value] = r.n
    shown = lambda rows: [{"summary": r.summary, "warnings": list(r.warnings)} for r in rows.orderBy("summary").limit(examples).collect()]
    one = lambda kind: counts.get(kind, {}).get("", 0)
    return {
        "total": one("total"), "accepted": one("accepted"), "rejected": one("rejected"), "with_warnings": one("with_warnings"), "average_confidence": average_confidence(results).first()[0],
        "by_category": counts.get("category", {}), "by_reason": counts.get("reason", {}), "by_warning": counts.get("warning", {}),
        "examples": {"rejected": shown(results.where("not accepted")), "warnings": shown(results.where(F.col("accepted") & (F.size("warnings") > 0)))},
    }


def text(report: dict) -> str:
    """A dry run as lines of text."""
    one = ("total", "accepted", "rejected", "with_warnings", "average_confidence")
    lines = [f"{k.replace('_', ' ')}: {report[k]}" for k in one]
    for k in ("by_category", "by_reason", "by_warning"):
        lines += [f"{k.replace('_', ' ')}:"] + [f"  {name}: {n}" for name, n in report[k].items()]
    for k, rows in report["examples"].items():
        lines += [f"{k}:"] * bool(rows) + [f"  {r['summary']}" + (f" ({', '.join(r['warnings'])})" if r["warnings"] else "") for r in rows]
    return "\n".join(lines)
