"""The decision ladder against a plain reading of its table, row by row."""

import datetime as dt
import statistics

import pytest

from tarsia.operators.predict import MIN_POINTS, predict, price_context, text_table
from tarsia.sources.catalog import Catalog

T0 = dt.datetime(2026, 1, 1)


def plain(price, availability, prices):
    if price is None or (availability or "").lower() == "out_of_stock" or len(prices) < MIN_POINTS:
        return "insufficient_data"
    low, mean, recent = min(prices), statistics.fmean(prices), statistics.fmean(prices[-3:])
    first, last = prices[0], prices[-1]
    falling = first > 0 and (last - first) / first * 100 <= -3
    if price <= low * 1.03 or price <= mean * 0.92:
        return "buy_now"
    if price >= mean * 1.08 and price >= low * 1.15:
        return "wait"
    return "wait" if falling and price > recent else "monitor"


CASES = {
    "at_low": (103.0, None, [100, 110, 120]),
    "below_mean": (92.0, None, [50, 100, 150]),
    "high": (150.0, None, [100, 110, 120]),
    "falling": (108.0, None, [112, 106, 104]),
    "monitor": (106.0, None, [100, 106, 108]),
    "few": (100.0, None, [100, 100]),
    "gone": (100.0, "out_of_stock", [100, 110, 120]),
    "no_price": (None, None, [100, 110, 120]),
    "zero_first": (10.0, None, [0, 10, 10]),
    "none": (1.0, None, []),
}


def catalog(spark):
    history = [{"product_id": k, "store_id": "s", "price": float(p), "checked_at": T0 + dt.timedelta(days=i), "data_confidence": "alta"} for k, (_, _, ps) in CASES.items() for i, p in enumerate(ps)]
    # rows that don't count: low confidence, used, another kind of listing
    history += [{"product_id": "few", "store_id": "s", "price": 1.0, "data_confidence": "bassa"}, {"product_id": "few", "store_id": "s", "price": 1.0, "condition": "used"}, {"product_id": "few", "store_id": "s", "price": 1.0, "listing_type": "auction"}]
    offers = [{"id": k, "product_id": k, "store_id": "s", "current_price": c, "availability": a} for k, (c, a, _) in CASES.items()]
    return Catalog.from_rows(spark, products=[{"id": k, "name": k, "category": "tv"} for k in CASES], offers=[*offers, {"id": "x", "product_id": "unknown", "store_id": "s", "current_price": 1.0}], history=history)


def test_ladder(spark):
    rows = {r.product_id: r for r in predict(catalog(spark)).collect()}
    assert {k: r.recommendation for k, r in rows.items()} == {k: plain(c, a, [float(p) for p in ps]) for k, (c, a, ps) in CASES.items()}
    assert set(rows["few"].asDict().items()) >= {("history_points", 2), ("history_min", None), ("trend", "unknown"), ("confidence", "bassa"), ("store_name", "negozio sconosciuto")}
    assert rows["high"].trend == "rising" and rows["high"].history_avg == 110.0 and rows["high"].confidence == "media"


def test_filters(spark):
    cat = catalog(spark)
    assert [r.product_id for r in predict(cat, limit=2).collect()] == sorted(CASES)[:2]
    assert predict(cat, product_id="high").count() == 1 and predict(cat, category="laptop").count() == 0
    assert {r.product_id: r.history_points for r in predict(cat, include_low_confidence=True).collect()}["few"] == 3
    assert "recommendation" in text_table(predict(cat, limit=1))


def test_context(spark):
    c = {r.product_id: r for r in price_context(catalog(spark)).collect()}
    assert (c["falling"].points, c["falling"].low, c["falling"].latest) == (3, 104.0, 104.0)


@pytest.mark.parametrize(("price", "want"), [(1.03 * 200, "buy_now"), (216.0, "monitor")])
def test_bounds(spark, price, want):
    cat = Catalog.from_rows(spark, products=[{"id": "p", "name": "p"}], offers=[{"id": "o", "product_id": "p", "store_id": "s", "current_price": price}], history=[{"product_id": "p", "store_id": "s", "price": p} for p in (200.0, 210.0, 220.0)])
    assert predict(cat).first().recommendation == plain(price, None, [200.0, 210.0, 220.0]) == want
