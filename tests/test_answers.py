"""What is said to questions, and what replies from outside may change."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarsia.functions import vocab
from tarsia.functions.prices import money
from tarsia.operators import extract
from tarsia.plans import answers
from tarsia.plans.assistant import answer
from tarsia.plans.intent import parse
from tarsia.sources.catalog import Catalog


@pytest.fixture(scope="module")
def cat(spark):
    products = [{"id": f"m{i}", "name": f"Monitor portatile {i}", "category": "laptop"} for i in range(25)] + [{"id": "w", "name": "Apple iPhone 15 nero", "category": "smartphone"}, {"id": "z", "name": "Samsung Galaxy A55", "category": "smartphone"}]
    offer = lambda p, s, v, **more: {"id": f"{p}-{s}", "product_id": p, "store_id": s, "current_price": v, "availability": "available", "condition": "new", "data_confidence": "alta"} | more
    offers = [offer(f"m{i}", "a" if i % 2 else "b", 300.0 + i, old_price=400.0) for i in range(25)] + [offer("w", "a", 800.0)]
    at = dt.datetime(2026, 1, 1)
    history = [{"product_id": "w", "store_id": "a", "price": p, "checked_at": at + dt.timedelta(days=i), "condition": "new", "data_confidence": "alta"} for i, p in enumerate((820.0, 810.0, 805.0, 900.0))]
    return Catalog.from_rows(spark, products=products, stores=[{"id": "a", "name": "Alfa"}, {"id": "b", "name": "Beta"}], offers=offers, history=history)


def test_texts_by_intent(cat):
    said = lambda q: answer(cat, q).text
    assert said("").startswith("Non ho capito bene la domanda.")
    assert said("migliori laptop").split("\n")[0] == "Ho trovato 6 risultati per laptop."
    assert said("migliori laptop").endswith("Confronto basato su 2 store.")
    assert said("laptop sotto 310 euro").split("\n")[0] == "Ho trovato 6 opzioni sotto €310.00."
    assert said("laptop con lo sconto maggiore").startswith(vocab.DISCOUNTS)
    assert said("iphone 15") == vocab.SPECIFIC[1]
    assert said("samsung galaxy a55") == vocab.SPECIFIC[0]
    assert said("cerca aspirapolvere robot").startswith('Non ho trovato prodotti reali per "')


def test_when_to_buy():
    ctx = {"points": 4, "low": 805.0, "mean": 833.75}
    p = {"recommendation": "wait", "confidence": "media", "current_price": 1000.0, "history_avg": 833.75, "history_min": 805.0}
    best = {"store_name": "Alfa", "price": 800.0}
    text = answers.timing("Telefono", best, ctx, p)
    assert "Per Telefono: wait." in text and vocab.REASONS["high"] in text and "min=€805.00, media=€833.75, confidence=media" in text
    assert vocab.REASONS["falling"] in answers.timing("Telefono", best, ctx, p | {"current_price": 810.0})
    assert vocab.REASONS["low"] in answers.timing("Telefono", best, ctx, p | {"recommendation": "buy_now"}) and vocab.REASONS["plain"] in answers.timing("Telefono", best, ctx, p | {"recommendation": "monitor"})
    assert answers.timing("Telefono", best, None, None).startswith("Non ho ancora abbastanza storico per dire quando conviene comprare Telefono. Prezzo attuale migliore: Alfa a €800.00.")
    assert answers.timing("Telefono", None, ctx, None).startswith("Non ho ancora una previsione affidabile per Telefono.")


def test_timing_of_the_catalog(cat):
    a = answer(cat, "quando conviene comprare smartphone")
    assert a.text.split("\n")[0] in ("Per Apple iPhone 15 nero: buy_now.",) or "storico" in a.text


def test_replies_from_outside(cat):
    q = "migliori laptop"
    first = [c["product_id"] for c in answer(cat, q).cards]
    reply = {"answer_title": "  Ecco i  monitor ", "answer_summary": "scelti bene", "product_ids": [first[2], 7, "altro"], "product_reasons": [{"product_id": first[2], "reason": "x" * 150}, {"product_id": "altro", "reason": "no"}, {"product_id": first[0], "reason": "costa € 1"}, "rotto", {"product_id": first[1], "reason": 5}]}
    a = answer(cat, q, outside=json.dumps(reply))
    assert a.text.split("\n")[:2] == ["Ecco i monitor", "scelti bene"] and a.cards[0]["product_id"] == first[2]
    assert a.cards[0]["reason"] == "x" * 137 + "..." and {c["product_id"] for c in a.cards} == set(first)
    assert answer(cat, q, outside={**reply, "answer_summary": "da € 9"}).text.startswith(f"laptop: 6 opzioni reali\n{vocab.CONCISE_SUMMARY}")
    for broken in ("{", "", "[1]", None, {"answer_title": " "}, {"product_reasons": None}):
        assert answer(cat, q, outside=broken).text == answer(cat, q).text


def test_small_parts(spark):
    assert answers.tolerant_json('{"a": 1}') == {"a": 1} and answers.tolerant_json("{") is None and answers.tolerant_json(None) is None
    assert answers.honesty({"Alfa"}, 2) == "Confronto limitato: al momento ho dati utilizzabili solo da Alfa. " + vocab.FEW_PRODUCTS
    assert answers.honesty(points=1) == vocab.THIN_HISTORY and answers.honesty() == vocab.REAL_DATA == answers.honesty(set())
    assert answers.query_label(parse("iphone 15 pro")).startswith("iPhone")
    got = [r[0] for r in spark.createDataFrame([(1.5,), (None,), (1234.0,)], "v double").select(money(F.col("v"))).collect()]
    assert got == [answers.price_text(v) for v in (1.5, None, 1234.0)]


def test_prices_and_stock_of_each_shop(spark):
    """One decimal is an amount in the first shop's texts alone; words in a script are no statement that stock is out."""
    text = lambda shop, t: spark.createDataFrame([(t,)], "t string").select(extract.contextual_price(F.col("t"), shop)).first()[0]
    assert text(extract.UNIEURO, "iva inclusa 12,5 €") == 12.5 and text(extract.MEDIAWORLD, "prezzo 12,5 €") == 5
    assert text(extract.UNIEURO, "iva inclusa 99 € invece di € 120") == 120
    old = lambda shop, t: spark.createDataFrame([(t,)], "t string").select(extract.old_price(F.col("t"), F.lit(None).cast("double"), shop)).first()[0]
    assert old(extract.UNIEURO, "anziché € 99,5") == 99.5 and old(extract.MEDIAWORLD, "anziché € 99,5") == 99
    stock = lambda shop, t, page: spark.createDataFrame([(t,)], "t string").select(extract.availability(F.col("t"), shop, page)).first()[0]
    for shop in extract.RETAILERS.values():
        assert stock(shop, '{"status": "out_of_stock"}', True) == "available" and stock(shop, "out_of_stock", False) == "out_of_stock"
        assert stock(shop, "Prodotto non disponibile", True) == "out_of_stock"
    assert stock(extract.MEDIAWORLD, "soldout", True) == "available" and stock(extract.MEDIAWORLD, "soldout", False) == "out_of_stock"
