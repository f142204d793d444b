"""Retrieval, ranking, matching, gates, extraction and the write path on made rows."""

import pytest
from pyspark.sql import functions as F

from tarsia.functions import prices, text
from tarsia.functions.predicates import usable_offer
from tarsia.operators import extract, gates, ingest, matching, offers, retrieve
from tarsia.plans.assistant import answer, payload
from tarsia.plans.intent import parse, refine
from tarsia.sources.catalog import Catalog, by_ids, read_candidates


def values(spark, f, items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def offer(id_, product, price, old=None, store="s1", **more):
    return {"id": id_, "product_id": product, "store_id": store, "current_price": price, "old_price": old, **more}


def test_normalisers(spark):
    assert values(spark, text.search_text, ["Però! 5€", None]) == ["pero 5 euro", ""]
    assert values(spark, text.gate_text, ['USB-C È 55"']) == ['usbc è 55"']
    assert values(spark, text.audit_text, ["  A-b È "]) == ["a b è"]
    assert values(spark, text.match_text, ['TV 55,5" 256 GB PlayStation 5 usb c']) == ["tv 55.5inch 256gb ps5 usbc"]
    assert values(spark, text.canonical_key, ["Apple AirPods (2nd gen) USB-C wireless"]) == ["airpods-2-usbc"]
    assert values(spark, text.search_term, ["a%_(b)è-c", None]) == ["a b è-c", ""]


def test_prices(spark):
    assert values(spark, prices.gate_price, ["1.299,00 €", "1.299", "12,5", "abc", None]) == [1299.0, 1.299, 12.5, None, None]
    assert values(spark, prices.page_price, ["1.299,00", "4,99", "5000,01", "EUR 12,5"]) == [1299.0, None, None, 12.5]
    assert values(spark, lambda c: prices.page_price(c, dot_thousands=True), ["1.299", "12.5"]) == [1299.0, 12.5]


def test_availability_is_read_in_two_ways(spark):
    cat = Catalog.from_rows(spark, offers=[offer(a, "p", 1.0, availability=a) for a in ("out_of_stock", "Non disponibile", " esaurito ", "available")] + [offer("null", "p", 1.0)])
    ids = lambda strict: {r.id for r in cat.offers.where(usable_offer(strict)).collect()}
    assert ids(False) == {"out_of_stock", "available", "null"} and ids(True) == {"available", "null"}


def test_retrieval(spark):
    rows = [offer("1", "2", 80.0, 100.0), offer("2", "1", 100.0, 200.0), offer("3", "1", 40.0, 100.0), offer("4", "3", 100.0, 100.0)]
    cat = Catalog.from_rows(spark, products=[{"id": str(i), "name": f"n{i}", "category": "tv"} for i in range(4)], offers=rows)
    assert [r.product_id for r in retrieve.offer_first(cat.offers, "discount").orderBy("pos").collect()] == ["1", "2"]
    assert [r.product_id for r in retrieve.offer_first(cat.offers, "budget", budget=90.0).orderBy("pos").collect()] == ["1", "2"]
    assert [r.id for r in by_ids(cat.products, ["2", "1", "2", None, ""]).collect()] == ["2", "1"]
    assert retrieve.candidates(cat.products).count() == 0 and retrieve.candidates(cat.products, terms=["_ %"]).count() == 0
    best = {r.product_id: (r.price, r.offers_checked, r.store_name) for r in offers.best_offers(cat.offers, cat.stores).collect()}
    assert best["1"] == (40.0, 2, "negozio sconosciuto")
    with pytest.raises(ValueError, match="mode"):
        retrieve.offer_first(cat.offers, "other")


def test_questions():
    q = parse("Quali cuffie wireless Sony sotto 100 euro?")
    assert (q.intent, q.category, q.brand, q.budget, q.needs, q.sort_preference) == ("best_under_budget", "cuffie", "sony", 100.0, ("wireless",), "lowest_price")
    assert parse("iphone 16").keywords == ("iphone",) and parse("iphone 16").specific
    assert [parse(t).intent for t in ("maggior sconto tv", "quando comprare un tv", "dove costa meno il tv", "consigli tv", "trova", "tv", "")] == ["discount_ranking", "when_to_buy", "cheapest_offer", "category_recommendation", "product_search", "product_search", "unknown"]
    assert parse("tv per ps5").brand is None and not parse("tv per ps5").specific
    base = parse("tv")
    assert refine("tv", base, lambda *_: {"intent": "nonsense", "budget_max": 70000, "brand": "lg"}).brand == "lg"
    assert refine("tv", base, lambda *_: 1 / 0) == base and refine("tv", base, lambda *_: {"budget_max": 70000}).budget is None


def test_answers(spark):
    products = [{"id": f"t{i}", "name": f"Televisore {i} pollici", "category": "tv"} for i in range(20)] + [{"id": "c", "name": "Cuffie JBL", "category": "cuffie"}]
    cat = Catalog.from_rows(spark, products=products, stores=[{"id": "s1", "name": "Shop"}], offers=[offer(f"o{i}", f"t{i}", 100.0 + i, 130.0, data_confidence="alta", availability="available") for i in range(20)])
    a = answer(cat, "consigli per un tv")
    assert len(a.cards) == 6 and a.diagnostics["fallback"] is None and a.cards[0]["product_id"] == "t0"
    assert set(a.cards[0]) == {"product_id", "name", "category", "image_url", "store_name", "price", "old_price", "discount_pct", "product_url", "availability", "data_confidence", "reason"}
    again = answer(cat, "consigli per un tv", ranking=["t3", "nope", "t3"], reasons={"t3": "perché sì", "t0": "€ 1"})
    assert [c["product_id"] for c in again.cards][:2] == ["t3", "t0"] and again.cards[0]["reason"] == "perché sì"
    assert answer(cat, "maggiore sconto").diagnostics["offer_first"] == "discount"
    assert payload(answer(cat, ""))["products"] == []


def match(spark, a, b, ca="tv", cb="tv"):
    cat = Catalog.from_rows(spark, products=[{"id": "1", "name": a, "category": ca}, {"id": "2", "name": b, "category": cb}])
    f = matching.features(cat.products)
    return [(r.confidence, r.conflicts) for r in matching.candidate_pairs(f).collect()], matching.exact_groups(f).count()


@pytest.mark.parametrize(("a", "b", "conflict"), [("Apple iPhone 15", "Apple iPhone 15 Pro", "different_variant"), ("Samsung Galaxy S24 128GB", "Samsung Galaxy S24 256GB", "different_capacity_storage"), ('LG OLED TV 55"', 'LG OLED TV 75"', "different_screen_size"), ("Sony PlayStation 5 disc", "Sony PlayStation 5 digital", "different_variant")])
def test_conflicts(spark, a, b, conflict):
    pairs, groups = match(spark, a, b)
    assert groups == 0 and len(pairs) == 1 and pairs[0][0] == "LOW" and conflict in pairs[0][1]


def test_matches(spark):
    assert match(spark, "Sony WH-1000XM5", "Sony WH-1000XM5") == ([], 1)
    assert match(spark, "Sony WH-1000XM5", "Cuffie Sony WH-1000XM5 bluetooth nuovo")[1] == 1
    assert match(spark, "Sony WH-1000XM5", "Sony WH-1000XM5", cb="cuffie") == ([], 0)
    three = Catalog.from_rows(spark, products=[{"id": str(i), "name": "Sony WH-1000XM5", "category": "tv"} for i in range(3)])
    assert matching.candidate_pairs(matching.features(three.products)).count() == 3


def test_gates(spark):
    base = {"name": "Sony WH-1000XM5 Black", "store_name": "Shop", "current_price": "100", "old_price": "120", "product_url": "u", "category": "cuffie", "image_url": "i", "availability": "available"}
    cases = [base, base | {"name": ""}, base | {"product_url": ""}, base | {"current_price": "-1"}, base | {"current_price": "200", "old_price": "100"}, base | {"image_url": ""}, base | {"name": "Sony " + "x" * 130}, base | {"category": "sconosciuta"}, base | {"name": "HP notebook 15", "category": "laptop"}, base | {"name": "Sony PlayStation 5 Digital Edition Slim bundle 1TB", "category": "gaming"}, base | {"category": "gaming_accessori"}]
    df = spark.createDataFrame([tuple([*c.values(), i]) for i, c in enumerate(cases)], [*base, "i"])
    r = gates.evaluate(df).orderBy("i").collect()
    assert r[0].accepted and r[0].severity == "WARNING" and r[0].normalized_category == "cuffie"
    assert [x.discard_reasons for x in r[1:4]] == [["missing_name"], ["missing_url"], ["invalid_price"]]
    assert "old_price_lower_than_current_price" in r[4].warnings and "missing_image" in r[5].warnings and "title_too_long" in r[6].warnings
    assert r[7].accepted and r[7].normalized_category is None and "unknown_category" in r[7].warnings
    assert r[8].matching_risk == "high" and "category_high_matching_complexity" in r[8].warnings
    assert {"digital_edition", "slim", "bundle", "1tb"} <= set(r[9].title.important_differentiators)
    assert r[10].normalized_category == "gaming"
    n = {(x.kind, x.value): x.n for x in gates.summarize(gates.evaluate(df)).collect()}
    assert n["total", ""] == 11 and n["accepted", ""] == 8 and n["rejected", ""] == 3
    assert gates.average_confidence(gates.evaluate(df)).first()[0] in ("low", "medium", "high")
    assert gates.average_confidence(gates.evaluate(df.limit(0))).first()[0] == "none"


def test_extraction(spark):
    ld = '<script type="application/ld+json">not json</script><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "TV Sony 55", "image": ["https://x.example/a.jpg"], "offers": [{"price": "499,90", "availability": "http://schema.org/InStock"}]}]}</script>'
    pages = [("/online/tv-pidABC1?x=1", ld, "", None), ("https://www.unieuro.it/online/tv-pidD2", "", "# TV LG 43\nSpedizione € 7,00\nPrezzo € 299,00 iva inclusa\nanziché 350", None), ("https://other.example/online/x-pid1", ld, "", None), ("/online/x-pid9", "", "", None), ("/online/x-pid8", "", "# Titolo buono", None), ("/online/x-pid7", "", "Sony WH-1|ABCD1|outOfStock|199,90|", None)]
    rows = {r.url: r for r in extract.extract_products(spark.createDataFrame(pages, "url string, html string, markdown string, search_title string"), extract.UNIEURO, "tv").collect()}
    a, b = rows[pages[0][0]], rows[pages[1][0]]
    assert (a.product_url, a.product_code, a.name, a.price, a.data_confidence, a.image_url, a.discard_reason) == ("https://www.unieuro.it/online/tv-pidABC1", "abc1", "TV Sony 55", 499.9, "alta", "https://x.example/a.jpg", None)
    assert (b.name, b.price, b.old_price, b.data_confidence, b.discard_reason) == ("TV LG 43", 299.0, 350.0, "media", None)
    assert [rows[p[0]].discard_reason for p in pages[2:]] == ["bad_url", "no_title", "no_price", "out_of_stock"]
    listing = "see /online/a-pid1 and https://unieuro.it/online/b-pid2?q and /online/a-pid1"
    assert values(spark, lambda c: extract.product_links(c, extract.UNIEURO), [listing]) == [["https://www.unieuro.it/online/a-pid1", "https://unieuro.it/online/b-pid2"]]
    found = spark.createDataFrame([(0, 0, "/online/list", listing), (0, 1, "/online/c-pid3", ""), (1, 0, "/online/a-pid1", "")], "query_ord int, item_ord int, url string, text string")
    assert [r.product_url[-4:] for r in extract.discover(found, extract.UNIEURO, 2).collect()] == ["pid1", "pid2"]
    assert values(spark, lambda c: extract.clean_title(c, extract.MEDIAWORLD), ["TV LG | MediaWorld.it", "login", "abc"]) == ["TV LG", None, None]


def test_second_shop(spark):
    shop = extract.MEDIAWORLD
    url = "/it/product/tv-12.html"
    data = '<script>{"sku": "1", "price": "19,90", "shipping": true}</script>' + " " * 10 + "x " * 400 + '<script>{"product": 1, "currency": "EUR", "value": "249,90"}</script>'
    pages = [
        (url, "<title>a</title>", "# TV LG 43", {"OG:Price:Amount": "399,00", "og:title": "TV LG %26 Co | MediaWorld.it", "og:image": "//img.example/a.jpg"}),
        (url, data, "# TV Sony", {"price": "none"}),
        (url, "", "![Carrello](x)\n![Forno Smeg](y)\nPrezzo € 99,00", None),
        (url, "", "# TV\u0020Rotta", {}),
    ]
    rows = extract.extract_products(spark.createDataFrame([(i, *p, None) for i, p in enumerate(pages)], "i int, url string, html string, markdown string, metadata map<string,string>, search_title string"), shop, "tv")
    got = [(r.name, r.price, r.data_confidence, r.discard_reason) for r in rows.collect()]
    assert got == [("TV LG & Co", 399.0, "alta", None), ("TV Sony", 249.9, "alta", None), ("Forno Smeg", 99.0, "media", None), ("TV Rotta", None, "bassa", "no_price")]
    assert rows.first().image_url == "https://img.example/a.jpg" and rows.first().product_url == "https://www.mediaworld.it/it/product/tv-12.html" and rows.first().product_code == "tv12"
    assert values(spark, lambda c: extract.clean_text(c, True), ["a%20b\\/c \\u002F d", None]) == ["a b/c / d", ""]
    asked = ["site:x.it tv, 4k  €", "site:x.it", None]
    assert values(spark, lambda c: extract.search_query(c, shop), asked) == ["site:mediaworld.it/it/product tv 4k", *["site:mediaworld.it/it/product mediaworld prodotti"] * 2]
    assert values(spark, lambda c: extract.search_query(c, extract.UNIEURO), asked)[:2] == ["site:unieuro.it/online tv, 4k €", "site:unieuro.it/online unieuro prodotti"]
    assert values(spark, lambda c: extract.old_price(c, F.lit(10.0), shop), ["invece di € 12,50"]) == [12.5]


def test_search_payloads(spark):
    item = '{"url": "/u", "title": "t", "markdown": "m"}'
    said = [f"[{item}, 3]", f'{{"data": [{item}]}}', f'{{"data": {{"web": 1, "results": [{item}]}}}}', f'{{"data": {{"items": [{item}]}}}}', "{}", "broken", None, "[]"]
    rows = extract.search_items(spark.createDataFrame(list(enumerate(said)), "query_ord int, payload string")).orderBy("query_ord").collect()
    assert [(r.query_ord, r.item_ord, r.url, r.title, r.text) for r in rows] == [(i, 0, "/u", "t", "m") for i in range(4)]


def test_listing_import(spark):
    schema = "ord long, name string, category string, image_url string, search_keywords string, store_name string, store_website string, current_price double, old_price double, product_url string, availability string, condition string, listing_type string, data_confidence string, checked_at timestamp, buying_options array<string>, seller_feedback_percentage string"
    row = lambda o, condition, options, feedback: (o, f"tv {o}", "tv", None, None, "Shop", "w", 1.0, None, "u", None, condition, None, None, None, options, feedback)
    rows = [row(0, "Brand New", ["FIXED_PRICE"], "98.0"), row(1, "Used", ["FIXED_PRICE"], "99"), row(2, "New", ["AUCTION"], "99"), row(3, "New", ["FIXED_PRICE"], "97.9"), row(4, "New", ["FIXED_PRICE"], "many"), row(5, None, None, None)]
    cat = ingest.import_listings(Catalog.from_rows(spark), spark.createDataFrame(rows, schema))
    assert [p.name for p in cat.products.collect()] == ["tv 0"] and cat.offers.count() == 1


def test_candidates_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"candidates": [{"name": "x", "category": "tv"}]}')
    (tmp_path / "b.json").write_text('[{"name": "x"}, {"name": "y"}]')
    assert read_candidates(spark, f"file://{tmp_path}/a.json").count() == 1 and read_candidates(spark, f"file://{tmp_path}/b.json").count() == 2


def test_write_path(spark):
    schema = "ord long, name string, category string, image_url string, search_keywords string, store_name string, store_website string, current_price double, old_price double, product_url string, availability string, condition string, listing_type string, data_confidence string, checked_at timestamp"
    row = lambda o, name, price, store="Shop": (o, name, "tv", f"i{o}", None, store, "w", price, None, "u", "available", None, None, "alta", None)
    cat = ingest.save_batch(Catalog.from_rows(spark), spark.createDataFrame([row(0, "A tv", 10.0), row(1, "A tv", 10.0), row(2, "A tv", 12.0), row(3, "B", None)], schema))
    assert cat.products.count() == 2 and cat.stores.count() == 1 and {(o.current_price) for o in cat.offers.collect()} == {12.0, None}
    assert sorted(h.price or 0 for h in cat.history.collect()) == [0, 10.0, 12.0]
    cat = ingest.save_batch(cat, spark.createDataFrame([row(9, "A tv", 12.0), row(10, "A tv", 11.0, "Other"), row(11, "B", 5.0)], schema))
    assert cat.offers.count() == 3 and cat.stores.count() == 2 and sorted(h.price or 0 for h in cat.history.collect()) == [0, 5.0, 10.0, 11.0, 12.0]
    assert {p.image_url for p in cat.products.collect()} == {"i0", "i3"}
