"""Audits over random catalogs, counted again in plain Python."""

import datetime as dt
import json
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarsia.operators import matching
from tarsia.operators.predict import as_json, predict
from tarsia.plans import metrics, quality, readiness
from tarsia.sources.catalog import Catalog

NOW = dt.datetime(2026, 6, 15, 12)


def got(report):
    return {(r.section, r.label): (r.count_num, r.total) for r in report.collect()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('reports')}"


def blank_or(r, value, share=0.2):
    return r.choice([None, ""]) if r.random() < share else value


def messy(seed):
    """Relations with every kind of fault: blanks, keys that nothing has, repeats, prices of zero and none."""
    r = random.Random(seed)
    nouns = ["Frigo", "frigo", "Lampada", "Radio", "radio!", "Forno x" * 30]
    products = [{"id": f"item-{i}", "name": blank_or(r, r.choice(nouns)), "category": blank_or(r, r.choice(["casa", "Cucina", "cucina"])), "canonical_key": blank_or(r, "k"), "search_keywords": blank_or(r, "w", 0.4), "image_url": blank_or(r, "i", 0.5)} for i in range(37)]
    shops = [{"id": f"shop-{i}", "name": blank_or(r, r.choice(["Emporio", "EMPORIO", "Bottega", "Mercato"]))} for i in range(11)]
    keys, sellers = [f"item-{i}" for i in range(0, 50, 2)], [f"shop-{i}" for i in range(0, 16, 3)]
    offers = [{"id": f"offer-{i}", "product_id": blank_or(r, r.choice(keys), 0.1), "store_id": blank_or(r, r.choice(sellers), 0.1), "current_price": r.choice([None, 0.0, -2.0, 9.5, 30.0]), "old_price": r.choice([None, 7.0, 40.0]), "product_url": blank_or(r, r.choice(["a", "b"])), "availability": blank_or(r, "available")} for i in range(83)]
    history = [{"id": f"seen-{i}", "product_id": blank_or(r, r.choice([f"item-{k}" for k in range(3, 60, 4)]), 0.1), "store_id": r.choice(sellers), "price": r.choice([None, 0.0, 12.0, 15.0]), "checked_at": NOW} for i in range(71)]
    return products, shops, offers, history


def none(rows, field):
    return sum(1 for x in rows if x.get(field) in (None, ""))


def repeats(keys):
    return sum(1 for k, n in Counter(keys).items() if n > 1 and all(k))


def plain(text):
    return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in (text or "").lower()).split())


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_counts(spark, folder, seed):
    products, shops, offers, history = messy(seed)
    report = quality.report(Catalog.from_rows(spark, products=products, stores=shops, offers=offers, history=history), folder)
    n = {k: v for k, (v, _) in got(report).items()}
    ids, sold, seen, stores, selling = ({x[f] for x in rows if x[f]} for rows, f in ((products, "id"), (offers, "product_id"), (history, "product_id"), (shops, "id"), (offers, "store_id")))
    strange = {"offers of unknown products": sum(1 for o in offers if o["product_id"] and o["product_id"] not in ids), "offers of unknown stores": sum(1 for o in offers if o["store_id"] and o["store_id"] not in stores)}
    rows_of_unknown = sum(1 for h in history if h["product_id"] and h["product_id"] not in ids)
    want = {
        "products": {f"products without {f}": none(products, f) for f in ("name", "category", "canonical_key", "search_keywords", "image_url")}
        | {"products": len(products), "duplicate name and category": repeats((plain(p["category"]), plain(p["name"])) for p in products), "products without offers": len(ids - sold), "products without history": len(ids - seen), "names of over 120 characters": sum(len(p["name"] or "") > 120 for p in products)},
        "offers": strange
        | {"offers": len(offers), "offers without product": none(offers, "product_id"), "offers without store": none(offers, "store_id"), "offers without price": none(offers, "current_price"), "offers without url": none(offers, "product_url"), "offers without availability": none(offers, "availability")}
        | {"offers with price of at most 0": sum(o["current_price"] is not None and o["current_price"] <= 0 for o in offers), "old price below current price": sum(None not in (o["old_price"], o["current_price"]) and o["old_price"] < o["current_price"] for o in offers)}
        | {"duplicate product, store and url": repeats((o["product_id"], o["store_id"], o["product_url"]) for o in offers), "products with several offers": repeats((o["product_id"],) for o in offers)},
        "stores": {"stores": len(shops), "stores without name": none(shops, "name"), "duplicate store names": repeats((plain(s["name"]),) for s in shops), "stores without offers": len(stores - selling)},
        "history": {"history rows": len(history), "rows without product": none(history, "product_id"), "rows of unknown products": rows_of_unknown, "rows without price": none(history, "price"), "rows with price of at most 0": sum(h["price"] == 0 for h in history)}
        | {"products with history": len(ids & seen), "products without history": len(ids - seen), "rows per product with history": round(sum(1 for h in history if h["product_id"]) / len(ids & seen), 2)},
        "cross": strange | {"rows of unknown products": rows_of_unknown, "products without offers": len(ids - sold)},
    }
    assert n == {(s, label): count for s, labels in want.items() for label, count in labels.items()}

    risks = [r.status for r in metrics.top_risks(report).collect()]
    assert len(risks) == 8 and risks == sorted(risks, key=lambda s: s != "CRITICAL")
    assert f"offers of unknown products: {strange['offers of unknown products']} of {len(offers)}" in metrics.text_report(report)
    found = {(s, m["label"]): m for s, rows in json.loads(metrics.json_report(report))["sections"].items() for m in rows}
    names = Counter(plain(s["name"]) for s in shops)
    assert found["stores", "duplicate store names"]["examples"] == sorted(f"{k}: {v} rows" for k, v in names.items() if k and v > 1)[:5]
    assert all(x.startswith(tuple(ids - sold)) for x in found["products", "products without offers"]["examples"])
    assert len(found["products", "products without offers"]["examples"]) == 5
    assert found["history", "rows of unknown products"]["examples"] == sorted(found["history", "rows of unknown products"]["examples"])


def test_a_missing_column_is_said(spark, folder):
    cat = Catalog.from_rows(spark, products=[{"id": "a", "name": "A"}])
    cat.products = cat.products.drop("canonical_key")
    row = next(r for r in quality.report(cat, folder).collect() if r.label == "products without canonical_key")
    assert (row.status, row.count_num, row.note) == ("OK", 0, "no such column: skipped")


def watched(seed):
    """Series of many depths, some flat, some unusable, of known and unknown products."""
    r = random.Random(seed)
    products = [{"id": f"item-{i}", "name": f"N{i}", "category": "casa"} for i in range(23)]
    history, offers = [], []
    for i in range(27):
        if i % 5:
            base = r.uniform(20, 90)
            for k in range(r.choice([1, 2, 3, 5, 9, 12])):
                price = round(base if i % 3 == 0 else base + r.randrange(4), 2)
                at = NOW - dt.timedelta(days=r.choice([1, 2, 5, 20, 40]), minutes=k)
                history.append({"product_id": f"item-{i}", "store_id": f"shop-{i % 2}", "price": r.choice([price, price, price, 0.0, None]), "checked_at": at, "data_confidence": r.choice(["alta", "alta", "bassa"]), "condition": r.choice(["new", "new", "used"])})
        offers.append({"id": f"offer-{i}", "product_id": f"item-{i}", "store_id": r.choice(["shop-0", "shop-1", ""]), "current_price": 50.0})
    history += [{"product_id": p, "store_id": "shop-0", "price": 3.0, "checked_at": NOW, "data_confidence": "alta"} for p in (None, "")]
    return products, offers, history


@pytest.mark.parametrize("seed", [3, 4])
def test_readiness_counts(spark, folder, seed):
    products, offers, history = watched(seed)
    cat = Catalog.from_rows(spark, products=products, offers=offers, stores=[], history=history)
    n = got(readiness.report(cat, folder, now=F.lit(str(NOW)).cast("timestamp")))
    usable = [h for h in history if h["price"] and h.get("condition", "new") == "new" and h["data_confidence"] == "alta"]
    series, pairs = defaultdict(list), defaultdict(list)
    for i, h in enumerate(usable):
        series[h["product_id"]].append(h)
        pairs[h["product_id"], h["store_id"]].append((h["checked_at"], i, h["price"]))
    ids = [p["id"] for p in products]
    depth = [len(series[i]) if i in series else 0 for i in ids]
    level = lambda d: "strong" if d >= 10 else "weak" if d >= 4 else "monitor" if d >= 2 else "none"
    levels = Counter(map(level, depth))
    newest = [max(h["checked_at"] for h in series[i]) for i in ids if i in series]
    keyed = {k: v for k, v in series.items() if k}
    latest = {k: max(v)[2] for k, v in pairs.items()}
    named = [o for o in offers if o["store_id"]]
    want = {
        ("coverage", "products"): len(ids), ("coverage", "history rows"): len(history), ("coverage", "products with usable history"): sum(d > 0 for d in depth), ("coverage", "products without usable history"): sum(d == 0 for d in depth),
        ("coverage", "mean usable points"): round(statistics.mean(depth), 2), ("coverage", "median usable points"): statistics.median(depth), ("coverage", "most usable points"): max(depth), **{("coverage", f"products with {k} points or more"): sum(d >= k for d in depth) for k in (2, 3, 5, 10)},
        ("recency", "oldest usable observation"): None, ("recency", "newest usable observation"): None,
        ("recency", "products seen in the last 3 days"): sum(t >= NOW - dt.timedelta(days=3) for t in newest), ("recency", "products not seen for 14 days"): sum(t < NOW - dt.timedelta(days=14) for t in newest),
        ("quality", "rows without product"): none(history, "product_id"), ("quality", "rows of unknown products"): sum(1 for h in history if h["product_id"] and h["product_id"] not in ids), ("quality", "rows without price"): none(history, "price"), ("quality", "rows with price of at most 0"): sum(h["price"] == 0 for h in history),
        ("quality", "repeated price points"): sum(len(v) - len({h["price"] for h in v}) for v in keyed.values()), ("quality", "products whose price never changed"): sum(1 for i in ids if len(keyed.get(i, [])) >= 2 and len({h["price"] for h in keyed[i]}) == 1),
        ("quality", "offers that differ from the latest observation"): sum(1 for o in offers if (o["product_id"], o["store_id"]) in latest and abs(latest[o["product_id"], o["store_id"]] - 50.0) > 0.01),
        ("readiness", "products with too little data"): levels["none"], ("readiness", "products to monitor only"): levels["monitor"], ("readiness", "products with a weak signal"): levels["weak"], ("readiness", "products with a stronger signal"): levels["strong"],
        ("readiness", "offers whose pair has too little data"): sum(len(pairs.get((o["product_id"], o["store_id"]), [])) < 2 for o in named),
    }
    assert {k: v for k, (v, _) in n.items()} == want
    assert n["readiness", "offers whose pair has too little data"][1] == len(named)
    said = {r.bucket: r.n for r in readiness.distribution(readiness.depths(cat)).collect()}
    assert said == {"insufficient_data": levels["none"], "monitor_only": levels["monitor"], "weak_buy_wait_guidance": levels["weak"], "stronger_buy_wait_guidance": levels["strong"]}


def test_unknown_times_are_those_of_creation(spark, folder):
    seen = [("2026-06-14 00:00:00", "2026-01-01 00:00:00"), (None, "2026-06-01 00:00:00"), (None, None)]
    cat = Catalog.from_rows(spark, products=[{"id": "a", "name": "A"}], history=[{"product_id": "a", "price": 5.0 + i, "data_confidence": "alta"} for i in range(3)])
    times = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(seen)], "ord long, checked string, created_at string")
    cat.history = cat.history.drop("checked_at").join(times, "ord").withColumn("checked_at", F.col("checked").cast("timestamp")).drop("checked")
    said = {r.label: r.count_text for r in readiness.report(cat, folder, now=F.lit(str(NOW)).cast("timestamp")).collect()}
    assert (said["oldest usable observation"], said["newest usable observation"]) == ("2026-06-01T00:00:00", "2026-06-14T00:00:00")


def test_each_relation_is_read_once(spark, folder, monkeypatch):
    """Every relation stands in the plan of one written table only."""
    products, shops, offers, history = messy(5)
    cat = Catalog.from_rows(spark, products=products, stores=shops, offers=offers, history=history)
    for name in ("products", "stores", "offers", "history"):
        setattr(cat, name, getattr(cat, name).withColumn(f"of_{name}", F.lit(name)).where(F.col(f"of_{name}") != "x").alias(f"relation_{name}"))
    seen, write = Counter(), metrics.Pass.write

    def counted(self, name, rows):
        plan = rows._jdf.queryExecution().analyzed().toString()
        seen.update({n: plan.count(f"relation_{n}") for n in ("products", "stores", "offers", "history")})
        return write(self, name, rows)

    monkeypatch.setattr(metrics.Pass, "write", counted)
    quality.report(cat, folder)
    assert dict(seen) == {"products": 1, "stores": 1, "offers": 1, "history": 1}
    seen.clear()
    readiness.report(cat, folder)
    assert (seen["products"], seen["offers"], seen["history"]) == (1, 1, 1)


def test_empty_catalog(spark, folder):
    cat = Catalog.from_rows(spark)
    assert got(quality.report(cat, folder))["offers", "offers"] == (0, None)
    assert got(readiness.report(cat, folder))["coverage", "products"] == (0, None)


def test_pair_report_and_prediction_json(spark):
    cat = Catalog.from_rows(
        spark,
        products=[{"id": str(i), "name": f"Lenovo Tab P12 {x}", "category": "tablet"} for i, x in enumerate(("64GB grigio", "64 GB verde", "128GB"))],
        offers=[{"id": f"offer-{s}", "product_id": "1", "store_id": s, "current_price": p} for s, p in (("nord", 210.0), ("sud", 199.0), ("est", 220.0))],
        stores=[{"id": s, "name": s.title()} for s in ("nord", "sud", "est")],
    )
    pairs = matching.match_report(matching.candidate_pairs(matching.features(cat.products)), cat.offers).collect()
    assert pairs and all((p.offer_count_l, p.store_count_l) == ((3, 3) if p.id_l == "1" else (0, 0)) for p in pairs)
    assert all((p.offer_count_r, p.store_count_r) == ((3, 3) if p.id_r == "1" else (0, 0)) for p in pairs)
    said = [json.loads(r.prediction) for r in as_json(predict(cat)).collect()]
    assert {(x["store_name"], x["current_price"]) for x in said} == {("Nord", 210.0), ("Sud", 199.0), ("Est", 220.0)} and all("volatility_pct" in x for x in said)


@pytest.mark.parametrize(("of", "table"), [(readiness, "points"), (quality, "history")])
def test_no_label_goes_with_the_history(spark, folder, monkeypatch, of, table):
    """Labels are as long as the rows; only those of orphans are made, and they are found."""
    cat = Catalog.from_rows(spark, products=[{"id": "a", "name": "A"}], history=[{"product_id": p, "store_id": "s", "price": 2.0} for p in "azy"])
    written, write = {}, metrics.Pass.write
    monkeypatch.setattr(metrics.Pass, "write", lambda self, name, rows: written.setdefault(name, write(self, name, rows)))
    orphans = next(r for r in of.report(cat, folder).collect() if r.label == "rows of unknown products")
    assert orphans.examples == ["y | s | 2.0", "z | s | 2.0"] and orphans.count_num == 2
    assert not {"said", "example"} & set(written[table].columns)
