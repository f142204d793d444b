"""Data-quality audit of a catalog: missing fields, orphans, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import missing, number
from ..functions.text import audit_text, label
from ..sources.catalog import Catalog
from .metrics import Pass, Section, report_of, when_

LONG_NAME = 120
C = F.col


def keys_of(df: DataFrame, col: str) -> DataFrame:
    """Distinct ids of a column, without missing ones."""
    return df.where(~missing(C(col))).select(C(col).alias("id")).distinct()


def without_match(rows: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    """Rows whose id, which they have, isn't among the keys."""
    return rows.where(~missing(C(col))).join(keys.withColumnRenamed("id", col), col, "left_anti")


def duplicate_products(products: DataFrame) -> DataFrame:
    """(category, name, n): products alike by normalised name and category."""
    key = products.select(audit_text(C("category")).alias("category"), audit_text(C("name")).alias("name")).where("category <> '' and name <> ''")
    return key.groupBy("category", "name").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_offers(offers: DataFrame) -> DataFrame:
    parts = [F.trim(F.coalesce(C(c), F.lit(""))).alias(c) for c in ("product_id", "store_id", "product_url")]
    key = offers.select(*parts).where("product_id <> '' and store_id <> '' and product_url <> ''")
    return key.groupBy("product_id", "store_id", "product_url").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_stores(stores: DataFrame) -> DataFrame:
    return stores.select(audit_text(C("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_label(*keys: str) -> Column:
    """What a group of duplicates has in common, and how many rows it has."""
    return F.concat(F.concat_ws(" | ", *keys), F.lit(": "), C("n").cast("string"), F.lit(" rows"))


def multi_offer_products(offers: DataFrame) -> DataFrame:
    return offers.where(~missing(C("product_id"))).groupBy("product_id").agg(F.count("*").alias("n")).where("n > 1")


def old_price_lower() -> Column:
    return number(C("old_price")) < number(C("current_price"))


def mean_depth(history: DataFrame) -> DataFrame:
    """One row: history rows that name a product, for each product that they name."""
    keyed = history.where(~missing(C("product_id")))
    return keyed.agg(F.coalesce(F.round(F.try_divide(F.count("*"), F.count_distinct("product_id")), 2), F.lit(0.0)).alias("mean_depth"))


def product_label() -> Column:
    return label(C("id"), C("name"), C("category"))


def offer_label() -> Column:
    return label(C("id"), C("product_id"), C("store_id"))


def history_label() -> Column:
    return label(C("product_id"), C("store_id"), C("price"))


def first_of(rows: DataFrame, key: str, keys: DataFrame, label: Column) -> DataFrame:
    """(id, label): of the rows of each of the keys (id) the first label."""
    return rows.select(C(key).alias("id"), label.alias("label")).join(keys.select("id"), "id", "left_semi").groupBy("id").agg(F.min("label").alias("label"))


def _grouped(rows: DataFrame, sets: dict[str, list[str]], label: Column) -> DataFrame:
    """(kind, keys, n, example): groups of several kinds at once, from one reading of the rows."""
    cols = list(dict.fromkeys(c for s in sets.values() for c in s))
    bit = {c: 1 << (len(cols) - 1 - i) for i, c in enumerate(cols)}
    kind = F.coalesce(*[F.when(F.grouping_id() == sum(b for c, b in bit.items() if c not in keys), F.lit(name)) for name, keys in sets.items()])
    rows = rows.withColumn("__label", label).groupingSets([[C(c) for c in keys] for keys in sets.values()], *[C(c) for c in cols])
    return rows.agg(kind.alias("kind"), F.count("*").alias("n"), F.min("__label").alias("example"))


def report(cat: Catalog, folder: str, examples: int = 5) -> DataFrame:
    """All metrics of the audit.

    Each relation is read once, the history once more for examples if any of it is orphaned:
    rows are counted on their way into groups by all their keys, which are small next to them.
    What concerns two relations is counted over the keys of both. The groups are written below ``folder``, which all executors share, and removed.
    """
    p, o, s, h = cat.products, cat.offers, cat.stores, cat.history
    trimmed = lambda c: F.trim(F.coalesce(C(c), F.lit("")))
    price = number(C("current_price"))
    optional = [c for c in ("canonical_key", "search_keywords", "image_url") if c in p.columns]
    with Pass(p.sparkSession, folder) as run:
        rows = run.watch(p, products=F.count("*"), no_name=when_(missing(C("name"))), no_category=when_(missing(C("category"))), long=when_(F.length("name") > LONG_NAME), **{f"no_{c}": when_(missing(C(c))) for c in optional})
        rows = rows.withColumns({"k_name": audit_text(C("name")), "k_category": audit_text(C("category"))})
        twice = (C("kind") == "alike") & (C("n") > 1) & (C("k_name") != "") & (C("k_category") != "")
        products = _grouped(rows, {"id": ["id"], "alike": ["k_category", "k_name"]}, F.when(missing(C("name")), F.concat(F.lit("\x01"), product_label())).otherwise(product_label()))
        products = run.write("products", run.watch(products, dup_products=when_(twice)))
        run.sample("dup_products", products.where(twice), F.concat(F.concat_ws(" | ", "k_category", "k_name"), F.lit(": "), C("n").cast("string"), F.lit(" rows")))
        run.sample("no_name", products.where((C("kind") == "id") & F.startswith("example", F.lit("\x01"))), F.substr("example", F.lit(2)))

        rows = run.watch(
            o, offers=F.count("*"), no_pid=when_(missing(C("product_id"))), no_sid=when_(missing(C("store_id"))), no_price=when_(missing(C("current_price"))), bad_price=when_(price <= 0), lower=when_(old_price_lower()),
            no_url=when_(missing(C("product_url"))), no_stock=when_(missing(C("availability"))),
        )
        rows = rows.withColumns({f"k_{c}": trimmed(c) for c in ("product_id", "store_id", "product_url")})
        alike = ["k_product_id", "k_store_id", "k_product_url"]
        twice = (C("kind") == "alike") & (C("n") > 1) & (C(alike[0]) != "") & (C(alike[1]) != "") & (C(alike[2]) != "")
        offers = _grouped(rows, {"product": ["product_id"], "store": ["store_id"], "alike": alike}, offer_label())
        offers = run.write("offers", run.watch(offers, dup_offers=when_(twice), multi=when_((C("kind") == "product") & ~missing(C("product_id")) & (C("n") > 1))))
        run.sample("dup_offers", offers.where(twice), duplicate_label(*alike))

        rows = run.watch(s, stores=F.count("*"), no_store_name=when_(missing(C("name")))).withColumn("k_name", audit_text(C("name")))
        twice = (C("kind") == "alike") & (C("n") > 1) & (C("k_name") != "")
        stores = run.write("stores", run.watch(_grouped(rows, {"id": ["id"], "alike": ["k_name"]}, label(C("name"))), dup_stores=when_(twice)))
        run.sample("dup_stores", stores.where(twice), duplicate_label("k_name"))

        # the history's counts are sums of its groups': nothing but numbers is held for a product
        history = run.write("history", h.groupBy("product_id").agg(F.count("*").alias("n"), when_(missing(C("price"))).alias("no_price"), when_(number(C("price")) <= 0).alias("bad_price")))
        of_all = lambda n, when=F.lit(True): F.coalesce(F.sum(F.when(when, C(n))), F.lit(0))
        run.seen |= history.agg(
            of_all("n").alias("history"), of_all("n", ~missing(C("product_id"))).alias("keyed"), of_all("n", missing(C("product_id"))).alias("h_no_pid"), of_all("no_price").alias("h_no_price"), of_all("bad_price").alias("h_bad_price"),
        ).first().asDict()

        def keyed(groups: DataFrame, key: str, name: str, kind: str | None = None) -> DataFrame:
            groups = groups if kind is None else groups.where(C("kind") == kind)
            return groups.where(~missing(C(key))).select(C(key).alias("id"), C("n").alias(name), *([] if kind is None else [C("example").alias(f"x_{name}")]))

        # all keys of products, with how often each relation has them
        known = products.where("kind = 'id'").select("id", C("n").alias("p"), F.ltrim(C("example"), F.lit("\x01")).alias("x_p"))
        facts = known.join(keyed(offers, "product_id", "o", "product"), "id", "full_outer").join(keyed(history, "product_id", "h"), "id", "full_outer")
        rows_of = lambda n, when: F.coalesce(F.sum(F.when(when, C(n))), F.lit(0))
        facts = run.write("facts", run.watch(
            facts, lonely=rows_of("p", C("o").isNull()), silent=rows_of("p", C("h").isNull()), orphan_p=rows_of("o", C("p").isNull()), orphan_h=rows_of("h", C("p").isNull()), known=when_(C("p").isNotNull() & C("h").isNotNull()),
        ))
        run.sample("lonely", facts.where("p is not null and o is null"), C("x_p"))
        run.sample("orphan_p", facts.where("p is null and o is not null"), C("x_o"))
        # labels of the history's rows are looked for only where there are orphans
        if run.seen["orphan_h"]:
            run.sample("orphan_h", first_of(h, "product_id", facts.where("p is null and h is not null"), history_label()), C("label"))
        known = stores.where("kind = 'id'").select("id", C("n").alias("s"), C("example").alias("x_s"))
        shops = known.join(keyed(offers, "store_id", "o", "store"), "id", "full_outer")
        shops = run.write("shops", run.watch(shops, idle=rows_of("s", C("o").isNull()), orphan_s=rows_of("o", C("s").isNull())))
        run.sample("idle", shops.where("s is not null and o is null"), C("x_s"))
        n, x = run.seen, run.examples(examples)

    total = n["products"]
    of_products = Section("products").add("products", total, status="OK").add("products without name", n["no_name"], total, critical=True, examples=x.get("no_name")).add("products without category", n["no_category"], total, critical=True)
    for c in ("canonical_key", "search_keywords", "image_url"):
        if c in optional:
            of_products.add(f"products without {c}", n[f"no_{c}"], total)
        else:
            of_products.add(f"products without {c}", 0, total, note="no such column: skipped")
    of_products.add(f"names of over {LONG_NAME} characters", n["long"], total).add("duplicate name and category", n["dup_products"], total, examples=x.get("dup_products"))
    of_products.add("products without offers", n["lonely"], total, critical=True, examples=x.get("lonely")).add("products without history", n["silent"], total)

    total = n["offers"]
    of_offers = Section("offers").add("offers", total, status="OK").add("offers without product", n["no_pid"], total, critical=True).add("offers of unknown products", n["orphan_p"], total, critical=True, examples=x.get("orphan_p"))
    of_offers.add("offers without store", n["no_sid"], total, critical=True).add("offers of unknown stores", n["orphan_s"], total, critical=True).add("offers without price", n["no_price"], total, critical=True)
    of_offers.add("offers with price of at most 0", n["bad_price"], total, critical=True).add("old price below current price", n["lower"], total).add("offers without url", n["no_url"], total).add("offers without availability", n["no_stock"], total)
    of_offers.add("duplicate product, store and url", n["dup_offers"], total, examples=x.get("dup_offers")).add("products with several offers", n["multi"], status="OK" if n["multi"] else "WARNING", note="Prices can only be compared where there are several.")

    total = n["stores"]
    of_stores = Section("stores").add("stores", total, status="OK").add("stores without name", n["no_store_name"], total, critical=True).add("duplicate store names", n["dup_stores"], total, examples=x.get("dup_stores")).add("stores without offers", n["idle"], total, examples=x.get("idle"))

    total = n["history"]
    depth = round(n["keyed"] / n["known"], 2) if n["known"] else 0.0
    of_history = Section("history").add("history rows", total, status="OK").add("rows without product", n["h_no_pid"], total, critical=True).add("rows of unknown products", n["orphan_h"], total, critical=True, examples=x.get("orphan_h"))
    of_history.add("rows without price", n["h_no_price"], total, critical=True).add("rows with price of at most 0", n["h_bad_price"], total, critical=True).add("products with history", n["known"], n["products"], status="OK")
    of_history.add("products without history", n["silent"], n["products"]).add("rows per product with history", depth, status="OK" if depth >= 2 else "WARNING", note="Counts all rows that name a product.")

    cross = Section("cross").again("offers of unknown products", of_offers).again("offers of unknown stores", of_offers).again("rows of unknown products", of_history).again("products without offers", of_products)
    return report_of(p.sparkSession, of_products, of_offers, of_stores, of_history, cross)
