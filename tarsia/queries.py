"""Registered queries over the star-schema tables, each with the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.predicates import missing, usable_history, usable_offer
from .functions.prices import page_price, rounded
from .operators import extract, gates, matching, offers, predict, rank, retrieve
from .operators.ingest import price_changes
from .operators.termindex import TermIndex
from .plans import metrics, quality, readiness
from .plans.intent import parse
from .sources.catalog import StarCatalog, by_ids, offers_of
from .sources.keyed import lookup, write_keyed
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col

BASE = """WITH products AS (
  SELECT p_partkey::VARCHAR AS id, p_name AS name, p_type AS category, p_brand AS brand, p_brand || ' ' || p_type AS search_keywords FROM part
), stores AS (
  SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier
), history AS (
  SELECT l_partkey::VARCHAR AS product_id, l_suppkey::VARCHAR AS store_id, l_extendedprice / l_quantity AS list_price, l_extendedprice / l_quantity * (1 - l_discount) AS price, l_shipdate AS checked_at,
         CASE l_returnflag WHEN 'N' THEN 'alta' WHEN 'A' THEN 'media' ELSE 'bassa' END AS data_confidence, CASE l_linestatus WHEN 'O' THEN 'new' ELSE 'used' END AS condition,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_discount) AS ord
  FROM lineitem
), offers AS (
  SELECT product_id || '-' || store_id AS id, *, price AS current_price, list_price AS old_price FROM history
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY ord DESC) = 1
), usable AS (
  SELECT * FROM history WHERE data_confidence IN ('alta', 'media') AND condition = 'new'
), good_offers AS (
  SELECT * FROM offers WHERE data_confidence IN ('alta', 'media') AND condition = 'new'
), best AS (
  SELECT *, count(*) OVER (PARTITION BY product_id) AS offers_checked FROM good_offers
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY current_price, id) = 1
), series AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY checked_at, ord) AS up, row_number() OVER (PARTITION BY product_id, store_id ORDER BY checked_at DESC, ord DESC) AS down FROM usable
), stats AS (
  SELECT product_id, store_id, count(*) AS points, min(price) AS low, max(price) AS high, avg(price) AS mean, avg(price) FILTER (down <= 3) AS recent, max(price) FILTER (up = 1) AS first, max(price) FILTER (down = 1) AS last,
         stddev_pop(price) AS spread, count(*) FILTER (data_confidence = 'alta') AS trusted
  FROM series GROUP BY ALL
), trends AS (
  SELECT *, CASE WHEN points < 2 OR first <= 0 THEN 'unknown' WHEN (last - first) / first * 100 <= -3 THEN 'falling' WHEN (last - first) / first * 100 >= 3 THEN 'rising' ELSE 'stable' END AS direction,
         CASE WHEN points < 3 THEN 'insufficient' WHEN points >= 8 AND trusted / points >= 0.5 THEN 'strong' ELSE 'usable' END AS quality
  FROM stats
), depths AS (
  SELECT p.id, coalesce(d, 0) AS depth FROM products p LEFT JOIN (SELECT product_id, count(*) AS d FROM usable WHERE price > 0 GROUP BY 1) h ON p.id = h.product_id
)
"""
PREDICT = """, judged AS (
  SELECT o.product_id, o.store_id, p.name AS product_name, p.category, coalesce(s.name, 'negozio sconosciuto') AS store_name, o.current_price AS price, t.*,
         CASE WHEN coalesce(points, 0) < 3 THEN 'insufficient_data' WHEN o.current_price <= low * 1.03 OR o.current_price <= mean * 0.92 THEN 'buy_now'
              WHEN o.current_price >= mean * 1.08 AND o.current_price >= low * 1.15 THEN 'wait' WHEN direction = 'falling' AND o.current_price > recent THEN 'wait' ELSE 'monitor' END AS recommendation
  FROM offers o JOIN products p ON o.product_id = p.id LEFT JOIN stores s ON o.store_id = s.id LEFT JOIN trends t ON o.product_id = t.product_id AND o.store_id = t.store_id
)
"""


def stable(sql: str) -> str:
    """round(x, n) as floor(x * 10^n + 0.5) / 10^n, as the queries round."""
    while (at := sql.find("round(")) >= 0:
        depth, i, comma = 1, at + 6, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        scale = f"{10 ** int(sql[comma + 1 : i - 1])}.0::DOUBLE"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {scale} + 0.5) / {scale}){sql[i:]}"
    return sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = stable(sql)
        return f

    return put


def star(spark: SparkSession, sf_dir: str) -> StarCatalog:
    return StarCatalog(spark, sf_dir)


# -- prediction ------------------------------------------------------------------------


@query(BASE + PREDICT + """SELECT product_id, store_id, product_name, category, store_name, round(price, 2) AS current_price, recommendation,
  CASE WHEN recommendation = 'insufficient_data' THEN 'bassa' WHEN quality = 'strong' THEN 'alta' ELSE 'media' END AS confidence, coalesce(points, 0) AS history_points,
  CASE WHEN recommendation <> 'insufficient_data' THEN round(low, 2) END AS history_min, CASE WHEN recommendation <> 'insufficient_data' THEN round(high, 2) END AS history_max,
  CASE WHEN recommendation <> 'insufficient_data' THEN round(mean, 2) END AS history_avg, CASE WHEN recommendation <> 'insufficient_data' THEN round(recent, 2) END AS recent_avg,
  CASE WHEN recommendation <> 'insufficient_data' THEN direction ELSE 'unknown' END AS trend, CASE WHEN recommendation <> 'insufficient_data' AND mean > 0 THEN round(spread / mean * 100, 2) END AS volatility_pct,
  CASE WHEN recommendation <> 'insufficient_data' THEN quality ELSE 'insufficient' END AS data_quality FROM judged""")  # fmt: skip
def predict_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.predict(star(spark, sf_dir))


@query(BASE + PREDICT + "SELECT category, recommendation, count(*) AS offers FROM judged GROUP BY ROLLUP (category, recommendation)")
def predict_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.predict(star(spark, sf_dir)).rollup("category", "recommendation").agg(F.count("*").alias("offers"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.series_stats(star(spark, sf_dir).history.where(usable_history()))


@query(BASE + "SELECT product_id, store_id, points, direction AS trend FROM trends")
def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("product_id", "store_id", "points", predict.trend(C("points"), C("first"), C("last")).alias("trend"))


@query(BASE + "SELECT product_id, store_id, round(CASE WHEN points >= 2 AND mean > 0 THEN spread / mean * 100 END, 4) AS volatility_pct FROM trends")
def price_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("product_id", "store_id", rounded(predict.volatility_pct(C("points"), C("spread"), C("mean")), 4).alias("volatility_pct"))


@query(BASE + "SELECT product_id, store_id, round(recent, 4) AS recent_avg FROM trends")
def recent_avg_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("product_id", "store_id", rounded(C("recent"), 4).alias("recent_avg"))


@query(BASE + "SELECT quality AS data_quality, count(*) AS pairs, sum(points)::BIGINT AS points FROM trends GROUP BY 1")
def data_quality_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).groupBy(predict.data_quality(C("points"), C("trusted")).alias("data_quality")).agg(F.count("*").alias("pairs"), F.sum("points").alias("points"))


@query(BASE + "SELECT product_id, count(*) AS points, round(min(price), 4) AS low, round(max(price), 4) AS high, round(avg(price), 4) AS mean, round(arg_max(price, (checked_at, ord)), 4) AS latest FROM usable GROUP BY 1")
def price_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = predict.price_context(star(spark, sf_dir))
    return c.select("product_id", "points", *[rounded(C(x), 4).alias(x) for x in ("low", "high", "mean", "latest")])


# -- offers and retrieval ---------------------------------------------------------------


@query(BASE + "SELECT b.product_id, b.id, b.store_id, coalesce(s.name, 'negozio sconosciuto') AS store_name, round(current_price, 4) AS price, round(old_price, 4) AS old_price, offers_checked FROM best b LEFT JOIN stores s ON b.store_id = s.id")
def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return offers.best_offers(cat.offers, cat.stores).select("product_id", "id", "store_id", "store_name", rounded(C("price"), 4).alias("price"), rounded(C("old_price"), 4).alias("old_price"), "offers_checked")


@query(BASE + "SELECT o.id, coalesce(s.name, 'negozio sconosciuto') AS store_name FROM offers o LEFT JOIN stores s ON s.id = o.store_id")
def offers_with_store_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return offers.with_store(cat.offers, cat.stores).select("id", "store_name")


@query(BASE + "SELECT w.pos, p.id, p.name FROM (SELECT unnest(['17', '3', 'none', '5', '0']) AS id, unnest([0, 1, 3, 5, 6]) AS pos) w JOIN products p USING (id)")
def multi_get_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["17", "3", "17", "none", None, "5", "0", " "]
    pos = spark.createDataFrame([(v, asked.index(v)) for v in set(asked) if v], "id string, pos int")
    return by_ids(star(spark, sf_dir).products, asked).join(F.broadcast(pos), "id").select("pos", "id", "name")


@query(BASE + "SELECT id, name, category FROM products WHERE category IN ('ECONOMY', 'PROMO') ORDER BY name, id LIMIT 300")
def bounded_category_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.candidates(star(spark, sf_dir).products, categories=["ECONOMY", "PROMO"]).select("id", "name", "category")


BY_TERM = BASE + "SELECT id, name, category FROM products WHERE " + " OR ".join(f"{c} ILIKE '%{t}%'" for t in ("anvil", "brand 7", "econ") for c in ("name", "search_keywords", "category")) + " ORDER BY name, id LIMIT 300"
TERMS = ["anvil", "Brand#7", "Econ_"]


@query(BY_TERM)
def bounded_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.candidates(star(spark, sf_dir).products, terms=TERMS).select("id", "name", "category")


@query(BY_TERM)
def indexed_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of trigrams, which is built first."""
    p = star(spark, sf_dir).products
    index = TermIndex.build(p, f"{_scratch(spark)}/terms")
    return index.candidates(p, TERMS).select("id", "name", "category")


@query(BASE + """, u AS (SELECT *, 0 AS src FROM (SELECT id, name FROM products WHERE category = 'SMALL' ORDER BY name, id LIMIT 60) UNION ALL SELECT *, 1 FROM (SELECT id, name FROM products WHERE name ILIKE '%bolt%' ORDER BY name, id LIMIT 60))
SELECT id, name, src FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src) = 1""")
def ordered_union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star(spark, sf_dir).products
    a = retrieve.candidates(p, categories=["SMALL"], limit=60).select("id", "name", F.lit(0).alias("src"))
    b = retrieve.candidates(p.where("name ilike '%bolt%'"), categories=["SMALL", "LARGE", "STANDARD", "ECONOMY", "MEDIUM", "PROMO"], limit=60).select("id", "name", F.lit(1).alias("src"))
    return retrieve.ordered_union(a, b)


@query(BASE + """, top AS (SELECT * FROM offers WHERE current_price > 0 AND old_price > 0 ORDER BY old_price DESC, current_price, id LIMIT 200),
ok AS (SELECT *, (old_price - current_price) / old_price * 100 AS d FROM top WHERE data_confidence IN ('alta', 'media') AND condition = 'new' AND old_price > current_price),
r AS (SELECT product_id, min(rn) AS rn FROM (SELECT *, row_number() OVER (ORDER BY d DESC, current_price, id) AS rn FROM ok) GROUP BY 1 ORDER BY 2 LIMIT 80)
SELECT product_id, row_number() OVER (ORDER BY rn)::INT AS pos FROM r""")
def offer_first_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.offer_first(star(spark, sf_dir).offers, "discount")


@query(BASE + """, top AS (SELECT * FROM offers WHERE current_price > 0 AND current_price <= 1500 ORDER BY current_price, id LIMIT 200),
ok AS (SELECT * FROM top WHERE data_confidence IN ('alta', 'media') AND condition = 'new'),
r AS (SELECT product_id, min(rn) AS rn FROM (SELECT *, row_number() OVER (ORDER BY current_price, id) AS rn FROM ok) GROUP BY 1 ORDER BY 2 LIMIT 80)
SELECT product_id, row_number() OVER (ORDER BY rn)::INT AS pos FROM r""")
def offer_first_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.offer_first(star(spark, sf_dir).offers, "budget", budget=1500.0)


@query(BASE + "SELECT product_id, round((old_price - current_price) / old_price * 100, 4) AS discount_pct, round(current_price, 4) AS price FROM best WHERE old_price > current_price ORDER BY (old_price - current_price) / old_price * 100 DESC, current_price, product_id LIMIT 20")
def discount_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    r = offers.offer_records(cat.products, cat.offers, cat.stores).where("discount_pct > 0").orderBy(F.desc("discount_pct"), "price", "product_id").limit(20)
    return r.select("product_id", rounded(C("discount_pct"), 4).alias("discount_pct"), rounded(C("price"), 4).alias("price"))


@query(BASE + "SELECT product_id, store_id, round(current_price, 4) AS price, offers_checked FROM best WHERE current_price <= 2000")
def best_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return offers.offer_records(cat.products, cat.offers, cat.stores, budget=2000.0).select("product_id", "store_id", rounded(C("price"), 4).alias("price"), "offers_checked")


@query(BASE + "SELECT p.name, min(b.current_price)::DOUBLE AS price, count(*) AS products FROM best b JOIN products p ON b.product_id = p.id GROUP BY 1")
def cheapest_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return offers.offer_records(cat.products, cat.offers, cat.stores).groupBy("name").agg(F.min("price").alias("price"), F.count("*").alias("products"))


# -- scores -------------------------------------------------------------------------------

QUESTION = "cerca red widget brand 17 sotto 90000 euro"
SCORED = """, blobs AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(name || ' ' || search_keywords || ' ' || category), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS blob FROM products
), scored AS (
  SELECT *, list_sum([CASE WHEN contains(' ' || blob || ' ', ' ' || t || ' ') THEN 70 WHEN contains(blob, t) THEN 18 ELSE 0 END FOR t IN ['cerca', 'red', 'widget', 'brand']])::DOUBLE
    + CASE WHEN contains(name, 'cerca red widget brand') THEN 180 ELSE 0 END AS score FROM blobs
)
"""


@query(BASE + SCORED + "SELECT id, score FROM scored WHERE score > 0")
def product_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rank.with_blob(star(spark, sf_dir).products)
    return p.select("id", rank.product_score(parse(QUESTION)).alias("score")).where("score > 0")


@query(BASE + SCORED + """, r AS (SELECT s.id AS product_id, score, current_price AS price, old_price, offers_checked, data_confidence, min(current_price) OVER () AS low, max(current_price) OVER () AS high FROM scored s JOIN best b ON s.id = b.product_id WHERE score > 0 AND current_price <= 90000)
SELECT product_id, round(score + CASE WHEN high <= low THEN 35 ELSE (high - price) / (high - low) * 70 END + 50 + greatest(0, 25 - (90000 - price) / 90000 * 20) + least(65, coalesce(CASE WHEN old_price > price THEN (old_price - price) / old_price * 100 END, 0) * 1.2)
  + CASE data_confidence WHEN 'alta' THEN 20 WHEN 'media' THEN 10 ELSE 0 END + least(25, offers_checked * 5) + 15, 4) AS ranking_score FROM r""")
def record_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("product_id", rounded(rank.record_score(parse(QUESTION)), 4).alias("ranking_score"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, q = star(spark, sf_dir), parse(QUESTION)
    p = rank.with_blob(cat.products).withColumn("score", rank.product_score(q)).where("score > 0")
    r = offers.offer_records(p, cat.offers, cat.stores, budget=q.budget)
    return r.crossJoin(F.broadcast(r.agg(F.min("price").alias("low"), F.max("price").alias("high"))))


@query(BASE + """SELECT product_id, name, round(current_price, 4) AS price FROM best b JOIN products p ON b.product_id = p.id QUALIFY row_number() OVER (PARTITION BY replace(replace(name, 'red ', ''), 'blue ', '') ORDER BY current_price, product_id) = 1""")
def dedupe_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    r = offers.offer_records(cat.products, cat.offers, cat.stores)
    return rank.dedupe_similar(r, [F.asc("price"), F.asc("product_id")]).select("product_id", "name", rounded(C("price"), 4).alias("price"))


# -- data quality ---------------------------------------------------------------------------


@query(BASE + "SELECT count(*) AS total, count(*) FILTER (coalesce(name, '') = '') AS no_name, count(*) FILTER (coalesce(category, '') = '') AS no_category, count(*) AS no_image, count(*) FILTER (length(name) > 120) AS long_name FROM products")
def dq_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts(star(spark, sf_dir).products, total=F.lit(True), no_name=missing(C("name")), no_category=missing(C("category")), no_image=missing(C("image_url")), long_name=F.length("name") > quality.LONG_NAME)


@query(BASE + "SELECT lower(category) AS category, lower(name) AS name, count(*) AS n FROM products GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_products(star(spark, sf_dir).products)


@query(BASE + "SELECT id, name FROM products WHERE id NOT IN (SELECT product_id FROM good_offers WHERE current_price < 200)")
def dq_products_without_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a usable offer below a price."""
    cat = star(spark, sf_dir)
    low = cat.offers.where(usable_offer() & (C("current_price") < 200))
    return cat.products.join(quality.keys_of(low, "product_id"), "id", "left_anti").select("id", "name")


@query(BASE + "SELECT id FROM offers WHERE product_id NOT IN (SELECT id FROM products WHERE category <> 'PROMO')")
def dq_orphan_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return quality.without_match(cat.offers, "product_id", quality.keys_of(cat.products.where("category <> 'PROMO'"), "id")).select("id")


@query(BASE + "SELECT product_id, count(*) AS n FROM history WHERE product_id NOT IN (SELECT id FROM products WHERE category <> 'PROMO') GROUP BY 1")
def dq_orphan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return quality.without_match(cat.history, "product_id", quality.keys_of(cat.products.where("category <> 'PROMO'"), "id")).groupBy("product_id").agg(F.count("*").alias("n"))


@query(BASE + "SELECT id, name FROM stores WHERE id NOT IN (SELECT store_id FROM offers WHERE current_price < 20)")
def dq_inactive_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores without an offer below a price."""
    cat = star(spark, sf_dir)
    return cat.stores.join(quality.keys_of(cat.offers.where("current_price < 20"), "store_id"), "id", "left_anti").select("id", "name")


@query(BASE + "SELECT product_id, count(*) AS n FROM offers GROUP BY 1 HAVING count(*) > 1")
def dq_multi_offer_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.multi_offer_products(star(spark, sf_dir).offers)


@query(BASE + "SELECT count(*) FILTER (old_price < current_price) AS lower, count(*) FILTER (old_price = current_price) AS same, count(*) AS total FROM offers")
def dq_old_price_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts(star(spark, sf_dir).offers, lower=quality.old_price_lower(), same=C("old_price") == C("current_price"), total=F.lit(True))


@query(BASE + "SELECT round(count(*) / count(DISTINCT product_id), 2) AS mean_depth FROM history")
def dq_avg_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mean_depth(star(spark, sf_dir).history)


def said(*rows: tuple[str, str, str, str, str]) -> str:
    """Rows of a report in SQL: section, label, count, total, and CRITICAL or WARNING if the count is above 0, or a status of its own."""
    kinds = {"CRITICAL": "CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'OK' END", "WARNING": "CASE WHEN n > 0 THEN 'WARNING' ELSE 'OK' END"}
    one = lambda section, label, n, total, kind: f"SELECT '{section}' AS section, '{label}' AS label, {kinds.get(kind, kind)} AS status, n::DOUBLE AS count_num, {total}::BIGINT AS total FROM (SELECT {n} AS n)"
    return " UNION ALL ".join(one(*r) for r in rows)


P, O, S, H = ("(SELECT count(*) FROM products)", "(SELECT count(*) FROM offers)", "(SELECT count(*) FROM stores)", "(SELECT count(*) FROM history)")
count_of = lambda table, where="true": f"(SELECT count(*) FROM {table} WHERE {where})"
OK, NO_P, NO_O = "'OK'", "product_id NOT IN (SELECT id FROM products)", "id NOT IN (SELECT product_id FROM offers)"
ORPHANS = [("offers of unknown products", count_of("offers", NO_P), O, "CRITICAL"), ("offers of unknown stores", count_of("offers", "store_id NOT IN (SELECT id FROM stores)"), O, "CRITICAL"), ("rows of unknown products", count_of("history", NO_P), H, "CRITICAL"), ("products without offers", count_of("products", NO_O), P, "CRITICAL")]
KNOWN = count_of("products", "id IN (SELECT product_id FROM history)")
DQ = said(
    ("products", "products", P, "NULL", OK), ("products", "products without name", count_of("products", "coalesce(name, '') = ''"), P, "CRITICAL"), ("products", "products without category", count_of("products", "coalesce(category, '') = ''"), P, "CRITICAL"),
    ("products", "products without canonical_key", count_of("products", "regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = ''"), P, "WARNING"), ("products", "products without search_keywords", count_of("products", "coalesce(search_keywords, '') = ''"), P, "WARNING"), ("products", "products without image_url", P, P, "WARNING"),
    ("products", "names of over 120 characters", count_of("products", "length(name) > 120"), P, "WARNING"), ("products", "duplicate name and category", "(SELECT count(*) FROM (SELECT 1 FROM products GROUP BY lower(category), lower(name) HAVING count(*) > 1))", P, "WARNING"),
    ("products", *ORPHANS[3]), ("products", "products without history", count_of("products", "id NOT IN (SELECT product_id FROM history)"), P, "WARNING"),
    ("offers", "offers", O, "NULL", OK), ("offers", "offers without product", count_of("offers", "product_id IS NULL"), O, "CRITICAL"), ("offers", *ORPHANS[0]), ("offers", "offers without store", count_of("offers", "store_id IS NULL"), O, "CRITICAL"), ("offers", *ORPHANS[1]),
    ("offers", "offers without price", count_of("offers", "current_price IS NULL"), O, "CRITICAL"), ("offers", "offers with price of at most 0", count_of("offers", "current_price <= 0"), O, "CRITICAL"), ("offers", "old price below current price", count_of("offers", "old_price < current_price"), O, "WARNING"),
    ("offers", "offers without url", O, O, "WARNING"), ("offers", "offers without availability", "0", O, "WARNING"), ("offers", "duplicate product, store and url", "0", O, "WARNING"),
    ("offers", "products with several offers", "(SELECT count(*) FROM (SELECT 1 FROM offers GROUP BY product_id HAVING count(*) > 1))", "NULL", "CASE WHEN n > 0 THEN 'OK' ELSE 'WARNING' END"),
    ("stores", "stores", S, "NULL", OK), ("stores", "stores without name", count_of("stores", "coalesce(name, '') = ''"), S, "CRITICAL"), ("stores", "duplicate store names", "(SELECT count(*) FROM (SELECT 1 FROM stores GROUP BY lower(name) HAVING count(*) > 1))", S, "WARNING"), ("stores", "stores without offers", count_of("stores", "id NOT IN (SELECT store_id FROM offers)"), S, "WARNING"),
    ("history", "history rows", H, "NULL", OK), ("history", "rows without product", count_of("history", "product_id IS NULL"), H, "CRITICAL"), ("history", *ORPHANS[2]), ("history", "rows without price", count_of("history", "price IS NULL"), H, "CRITICAL"), ("history", "rows with price of at most 0", count_of("history", "price <= 0"), H, "CRITICAL"),
    ("history", "products with history", KNOWN, P, OK), ("history", "products without history", count_of("products", "id NOT IN (SELECT product_id FROM history)"), P, "WARNING"), ("history", "rows per product with history", f"round({H} / {KNOWN}, 2)", "NULL", "CASE WHEN n >= 2 THEN 'OK' ELSE 'WARNING' END"),
    *(("cross", *r) for r in ORPHANS),
)


@query(BASE + DQ)
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(star(spark, sf_dir), _scratch(spark)).select("section", "label", "status", "count_num", "total")


@query(BASE + f"SELECT {', '.join(f'{n} AS {name}' for name, (_, n, _, _) in zip(('offers_product', 'offers_store', 'history_product', 'products_offers'), ORPHANS, strict=True))}, {count_of('stores', 'id NOT IN (SELECT store_id FROM offers)')} AS stores_offers")
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of whole relations whose keys another one lacks."""
    r = quality.report(star(spark, sf_dir), _scratch(spark))
    n = {"offers_product": ("offers", "offers of unknown products"), "offers_store": ("offers", "offers of unknown stores"), "history_product": ("history", "rows of unknown products"), "products_offers": ("products", "products without offers"), "stores_offers": ("stores", "stores without offers")}
    return r.agg(*[F.max(F.when((C("section") == s) & (C("label") == x), C("count_num"))).cast("long").alias(k) for k, (s, x) in n.items()])


@query(BASE + f"SELECT status, label, count_num FROM ({DQ}) WHERE status <> 'OK' QUALIFY row_number() OVER (ORDER BY CASE status WHEN 'CRITICAL' THEN 0 ELSE 1 END, count_num DESC, list_position(['cross', 'history', 'offers', 'products', 'stores'], section)) <= 8")
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_risks(quality.report(star(spark, sf_dir), _scratch(spark))).select("status", "label", "count_num")


# -- readiness --------------------------------------------------------------------------------


@query(BASE + "SELECT round(avg(depth), 2) AS mean, median(depth)::DOUBLE AS median, max(depth) AS most, count(*) FILTER (depth >= 2) AS at2, count(*) FILTER (depth >= 3) AS at3, count(*) FILTER (depth >= 5) AS at5, count(*) FILTER (depth >= 10) AS at10 FROM depths")
def depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = readiness.depths(star(spark, sf_dir))
    return d.agg(rounded(F.avg("depth"), 2).alias("mean"), F.median("depth").alias("median"), F.max("depth").alias("most"), *[F.count_if(C("depth") >= k).alias(f"at{k}") for k in (2, 3, 5, 10)])


BUCKET = "CASE WHEN depth >= 10 THEN 'stronger_buy_wait_guidance' WHEN depth >= 4 THEN 'weak_buy_wait_guidance' WHEN depth >= 2 THEN 'monitor_only' ELSE 'insufficient_data' END"
ALL_BUCKETS = "(SELECT unnest(['insufficient_data', 'monitor_only', 'weak_buy_wait_guidance', 'stronger_buy_wait_guidance']) AS bucket)"


@query(BASE + f"SELECT bucket, coalesce(n, 0) AS n FROM {ALL_BUCKETS} LEFT JOIN (SELECT {BUCKET} AS bucket, count(*) AS n FROM depths GROUP BY 1) USING (bucket)")
def depth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.distribution(readiness.depths(star(spark, sf_dir)))


@query(BASE + f", d AS (SELECT o.id, coalesce(n, 0) AS depth FROM offers o LEFT JOIN (SELECT product_id, store_id, count(*) AS n FROM usable WHERE price > 0 GROUP BY 1, 2) h USING (product_id, store_id)) SELECT bucket, coalesce(n, 0) AS n FROM {ALL_BUCKETS} LEFT JOIN (SELECT {BUCKET} AS bucket, count(*) AS n FROM d GROUP BY 1) USING (bucket)")
def pair_depth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.distribution(readiness.pair_depths(star(spark, sf_dir)))


@query(BASE + """, seen AS (SELECT product_id, max(checked_at) AS latest FROM usable WHERE price > 0 GROUP BY 1)
SELECT count(*) FILTER (latest >= TIMESTAMP '2001-11-01' - INTERVAL 3 DAY) AS recent, count(*) FILTER (latest < TIMESTAMP '2001-11-01' - INTERVAL 14 DAY) AS stale FROM seen""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2001-11-01").cast("timestamp")
    seen = readiness.latest_seen(star(spark, sf_dir))
    return metrics.counts(seen, recent=C("latest") >= now - F.expr("INTERVAL 3 DAYS"), stale=C("latest") < now - F.expr("INTERVAL 14 DAYS"))


def priced_up_to(cat: StarCatalog, step: int) -> StarCatalog:
    """The catalog with observed prices raised to the next multiple of ``step``, so that some repeat."""
    cat.history = cat.history.withColumn("price", (F.ceil(C("price") / step) * step).cast("double"))
    return cat


@query(BASE + ", coarse AS (SELECT product_id, ceil(price / 10) * 10 AS price FROM usable WHERE price > 0) SELECT product_id, count(price) - count(DISTINCT price) AS repeated FROM coarse GROUP BY 1 HAVING count(price) > count(DISTINCT price)")
def repeated_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.repeated_points(priced_up_to(star(spark, sf_dir), 10))


@query(BASE + "SELECT p.id, p.name FROM products p JOIN (SELECT product_id FROM usable WHERE price > 0 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT ceil(price / 10000)) = 1) h ON p.id = h.product_id")
def no_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.no_variation(priced_up_to(star(spark, sf_dir), 10000)).select("id", "name")


@query(BASE + ", latest AS (SELECT product_id, store_id, arg_max(price, (checked_at, ord)) AS latest FROM usable WHERE price > 0 GROUP BY 1, 2) SELECT o.id, round(current_price, 4) AS price, round(latest, 4) AS latest FROM offers o JOIN latest USING (product_id, store_id) WHERE abs(current_price - latest) > 0.01")
def latest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness.latest_mismatches(star(spark, sf_dir)).select("id", rounded(C("price"), 4).alias("price"), rounded(C("latest"), 4).alias("latest"))


D = lambda where="true": f"(SELECT count(*) FROM depths WHERE {where})"
READY = ", newest AS (SELECT product_id, max(checked_at) AS latest FROM usable WHERE price > 0 GROUP BY 1), pairs AS (SELECT product_id, store_id, count(*) AS n, arg_max(price, (checked_at, ord)) AS latest FROM usable WHERE price > 0 GROUP BY 1, 2), " + (
    "flat AS (SELECT product_id FROM usable WHERE price > 0 GROUP BY 1 HAVING count(*) >= 2 AND min(price) = max(price)), again AS (SELECT count(price) - count(DISTINCT price) AS n FROM usable WHERE price > 0 GROUP BY product_id) "
)
ENOUGH = lambda k: f"CASE WHEN n >= {k} THEN 'OK' ELSE 'WARNING' END"
READINESS = said(
    ("coverage", "products", P, "NULL", OK), ("coverage", "history rows", H, "NULL", OK), ("coverage", "products with usable history", D("depth > 0"), P, OK), ("coverage", "products without usable history", D("depth = 0"), P, "CRITICAL"),
    ("coverage", "mean usable points", "(SELECT round(avg(depth), 2) FROM depths)", P, ENOUGH(4)), ("coverage", "median usable points", "(SELECT median(depth) FROM depths)", P, ENOUGH(4)), ("coverage", "most usable points", "(SELECT max(depth) FROM depths)", P, ENOUGH(10)),
    *(("coverage", f"products with {k} points or more", D(f"depth >= {k}"), P, OK) for k in (2, 3, 5, 10)),
    ("recency", "oldest usable observation", "NULL", "NULL", OK), ("recency", "newest usable observation", "NULL", "NULL", OK),
    ("recency", "products seen in the last 3 days", count_of("newest", "latest >= TIMESTAMP '2001-11-01' - INTERVAL 3 DAY"), P, "CASE WHEN n > 0 THEN 'OK' ELSE 'WARNING' END"), ("recency", "products not seen for 14 days", count_of("newest", "latest < TIMESTAMP '2001-11-01' - INTERVAL 14 DAY"), P, "WARNING"),
    ("quality", "rows without product", count_of("history", "product_id IS NULL"), H, "CRITICAL"), ("quality", "rows of unknown products", count_of("history", NO_P), H, "CRITICAL"), ("quality", "rows without price", count_of("history", "price IS NULL"), H, "CRITICAL"), ("quality", "rows with price of at most 0", count_of("history", "price <= 0"), H, "CRITICAL"),
    ("quality", "repeated price points", "(SELECT coalesce(sum(n), 0) FROM again)", H, "WARNING"), ("quality", "products whose price never changed", count_of("flat"), P, "WARNING"),
    ("quality", "offers that differ from the latest observation", "(SELECT count(*) FROM offers o JOIN pairs USING (product_id, store_id) WHERE abs(o.current_price - pairs.latest) > 0.01)", O, "WARNING"),
    ("readiness", "products with too little data", D("depth < 2"), P, "CRITICAL"), ("readiness", "products to monitor only", D("depth BETWEEN 2 AND 3"), P, OK), ("readiness", "products with a weak signal", D("depth BETWEEN 4 AND 9"), P, OK),
    ("readiness", "products with a stronger signal", D("depth >= 10"), P, "CASE WHEN n > 0 THEN 'OK' ELSE 'WARNING' END"), ("readiness", "offers whose pair has too little data", "(SELECT count(*) FROM offers LEFT JOIN pairs USING (product_id, store_id) WHERE coalesce(n, 0) < 2)", O, "WARNING"),
)


@query(BASE + READY + READINESS)
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readiness.report(star(spark, sf_dir), _scratch(spark), now=F.lit("2001-11-01").cast("timestamp"))
    return r.select("section", "label", "status", "count_num", "total")


# -- matching -----------------------------------------------------------------------------------

TOKENS = """, toks AS (SELECT id, category, brand, lower(name) AS norm, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name || ' ' || search_keywords), '[^a-z0-9\\s.]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t NOT IN ('new', 'promo')))) AS tokens,
  trim(replace(' ' || lower(name), ' new ', ' ')) AS normalized FROM products)
"""


@query(BASE + "SELECT product_id, count(*) AS offer_count, count(DISTINCT store_id) AS store_count FROM offers GROUP BY 1")
def offer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.offer_summary(star(spark, sf_dir).offers)


@query(BASE + TOKENS + "SELECT category, normalized AS normalized_name, count(*)::INT AS members, 'HIGH' AS confidence FROM toks GROUP BY 1, 2 HAVING count(*) > 1")
def match_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_groups(matching.features(star(spark, sf_dir).products)).select("category", "normalized_name", C("members").cast("int").alias("members"), "confidence")


def _alike(spark: SparkSession, sf_dir: str, min_similarity: float | None = 0.74) -> matching.Alike:
    """Star-schema brands stand in for the block; model numbers are the brands' digits."""
    p = star(spark, sf_dir).products
    return matching.alike_classes(matching.features(p), block=("category", "brand"), extra_block=p.select("id", "brand"), min_similarity=min_similarity, folder=_scratch(spark))


@query(BASE + TOKENS + """SELECT a.id AS id_l, b.id AS id_r, round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), 3) AS overlap
FROM toks a JOIN toks b ON a.category = b.category AND a.brand = b.brand AND a.id < b.id
WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.42 AND (a.category, a.normalized, b.normalized) NOT IN (SELECT category, normalized, normalized FROM toks GROUP BY category, normalized HAVING count(*) = 2)""")
def match_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alike(spark, sf_dir, None).expanded(named=False).where("overlap >= 0.42").select("id_l", "id_r", "overlap")


@query()
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alike(spark, sf_dir).top()


@query(BASE + TOKENS + """, p AS (SELECT a.category, list_sort(list_filter(a.tokens, lambda t: t IN ('blue', 'red'))) AS x, list_sort(list_filter(b.tokens, lambda t: t IN ('blue', 'red'))) AS y FROM toks a JOIN toks b ON a.category = b.category AND a.brand = b.brand AND a.id < b.id
WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.42 AND (a.category, a.normalized, b.normalized) NOT IN (SELECT category, normalized, normalized FROM toks GROUP BY category, normalized HAVING count(*) = 2))
SELECT category, CASE WHEN len(x) > 0 AND len(y) > 0 AND x <> y THEN 'different_color' ELSE '' END AS conflicts, count(*) AS pairs FROM p GROUP BY 1, 2""")
def match_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alike(spark, sf_dir, None).counted().where("overlap >= 0.42").groupBy("category", F.array_join("conflicts", ",").alias("conflicts")).agg(F.sum("times").alias("pairs"))


@query(BASE + TOKENS + """, p AS (SELECT a.category, list_sort(list_filter(a.tokens, lambda t: t IN ('blue', 'red'))) AS x, list_sort(list_filter(b.tokens, lambda t: t IN ('blue', 'red'))) AS y FROM toks a JOIN toks b ON a.category = b.category AND a.brand = b.brand AND a.id < b.id
WHERE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.42 AND (a.category, a.normalized, b.normalized) NOT IN (SELECT category, normalized, normalized FROM toks GROUP BY category, normalized HAVING count(*) = 2))
SELECT count(*) AS pairs, count(*) FILTER (len(x) > 0 AND len(y) > 0 AND x <> y) AS with_conflicts, count(DISTINCT category) AS categories, (SELECT count(*) FROM (SELECT 1 FROM toks GROUP BY category, normalized HAVING count(*) > 1)) AS exact_groups FROM p""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = matching.exact_groups(matching.features(star(spark, sf_dir).products))
    return matching.match_summary(_alike(spark, sf_dir, None).counted().where("overlap >= 0.42"), groups).select("pairs", "with_conflicts", "categories", "exact_groups")


@query(BASE + "SELECT p.id, p.name, count(o.id) AS offer_count, count(DISTINCT o.store_id) AS store_count FROM products p LEFT JOIN offers o ON o.product_id = p.id GROUP BY 1, 2")
def match_offer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    return matching.with_offer_counts(matching.features(cat.products).select("id", "name"), cat.offers)


@query(BASE + "SELECT p.id AS product_id, o.id AS offer_id, round(o.current_price, 4) AS price FROM products p JOIN offers o ON o.product_id = p.id WHERE p.brand = 'Brand#13'")
def offers_of_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = star(spark, sf_dir)
    found = offers_of(cat.offers, cat.products.where("brand = 'Brand#13'"))
    return found.select("product_id", C("id").alias("offer_id"), rounded(C("current_price"), 4).alias("price"))


LOOKED_UP = ["7", "42", "no such product"]


@query(BASE + "SELECT product_id, store_id, round(current_price, 4) AS price FROM offers WHERE product_id IN ('7', '42') ORDER BY 1, 3")
def offers_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a few products from a table written for lookups."""
    rows, path = star(spark, sf_dir).offers, f"{_scratch(spark)}/offers"
    write_keyed(rows, path, "product_id", then=("store_id",))
    return lookup(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes), "product_id", LOOKED_UP).select("product_id", "store_id", rounded(C("current_price"), 4).alias("price"))


@query(BASE + "SELECT product_id, store_id, round(price, 4) AS price, checked_at FROM history WHERE product_id IN ('7', '42')")
def history_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was observed of a few products, from a table written for lookups."""
    rows, path = star(spark, sf_dir).history.select("product_id", "store_id", "price", "checked_at"), f"{_scratch(spark)}/history"
    write_keyed(rows, path, "product_id", then=("store_id", "checked_at"))
    found = lookup(spark, path, ", ".join(f"{c} {t}" for c, t in rows.dtypes), "product_id", LOOKED_UP)
    return found.select("product_id", "store_id", rounded(C("price"), 4).alias("price"), "checked_at")


# -- quality gates ----------------------------------------------------------------------------------

KINDS = ["smartphone", "cuffie wireless", "laptop", "smart tv", "", "giardino"]
MAKERS = ["samsung galaxy", "prodotto", "nuovo", "sony", ""]
LISTED = """WITH c AS (
  SELECT p_partkey AS ord, ['samsung galaxy ', 'prodotto ', 'nuovo ', 'sony ', ''][p_partkey % 5 + 1] || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || p_size || 'GB' WHEN p_size % 3 = 1 THEN ' pro' ELSE '' END END AS name,
    ['smartphone', 'cuffie wireless', 'laptop', 'smart tv', '', 'giardino'][p_size % 6 + 1] AS category, CASE WHEN p_partkey % 13 = 0 THEN '-1' ELSE replace(p_retailprice::VARCHAR, '.', ',') END AS price, CASE WHEN p_partkey % 7 = 0 THEN '1' END AS old, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'https://x.example/' || p_partkey END AS url FROM part
), n AS (
  SELECT *, trim(name) AS t, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS s FROM c
), k AS (
  SELECT *, length(t) AS length, list_filter(string_split(s, ' '), lambda x: x <> '') AS tokens FROM n
), d AS (
  SELECT *, len(tokens) AS token_count, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(t, '(?i)\\b\\d+(?:[,.]\\d+)?\\s*(?:gb|tb)\\b'), lambda x: lower(x)), list_filter(tokens, lambda x: x IN ('pro', 'blue', 'red'))))) AS differs,
    list_filter(tokens, lambda x: x IN ('samsung', 'sony')) AS brands, list_filter(tokens, lambda x: x = 'galaxy' OR regexp_matches(x, '\\d')) AS models, len(list_filter(tokens, lambda x: x NOT IN ('prodotto', 'nuovo'))) AS meaningful,
    CASE category WHEN 'smartphone' THEN 'smartphone' WHEN 'cuffie wireless' THEN 'cuffie' WHEN 'laptop' THEN 'laptop' WHEN 'smart tv' THEN 'tv' END AS cat, try_cast(replace(price, ',', '.') AS DOUBLE) AS p
  FROM k
), g AS (
  SELECT *, token_count > 0 AND meaningful <= 1 AND len(brands) = 0 AND len(models) = 0 AS generic FROM d
), r AS (
  SELECT *, CASE WHEN coalesce(cat = 'laptop', false) OR generic THEN 'high' WHEN len(differs) > 0 OR (len(brands) = 0 AND len(models) = 0) THEN 'medium' ELSE 'low' END AS risk FROM g
), w AS (
  SELECT *, list_filter([CASE WHEN name = '' THEN 'missing_name' END, CASE WHEN p <= 0 THEN 'invalid_price' END, CASE WHEN url = '' THEN 'missing_url' END, CASE WHEN category = '' THEN 'missing_category' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter([CASE WHEN category <> '' AND cat IS NULL THEN 'unknown_category' END, CASE WHEN old = '1' AND 1 < p THEN 'old_price_lower_than_current_price' END, 'missing_image', CASE WHEN length < 8 OR token_count < 2 THEN 'title_too_short' END, CASE WHEN length > 120 THEN 'title_too_long' END, CASE WHEN generic THEN 'generic_title' END,
      CASE WHEN cat = 'laptop' THEN 'category_high_matching_complexity' END, CASE WHEN len(differs) > 0 THEN 'important_differentiators_detected' END, CASE WHEN risk <> 'low' THEN 'needs_matching_review' END], lambda x: x IS NOT NULL) AS warnings FROM r
)
"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with every kind of fault, made of the parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    name = F.when(C("p_partkey") % 11 == 0, "").otherwise(F.concat("p_name", F.when(C("p_size") % 3 == 0, F.concat(F.lit(" "), C("p_size").cast("string"), F.lit("GB"))).when(C("p_size") % 3 == 1, " pro").otherwise("")))
    maker = F.concat(pick(MAKERS, C("p_partkey") % 5), F.when(C("p_partkey") % 5 < 4, " ").otherwise(""))
    return p.select(
        C("p_partkey").alias("ord"), F.concat(maker, name).alias("name"), pick(KINDS, C("p_size") % 6).alias("category"), F.when(C("p_partkey") % 13 == 0, "-1").otherwise(F.replace(C("p_retailprice").cast("string"), F.lit("."), F.lit(","))).alias("current_price"),
        F.when(C("p_partkey") % 7 == 0, "1").alias("old_price"), F.when(C("p_partkey") % 17 == 0, "").otherwise(F.concat(F.lit("https://x.example/"), C("p_partkey").cast("string"))).alias("product_url"), F.lit("shop").alias("store_name"), F.lit("").alias("image_url"), F.lit("available").alias("availability"),
    )


@query(LISTED + "SELECT ord, length::INT AS length, token_count::INT AS token_count, length < 8 OR token_count < 2 AS too_short, generic, array_to_string(differs, ',') AS differentiators FROM g")
def gate_title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _listings(spark, sf_dir).select("ord", gates.title_quality(C("name")).alias("t"))
    return r.select("ord", "t.length", "t.token_count", "t.too_short", "t.generic", F.array_join("t.important_differentiators", ",").alias("differentiators"))


@query(LISTED + """SELECT ord, len(reasons) = 0 AS accepted, CASE WHEN len(reasons) > 0 THEN 'CRITICAL' WHEN len(warnings) > 0 THEN 'WARNING' ELSE 'OK' END AS severity,
  CASE WHEN len(reasons) > 0 THEN 'low' WHEN risk = 'high' OR list_has_any(warnings, ['generic_title', 'unknown_category', 'category_high_matching_complexity']) THEN 'low' WHEN len(warnings) = 0 THEN 'high' ELSE 'medium' END AS confidence,
  array_to_string(reasons, ',') AS discard_reasons, array_to_string(warnings, ',') AS warnings, cat AS normalized_category, risk AS matching_risk FROM w""")
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gates.evaluate(_listings(spark, sf_dir))
    return r.select("ord", "accepted", "severity", "confidence", F.array_join("discard_reasons", ",").alias("discard_reasons"), F.array_join("warnings", ",").alias("warnings"), "normalized_category", "matching_risk")


@query(LISTED + """SELECT 'total' AS kind, '' AS value, count(*) AS n FROM w UNION ALL SELECT CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END, '', count(*) FROM w GROUP BY 1 UNION ALL SELECT 'with_warnings', '', count(*) FROM w WHERE len(warnings) > 0
UNION ALL SELECT 'reason', x, count(*) FROM (SELECT unnest(reasons) AS x FROM w) GROUP BY 2 UNION ALL SELECT 'warning', x, count(*) FROM (SELECT unnest(warnings) AS x FROM w) GROUP BY 2 UNION ALL SELECT 'category', coalesce(cat, 'unknown'), count(*) FROM w GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN len(reasons) > 0 THEN 'low' WHEN risk = 'high' OR list_has_any(warnings, ['generic_title', 'unknown_category', 'category_high_matching_complexity']) THEN 'low' WHEN len(warnings) = 0 THEN 'high' ELSE 'medium' END, count(*) FROM w GROUP BY 2""")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.summarize(gates.evaluate(_listings(spark, sf_dir)))


# -- text, pages ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name || ' USB-C ' || p_brand || ' Wireless'), ' '), lambda t: t NOT IN ('new', 'wireless')), '-').replace('usb-c', 'usbc').replace('#', '-') AS canonical_key FROM part")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.canonical_key(F.concat("p_name", F.lit(" USB-C "), "p_brand", F.lit(" Wireless"))).alias("canonical_key"))


@query("SELECT doc_id, len(w)::INT AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, list_filter(string_split(regexp_replace(replace(lower(strip_accents(text)), '€', ' euro '), '[^a-z0-9\\s]', ' ', 'g').regexp_replace('\\s+', ' ', 'g'), ' '), lambda t: t <> '') AS w FROM documents)")
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search sees of each text: words without accents and case."""
    w = tx.words(tx.search_text(C("text")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(w).alias("n_words"), F.sha2(F.array_join(w, " "), 256).alias("words_sha256"))


@query("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", extract.page_title(C("html")).alias("title"))


@query("SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages")
def page_url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", extract.url_path(C("url")).alias("path"), F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"))


@query("SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)) GROUP BY 1, 2")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(links).alias("pos", "link")).groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("pos"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(CASE WHEN x BETWEEN 5 AND 5000 THEN x END, 2) AS page_price FROM (SELECT *, round(l_extendedprice / l_quantity, 2) AS x FROM lineitem)")
def price_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("€ "), F.translate(F.format_number(rounded(C("l_extendedprice") / C("l_quantity"), 2), 2), ".,", ",."))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", rounded(page_price(shown), 2).alias("page_price"))


@query()
def json_ld_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages made of the offers, read back."""
    cat = star(spark, sf_dir)
    o = offers.offer_records(cat.products, cat.offers, cat.stores)
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), "name", F.array(F.struct(rounded(C("price"), 2).alias("price"), F.lit("http://schema.org/InStock").alias("availability"))).alias("offers")))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph": ['), ld, F.lit("]}</script></html>"))
    pages = o.select(F.concat(F.lit("/online/x-pid"), "product_id").alias("url"), html.alias("html"), F.lit("").alias("markdown"), F.lit(None).cast("string").alias("search_title"))
    return extract.extract_products(pages, extract.UNIEURO, "tv")


# -- changes -------------------------------------------------------------------------------------------------


@query(BASE + ", l AS (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS n FROM history WINDOW w AS (PARTITION BY product_id, store_id ORDER BY ord)) SELECT product_id, store_id, round(price, 4) AS price, round(prev, 4) AS previous_price, checked_at FROM l WHERE n = 1 OR price <> prev")
def price_changes_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = price_changes(star(spark, sf_dir).history)
    return c.select("product_id", "store_id", rounded(C("price"), 4).alias("price"), rounded(C("previous_price"), 4).alias("previous_price"), "checked_at")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a stream of observed prices; seq sorts as they arrived."""
    path = f"{sf_dir}/lineitem.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith("/lineitem.parquet"):  # a stream reads folders
        items = stream.option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    else:
        items = stream.parquet(path)
    cents = [F.round(C(c) * 100).cast("long") for c in ("l_extendedprice", "l_quantity", "l_discount")]
    day, time = F.unix_date(C("l_shipdate").cast("date")), (F.hour("l_shipdate") * 60 + F.minute("l_shipdate")) * 60_000_000 + (F.extract(F.lit("SECOND"), "l_shipdate") * 1_000_000).cast("long")
    seq = changes.sortable(C("l_orderkey"), C("l_linenumber"), day, time, *cents)
    return items.select(C("l_partkey").cast("string").alias("product_id"), C("l_suppkey").cast("string").alias("store_id"), (C("l_extendedprice") / C("l_quantity") * (1 - C("l_discount"))).alias("price"), C("l_shipdate").cast("timestamp").alias("checked_at"), seq.alias("seq"))


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("streams need spark.checkpoint.dir, a folder that all executors share")
    return f"{base}/stream-{uuid.uuid4().hex}"


@query(ORACLE_SQL["price_changes_lag"])
def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes.drain(changes.change_stream(_log(spark, sf_dir)), _scratch(spark))
    return c.select("product_id", "store_id", rounded(C("price"), 4).alias("price"), rounded(C("previous_price"), 4).alias("previous_price"), C("checked_at").cast("timestamp_ntz").alias("checked_at"))


@query(BASE + ", l AS (SELECT product_id, store_id, arg_max(price, ord) AS price, max(checked_at) AS checked_at FROM history GROUP BY 1, 2) SELECT product_id, store_id, round(price, 4) AS price, checked_at FROM l WHERE checked_at + INTERVAL 14 DAY <= (SELECT max(checked_at) FROM history)")
def stream_stale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that the stream's timers have found unseen for two weeks."""
    stale = changes.change_stream(_log(spark, sf_dir), stale_days=changes.STALE_DAYS, changed=False).select("product_id", "store_id", "price", "checked_at")
    c = changes.drain(stale, _scratch(spark))
    return c.select("product_id", "store_id", rounded(C("price"), 4).alias("price"), C("checked_at").cast("timestamp_ntz").alias("checked_at"))


@query(BASE + "SELECT product_id, store_id, round(current_price, 4) AS price FROM offers")
def stream_latest_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changes.drain(changes.latest_stream(_log(spark, sf_dir)), _scratch(spark), keys=("product_id", "store_id"))
    return c.select("product_id", "store_id", rounded(C("price"), 4).alias("price"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", C("ts").cast("timestamp"))
    return changes.hourly_activity(e).select(C("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", rounded(C("total"), 4).alias("total"))


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", C("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))

