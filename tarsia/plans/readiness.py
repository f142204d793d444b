"""Is there enough history to advise? Depth, recency, quality of series, and readiness buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import missing, number, usable_history
from ..functions.prices import observed_at
from ..functions.text import label
from ..operators.predict import when
from ..sources.catalog import Catalog
from .metrics import Pass, Section, report_of, when_
from .quality import first_of, history_label, keys_of, product_label

C = F.col
#: From so many points on: nothing, monitoring, weak and stronger guidance.
BUCKETS = {"insufficient_data": 0, "monitor_only": 2, "weak_buy_wait_guidance": 4, "stronger_buy_wait_guidance": 10}
RECENT_DAYS, STALE_DAYS = 3, 14
DIFFERS = 0.01


def timed(history: DataFrame) -> DataFrame:
    """Observations with the time of their creation where none of checking is known, if the table has one."""
    return history.withColumn("checked_at", observed_at(C("checked_at"), C("created_at"))) if "created_at" in history.columns else history


def valid(history: DataFrame) -> DataFrame:
    return timed(history).where(usable_history(positive=True))


def by_product(cat: Catalog) -> DataFrame:
    """What the audit asks of each product's usable points; a plan computes only the columns that it reads."""
    h = valid(cat.history).where(~missing(C("product_id")))
    return h.groupBy("product_id").agg(F.count("price").alias("points"), F.count_distinct("price").alias("prices"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("checked_at").alias("newest"))


def by_pair(cat: Catalog) -> DataFrame:
    """The same of each product and store, points without a product included."""
    return valid(cat.history).groupBy("product_id", "store_id").agg(F.count("*").alias("points"), F.max_by(number(C("price")), when()).alias("latest"), F.min("checked_at").alias("oldest"), F.max("checked_at").alias("newest"))


def bucket(depth: Column) -> Column:
    names = list(BUCKETS)
    out = F.when(depth >= BUCKETS[names[-1]], names[-1])
    for name in reversed(names[1:-1]):
        out = out.when(depth >= BUCKETS[name], name)
    return out.otherwise(names[0])


def depths(cat: Catalog) -> DataFrame:
    """(id, depth): usable points of each product, 0 included."""
    per = by_product(cat).select(C("product_id").alias("id"), C("points").alias("d"))
    return keys_of(cat.products, "id").join(per, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("depth"))


def pair_depths(cat: Catalog) -> DataFrame:
    """(id, product_id, store_id, depth) of each offer that names both."""
    per = by_pair(cat).select("product_id", "store_id", C("points").alias("d"))
    some = cat.offers.where(~missing(C("product_id")) & ~missing(C("store_id")))
    return some.join(per, ["product_id", "store_id"], "left").select("id", "product_id", "store_id", F.coalesce("d", F.lit(0)).alias("depth"))


def distribution(of: DataFrame) -> DataFrame:
    """(bucket, n) of all buckets, empty ones with 0."""
    spark = of.sparkSession
    all_ = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return F.broadcast(all_).join(of.groupBy(bucket(C("depth")).alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def repeated_points(cat: Catalog) -> DataFrame:
    """(product_id, repeated): usable points beyond the distinct prices."""
    return by_product(cat).select("product_id", (C("points") - C("prices")).alias("repeated")).where("repeated > 0")


def no_variation(cat: Catalog) -> DataFrame:
    """Products with two points or more, all at one price."""
    per = by_product(cat).where("points >= 2 and low = high")
    return cat.products.join(per.select(C("product_id").alias("id")), "id", "left_semi")


def latest_prices(cat: Catalog) -> DataFrame:
    return by_pair(cat).select("product_id", "store_id", "latest")


def latest_mismatches(cat: Catalog) -> DataFrame:
    """Offers whose price isn't that of the latest usable observation of their product and store."""
    both = cat.offers.withColumn("price", number(C("current_price"))).join(latest_prices(cat), ["product_id", "store_id"])
    return both.where(F.abs(C("price") - C("latest")) > DIFFERS).select("id", "product_id", "store_id", "price", "latest")


def latest_seen(cat: Catalog) -> DataFrame:
    """(id, latest): when each known product was last observed."""
    per = by_product(cat).where(C("newest").isNotNull()).select(C("product_id").alias("id"), C("newest").alias("latest"))
    return per.join(keys_of(cat.products, "id"), "id")


def report(cat: Catalog, folder: str, now: Column | None = None, examples: int = 5) -> DataFrame:
    """All metrics; ``now`` can be fixed.

    The history is read once, into one row for each product, store, price and usability; products,
    pairs and offers are judged by what is left of it. Tables are written below
    ``folder``, which all executors share, and removed.
    """
    spark, now = cat.products.sparkSession, F.current_timestamp() if now is None else now
    with Pass(spark, folder) as run:
        rows = run.watch(timed(cat.history), rows=F.count("*"), no_pid=when_(missing(C("product_id"))), no_price=when_(missing(C("price"))), bad_price=when_(number(C("price")) <= 0))
        rows = rows.select("product_id", "store_id", "price", usable_history(positive=True).alias("ok"), "checked_at", when().alias("at"))
        points = run.write("points", rows.groupBy("product_id", "store_id", "price", "ok").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.min("checked_at").alias("oldest"), F.max("checked_at").alias("newest")))
        points = points.withColumns({"said": history_label(), "price": number(C("price"))})
        pairs = points.where("ok").groupBy("product_id", "store_id").agg(F.sum("n").alias("points"), F.max_by("price", "at").alias("latest"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
        pairs = run.write("pairs", run.watch(pairs, oldest=F.min("oldest"), newest=F.max("newest")))

        if_ok = lambda c: F.when(C("ok"), C(c))
        seen = points.where(~missing(C("product_id"))).groupBy(C("product_id").alias("id")).agg(
            F.coalesce(F.sum(if_ok("n")), F.lit(0)).alias("points"), F.count_distinct(if_ok("price")).alias("prices"), F.min(if_ok("price")).alias("low"), F.max(if_ok("price")).alias("high"), F.max(if_ok("newest")).alias("newest"),
            F.sum("n").alias("h"),
        )
        products = run.watch(cat.products, products=F.count("*")).groupBy("id").agg(F.count("*").alias("p"), F.min(product_label()).alias("said_p"))
        facts = products.join(seen, "id", "full_outer").withColumns({"known": C("p").isNotNull() & ~missing(C("id")), "depth": F.coalesce("points", F.lit(0))})
        flat = (C("points") >= 2) & (C("low") == C("high"))
        recent, stale = C("newest") >= now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), C("newest") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
        sum_if = lambda c, when: F.coalesce(F.sum(F.when(when, C(c))), F.lit(0))
        facts = run.write("facts", run.watch(
            facts, keyed=when_(C("known")), none=when_(C("known") & (C("depth") == 0)), mean=F.avg(F.when(C("known"), C("depth"))), most=F.max(F.when(C("known"), C("depth"))),
            **{f"at{k}": when_(C("known") & (C("depth") >= k)) for k in (2, 3, 5, 10)}, **{b: when_(C("known") & (bucket(C("depth")) == b)) for b in BUCKETS},
            recent=when_(C("known") & recent), stale=when_(C("known") & stale), orphan=sum_if("h", C("p").isNull()), repeated=F.coalesce(F.sum(C("points") - C("prices")), F.lit(0)), flat=sum_if("p", flat),
        ))
        run.sample("none", facts.where("known and depth = 0"), C("said_p"))
        run.sample("stale", facts.where(C("known") & stale), C("said_p"))
        if run.seen["orphan"]:
            run.sample("orphan", first_of(points, "product_id", facts.where("p is null and h is not null"), C("said")), C("label"))

        price, named = number(C("current_price")), ~missing(C("product_id")) & ~missing(C("store_id"))
        offers = run.watch(cat.offers, offers=F.count("*")).join(pairs.select("product_id", "store_id", "points", "latest"), ["product_id", "store_id"], "left")
        differs = F.coalesce(F.abs(price - C("latest")) > DIFFERS, F.lit(False))
        thin = bucket(F.coalesce("points", F.lit(0))) == "insufficient_data"
        differ = run.write("differ", run.watch(offers, differ=when_(differs), pairs=when_(named), thin=when_(named & thin)).where(differs).select("product_id", "store_id"))
        run.sample("differ", differ, label(C("product_id"), C("store_id")))
        median = facts.where("known").agg(F.median("depth")).first()[0]
        n, x = run.seen, run.examples(examples)

    enough = lambda c, k: "OK" if (c or 0) >= k else "WARNING"
    total, mean = n["products"], round(n["mean"] or 0, 2)
    coverage = Section("coverage").add("products", total, status="OK").add("history rows", n["rows"], status="OK").add("products with usable history", total - n["none"], total, status="OK").add("products without usable history", n["none"], total, critical=True, examples=x.get("none"))
    coverage.add("mean usable points", mean, total, status=enough(mean, 4)).add("median usable points", median or 0, total, status=enough(median, 4)).add("most usable points", n["most"] or 0, total, status=enough(n["most"], 10))
    for k in (2, 3, 5, 10):
        coverage.add(f"products with {k} points or more", n[f"at{k}"], total, status="OK")

    recency = Section("recency")
    for which in ("oldest", "newest"):
        at = n[which]
        recency.add(f"{which} usable observation", None, status="WARNING" if at is None else "OK", text=None if at is None else at.strftime("%Y-%m-%dT%H:%M:%S"))
    recency.add(f"products seen in the last {RECENT_DAYS} days", n["recent"], total, status="OK" if n["recent"] else "WARNING").add(f"products not seen for {STALE_DAYS} days", n["stale"], total, examples=x.get("stale"))

    rows = n["rows"]
    quality = Section("quality").add("rows without product", n["no_pid"], rows, critical=True).add("rows of unknown products", n["orphan"], rows, critical=True, examples=x.get("orphan")).add("rows without price", n["no_price"], rows, critical=True).add("rows with price of at most 0", n["bad_price"], rows, critical=True)
    quality.add("repeated price points", n["repeated"], rows, note="A price that stays adds little to a forecast.").add("products whose price never changed", n["flat"], total)
    quality.add("offers that differ from the latest observation", n["differ"], n["offers"], examples=x.get("differ"), note="Of the same product and store.")

    none, monitor, weak, strong = (n[b] for b in BUCKETS)
    readiness = Section("readiness").add("products with too little data", none, n["keyed"], critical=True).add("products to monitor only", monitor, n["keyed"], status="OK").add("products with a weak signal", weak, n["keyed"], status="OK")
    readiness.add("products with a stronger signal", strong, n["keyed"], status="OK" if strong else "WARNING").add("offers whose pair has too little data", n["thin"], n["pairs"], note="The predictor looks at pairs of product and store.")
    return report_of(spark, coverage, recency, quality, readiness)
