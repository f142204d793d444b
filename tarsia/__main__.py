"""``python -m tarsia COMMAND``: reports and predictions over a catalog's tables, gates over a file of listings, a dry collection."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import gates, matching, predict
from .plans import metrics, quality, readiness
from .sources.catalog import Catalog, StarCatalog, read_candidates
from .streaming import collector


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarsia")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("quality", "data quality of a catalog"), ("readiness", "whether its history is enough to advise"), ("match", "products that may be the same"), ("predict", "buy, wait or monitor")):
        c = sub.add_parser(name, help=what)
        c.add_argument("tables", help="folder of the catalog's tables")
        c.add_argument("--star", action="store_true", help="the folder holds star-schema tables")
        c.add_argument("--json", action="store_true")
        c.add_argument("--limit", type=int, default=20)
        if name in ("quality", "readiness"):
            c.add_argument("--scratch", required=True, help="a folder that driver and executors share")
        if name == "predict":
            c.add_argument("--product")
            c.add_argument("--category")
            c.add_argument("--low-confidence", action="store_true", help="use untrusted observations too")
            c.add_argument("--min-points", type=int, default=predict.MIN_POINTS)
    g = sub.add_parser("gates", help="what would become of incoming listings")
    g.add_argument("file")
    g.add_argument("--json", action="store_true")
    g.add_argument("--examples", type=int, default=5)
    c = sub.add_parser("collect", help="what a collection would ask for; running one takes a transport, see streaming.collector")
    c.add_argument("--retailer", default="all")
    c.add_argument("--categories", default="all")
    c.add_argument("--limit", type=int, default=collector.LIMIT)
    sub.add_parser("self-test", help="that a product without history gets no advice")
    return p


def self_test(spark: SparkSession) -> bool:
    """Whether a product with an offer and one observation is left without advice."""
    cat = Catalog.from_rows(spark, products=[{"id": "p", "name": "P", "category": "tv"}], stores=[{"id": "s", "name": "S"}], offers=[{"id": "o", "product_id": "p", "store_id": "s", "current_price": 10.0}], history=[{"product_id": "p", "store_id": "s", "price": 10.0, "data_confidence": "alta"}])
    row = predict.predict(cat).first()
    return (row.recommendation, row.confidence, row.history_min, row.trend) == ("insufficient_data", "bassa", None, "unknown")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "collect":
        if a.limit <= 0:
            raise SystemExit("--limit must be positive")
        try:
            for shop in collector.retailers_of(a.retailer):
                for category in collector.categories_of(a.categories):
                    print(f"would collect up to {a.limit} of {category} from {shop}")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = spark or SparkSession.builder.appName("tarsia").getOrCreate()
    if a.command == "self-test":
        ok = self_test(spark)
        print("ok" if ok else "failed")
        return 0 if ok else 1
    if a.command == "gates":
        report = gates.dry_run(read_candidates(spark, a.file), a.examples)
        print(json.dumps(report, ensure_ascii=False, indent=2) if a.json else gates.text(report))
        return 0
    cat = StarCatalog(spark, a.tables) if a.star else Catalog.from_tables(spark, a.tables)
    if a.command in ("quality", "readiness"):
        report = (quality if a.command == "quality" else readiness).report(cat, a.scratch)
        print(metrics.json_report(report) if a.json else metrics.text_report(report))
        return 0
    if a.command == "match":
        rows = matching.match_report(matching.alike_classes(matching.features(cat.products)), cat.offers, a.limit)
    else:
        rows = predict.predict(cat, a.product, a.category, a.limit, a.low_confidence, a.min_points)
    if a.json:
        print(json.dumps([json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()], ensure_ascii=False, indent=2))
    else:
        print(predict.text_table(rows, a.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
