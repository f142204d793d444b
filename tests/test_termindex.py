"""The trigram index against looking at every product."""

import random

import pytest

from tarsia.operators import predict, retrieve
from tarsia.operators.termindex import TermIndex
from tarsia.sources.catalog import Catalog, StarCatalog


@pytest.fixture(scope="module")
def products(spark):
    r = random.Random(3)
    parts = ["Galaxy", "iPhone", "Écran", "tv", "OLED", "100%", "a_b", "cuffie", "ß", "İstanbul", "x", ""]
    rows = [{"id": str(i), "name": " ".join(r.choices(parts, k=3)), "search_keywords": r.choice([None, "smart casa", "gal axy"]), "category": r.choice(["tech", "casa", None])} for i in range(200)]
    return Catalog.from_rows(spark, products=rows).products.cache()


@pytest.fixture(scope="module")
def index(spark, products, tmp_path_factory):
    return TermIndex.build(products, f"file://{tmp_path_factory.mktemp('index')}", buckets=4)


@pytest.mark.parametrize("terms", [["galaxy"], ["ALAX", "oled tv"], ["écran"], ["zzz"], ["zzz", "iphone"], ["tv"], ["x", "cuffie"], ["Galaxy", "nothing of it"], ["smart casa"], ["casa tech"], []])
@pytest.mark.parametrize("categories", [[], ["tech"]])
def test_as_the_scan(products, index, terms, categories):
    want = retrieve.candidates(products, categories=categories, terms=terms).collect() if terms else []
    assert index.candidates(products, terms, categories=categories).collect() == want


def test_reads_postings_of_the_rarest_grams(index):
    grams = index.rarest(["galaxy", "tv", "zzz"])
    assert len(grams["galaxy"]) == 3 and grams["tv"] is None and grams["zzz"] == []
    plan = index.ids(["galaxy"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters: [In(gram" in plan


def test_last_three_are_limited_before_the_shuffle(spark, sf):
    plan = predict.latest_points(StarCatalog(spark, sf).history)._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.find("WindowGroupLimit"), plan.rfind("WindowGroupLimit")
    assert 0 < final < plan.find("Exchange hashpartitioning", final) < partial and "Partial" in plan[partial : partial + 300]
