"""Archives: an exact round trip, lookups, damaged and odd input."""

import hashlib

import pytest

from tarsia.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    first = {}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        ref = first.get(raw)
        ref = None if ref == page else ref
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def check(spark, rows):
    got = warc.archive_and_read(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_round_trip(spark):
    big = "ü" * 60
    rows = [(1, "http://a.example/x?y", None, "d"), (2, None, "", None), (3, "http://[bad", "short", "d"), (4, "http://b.example", "short", "d")]
    rows += [(9, "u\t\r\nv", big, ""), (7, "https://WWW.c.example:8443/q", big, ""), (8, "u", big + "\r\n\r\nWARC/1.1\r\n", ""), (None, "n", big, ""), (5, "very" + "x" * 10000, "z" * 300000, "")]
    rows += [(20, "same", "r" * 200, ""), (20, "same", "r" * 200, ""), (21, "same", "r" * 200, "")]
    check(spark, rows)


def test_many_pages_of_one_host(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    check(spark, [(i, f"http://h.example/{i % 50}", f"page {i % 90}" * 20, "x") for i in range(400)])


def test_empty(spark):
    check(spark, [])


def test_given_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html, None) for r in pages.collect()]
    assert sorted(map(tuple, warc.archive_and_read(pages).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("url", "key"), [("http://www.a.b.org/p?q#f", "org,b,a)/p?q"), ("https://h:81", "h:81)/"), (None, ")/"), ("http://[", ")/http://[")])
def test_keys(url, key):
    assert warc.url_key(url) == key
