"""Search source, stateful price changes, the sink and collections."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tarsia.sources.search import Authorized, BadRequest, RateLimited, Reply, RequestFailed, Unavailable, fetch, register_search
from tarsia.streaming import changes, collector
from tarsia.streaming.sink import OfferSink

# -- search ------------------------------------------------------------------------------------


def scripted(*replies):
    """A transport that gives the replies in turn; an exception is raised."""
    left = list(replies)

    def transport(request):
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return transport


def test_retry_rules():
    def run(*replies):
        waits = []
        try:
            return fetch(scripted(*replies), {}, waits.append), waits
        except RequestFailed as e:
            return type(e), e.attempts, waits

    ok, gone, busy, down, late = Reply(200, {"data": []}), Reply(404, "x"), Reply(429), Reply(503), TimeoutError("late")
    assert run(ok) == (({"data": []}, 1), [])
    assert run(late, down, ok) == (({"data": []}, 3), [10, 20])
    assert run(down, down, down) == (Unavailable, 3, [10, 20])
    assert run(late, late, late) == (Unavailable, 3, [10, 20])
    assert run(busy, busy, busy, busy, ok) == (({"data": []}, 5), [60, 120, 180, 240])
    assert run(*[busy] * 5) == (RateLimited, 5, [60, 120, 180, 240])
    assert run(Reply(400, "bad")) == (BadRequest, 1, []) and run(gone) == (RequestFailed, 1, [])


def test_tokens_are_asked_for_again_when_refused():
    granted, seen = iter(["a", "b"]), []

    def service(request):
        seen.append(request["token"])
        return Reply(401 if request["token"] == "a" and len(seen) > 1 else 200, "ok")

    t = Authorized(service, lambda: next(granted))
    assert [t({}).status, t({}).status] == [200, 200] and seen == ["a", "a", "b"]
    assert t.__getstate__()["token"] is None


RECORDED = {
    ("tv 55", 0): Reply(200, {"data": [{"url": "https://shop.example/1", "title": "Uno"}]}),
    ("tv 55", 1): Reply(200, {"data": []}),
    ("site:x bad", 0): Reply(400, "no such operator"),
    ("bad", 0): Reply(200, [{"url": "https://shop.example/2"}]),
}


def test_source_reads_queries_and_pages(spark):
    def transport(request):
        assert request["limit"] == 30 and request["service"] == "web"
        return RECORDED.get((request["query"], request["page"]), Reply(500, "down"))

    name = register_search(spark, transport, "recorded_search", wait=lambda s: None, simpler=lambda q: q.replace("site:x ", ""))
    df = spark.read.format(name).option("queries", json.dumps(["tv 55", "site:x bad"])).option("pages", 2).option("limit", 99).option("service", "web").load()
    assert df.rdd.getNumPartitions() == 4
    got = {(r.query, r.page): (r.failure, r.attempts, r.payload and json.loads(r.payload)) for r in df.collect()}
    assert got["tv 55", 0] == (None, 1, RECORDED["tv 55", 0].body)
    assert got["site:x bad", 0] == ("bad_request", 1, None) and got["bad", 0] == (None, 1, [{"url": "https://shop.example/2"}])
    assert got["site:x bad", 1] == ("unavailable", 3, None)


# -- price changes -------------------------------------------------------------------------------

LOG = "product_id string, store_id string, price double, checked_at timestamp, seq string"
DAY = dt.datetime(2026, 3, 1)


def written(spark, folder, name, rows):
    spark.createDataFrame([(p, "s", v, DAY + dt.timedelta(days=d), f"{q:05d}") for p, v, d, q in rows], LOG).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, **options):
    log = spark.readStream.schema(LOG).option("recursiveFileLookup", True).parquet(folder)
    return changes.change_stream(log, **options)


def test_changes_go_on_from_a_checkpoint(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, "a", [("p", 5.0, 0, 1), ("p", 5.0, 1, 2), ("p", 4.0, 2, 3), ("q", None, 0, 1)])
    first = changes.drain(stream(spark, source), out)
    assert {(r.product_id, r.price, r.previous_price, r.kind) for r in first.collect()} == {("p", 5.0, None, "change"), ("p", 4.0, 5.0, "change"), ("q", None, None, "change")}
    # a new query: the state says what was last; rows seen before are ignored
    written(spark, source, "b", [("p", 4.0, 2, 3), ("p", 4.0, 3, 4), ("p", 6.0, 4, 5), ("q", 1.0, 1, 2)])
    both = changes.drain(stream(spark, source), out)
    assert {(r.product_id, r.price, r.previous_price) for r in both.collect()} == {("p", 5.0, None), ("p", 4.0, 5.0), ("q", None, None), ("p", 6.0, 4.0), ("q", 1.0, None)}
    assert both.count() == 5


def test_unseen_series_grow_stale(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, "a", [("old", 5.0, 0, 1), ("seen", 1.0, 0, 1), ("seen", 1.0, 20, 2)])
    got = changes.drain(stream(spark, source, stale_days=14), out)
    assert {(r.product_id, r.price) for r in got.where("kind = 'stale'").collect()} == {("old", 5.0)}


# -- sink ----------------------------------------------------------------------------------------


def listing(name, price, **more):
    return {"name": name, "category": "tv", "store_name": "Negozio", "current_price": price, "product_url": "u", "availability": "available", "condition": "new", "data_confidence": "alta", "checked_at": "2026-03-01 10:00:00"} | more


def batch(spark, *rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def state(sink):
    c = sink.catalog()
    return (
        sorted((r.name, r.category) for r in c.products.collect()),
        sorted((r.product_id, r.current_price) for r in c.offers.collect()),
        sorted((r.product_id, r.price) for r in c.history.collect()),
        sorted(r.reason for r in sink.table("quarantine").collect()),
    )


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_are_applied_once(spark, tmp_path):
    sink = OfferSink(spark, f"file://{tmp_path}/shop", buckets=16)
    rows = [listing("Tv Uno 50", "100.50"), listing("Tv Due 60", 200), listing("", 5), listing("Tre", "gratis"), listing("Quattro", -1), listing("Cinque", 5, checked_at="domani"), listing("Sei", 5, store_name=" ")]
    sink(batch(spark, *rows), 0)
    products, offers, history, reasons = state(sink)
    assert [p for p, _ in products] == ["Tv Due 60", "Tv Uno 50"] and sorted(v for _, v in offers) == [100.5, 200.0] and len(history) == 2
    assert reasons == ["bad_price", "bad_time", "missing_name", "missing_store", "price_not_positive"]
    before, at = state(sink), files(f"{tmp_path}/shop")
    sink(batch(spark, *rows), 0)
    assert state(sink) == before and files(f"{tmp_path}/shop") == at
    # a second batch rewrites the buckets of its keys alone, and the history has the change
    sink(batch(spark, listing("Tv Uno 50", 90), listing("Tv Uno 50", 90)), 1)
    assert sorted(v for _, v in state(sink)[1]) == [90.0, 200.0] and sorted(v for _, v in state(sink)[2]) == [90.0, 100.5, 200.0]
    now = files(f"{tmp_path}/shop/offers")
    kept = [f for f in now if f in at and now[f] == at[f]]
    assert len(kept) == 1 and len(now) == 2


def test_a_batch_cut_off_while_publishing(spark, tmp_path, monkeypatch):
    sink = OfferSink(spark, f"file://{tmp_path}/shop", buckets=4)
    sink(batch(spark, listing("Tv Uno 50", 100)), 0)
    publish = OfferSink._publish

    def cut_off(self, batch_id):
        publish(self, batch_id)
        raise OSError("lost")

    monkeypatch.setattr(OfferSink, "_publish", cut_off)
    with pytest.raises(OSError):
        sink(batch(spark, listing("Tv Uno 50", 80)), 1)
    monkeypatch.undo()
    sink(batch(spark, listing("Tv Uno 50", 80)), 1)  # the offer is new already, the staged history is published all the same
    assert [v for _, v in state(sink)[1]] == [80.0] and sorted(v for _, v in state(sink)[2]) == [80.0, 100.0]


def test_sink_of_a_stream(spark, tmp_path):
    sink = OfferSink(spark, f"file://{tmp_path}/shop", buckets=4)
    batch(spark, listing("Tv Uno 50", 100), listing("Tv Due 60", 7)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(state(sink)[1]) == 2


# -- collections -----------------------------------------------------------------------------------

URL = "https://www.unieuro.it/online/tv/tv-uno-pidTV1"


def shop_source(spark, name, clock=time.time):
    def transport(request):
        if "laptop" in request["query"]:
            return Reply(404, "gone")
        return Reply(200, {"data": [{"url": URL, "title": "Tv Uno"}]})

    return register_search(spark, transport, name, wait=lambda s: None, clock=clock)


def scrape(urls):
    ld = json.dumps({"@type": "Product", "name": "Tv Uno 50", "offers": {"price": "499.00", "availability": "InStock"}})
    html = f'<html><script type="application/ld+json">{ld}</script></html>'
    return urls.select(F.col("product_url").alias("url"), F.lit(html).alias("html"), F.lit("").alias("markdown"), F.lit(None).cast("string").alias("search_title"))


def test_names_are_resolved():
    assert collector.retailers_of() == ["unieuro", "mediaworld"] and collector.retailers_of("unieuro") == ["unieuro"]
    assert collector.categories_of("tv, laptop") == ["tv", "laptop"] and collector.categories_of("all") == list(collector.CATEGORIES)
    with pytest.raises(ValueError):
        collector.retailers_of("ignoto")
    with pytest.raises(ValueError):
        collector.categories_of("tv,giardino")


def test_one_pass(spark, tmp_path):
    source = shop_source(spark, "pass_search")
    sink = OfferSink(spark, f"file://{tmp_path}/shop", buckets=4)
    dry = collector.run_once(spark, source, scrape, sink, "unieuro", "tv,laptop")
    assert [(s.executed, s.errors) for s in dry] == [(False, [])] and state(sink)[1] == []

    def failing(urls):
        if urls.isEmpty():
            raise RuntimeError("no pages")
        return scrape(urls)

    done = collector.run_once(spark, source, failing, sink, "unieuro", "laptop,tv", execute=True)
    assert [len(s.errors) for s in done] == [1] and "laptop" in done[0].errors[0]
    assert [v for _, v in state(sink)[1]] == [499.0]


def test_passes_at_an_interval(spark, tmp_path):
    """Each interval that has gone by is one batch; a restarted loop goes on from its offsets."""
    source = shop_source(spark, "loop_search")
    sink = OfferSink(spark, f"file://{tmp_path}/shop", buckets=4)
    for _ in range(2):
        query = collector.run_loop(spark, source, scrape, sink, "unieuro", "tv", str(tmp_path / "c"), interval_hours=2 / 3600, poll="1 second")
        until = time.time() + 90
        while not (query.lastProgress and query.lastProgress["batchId"] >= 1) and time.time() < until and query.isActive:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None
    assert [o.current_price for o in sink.catalog().offers.collect()] == [499.0]
    assert len(sink.catalog().history.collect()) == 1
    published = sink._read("commits", "state string, batch long").where("state = 'published'").count()
    assert published >= 2


# -- price changes at size -----------------------------------------------------------------------


def test_state_is_asked_by_buckets(spark, tmp_path, monkeypatch):
    """Many series share a bucket: its state rows are no more than the buckets, and each series keeps its own price, time and timer."""
    monkeypatch.setattr(changes, "BUCKETS", 3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, "a", [x for i in range(40) for x in ((f"p{i}", 1.0, 0, 1), (f"p{i}", float(i % 2), 1, 2))] + [("late", 1.0, 16, 1)])
    changes.drain(stream(spark, source, stale_days=14), out)
    written(spark, source, "b", [(f"p{i}", 9.0, 20, 3) for i in range(5)] + [("late", 1.0, 40, 2)])
    got = changes.drain(stream(spark, source, stale_days=14), out).collect()
    changed = [(r.product_id, r.price, r.previous_price) for r in got if r.kind == "change"]
    want = [(f"p{i}", 1.0, None) for i in range(40)] + [(f"p{i}", 0.0, 1.0) for i in range(0, 40, 2)] + [(f"p{i}", 9.0, float(i % 2)) for i in range(5)] + [("late", 1.0, None)]
    assert sorted(changed, key=str) == sorted(want, key=str)
    stale = sorted((r.product_id, r.price) for r in got if r.kind == "stale")
    assert stale == sorted([(f"p{i}", float(i % 2)) for i in range(40)] + [(f"p{i}", 9.0) for i in range(5)])
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/checkpoint")
    assert 0 < state.count() <= 3


def test_stale_series_alone(spark, tmp_path, monkeypatch):
    """Without changes only stale series are rows; one timer a bucket reports each sight of a series once, though its state isn't written again."""
    monkeypatch.setattr(changes, "BUCKETS", 1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drained():
        return sorted((r.product_id, r.price, (r.checked_at - DAY).days) for r in changes.drain(stream(spark, source, stale_days=14, changed=False), out).select("product_id", "price", "checked_at").collect())

    def untold():
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/checkpoint").select("value.series")
        return sum(w is not None for r in state.collect() for w in changes._table(bytes(r.series))["wait"].to_pylist())

    written(spark, source, "a", [("x", 5.0, 0, 1), ("y", 6.0, 3, 1), ("z", 7.0, 20, 1), ("z", 8.0, 21, 2)])
    assert drained() == [("x", 5.0, 0), ("y", 6.0, 3)]
    assert untold() == 3  # as it was before the timer
    written(spark, source, "b", [("y", 6.0, 22, 2), ("w", 1.0, 40, 1)])
    assert drained() == [("x", 5.0, 0), ("y", 6.0, 3), ("y", 6.0, 22), ("z", 8.0, 21)]
    assert untold() == 3  # without x, as it was told when rows came
    written(spark, source, "c", [("w", 2.0, 60, 2), ("x", 5.0, 60, 2)])
    assert drained() == [("x", 5.0, 0), ("y", 6.0, 3), ("y", 6.0, 22), ("z", 8.0, 21)]


def test_binary_sorts_as_its_numbers_do(spark):
    top = 2**63 - 1
    rows = [(a, b) for a in (-top - 1, -300, -1, 0, 7, 15, 16, 255, 256, 70_000, top, None) for b in (-2, 0, 3, 4096, None)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", changes.sortable(F.col("a"), F.col("b")).alias("x"))
    found = [(r.a, r.b) for r in sorted(df.collect(), key=lambda r: bytes(r.x))]
    assert found == rows
    # what the line items' orders, dates and amounts come to: 78 characters before
    assert len(spark.range(1).select(changes.sortable(*map(F.lit, (6_000_000, 7, 10_500, 0, 9_499_999, 5000, 10))).alias("x")).first().x) <= 20


def test_rows_are_packed_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """A task's rows of a bucket go as one table, a few rows at once or many; times and prices go through as they are."""
    rows = [(f"p{i % 7}", None if i % 5 == 0 else "s", [1.5, None, float("nan")][i % 3], None if i % 11 == 0 else dt.datetime(1965 + 40 * (i % 4), 3, 29, 2, 30, 0, i), f"{i:05d}") for i in range(60)]
    got = {}
    for together in ((7, 1 << 27), (1 << 20, 1 << 27), (1 << 20, 1)):
        monkeypatch.setattr(changes, "TOGETHER", together)
        log = spark.createDataFrame(rows, LOG).coalesce(1).withColumn("seen", F.unix_micros("checked_at")).select(*changes.TAKEN, F.lit(3).alias("bucket"))
        batches = log.toArrow().to_batches(max_chunksize=5)
        packed = [x for b in changes._gathered(iter(batches)) for x in b.to_pylist()]
        assert {x["bucket"] for x in packed} == {3}
        got[together] = (len(packed), sorted((str(r) for x in packed for r in changes._table(x["rows"]).to_pylist())))
    assert [n for n, _ in got.values()] == [6, 1, 12]
    want = sorted(str(dict(zip(changes.TAKEN, (p, s, v, q, t), strict=True))) for p, s, v, q, t in spark.createDataFrame(rows, LOG).select("product_id", "store_id", "price", "seq", F.unix_micros("checked_at")).collect())
    assert all(x == want for _, x in got.values())
    # and through the stream: a pack of one row and a pack of all
    spark.createDataFrame(rows, LOG).write.parquet(str(tmp_path / "in" / "a"))
    found = changes.drain(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert {r.checked_at for r in found.collect()} <= {r[3] for r in rows} and found.count() >= 14


def test_late_rows_count(spark, tmp_path):
    """A row of an earlier time that is newer by its place in the log changes the price, whatever the watermark."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, "a", [("p", 5.0, 0, 1), ("q", 1.0, 30, 1)])
    changes.drain(stream(spark, source, stale_days=14), out)
    written(spark, source, "b", [("p", 6.0, 1, 2), ("q", 1.0, 31, 2)])
    got = changes.drain(stream(spark, source, stale_days=14), out).where("product_id = 'p'").collect()
    assert sorted((r.kind, r.price, r.previous_price) for r in got if r.kind == "change" and r.previous_price) == [("change", 6.0, 5.0)]
    assert sorted(r.price for r in got if r.kind == "stale") == [5.0, 6.0]
