"""Price changes as a stream: the last price of each product and store is state, and grows stale by a timer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import price_changes

CHANGE = "product_id string, store_id string, price double, previous_price double, checked_at timestamp, kind string"
#: The same with times in microseconds since the epoch, as the state's function finds it, what it returns, and what of a log goes to it.
SEEN = CHANGE.replace("checked_at timestamp", "seen long")
FOUND = pa.schema([("product_id", pa.string()), ("store_id", pa.string()), ("price", pa.float64()), ("previous_price", pa.float64()), ("seen", pa.int64()), ("kind", pa.string())])
OUT = Row("rows")
TAKEN = ("product_id", "store_id", "price", "seq", "seen")
#: Series of a bucket as one table; the type of seq is the log's. seen: microseconds since the epoch; wait: milliseconds
#: from then until it is due, null once reported as stale.
LAST = {"product_id": pa.string(), "store_id": pa.string(), "price": pa.float64(), "seq": None, "seen": pa.int64(), "wait": pa.int64()}
#: How the table is written: what is near its neighbour as a difference, what repeats as a dictionary.
WRITTEN = {
    "use_dictionary": ["seen", "wait"], "column_encoding": {"product_id": "DELTA_BYTE_ARRAY", "store_id": "DELTA_BYTE_ARRAY", "price": "BYTE_STREAM_SPLIT", "seq": "DELTA_BYTE_ARRAY"},
    "compression": "zstd", "compression_level": 9, "write_statistics": False, "store_schema": False,
}
#: Transform-with-state keeps its state there; the session must say so before a stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STALE_DAYS = 14
#: Buckets that series are dealt to; a checkpoint keeps to the number it began with.
BUCKETS = 1024
#: Rows and bytes that a task packs together before they are dealt to buckets.
TOGETHER = (1 << 20, 1 << 27)
DAY_MS = 86_400_000


def sortable(*numbers: Column) -> Column:
    """Whole numbers as one short binary that sorts as they do, the first one first; nulls come last."""

    def part(n: Column) -> Column:
        digits = F.hex(n.cast("long"))
        digits = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
        size = F.when(n < 0, "0").otherwise(F.substring(F.lit("12345678"), F.length(digits) / 2, F.lit(1)))
        return F.coalesce(F.concat(size, digits), F.lit("F"))

    each = F.concat(*map(part, numbers))
    return F.unhex(F.when(F.length(each) % 2 == 1, F.concat(each, F.lit("0"))).otherwise(each))


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, **WRITTEN)
    return sink.getvalue().to_pybytes()


def _table(raw: bytes) -> pa.Table:
    return pq.ParquetFile(pa.BufferReader(raw)).read(use_threads=False)


def _packed(series: dict[tuple, tuple]) -> bytes:
    rows = [(*key, *value) for key, value in series.items()]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LAST.values(), strict=True)], names=list(LAST))
    return _bytes(table.sort_by([("product_id", "ascending"), ("store_id", "ascending")]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ...) of a task: those of a bucket as one table (bucket, rows), so that less is exchanged and no row is taken alone."""

    def tables(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("bucket", "product_id", "store_id")])
        bucket, rows = table["bucket"].to_numpy(), table.drop_columns("bucket")
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        packed = [_bytes(rows.slice(i, j - i)) for i, j in zip(at, [*at[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "rows"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER[0] or sum(b.nbytes for b in held) >= TOGETHER[1]:
            yield tables(held)
            held = []
    if held:
        yield tables(held)


def _out(table: pa.Table) -> Row:
    """What was found in a bucket as one value: a row at a time costs more than finding it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, FOUND) as out:
        out.write_table(table)
    return OUT(sink.getvalue().to_pybytes())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch["rows"]:
            with pa.ipc.open_stream(raw.as_buffer()) as read:
                yield from read.read_all().to_batches(max_chunksize=10_000)


def _due(seen: int | None, wait: int | None) -> int | None:
    return None if wait is None else seen // 1000 + wait


class LastPrices(StatefulProcessor):
    """Rows that change the price of a series, by ``seq``; with ``stale_days`` a row as well when a series hasn't been seen for so long.

    State is asked a bucket of series at a time, with one timer: when the first of them is
    due. It isn't written again when they are: those due before the timer have been reported,
    and those without one all. Rows that aren't newer than the last one seen are ignored, so a
    source that repeats rows changes nothing. A trigger's rows of one bucket are held together:
    bound them by the source's limits on files or bytes a trigger.
    """

    def __init__(self, stale_days: int | None = None, changed: bool = True) -> None:
        self.stale_days, self.changed = stale_days, changed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "series binary")

    def _known(self) -> dict[tuple, tuple]:
        if not self.last.exists():
            return {}
        timer = None if self.stale_days is None else min(self.handle.listTimers(), default=None)
        rows = zip(*(c.to_pylist() for c in _table(self.last.get()[0]).columns), strict=True)
        return {(p, s): (price, seq, seen, None if wait is None or timer is None or _due(seen, wait) < timer else wait) for p, s, price, seq, seen, wait in rows}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        series = self._known()
        new: dict[tuple, list] = {}
        for r in rows:
            table = _table(r.rows)
            for product, store, price, seq, at in zip(*(table[c].to_pylist() for c in TAKEN), strict=True):
                if (product, store) not in series or seq > series[product, store][1]:
                    new.setdefault((product, store), []).append((seq, price, at))
        found = []
        for one, seen_now in new.items():
            known = one in series
            price, _, seen, wait = series.get(one, (None, "", None, None))
            seen_now.sort(key=lambda r: r[0])
            for _, now, at in seen_now:
                if self.changed and (not known or now != price):
                    found.append((*one, now, price, at, "change"))
                price, known = now, True
            times = [at for _, _, at in seen_now if at is not None]
            seen = max([*times, *([] if seen is None else [seen])], default=None)
            if self.stale_days is not None and seen is not None:
                wait = self.stale_days * DAY_MS
            series[one] = (price, seen_now[-1][0], seen, wait)
        if not new:
            return
        self.last.update((_packed(series),))
        if self.stale_days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self._ring(v[2:] for v in series.values())
        if found:
            yield _out(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), FOUND.types, strict=True)], schema=FOUND))

    def _ring(self, times: Iterable[tuple], after: int | None = None) -> None:
        """A timer for the first that is due, later than ``after``."""
        due = (d for d in (_due(*t) for t in times) if d is not None and (after is None or d > after))
        if (first := min(due, default=None)) is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        table, timer = _table(self.last.get()[0]), expiredTimerInfo.getExpiryTimeInMs()
        until = max(timerValues.getCurrentWatermarkInMs(), timer)
        times = list(zip(table["seen"].to_pylist(), table["wait"].to_pylist(), strict=True))
        stale = table.filter(pa.array([d is not None and timer <= d <= until for d in (_due(*t) for t in times)]))
        if stale.num_rows:
            yield _out(pa.Table.from_arrays([*(stale[c] for c in ("product_id", "store_id", "price", "price", "seen")), pa.repeat("stale", stale.num_rows)], schema=FOUND))
        self._ring(times, until)

    def close(self) -> None:
        """Nothing is open."""


def change_stream(log: DataFrame, stale_days: int | None = None, late: str = "0 seconds", changed: bool = True) -> DataFrame:
    """Change rows of a streaming log (product_id, store_id, price, checked_at, seq), kind ``change``.

    With ``stale_days``, a row of kind ``stale`` too once the watermark on checked_at, which
    allows rows to be ``late``, has passed the last sight of a key by so many days; these
    alone if ``changed`` is false. Rows that come later than that count as well: rows are
    packed before they are dealt to buckets, and none is left out by its time.
    """
    for key, value in STATE_STORE.items():
        log.sparkSession.conf.set(key, value)
    timed = stale_days is not None
    rows = log.withWatermark("checked_at", late) if timed else log
    rows = rows.withColumn("seen", F.unix_micros("checked_at")).select(*TAKEN, F.pmod(F.xxhash64("product_id", "store_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    packed = rows.mapInArrow(_gathered, "bucket int, rows binary")
    found = packed.groupBy("bucket").transformWithState(LastPrices(stale_days, changed), "rows binary", "append", "eventTime" if timed else "none")
    return found.mapInArrow(_found, SEEN).withColumn("seen", F.timestamp_micros("seen")).withColumnRenamed("seen", "checked_at")


def latest_stream(log: DataFrame) -> DataFrame:
    """The latest price of each key, by seq: in update mode, those that a trigger has changed."""
    return log.groupBy("product_id", "store_id").agg(F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq"))


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events an hour and kind; those later than the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def drain(stream: DataFrame, path: str, keys: tuple[str, ...] | None = None, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table below ``path``; the table.

    With ``keys`` the stream updates rows: each trigger appends those it has changed, in a
    folder of its own that a repeated trigger overwrites, and of a key the row of the last
    trigger counts. ``each`` takes the batches instead.
    """
    spark: SparkSession = stream.sparkSession
    write = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if each is not None:
        write.foreachBatch(each).start().awaitTermination()
    elif keys is None:
        write.format("parquet").option("path", f"{path}/table").outputMode("append").start().awaitTermination()
    else:
        write.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/table/batch={i}")).outputMode("update").start().awaitTermination()
        fields = [c for c in stream.columns if c not in keys]
        rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/table")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("x")).select(*keys, "x.*")
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


__all__ = ["change_stream", "drain", "hourly_activity", "latest_stream", "price_changes", "sortable"]
