"""WARC archives with a two-level capture index.

Archives: each task writes one file of records, a gzip member each, below the shared
folder. Index: captures sorted by reversed-host URL key are cut into compressed blocks; a
sparse directory names each block's first key and place, and the directory of each shard
is small. A lookup finds its shard by the shards' first keys, its block by binary search
in that shard's directory, reads the block's range, and then the record's range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, partitions_for, save, scratch, slices

#: Equal payloads of fewer bytes are stored each time.
LEAST = 100
#: Captures of an index block, and of a shard about.
BLOCK, SHARD = 512, 200_000
#: Records of one file that lie this close are read together, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of records that one task reads.
TASK = 64 << 20
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"

CAPTURE = "page_id long, key string, file string, offset long, length long"
ENTRY = "shard int, first_key string, last_key string, file string, offset long, length long, captures int"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then port, path and query: http://a.b.org/x?y -> org,b,a)/x?y."""
    url = (url or "").strip().replace("\t", "%09").replace("\n", "%0A")
    try:
        p = urlsplit(url)
        host, port = p.hostname or "", p.port
    except ValueError:
        return f")/{url}"
    host = ",".join(reversed(host.removeprefix("www.").split("."))) if host else ""
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{host}{port}){p.path or '/'}" + (f"?{p.query}" if p.query else "")


def _safe(header: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in header)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, html, digest, refers_to. A task that is run again writes a file of another name.

    The rows are returned once the file is closed, so that none names what isn't there.
    """
    name, out, at = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
    system, root = _open(folder)
    ids, keys, offsets, lengths = [], [], [], []
    for whole in batches:
        for b in slices(whole):
            for page_id, url, html, digest, ref in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, ref), 6, mtime=0)
                out.write(member)
                for column, v in ((ids, page_id), (keys, url_key(url)), (offsets, at), (lengths, len(member))):
                    column.append(v)
                at += len(member)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array([name] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page_id", "key", "file", "offset", "length"])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write page_id, url, html rows as records; (page_id, key, file, offset, length) of each.

    Of equal payloads of at least ``least`` bytes, the smallest page_id gets the response
    and the others refer to it. Rows that repeat that page_id are responses too; a null
    page_id is larger than any other, and never referred to.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("digest"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    # only payloads held more than once need to be looked up
    again = pages.where(size >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    long_, short = pages.where(size >= least), pages.where(size < least)
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = long_.join(again, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    rows = rows.union(short.select("page_id", "url", "html", "digest", F.lit(None).cast("long")))
    return rows.mapInArrow(partial(_write, folder), CAPTURE)


# -- the index -----------------------------------------------------------------------------


def _line(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), file, str(offset), str(length)))


def _index(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted captures to one shard file of compressed blocks; a directory row for each block."""
    from pyspark import TaskContext

    name, out, at, lines, rows = f"shard-{uuid.uuid4().hex}.idx", None, 0, [], []
    shard = TaskContext.get().partitionId()
    system, root = _open(folder)

    def flush() -> None:
        nonlocal out, at
        if not lines:
            return
        if out is None:
            system.create_dir(root, recursive=True)
            out = system.open_output_stream(f"{root}/{name}", compression=None)
        block = zlib.compress("\n".join(line for _, line in lines).encode("utf-8", "surrogatepass"), 6)
        out.write(block)
        rows.append((shard, lines[0][0], lines[-1][0], name, at, len(block), len(lines)))
        at += len(block)
        lines.clear()

    for b in batches:
        for page_id, key, file, offset, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            lines.append((_sort_key(key, page_id), _line(key, page_id, file, offset, length)))
            if len(lines) >= BLOCK:
                flush()
    flush()
    if out is not None:
        out.close()
    names = ["shard", "first_key", "last_key", "file", "offset", "length", "captures"]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _sort_key(key: str, page_id: int | None) -> str:
    """The URL key and, so that a host or page with very many captures is spread, the page."""
    return f"{key}\t{'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def _sort_column() -> Column:
    page = F.coalesce(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit(""))
    return F.concat(F.col("key"), F.lit("\t"), page)


def build_index(captures: DataFrame, folder: str, each: int = SHARD) -> DataFrame:
    """Write the blocks of all captures; the directory: shard, first and last key, file, offset, length, captures."""
    spark = captures.sparkSession
    n = max(1, -(-captures.count() // each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), captures.count() // (4 * BLOCK)))
    keyed = captures.withColumn("k", _sort_column())
    return keyed.repartitionByRange(n, "k").sortWithinPartitions("k").select("page_id", "key", "file", "offset", "length").mapInArrow(partial(_index, folder), ENTRY)


class _Directory:
    """The blocks of one shard, searched by their first keys; the last block read is kept."""

    def __init__(self, folder: str, entries: list[tuple]) -> None:
        self.system, self.root = _open(folder)
        self.entries = sorted(entries)
        self.firsts = [e[0] for e in self.entries]
        self.at, self.lines = -1, {}

    def find(self, key: str) -> list[tuple[str, int, int]]:
        i = bisect_right(self.firsts, key) - 1
        found: list[tuple[str, int, int]] = []
        # equal keys may reach back over a block's edge
        while i >= 0 and self.entries[i][1] >= key:
            if i != self.at:
                _, _, file, offset, length = self.entries[i]
                with self.system.open_input_file(f"{self.root}/{file}") as f:
                    f.seek(offset)
                    text = zlib.decompress(f.read(length)).decode("utf-8", "surrogatepass")
                self.at, self.lines = i, {}
                for line in text.split("\n"):
                    url, page, file, start, size = line.split("\t")
                    self.lines.setdefault(_sort_key(url, int(page) if page else None), []).append((file, int(start), int(size)))
            found += self.lines.get(key, [])
            i -= 1
        return found


def _located(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, directory entries (key null) before lookups, lookups by key."""
    shard, entries, directory, last, hit = None, [], None, None, []
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            if r["shard"] != shard:
                shard, entries, directory, last = r["shard"], [], None, None
            if r["k"] is None:
                entries.append((r["first_key"], r["last_key"], r["file"], r["offset"], r["length"]))
                continue
            directory = directory or _Directory(folder, entries)
            if r["k"] != last:
                last, hit = r["k"], directory.find(r["k"])
            out += [(r["n"], *h) for h in hit]
        names, types = ["n", "file", "offset", "length"], [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def lookup(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Places of the captures of (page_id, key) rows: n (how often it was asked for), file, offset, length.

    The shards' bounds, one row each, go to the driver; a shard holds SHARD captures or
    more, so they are few. A key that lies on the edge of two shards is asked of both.
    """
    bounds = directory.groupBy("shard").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).orderBy("lo").collect()
    asked = wanted.groupBy(_sort_column().alias("k")).agg(F.count("*").alias("n"))
    none = F.lit(None)
    los, his, shards = [b.lo for b in bounds], [b.hi for b in bounds], [b.shard for b in bounds]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ns, ss = [], [], []
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = bisect_right(los, k) - 1
                while i >= 0 and his[i] >= k:
                    ks.append(k)
                    ns.append(n)
                    ss.append(shards[i])
                    i -= 1
            yield pa.RecordBatch.from_arrays([pa.array(ss, pa.int32()), pa.array(ks, pa.string()), pa.array(ns, pa.int64())], ["shard", "k", "n"])

    homed = asked.mapInArrow(homes, "shard int, k string, n long")
    rows = homed.select("shard", "k", "n", none.cast("string").alias("first_key"), none.cast("string").alias("last_key"), none.cast("string").alias("file"), none.cast("long").alias("offset"), none.cast("long").alias("length"))
    rows = rows.unionByName(directory.select("shard", none.cast("string").alias("k"), none.cast("long").alias("n"), "first_key", "last_key", "file", "offset", "length"))
    dealt = rows.repartition(max(1, len(bounds)), "shard").sortWithinPartitions("shard", F.col("k").asc_nulls_first())
    return dealt.mapInArrow(partial(_located, folder), "n long, file string, offset long, length long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places sorted by file and offset: ranges that lie close are read at once."""
    system, root = _open(folder)

    def ranges(rows: list[tuple]) -> Iterator[bytes]:
        i = 0
        while i < len(rows):
            file, lo, _ = rows[i]
            j, hi = i, lo
            while j < len(rows) and rows[j][0] == file and rows[j][1] - hi <= GAP and (j == i or rows[j][1] + rows[j][2] - lo <= READ):
                hi = max(hi, rows[j][1] + rows[j][2])
                j += 1
            with system.open_input_file(f"{root}/{file}") as f:
                f.seek(lo)
                data = f.read(hi - lo)
            for _, at, size in rows[i:j]:
                yield gzip.GzipFile(fileobj=io.BytesIO(data[at - lo : at - lo + size])).read()
            i = j

    for b in batches:
        out = []
        for raw in ranges(list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))):
            fields, http, payload = parse(raw)
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"record of page {fields['X-Page-Id']} is damaged")
            refers = fields.get("WARC-Refers-To")
            out.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, int(http["Content-Length"]), digest, kind, int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None))
        names, types = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at (file, offset, length)."""
    # a file's neighbouring records stay together, in runs that bound what one task reads
    run = F.floor(F.col("offset") / F.lit(16 << 20))
    size = places.agg(F.sum("length")).first()[0] or 0
    # the rows are small but stand for what is read: so the number of tasks is given
    n = partitions_for(places.sparkSession, size, TASK)
    return places.withColumn("run", run).repartition(n, "file", "run").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(partial(_read, folder), RECORD)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC records, index them, look every page up, and read its record back.

    One row per page as in ``RECORD``. Null and empty html is an empty payload; a null url
    has the key ")/". Repeated rows (page and url) share a key and come back as often as
    they were written. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    with batches_of(spark, 1000):
        captures = save(write_archives(pages, f"{path}/archives"), f"{path}/captures")
    directory = save(build_index(captures, f"{path}/index"), f"{path}/directory")
    wanted = captures.select("page_id", "key")
    places = save(lookup(wanted, directory, f"{path}/index"), f"{path}/places")
    return read_records(places, f"{path}/archives")

