"""Search services as Spark sources: one partition a query and page, in batch or as a stream of passes.

What talks to a service is handed in: a transport takes a request (service, query, page,
limit) and gives a ``Reply``. Requests that keep failing become rows that say so, so one
bad query does not end a collection.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "pass long, query_ord int, query string, page int, payload string, failure string, detail string, attempts int"
#: Attempts after the first: on transport and server errors, and on a rate limit. Seconds to wait, times the attempt.
RETRIES, RATE_RETRIES, WAIT, RATE_WAIT = 2, 4, 10, 60
LIMIT_LEAST, LIMIT_MOST, DETAIL = 1, 30, 1200


@dataclass
class Reply:
    status: int
    body: object = None


Transport = Callable[[dict], Reply]


class RequestFailed(Exception):
    """A request that is not worth another attempt; ``kind`` is what a row says of it."""

    kind = "failed"

    def __init__(self, detail: object = "", attempts: int = 1) -> None:
        super().__init__(str(detail))
        self.detail, self.attempts = str(detail)[:DETAIL], attempts


class BadRequest(RequestFailed):
    kind = "bad_request"


class RateLimited(RequestFailed):
    kind = "rate_limited"


class Unavailable(RequestFailed):
    kind = "unavailable"


def fetch(transport: Transport, request: dict, wait: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """(body, attempts). Raises BadRequest at once, Unavailable and RateLimited after their retries, RequestFailed for other replies."""
    attempt = 1
    while True:
        try:
            reply = transport(request)
        except OSError as e:
            reply = None
            failure: RequestFailed = Unavailable(e, attempt)
        if reply is not None:
            if reply.status == 200:
                return reply.body, attempt
            if reply.status == 400:
                raise BadRequest(reply.body, attempt)
            kind = RateLimited if reply.status == 429 else Unavailable if reply.status >= 500 else RequestFailed
            failure = kind(f"{reply.status}: {reply.body}", attempt)
        most, pause = (RATE_RETRIES, RATE_WAIT) if isinstance(failure, RateLimited) else (RETRIES, WAIT) if isinstance(failure, Unavailable) else (0, 0)
        if attempt > most:
            raise failure
        wait(pause * attempt)
        attempt += 1


@dataclass
class Authorized:
    """A transport behind another one that grants tokens: asked once a task, and again when a token is refused."""

    transport: Transport
    grant: Callable[[], str]
    token: str | None = field(default=None, repr=False)

    def __call__(self, request: dict) -> Reply:
        fresh = self.token is None
        if fresh:
            self.token = self.grant()
        reply = self.transport(request | {"token": self.token})
        if reply.status == 401 and not fresh:
            self.token = None
            return self(request)
        return reply

    def __getstate__(self) -> dict:
        return {"transport": self.transport, "grant": self.grant, "token": None}  # tokens stay in their task


@dataclass
class Page(InputPartition):
    run: int
    query_ord: int
    query: str
    page: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport, wait: Callable[[float], None], simpler: Callable[[str], str] | None) -> None:
        self.queries = json.loads(options.get("queries", "[]"))
        self.pages = int(options.get("pages", 1))
        self.limit = min(max(int(options.get("limit", 10)), LIMIT_LEAST), LIMIT_MOST)
        self.service = options.get("service", "")
        self.transport, self.wait, self.simpler = transport, wait, simpler

    def pages_of(self, run: int) -> list[Page]:
        return [Page(run, i, q, p) for i, q in enumerate(self.queries) for p in range(self.pages)]

    def partitions(self) -> list[Page]:
        return self.pages_of(0)

    def read(self, partition: Page) -> Iterator[tuple]:
        p, query = partition, partition.query
        while True:
            request = {"service": self.service, "query": query, "page": p.page, "limit": self.limit}
            try:
                body, attempts = fetch(self.transport, request, self.wait)
                yield p.run, p.query_ord, query, p.page, body if isinstance(body, str) else json.dumps(body), None, None, attempts
                return
            except RequestFailed as e:
                yield p.run, p.query_ord, query, p.page, None, e.kind, e.detail, e.attempts
                plainer = self.simpler(query) if self.simpler and isinstance(e, BadRequest) else query
                if plainer == query:
                    return
                query = plainer


class _Passes(DataSourceStreamReader):
    """A pass over all queries each time the interval has gone by. Offsets are numbers of intervals since the
    epoch, so they go on after a restart; passes that were missed meanwhile are not made up for."""

    def __init__(self, reader: _Reader, seconds: float, clock: Callable[[], float]) -> None:
        self.reader, self.seconds, self.clock = reader, seconds, clock

    def initialOffset(self) -> dict:
        return {"pass": int(self.clock() // self.seconds) - 1}

    def latestOffset(self) -> dict:
        return {"pass": int(self.clock() // self.seconds)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.reader.pages_of(end["pass"]) if end["pass"] > start["pass"] else []

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for passes that are over."""


def register_search(spark: SparkSession, transport: Transport, name: str = "listing_search", wait: Callable[[float], None] = time.sleep, simpler: Callable[[str], str] | None = None, clock: Callable[[], float] = time.time) -> str:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read through the transport.

    Options: queries (a JSON list), pages, limit (1 to 30), service, and for streams
    intervalSeconds. ``simpler`` gives the query to try after a bad request.
    """

    class SearchSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, transport, wait, simpler)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Passes(self.reader(schema), float(self.options.get("intervalseconds", self.options.get("intervalSeconds", 3600))), clock)

    spark.dataSource.register(SearchSource)
    return name
