"""A batch data source that fetches web pages: spark.read.format("webpages").option("urls", ...), and fetch() for a column of URLs.

Only status 200 counts; anything else, and any error, is a page without HTML. Bytes are decoded by the
header's charset, UTF-8 without one, and what doesn't decode is replaced. The URL asked for is kept.
"""

from __future__ import annotations

import heapq
import math
import time
import urllib.request
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT, TIMEOUT, RATE = "webloom/0.1", 8.0, 5.0
#: URLs of a host for each task, where requests of a host are spaced.
EACH = 2000


def decode(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


def get(url: str, timeout: float = TIMEOUT) -> tuple[str | None, str | None]:
    """(html, error)"""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            if r.status != 200:
                return None, f"status {r.status}"
            return decode(r.read(), r.headers.get_content_charset()), None
    except Exception as e:  # noqa: BLE001 a page that can't be had is a failed page, whatever the reason
        return None, f"{type(e).__name__}: {e}"


class _Part(InputPartition):
    def __init__(self, urls: list[str], rate: float, timeout: float):
        self.urls, self.rate, self.timeout = urls, rate, timeout


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.parts = max(1, int(options.get("partitions", 1)))
        self.rate, self.timeout = float(options.get("rate", RATE)), float(options.get("timeout", TIMEOUT))

    def partitions(self):
        # The rate is for the whole read: each partition gets its share.
        return [_Part(self.urls[k :: self.parts], self.rate / self.parts, self.timeout) for k in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        due = time.monotonic()
        for url in partition.urls:
            if partition.rate > 0:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + 1 / partition.rate
            yield (url, *get(url, partition.timeout))


class WebPages(DataSource):
    @classmethod
    def name(cls):
        return "webpages"

    def schema(self):
        return "url string, html string, error string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


class _Host:
    """What a task has to fetch from its part of a host: URLs in order, and failed ones with the time from which they may be tried again."""

    def __init__(self, salt: int, parts: int, width: float):
        self.fresh: deque[str] = deque()
        self.again: list[tuple[float, str]] = []
        self.tries: Counter[str] = Counter()
        self.first, self.cycle, self.last = salt * width, parts * width, 0.0

    def due(self, now: float) -> float:
        """When the next request may start: at this part's next turn."""
        at = max(now, self.last + self.cycle / 2) if self.fresh else max(now, self.again[0][0])
        return self.first + math.ceil((at - self.first) / self.cycle) * self.cycle if self.cycle else at

    def take(self, now: float) -> str:
        return heapq.heappop(self.again)[1] if self.again and (self.again[0][0] <= now or not self.fresh) else self.fresh.popleft()


def lasting(error: str) -> bool:
    """Whether asking again is of no use: the server has answered, and not that it is busy or broken."""
    return error.startswith(("status 1", "status 2", "status 3", "status 4", "HTTPError: HTTP Error 4")) and "429" not in error and "408" not in error


def polite(urls: list[tuple[str, str, int, int]], get, gap: float, width: float, retries: int, backoff: float, clock=time.time, sleep=time.sleep) -> Iterator[tuple]:
    """(url, html, error, tries) of one task's (url, host, salt, parts of the host), in the order in which they are done.

    Requests of the task start at least `gap` apart; those of a host at multiples of `width`, where each part has turns
    of its own, so no two tasks ask a host at once. A failure that may pass comes again after backoff * 2^k seconds and
    up to as much more, by a hash of the URL.
    """
    hosts: dict[tuple[str, int], _Host] = {}
    for url, host, salt, parts in urls:
        hosts.setdefault((host, salt), _Host(salt, parts, width)).fresh.append(url)
    last = -math.inf
    turns = [(h.due(clock()), k) for k, h in hosts.items()]
    heapq.heapify(turns)
    while turns:
        due, key = heapq.heappop(turns)
        host, now = hosts[key], clock()
        if (at := max(due, last + gap)) > now:
            sleep(at - now)
            now = clock()
        if host.cycle and now - due > max(0.005, width / 11):
            # Its turn has gone by while others were asked: so late a request would come too near the next part's.
            heapq.heappush(turns, (host.due(now), key))
            continue
        url = host.take(now)
        host.last = last = now
        html, error = get(url)
        host.tries[url] += 1
        if html is None and host.tries[url] <= retries and not lasting(error):
            luck = zlib.crc32(f"{url} {host.tries[url]}".encode()) / (1 << 32)
            heapq.heappush(host.again, (clock() + backoff * 2 ** (host.tries[url] - 1) * (1 + luck), url))
        else:
            yield url, html, error, host.tries.pop(url)
        if host.fresh or host.again:
            heapq.heappush(turns, (host.due(clock()), key))


def fetch(urls: DataFrame, timeout: float = TIMEOUT, rate: float = RATE, delay: float = 0.0, parts: int = 1, host_delay: float = 0.0, retries: int = 0, backoff: float = 1.0) -> DataFrame:
    """url, html, error, tries for a column of URLs, fetched by `parts` tasks, at most `rate` a second in all (0: any), each `delay` seconds later.

    host_delay: seconds between two requests of a host (0: any); a host of more than EACH URLs is dealt to several tasks,
    which take turns. retries: how often a failure that may pass is tried again, after backoff seconds, then twice as many.
    """
    gap = (parts / rate if rate > 0 else 0.0) + delay
    rows = urls.select("url", F.lower(F.regexp_extract("url", "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1)).alias("host"))
    if host_delay > 0:
        # A row for each host.
        sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / EACH).cast("int").alias("n"))
        rows = rows.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("url"), F.col("n")).cast("int"))
    else:
        rows = rows.withColumns({"n": F.lit(1), "salt": F.lit(0)})
    dealt = rows.repartition(max(1, parts), *(["host", "salt"] if host_delay > 0 else ["url"]))

    def run(batches):
        # Of a task, only URLs are held.
        mine = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("url", "host", "salt", "n")))]
        get("data:,")  # so that the first request takes no longer than others
        # A request may start a tenth of the delay late.
        for x in polite(mine, lambda u: get(u, timeout), gap, host_delay * 1.1, retries, backoff):
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in x[:3]), pa.array([x[3]], pa.int32())], ["url", "html", "error", "tries"])

    return dealt.select("url", "host", "salt", "n").mapInArrow(run, "url string, html string, error string, tries int")
