"""Visited URLs: claimed in batches, in hashed buckets with a Bloom filter each.

A batch is a folder of URLs by bucket, which the manifest lists with its bounds; its filters, a row for each bucket
it has, lie beside it. new() asks the filters first: a URL that they don't know hasn't been visited, and only
buckets of the others are read. claim() commits a batch only if no other has been committed since the URLs were
found to be new, and otherwise looks again, so a URL is claimed once, whoever crawls.

A claim is pending until done() says that what was to be made of it is made. pending() lists those that aren't, with
what their owner wrote about them, so that another can do it after a failure. Null URLs are never new.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import TRIES, Conflict, Manifests

#: Buckets, unless asked otherwise when the first batch is claimed; bits for each URL of a filter, and hashes.
BUCKETS, BITS, HASHES = 32, 12, 8
_FILTERS = "bucket int, bits binary, batch string"


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    k = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (h1.view(np.uint64)[None, :] + k * (h2.view(np.uint64)[None, :] | np.uint64(1))) % np.uint64(size)


def _filter(table: pa.Table) -> pa.Table:
    h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
    bits = np.zeros(-(-max(64, BITS * len(h1)) // 8) * 8, bool)
    bits[_places(h1, h2, len(bits)).ravel()] = True
    return pa.table({"bits": [np.packbits(bits).tobytes()], "bucket": [table.column("bucket")[0].as_py()]}, schema=pa.schema([("bits", pa.binary()), ("bucket", pa.int32())]))


def _known(urls: pa.Table, filters: pa.Table) -> pa.Table:
    """url, maybe: whether any batch's filter knows it."""
    h1, h2 = (urls.column(c).to_numpy() for c in ("h1", "h2"))
    maybe = np.zeros(len(h1), bool)
    for b in filters.column("bits").to_pylist():
        bits = np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)
        maybe |= bits[_places(h1, h2, len(bits))].all(0)
    return pa.table({"url": urls.column("url"), "bucket": urls.column("bucket"), "maybe": maybe}, schema=pa.schema([("url", pa.string()), ("bucket", pa.int32()), ("maybe", pa.bool_())]))


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    return rows.withColumns({"bucket": bucket, "h1": F.xxhash64("url", F.lit(1)), "h2": F.xxhash64("url", F.lit(2))})


class Visited:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)
        self.buckets = self.manifests.load().get("buckets", buckets)
        #: Buckets that the last new() read.
        self.touched: list[int] = []

    def _paths(self, table: str, batches: list[dict]) -> list[str]:
        return [f"{self.root}/{table}/batch={b['folder']}" for b in batches]

    def batches(self, version: int | None = None) -> list[dict]:
        return self.manifests.load(version).get("batches", [])

    def count(self) -> int:
        return sum(b["n"] for b in self.batches())

    def read(self, batches: list[dict] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """url, key (as claimed), bucket, batch; of some batches, of some buckets."""
        batches = self.batches() if batches is None else batches
        schema = "url string, key array<bigint>, batch string, bucket int"
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/urls").parquet(*self._paths("urls", batches))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def new(self, urls: DataFrame, version: int | None = None) -> DataFrame:
        """The distinct URLs that aren't visited."""
        batches, rows = self.batches(version), _hashed(urls.select("url").where("url is not null").distinct(), self.buckets)
        self.touched = []
        if not batches:
            return rows.select("url")
        filters = self.spark.read.schema(_FILTERS).option("basePath", f"{self.root}/filters").parquet(*self._paths("filters", batches))
        asked = rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(lambda u, f: _known(u, f) if u.num_rows else _known(u.slice(0, 0), f), "url string, bucket int, maybe boolean")
        asked = _cut(asked)
        # A number for each bucket at most.
        self.touched = sorted(r.bucket for r in asked.where("maybe").select("bucket").distinct().collect())
        held = self.read(batches, self.touched).select("url")
        return asked.where("not maybe").select("url").unionByName(asked.where("maybe").select("url").join(held, "url", "left_anti"))

    def claim(self, level: DataFrame, name: str, about: dict, limit: int | None = None) -> tuple[DataFrame, int]:
        """(url, key of the level's URLs that this claim has, their number): those not visited, the first `limit` by (key, url).

        A claim of a name that there is already is that claim.
        """
        for _ in range(TRIES):
            last = self.manifests.load()
            for b in last.get("batches", []):
                if b["name"] == name:
                    return self.read([b]).select("url", "key"), b["n"]
            mine = level.join(self.new(level, last["version"]), "url", "left_semi").groupBy("url").agg(F.min("key").alias("key"))
            mine = mine if limit is None else mine.orderBy("key", "url").limit(limit)
            folder = f"{last['version']:012d}-{uuid.uuid4().hex[:12]}"
            batch = {"name": name, "folder": folder, "about": about, "pending": True, "at": int(time.time())}
            urls, filters = (f"{self.root}/{t}/batch={folder}" for t in ("urls", "filters"))
            _hashed(mine, self.buckets).hint("rebalance", "bucket").select("url", "key", "bucket").write.partitionBy("bucket").parquet(urls)
            mine = self.read([batch])
            batch["n"] = mine.count()
            if not batch["n"]:
                return mine.select("url", "key"), 0
            _hashed(mine.select("url"), self.buckets).groupBy("bucket").applyInArrow(_filter, "bits binary, bucket int").coalesce(1).write.parquet(filters)
            done = self.manifests.commit(lambda now: None if now["version"] != last["version"] else {"buckets": self.buckets, "batches": [*now.get("batches", []), batch]})
            if any(b["folder"] == folder for b in done.get("batches", [])):
                return mine.select("url", "key"), batch["n"]
        raise Conflict(f"{self.root}: others claimed {TRIES} times")

    def done(self, name: str) -> None:
        def change(now: dict) -> dict | None:
            held = now.get("batches", [])
            if not any(b["name"] == name and b["pending"] for b in held):
                return None
            return {"buckets": self.buckets, "batches": [b | {"pending": b["pending"] and b["name"] != name} for b in held]}

        self.manifests.commit(change)

    def pending(self) -> list[dict]:
        return [b for b in self.batches() if b["pending"]]


def _cut(df: DataFrame) -> DataFrame:
    from webloom.operators.lineage import cut

    return cut(df)
