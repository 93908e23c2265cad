"""A document store: one row for each document id, in hashed buckets that updates rewrite one by one.

A bucket is a folder of Parquet files, and the manifest says which folder each bucket has. upsert() writes the buckets
that its documents fall in anew, beside the old ones, and commits; the others stay as they are. A reader keeps the
buckets of its version. Of several rows of a document the latest (fetched_at), then the largest by content, counts;
a row that is older than the stored one changes nothing. Rows without an id are left out.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.manifests import TRIES, Conflict, Manifests, file_system

BUCKETS = 64
_ROW = "doc_id string, url string, title string, text string, fetched_at bigint, content_hash string, length int"


def documents(rows: DataFrame) -> DataFrame:
    """The stored columns from doc_id, url, title, text, fetched_at."""
    text = F.coalesce("text", F.lit(""))
    return rows.where("doc_id is not null").select(
        F.col("doc_id").cast("string").alias("doc_id"), "url", "title", text.alias("text"), F.col("fetched_at").cast("bigint").alias("fetched_at"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("content_hash"), F.length(text).alias("length"),
    )


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)
        self.buckets = self.manifests.load().get("buckets", buckets)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def _held(self, folders: dict) -> DataFrame:
        paths = [f"{self.root}/rows/{f}/bucket={b}" for b, f in folders.items()]
        return self.spark.read.schema(_ROW).parquet(*paths) if paths else self.spark.createDataFrame([], _ROW)

    def read(self, version: int | None = None) -> DataFrame:
        return self._held(self.manifests.load(version).get("folders", {}))

    def get(self, ids: list[str]) -> DataFrame:
        """The documents of some ids; only their buckets are read."""
        asked = self._bucketed(self.spark.createDataFrame([(i,) for i in ids], "doc_id string")).select("bucket").distinct().collect()
        folders = self.manifests.load().get("folders", {})
        return self._held({str(r.bucket): folders[str(r.bucket)] for r in asked if str(r.bucket) in folders}).where(F.col("doc_id").isin(ids))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Adds or replaces documents (doc_id, url, title, text, fetched_at); the buckets that were written."""
        draft = f"{self.root}/drafts/{uuid.uuid4().hex[:12]}"
        self._bucketed(documents(rows)).write.parquet(draft)
        new = self.spark.read.parquet(draft)
        # A number for each bucket at most.
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        for k in range(TRIES if touched else 0):
            last = self.manifests.load()
            old = {str(b): f for b, f in last.get("folders", {}).items() if int(b) in touched}
            both = self._bucketed(self._held(old)).withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
            # Of equally late rows the new ones count.
            rank = F.struct("fetched_at", "fresh", "content_hash", "url", "title")
            latest = both.groupBy("bucket", "doc_id").agg(F.max_by(F.struct("url", "title", "text", "fetched_at", "content_hash", "length"), rank).alias("r")).select("bucket", "doc_id", "r.*")
            folder = f"{last['version']:012d}-{uuid.uuid4().hex[:12]}"
            latest.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/rows/{folder}")
            done = self.manifests.commit(lambda now: None if now["version"] != last["version"] else {"buckets": self.buckets, "folders": now.get("folders", {}) | {str(b): folder for b in touched}})
            if folder in done.get("folders", {}).values():
                path, fs = file_system(self.spark, draft)
                fs.delete(path, True)
                return touched
            time.sleep(0.05 * k)
        if touched:
            raise Conflict(f"{self.root}: others committed {TRIES} times")
        return []
