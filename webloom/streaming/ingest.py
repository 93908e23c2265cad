"""Continuous indexing: pages arrive, URLs that were seen are dropped, the rest is indexed by batch, and searches read what is committed."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webloom.operators import index
from webloom.operators.segments import Segments
from webloom.sources.schema import PAGE
from webloom.sources.visited import Visited

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, by: str | None = None) -> DataFrame:
    """Pages from a folder of Parquet files, with the number `by` that tells them apart, if there is one. files_per_trigger bounds what a batch admits: back-pressure on the producer is files that wait."""
    reader = spark.readStream.schema(f"{PAGE}, {by} bigint" if by else PAGE)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


@contextmanager
def on_disk(spark: SparkSession):
    """Queries that start meanwhile keep their state in RocksDB, on the executors' disks instead of in their memory. The session's setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def unseen(pages: DataFrame, by: str | None = None) -> DataFrame:
    """The first page of each URL, or of each `by`; the state store is the visited set, and survives restarts."""
    return pages.dropDuplicates([by or "url"])


def index_stream(pages: DataFrame, path: str, checkpoint: str, origin: str = "", depth: int = 0, once: bool = True, by: str | None = None) -> StreamingQuery:
    """Appends postings of new pages to the index at path. With `by`, pages of one URL are told apart by it. Each batch is a folder of its own that a repeated batch replaces, so a restart doesn't count words twice."""

    ids = (by,) if by else ()

    def put(batch: DataFrame, n: int) -> None:
        rows = batch.where(F.col("html").isNotNull()).select(F.lit(origin).alias("origin_url"), F.col("url").alias("current_url"), F.lit(depth).alias("depth"), "html", *ids)
        index.write(index.page_postings(rows, by=ids), f"{path}/batch_id={n}", batch=n, mode="overwrite")

    writer = unseen(pages, by).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    with on_disk(pages.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def segment_stream(pages: DataFrame, root: str, visited: str, checkpoint: str, origin: str = "", depth: int = 0, name: str = "stream", once: bool = True, by: str | None = None) -> StreamingQuery:
    """Appends new pages to a segmented index, a segment a batch. The visited URLs are the table that crawl jobs share, so the stream holds no state.

    A batch claims its new URLs by its number, indexes the claim's pages, and says it is done. One that comes again finds
    its claim and its segment, so pages count once. Of several pages of a URL in a batch the least by its HTML counts;
    a page that is null is visited, not indexed. With `by`, pages of one URL are told apart by it, and it is what is claimed.
    """
    key = F.col(by or "url").cast("string")
    index_, seen = Segments(pages.sparkSession, root), Visited(pages.sparkSession, visited)

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("claimed", key)
        mine, count = seen.claim(batch.select(F.col("claimed").alias("url"), F.array(F.lit(0).cast("bigint")).alias("key")), f"{name}-{n}", {"job": name, "origin": origin, "depth": depth, "limit": depth})
        if not count:
            return
        rows = batch.where("html is not null").join(mine.select(F.col("url").alias("claimed")), "claimed", "left_semi").groupBy("claimed").agg(F.min(F.struct("html", "url")).alias("page"))
        index_.append_pages(rows.select(F.lit(origin).alias("origin_url"), F.col("page.url").alias("current_url"), F.lit(depth).alias("depth"), "page.html"), f"{name}-{n}")
        seen.done(f"{name}-{n}")

    writer = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def link_stream(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the resolved links of new pages, the next hop's URLs."""
    links = index.page_links(unseen(pages).where("html is not null")).where("target is not null").select(F.col("url").alias("src"), "pos", F.col("target").alias("dst"))
    with on_disk(pages.sparkSession):
        return links.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def telemetry(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of event types by window of event time; ts without a zone is taken as UTC by the session."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
