"""The inverted index: building, storing by bucket, appending, statistics, clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webloom.functions import counts
from webloom.functions import pages as P
from webloom.functions import text as X


def _counted(docs: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """word, keys, frequency. Pages are dealt by URL before their words are counted, in Arrow arrays, so neither words nor postings are shuffled or gathered in a task."""
    rows = docs.repartition("current_url").sortWithinPartitions("current_url", *keys).select(*keys, words.alias("words"))
    schema = StructType([StructField("word", StringType()), *docs.select(*keys).schema.fields, StructField("frequency", LongType())])
    return rows.mapInArrow(counts.of_pages(keys), schema)


def postings(docs: DataFrame, words: Column, ts: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """word, origin_url, current_url, depth, frequency, ts, bucket from origin_url, current_url, depth and a column of words. A page without words has no rows.

    by: columns that tell pages of one URL apart, which are kept; without, they are one page.
    """
    counted = _counted(docs, words, ["origin_url", "current_url", "depth", *by])
    return counted.withColumns({"ts": (F.unix_timestamp() if ts is None else ts).cast("bigint"), "bucket": X.bucket(F.col("word"))})


def page_postings(pages: DataFrame, ts: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """postings() of origin_url, current_url, depth, html."""
    return postings(pages, P.page_words(F.col("html")), ts, by)


def document_frequency(docs: DataFrame, words: Column) -> DataFrame:
    """word, df (the URLs that have it), total_frequency."""
    return _counted(docs, words, ["current_url"]).groupBy("word").agg(F.count("current_url").alias("df"), F.sum("frequency").alias("total_frequency"))


def page_links(pages: DataFrame) -> DataFrame:
    """url, pos, href, target: the anchors of each page; target is null where the link isn't a page's."""
    found = pages.select("url", F.posexplode(P.page_links(F.col("html"))).alias("pos", "href"))
    return found.withColumn("target", P.resolve_url(F.col("url"), F.col("href")))


def write(rows: DataFrame, path: str, batch: int = 0, mode: str = "append") -> None:
    """Appends postings as Parquet by bucket, each with seq = (batch, place). A writing task holds its buckets together.

    The rebalance lets AQE split a large bucket, even one word's rows, over as many tasks as its size asks for, and join small ones.
    """
    rows = rows.withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "word", "current_url").withColumn("seq", F.monotonically_increasing_id()).write.mode(mode).partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """The stored index, in segments or plain; with terms only their partitions are listed and read."""
    from .segments import Segments

    rows = Segments(spark, path).read() if Segments.at(spark, path) else spark.read.parquet(path)
    return rows if terms is None else lookup(rows, terms)


def lookup(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of the terms. Spark can't derive a word's bucket, so it is said: a bucket that isn't asked for isn't read."""
    buckets = sorted({X.bucket_of(t) for t in terms})
    found = rows.where(F.col("word").isin(terms))
    return found.where(F.col("bucket").isin(buckets)) if "bucket" in rows.columns else found


def incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def shard_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.countDistinct("word").alias("n_words"), F.sum("frequency").alias("total_frequency"))


def clear(spark: SparkSession, paths: list[str]) -> tuple[bool, dict[str, int]]:
    """Deletes stored data; refuses while a crawl job or a streaming query runs. Gives the number of files deleted for each path."""
    from . import job

    if job.any_alive() or any(q.isActive for q in spark.streams.active):
        return False, {}
    out = {}
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out[p] = fs.getContentSummary(path).getFileCount() if fs.exists(path) else 0
        fs.delete(path, True)
    return True, out
