"""Breadth-first crawling as joins over an edge table, one level a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, visited: DataFrame | None = None, max_pages: int | None = None, failed: DataFrame | None = None) -> DataFrame:
    """url, depth, key, ok for each page that a crawl visits.

    edges: src, pos, dst. A page's key holds the link positions on the way to it, which orders the pages of a
    level as a queue would: by their parents' order, then by position, the first way winning. Failed pages
    count as visited and aren't expanded. Levels are checkpointed; only counts reach the driver.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    known = visited.select(F.col("url").cast(kind).alias("url")) if visited is not None else None
    level = seeds.select(F.col("url").cast(kind).alias("url"), F.array(F.lit(0).cast("bigint")).alias("key")).groupBy("url").agg(F.min("key").alias("key"))
    done, left = [], max_pages
    for k in range(max(0, depth) + 1):
        if known is not None:
            level = level.join(known, "url", "left_anti")
        if left is not None:
            level = level.orderBy("key", "url").limit(left)
        if failed is not None:
            bad = failed.select(F.col("url").cast(kind).alias("url"), F.lit(False).alias("ok")).distinct()
            level = level.join(bad, "url", "left").select("url", "key", F.coalesce("ok", F.lit(True)).alias("ok"))
        else:
            level = level.withColumn("ok", F.lit(True))
        level = cut(level.withColumn("depth", F.lit(k)))
        n = level.count()
        if not n:
            break
        done.append(level)
        left = None if left is None else left - n
        known = level.select("url") if known is None else known.unionByName(level.select("url"))
        if left == 0:
            break
        ways = level.where("ok").join(edges, level["url"] == edges["src"]).where("dst is not null")
        level = ways.select(F.col("dst").alias("url"), F.concat("key", F.array(F.col("pos").cast("bigint"))).alias("key")).groupBy("url").agg(F.min("key").alias("key"))
    if not done:
        return spark.createDataFrame([], f"url {kind.simpleString()}, depth int, key array<bigint>, ok boolean")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("url", "depth", "key", "ok")


def counters(crawled: DataFrame, visited_before: DataFrame | None = None) -> DataFrame:
    """pages_processed = pages_indexed + pages_failed, and visited_count, which earlier jobs add to."""
    urls = crawled.select("url") if visited_before is None else crawled.select("url").unionByName(visited_before.select("url"))
    counts = crawled.agg(F.count("*").alias("pages_processed"), F.count_if("ok").alias("pages_indexed"), F.count_if(~F.col("ok")).alias("pages_failed"))
    return counts.crossJoin(F.broadcast(urls.agg(F.countDistinct("url").alias("visited_count"))))  # one row each


def unseen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """The distinct URLs that aren't visited yet, which is what is appended to the visited table."""
    return urls.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def fetch_outcome(links: DataFrame, pages: DataFrame) -> DataFrame:
    """url, ok for each distinct link: a page that isn't there is a failed fetch. Pages are joined by URL alone."""
    there = pages.where("html is not null").select("url", F.lit(True).alias("ok")).distinct()
    return links.select("url").distinct().join(there, "url", "left").select("url", F.coalesce("ok", F.lit(False)).alias("ok"))


def fetch_schedule(urls: DataFrame, order: list, hit_rate: float, host=None) -> DataFrame:
    """Adds start_s, the seconds after which each fetch may start: at most hit_rate a second in all, or for each host."""
    w = Window.partitionBy(host).orderBy(*order) if host is not None else Window.orderBy(*order)
    return urls.withColumn("start_s", F.lit(0.0) if hit_rate <= 0 else (F.row_number().over(w) - 1) / F.lit(float(hit_rate)))


def queue_depth(events: DataFrame, order: list, change, by=None) -> DataFrame:
    """Adds waiting: the running sum of enqueued less dequeued."""
    w = (Window.partitionBy(by) if by is not None else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("waiting", F.sum(change).over(w))


def crawl_site(pages: DataFrame, seed: str, depth: int, visited: DataFrame | None = None, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(visited pages, postings) of a crawl over url, html: parse all pages once, walk the links, index what was reached."""
    from . import index

    spark = pages.sparkSession
    links = cut(index.page_links(pages).where("target is not null").select(F.col("url").alias("src"), "pos", F.col("target").alias("dst")))
    seeds = spark.createDataFrame([(seed,)], "url string")
    targets = links.select(F.col("dst").alias("url")).unionByName(seeds)
    failed = fetch_outcome(targets, pages).where("not ok")
    reached = bfs(links, seeds, depth, visited, max_pages, failed)
    found = pages.join(reached.where("ok"), "url").select(F.lit(seed).alias("origin_url"), F.col("url").alias("current_url"), "depth", "html")
    return reached, index.page_postings(found)


def lead_over(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds next: value of the following row by key. Ranges of keys are sorted apart; only each range's first value goes on to the one before."""
    ranges = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()))
    inside = ranges.withColumn("next", F.lead(value).over(Window.partitionBy("part").orderBy(key))).withColumn("last", F.lead(key).over(Window.partitionBy("part").orderBy(key)).isNull())
    # A row for each range.
    firsts = ranges.groupBy("part").agg(F.min_by(value, key).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    return inside.join(F.broadcast(firsts), "part").withColumn("next", F.when(F.col("last"), F.col("after")).otherwise(F.col("next"))).drop("part", "last", "after")
