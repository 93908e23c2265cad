"""Ranked keyword search over postings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import status as S
from webloom.functions import text as X
from webloom.sources import files
from . import index
from .lineage import cut
from .segments import Segments

#: Most rows of a page by request; rows up to which a page is found in the same job as the total.
MOST, FIRST = 100, 10_000


def match(rows: DataFrame, terms: list[str]) -> DataFrame:
    """url, origin_url, depth, frequency: any term counts, the least depth, and the origin of the first row by (bucket, seq)."""
    found = files.valid_postings(index.lookup(rows, terms))
    first = F.struct(*[c for c in ("bucket", "batch", "seq") if c in rows.columns]) if "seq" in rows.columns else F.struct("bucket", "origin_url")
    return found.groupBy(F.col("current_url").alias("url")).agg(F.min_by("origin_url", first).alias("origin_url"), F.min("depth").alias("depth"), F.sum("frequency").alias("frequency"))


def scored(matched: DataFrame) -> DataFrame:
    return matched.withColumn("relevance_score", X.relevance(F.col("frequency"), F.col("depth").cast("bigint")))


def order(sort_by: str | None) -> list:
    """Anything but "frequency" sorts by relevance."""
    keys = [F.desc("frequency"), F.asc("depth"), F.asc("url")]
    return keys if (sort_by or "relevance").strip().lower() == "frequency" else [F.desc("relevance_score"), *keys]


def ranked(rows: DataFrame, terms: list[str], sort_by: str = "relevance") -> DataFrame:
    return scored(match(rows, terms)).orderBy(*order(sort_by))


def top_changes(old: DataFrame, new: DataFrame, terms: list[str], k: int, sort_by: str = "relevance") -> DataFrame:
    """url, change (entered, left or moved), old_rank, new_rank (0: not among them): what differs between the first k results over two versions of an index."""
    first = lambda rows, name: numbered(scored(match(rows, terms)).orderBy(*order(sort_by)).limit(k), order(sort_by)).select("url", F.col("rank").cast("bigint").alias(name))
    both = first(old, "old_rank").join(first(new, "new_rank"), "url", "full")
    change = F.when(F.col("old_rank").isNull(), "entered").when(F.col("new_rank").isNull(), "left").when(F.col("old_rank") != F.col("new_rank"), "moved")
    return both.select("url", change.alias("change"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("old_rank", "new_rank"))).where("change is not null")


def updates(old: DataFrame, added: DataFrame, terms: list[str]) -> DataFrame:
    """url, change (entered or changed) and the new result of each URL that added rows touch; the other results are as they were.

    old: the rows of the version before; of these only the touched URLs' are matched again.
    """
    added = index.lookup(added, terms)
    touched = files.valid_postings(added).select("current_url").distinct()
    held = index.lookup(old, terms).join(touched, "current_url", "left_semi")
    before = match(held, terms).select("url", F.lit(True).alias("was"))
    rows = scored(match(held.unionByName(added), terms)).join(before, "url", "left")
    return rows.withColumn("change", F.when(F.col("was"), "changed").otherwise("entered")).drop("was")


def page_bounds(total: int, page, size) -> tuple[int, int, int]:
    """(page, size, pages)"""
    size = max(1, int(size))
    pages = math.ceil(total / size)
    return (min(max(1, int(page)), pages) if pages else 1), size, pages


def numbered(results: DataFrame, keys: list) -> DataFrame:
    """Adds rank and total. Ranges of the order are sorted apart, so no task holds all results; what goes to all tasks is a row for each range."""
    ranges = cut(results.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return ranges.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + inside).drop("part", "start")


def page_of(results: DataFrame, keys: list, page: int, size: int) -> DataFrame:
    """One page, with rank, page, total, total_pages, has_prev, has_next; the page is clamped to those there are."""
    size = max(1, int(size))
    rows = numbered(results, keys)
    rows = rows.withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint")).withColumn("page", F.least(F.greatest(F.lit(int(page)), F.lit(1)), F.col("total_pages")).cast("bigint"))
    rows = rows.where((F.col("rank") > (F.col("page") - 1) * size) & (F.col("rank") <= F.col("page") * size))
    return rows.withColumns({"page_size": F.lit(size).cast("bigint"), "has_prev": F.col("page") > 1, "has_next": F.col("page") < F.col("total_pages")})


class SearchEngine:
    """Search over an index table, an index in segments as of its last version, or a folder of JSON-line shards."""

    def __init__(self, rows: DataFrame | Segments | None = None, spark: SparkSession | None = None, storage_dir: str | None = None):
        self.rows, self.spark, self.storage_dir = rows, spark, storage_dir

    def _rows(self, terms: list[str]) -> DataFrame:
        if isinstance(self.rows, Segments):
            return self.rows.matching(terms)
        return self.rows if self.rows is not None else files.read_shards(self.spark, self.storage_dir, terms)

    def _answer(self, query: str, sort_by: str, page: int, size: int) -> tuple[dict, list]:
        """(what all answers have, the page's rows). One job: the matches are counted as the first rows are found."""
        terms = X.query_terms(query)
        if not terms:
            return {"query": query, "total": 0, "page": 1, "page_size": max(1, int(size)), "total_pages": 0}, []
        wanted = max(1, int(page)) * max(1, int(size))
        results = scored(match(self._rows(terms), terms))
        if wanted <= FIRST:
            seen = Observation()
            rows = results.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order(sort_by)).limit(wanted).collect()
            total = seen.get["n"]
            page, size, pages = page_bounds(total, page, size)
            rows = rows[(page - 1) * size : page * size]
        else:
            total = results.count()
            page, size, pages = page_bounds(total, page, size)
            rows = results.orderBy(*order(sort_by)).offset((page - 1) * size).limit(size).collect() if total else []
        return {"query": query, "total": total, "page": page, "page_size": size, "total_pages": pages}, rows

    def search(self, query: str, page: int = 1, page_size: int = 20) -> dict:
        """(url, origin_url, depth) triples, most hits first, then least depth, then url."""
        found, rows = self._answer(query, "frequency", page, page_size)
        return found | {"results": [(r.url, r.origin_url, r.depth) for r in rows]}

    def search_triples(self, query: str, page: int = 1, page_size: int = 20) -> list[tuple]:
        return self.search(query, page, page_size)["results"]

    def search_api(self, query: str, sort_by: str = "relevance", page: int = 1, page_size: int = 20) -> dict:
        found, rows = self._answer(query, sort_by, page, page_size)
        asked = "frequency" if (sort_by or "").strip().lower() == "frequency" else "relevance"
        return found | {"sortBy": asked if X.query_terms(query) else sort_by, "results": [r.asDict() for r in rows]}

    def request(self, args: dict) -> dict:
        """search_api() by the parameters of a request: query (or q), sortBy, page from 1, page_size from 1 to MOST; ValueError for other pages and sizes."""
        page, size = S.clamped(args.get("page"), 1), S.clamped(args.get("page_size"), 1, MOST, 20)
        query = (args.get("query") or "").strip()
        if query:
            return self.search_api(query, (args.get("sortBy") or "relevance").strip().lower(), page, size)
        query = (args.get("q") or "").strip()
        return self.search_api(query, "relevance", page, size) if query else {"query": "", "total": 0, "page": page, "page_size": size, "total_pages": 0, "results": []}


def search(query: str, page: int = 1, page_size: int = 20, *, spark: SparkSession, storage_dir: str = "storage") -> dict:
    return SearchEngine(spark=spark, storage_dir=storage_dir).search(query, page, page_size)
