"""Ranking by TF-IDF and document length over a segmented index, and snippets from its positions.

A page's score is the sum over terms of floor(10^6 ln(1 + N / df) frequency / sqrt(length)), whole numbers that add
up in any order. N is the number of pages, from the manifest; df, and for each block of pages the most that a term
can add there, are in the small table of blocks. So a block's pages score at most the sum of its terms' bounds.

top() first scores some blocks of the highest bounds; the k-th best score there is one that the result has at
least. Then only blocks whose bound reaches it are read, by a filter that goes down to the sorted files, or a join
if they are more than PUSHED. What is skipped can't be among the first k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.sources import files

from . import index
from .segments import Segments, impact

UNIT, FIRST, PUSHED = 1_000_000, 4, 2_000


def _idf(df, n: int):
    return F.log(1 + F.lit(float(n)) / df)


def _scores(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """url, batch, score. terms: word, idf."""
    part = F.floor(UNIT * F.col("idf") * impact())
    return rows.join(F.broadcast(terms), "word").groupBy(F.col("current_url").alias("url"), "batch").agg(F.sum(part).alias("score"))


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of the blocks: by a filter if these are few, else by a join."""
    found = blocks.select("batch", "block").limit(PUSHED + 1).collect()
    return _filtered(rows, found) if len(found) <= PUSHED else rows.join(blocks.select("batch", "block"), ["batch", "block"], "left_semi")


def _filtered(rows: DataFrame, blocks: list) -> DataFrame:
    by_batch: dict[str, list[int]] = {}
    for r in blocks:
        by_batch.setdefault(r.batch, []).append(r.block)
    return rows.where(reduce(lambda x, y: x | y, ((F.col("batch") == b) & F.col("block").isin(xs) for b, xs in by_batch.items()), F.lit(False)))


def top(segments: Segments, terms: list[str], k: int, version: int | None = None) -> tuple[DataFrame, dict]:
    """(url, score of the best k pages, {"blocks", "read"}: blocks that hold a term, and those that are read). Of equal scores the smaller URL comes first."""
    pages = sum(s["pages"] for s in segments.listed(version))
    held = index.lookup(segments.read(version, "blocks"), terms)
    known = held.groupBy("word").agg(F.sum("n").alias("df")).select("word", _idf(F.col("df"), pages).alias("idf"))
    # A row for each term.
    known = segments.spark.createDataFrame(known.collect(), known.schema)
    # A term's share is floored, so the sum of bounds is a bound; a little more, as they are added up in another order.
    bound = F.sum(UNIT * F.col("idf") * F.col("most") * (1 + 1e-12)).alias("bound")
    blocks = held.join(F.broadcast(known), "word").groupBy("batch", "block").agg(bound, F.max("n").alias("n"))
    rows = files.valid_postings(index.lookup(segments.read(version), terms))
    order = [F.desc("score"), F.asc("url")]
    # As many of the best blocks as have twice k pages: k rows at most.
    best, n = [], 0
    for r in blocks.orderBy(F.desc("bound"), "batch", "block").limit(max(FIRST, k)).collect():
        if n < 2 * k or len(best) < FIRST:
            best.append(r)
            n += r.n
    kth = _scores(_filtered(rows, best), known).orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = kth.least if kth.n == k else 0
    wanted = blocks.where(F.col("bound") >= least)
    counts = blocks.agg(F.count("*").alias("blocks"), F.count_if(F.col("bound") >= least).alias("read")).first()
    return _scores(_in_blocks(rows, wanted), known).select("url", "score").orderBy(*order).limit(k), counts.asDict()


def windows(rows: DataFrame, terms: list[str]) -> DataFrame:
    """batch, url, first, last: of each page that has all the terms its smallest run of words with all of them, the first such run.

    A page's matches are sorted by position; for each, the last place of every term up to there tells the run that ends there.
    """
    found = index.lookup(rows, terms).repartition("batch", "current_url")
    each = found.select("batch", F.col("current_url").alias("url"), "word", F.posexplode("positions").alias("k", "step"))
    up_to = Window.partitionBy("batch", "url", "word").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("batch", "url", "word", F.sum("step").over(up_to).cast("int").alias("last"))
    so_far = Window.partitionBy("batch", "url").orderBy("last").rowsBetween(Window.unboundedPreceding, 0)
    places = [F.max(F.when(F.col("word") == t, F.col("last"))).over(so_far) for t in terms]
    each = each.select("batch", "url", "last", F.array(*places).alias("places")).where(~F.exists("places", lambda x: x.isNull()))
    run = F.struct((F.col("last") - F.array_min("places")).alias("n"), F.array_min("places").alias("first"), "last")
    return each.select("batch", "url", run.alias("run")).groupBy("batch", "url").agg(F.min("run").alias("run")).select("batch", "url", "run.first", "run.last")


def snippets(segments: Segments, terms: list[str], around: int = 5, version: int | None = None) -> DataFrame:
    """url, first, last, snippet: the words of each page's smallest run, with `around` more on each side."""
    found = windows(segments.read(version), terms)
    pages = segments.read(version, "pages").select("batch", F.col("current_url").alias("url"), "words")
    start = F.greatest(F.col("first") - around, F.lit(0))
    text = F.array_join(F.slice("words", start + 1, F.col("last") + around - start + 1), " ")
    return found.join(pages, ["batch", "url"]).select("url", "first", "last", text.alias("snippet"))
