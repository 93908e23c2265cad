"""The queries over the driver's tables, by name, and the SQL that gives the same rows.

`documents` stand for crawled pages (source as origin, doc_id modulo 7 as depth), `pages` for fetched HTML,
`orders` for a link graph (a customer's order links to the customer of the next order), and `events` for job
telemetry (a user is a job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import pages as P
from webloom.functions import status as S
from webloom.functions import text as X
from webloom.operators import canonical, crawl, index, lineage, ranking, robots, search, segments, status, store
from webloom.sources import files, manifests, visited
from webloom.streaming import ingest

TERMS = ["the", "thou", "les", "und", "9", "para"]
QUERY = "The thou, LES und-the 9 para"
NOW = 1706659200
PAGE, SIZE = 3, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("origin_url"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("current_url"), (F.col("doc_id") % 7).cast("int").alias("depth"), "text", "doc_id"
    )


def _index(spark, sf_dir, some="true"):
    """Postings of (some) documents."""
    rows = index.postings(_documents(spark, sf_dir).where(some), X.tokenize(F.col("text")), F.lit(0))
    return rows.withColumn("seq", F.substring("current_url", 5, 20).cast("bigint"))


#: Arrivals of documents, by doc_id; the URLs of pages that come with several of them.
BATCHES, AGAIN = 3, 97
_STORED: dict[tuple, segments.Segments] = {}


def _segments(spark, sf_dir, again=False) -> segments.Segments:
    """The stored index of documents, in three batches. It is built once for a session and table, and read by each search.

    again: documents are what was found at AGAIN URLs, each with many arrivals.
    """
    path, fs = manifests.file_system(spark, f"{sf_dir}/documents.parquet")
    held = fs.getContentSummary(path)
    key = (spark.sparkContext.applicationId, sf_dir, again, held.getLength(), held.getFileCount(), fs.getFileStatus(path).getModificationTime())
    if key not in _STORED:
        made, docs = segments.Segments(spark, lineage.folder(spark, "segments")), _documents(spark, sf_dir).withColumn("seq", F.col("doc_id"))
        if again:
            docs = docs.withColumn("current_url", F.concat(F.lit("page/"), F.col("doc_id") % AGAIN))
        for k in range(BATCHES):
            made.append(docs.where(F.col("doc_id") % BATCHES == k), X.tokenize(F.col("text")), f"documents {k}", F.lit(0))
        _STORED[key] = made
    return _STORED[key]


def tokenize(spark, sf_dir):
    words = X.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


def build_inverted_index(spark, sf_dir):
    return _index(spark, sf_dir).select("word", F.col("seq").alias("doc_id"), "frequency")


def bucket_word(spark, sf_dir):
    return _index(spark, sf_dir).select("word", "bucket").distinct()


def shard_stats(spark, sf_dir):
    return index.shard_stats(_index(spark, sf_dir))


def parse_query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.parse_query(F.col("text"))).alias("pos", "term"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def term_filter(spark, sf_dir):
    return index.lookup(_segments(spark, sf_dir).read(), TERMS).select("word", F.col("seq").alias("doc_id"), "frequency")


def valid_postings(spark, sf_dir):
    rows = _index(spark, sf_dir).withColumns({"frequency": F.col("frequency") - 1, "origin_url": F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("origin_url"))})
    return files.valid_postings(rows).select("word", F.col("seq").alias("doc_id"), "frequency")


def bucket_pruned_lookup(spark, sf_dir):
    rows = index.lookup(_segments(spark, sf_dir).read(), ["thou", "9"])
    return rows.select("bucket", "word", F.col("seq").alias("doc_id"), "frequency")


def _shards(spark, sf_dir):
    path = lineage.folder(spark, "shards")
    files.append_shards(_index(spark, sf_dir).drop("seq"), path)
    return path


def shard_scan(spark, sf_dir):
    return files.read_shards(spark, _shards(spark, sf_dir)).select("bucket", "word", "origin_url", "current_url", "depth", "frequency", "ts")


def shard_lookup(spark, sf_dir):
    """Of the shards, only those of the terms' buckets are read."""
    return index.lookup(files.read_shards(spark, _shards(spark, sf_dir), TERMS), TERMS).select("bucket", "word", "current_url", "frequency")


def search_request(spark, sf_dir):
    """A request for the third page of more rows than a page may have, from the stored index."""
    found = search.SearchEngine(_segments(spark, sf_dir)).request({"query": QUERY, "sortBy": " Frequency", "page": str(PAGE), "page_size": "5000"})
    # A page: search.MOST rows at most.
    rows = spark.createDataFrame(found["results"], "url string, origin_url string, depth int, frequency bigint, relevance_score bigint")
    return rows.withColumns({c: F.lit(found[c]).cast("bigint") for c in ("total", "page", "page_size", "total_pages")} | {"sort_by": F.lit(found["sortBy"])})


def search_json(spark, sf_dir):
    """Results as an answer's JSON objects."""
    found = search.scored(search.match(_segments(spark, sf_dir).read(), TERMS))
    return found.select("url", F.to_json(F.struct("url", "origin_url", "depth", "frequency", "relevance_score")).alias("row"))


def _ranked(spark, sf_dir, sort_by):
    results = search.scored(search.match(_segments(spark, sf_dir).read(), X.query_terms(QUERY)))
    return search.numbered(results, search.order(sort_by))


def search_triples(spark, sf_dir):
    return _ranked(spark, sf_dir, "frequency").select("rank", F.col("url").alias("relevant_url"), "origin_url", "depth")


def search_frequency(spark, sf_dir):
    return _ranked(spark, sf_dir, "Frequency ").select("rank", "url", "origin_url", "depth", "frequency")


def search_relevance(spark, sf_dir):
    return _ranked(spark, sf_dir, "relevance").select("rank", "url", "origin_url", "depth", "frequency", "relevance_score")


def _page(spark, sf_dir, page):
    results = search.scored(search.match(_segments(spark, sf_dir).read(), X.query_terms(QUERY)))
    return search.page_of(results, search.order("relevance"), page, SIZE).select("rank", "url", "relevance_score", "page", "page_size", "total", "total_pages", "has_prev", "has_next")


def search_page(spark, sf_dir):
    return _page(spark, sf_dir, PAGE)


def search_page_past_end(spark, sf_dir):
    return _page(spark, sf_dir, 1_000_000)


def first_origin(spark, sf_dir):
    """Documents of a language as the rows of one URL."""
    langs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    rows = index.lookup(_segments(spark, sf_dir).read(), TERMS).join(langs.withColumnRenamed("doc_id", "seq"), "seq").withColumn("current_url", F.col("lang"))
    return search.match(rows, TERMS).select("url", "origin_url", "depth", "frequency")


def search_all_terms(spark, sf_dir):
    """Documents that hold every one of two terms."""
    rows = index.lookup(_segments(spark, sf_dir).read(), ["the", "thou"])
    return rows.groupBy(F.col("current_url").alias("url")).agg(F.countDistinct("word").alias("n"), F.sum("frequency").alias("frequency")).where("n = 2").drop("n")


def search_tfidf(spark, sf_dir):
    """The best hundred pages by TF-IDF and length; blocks that can't have one aren't read."""
    best, _ = ranking.top(_segments(spark, sf_dir), X.query_terms(QUERY), 100)
    return search.numbered(best, [F.desc("score"), F.asc("url")]).select("rank", "url", "score")


def search_snippets(spark, sf_dir):
    """Of each page with both words, the smallest run of words that has both, with the words around it."""
    return ranking.snippets(_segments(spark, sf_dir), ["the", "thou"])


def search_updates(spark, sf_dir):
    """What the third batch has changed of a search: results that are new or another, as they are now."""
    s = _segments(spark, sf_dir, again=True)
    return search.updates(s.read(BATCHES - 1), s.read(BATCHES, since=BATCHES - 1), TERMS).select("url", "change", "origin_url", "depth", "frequency", "relevance_score")


def search_top_changes(spark, sf_dir):
    """What differs between the first fifty results before and after the third batch."""
    s = _segments(spark, sf_dir, again=True)
    return search.top_changes(s.read(BATCHES - 1), s.read(BATCHES), TERMS, 50)


def segment_replay(spark, sf_dir):
    """An index whose second batch died between write and commit and came again, as did the first: each counts once."""
    docs, root = _documents(spark, sf_dir).withColumn("seq", F.col("doc_id")), lineage.folder(spark, "replay")
    halves = [docs.where(F.col("doc_id") % 2 == k) for k in range(2)]
    s, words = segments.Segments(spark, root), X.tokenize(F.col("text"))
    s.append(halves[0], words, "even", F.lit(0))
    s._write(halves[1], words, "000000000001-died", F.lit(0))
    for half, name in ((1, "odd"), (0, "even"), (1, "odd")):
        segments.Segments(spark, root).append(halves[half], words, name, F.lit(0))
    s.recover(-60)
    return s.read().groupBy("word").agg(F.count("*").alias("n_rows"), F.sum("frequency").alias("total_frequency"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("last_positions"))


def visited_claims(spark, sf_dir):
    """Links as levels of two crawls after one of all pages: a URL is claimed once, by the first that has it."""
    v = visited.Visited(spark, lineage.folder(spark, "claims"))
    links = _links(spark, sf_dir).where("target is not null").select(F.col("target").alias("url"), F.array(F.lit(0).cast("bigint")).alias("key"), "pos")
    pages = table(spark, sf_dir, "pages").select("url", F.array(F.lit(0).cast("bigint")).alias("key"))
    for name, level in (("pages", pages), ("first", links.where("pos % 2 = 0")), ("second", links)):
        v.claim(level.select("url", "key"), name, {"job": name})
    names = spark.createDataFrame([(b["folder"], b["name"]) for b in v.batches()], "batch string, claim string")
    return v.read().join(F.broadcast(names), "batch").select("url", "claim")  # a row a claim


def robots_allowed(spark, sf_dir):
    """Pages and links against rules made of the pages' own paths: starts of them, and endings with a * before."""
    pages = table(spark, sf_dir, "pages").select("page_id", robots.host_of(F.col("url")).alias("host"), robots.path_of(F.col("url")).alias("path"), "url")
    k, path = F.col("page_id"), F.col("path")
    pattern = F.when(k % 3 == 0, F.substring(path, 1, 4)).when(k % 3 == 1, F.substring(path, 1, 7)).otherwise(F.concat(F.lit("/*"), F.right(path, F.lit(2)), F.lit("$")))
    rules = pages.where(~path.contains("*") & ~path.contains("$")).select("host", (k % 2 == 0).alias("allow"), pattern.alias("pattern"))
    links = _links(spark, sf_dir).where("target is not null").select(F.col("target").alias("url"))
    return robots.allowed(pages.select("url").unionByName(links), rules)


def document_frequency(spark, sf_dir):
    return index.document_frequency(_documents(spark, sf_dir), X.tokenize(F.col("text")))


def html_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(P.page_words(F.col("html"))).alias("word"))
    return pages.groupBy("page_id", "word").agg(F.count("*").alias("frequency"))


def _links(spark, sf_dir):
    return index.page_links(table(spark, sf_dir, "pages"))


def extract_links(spark, sf_dir):
    return _links(spark, sf_dir).select("url", F.col("pos").cast("bigint").alias("pos"), "href")


def normalize_url(spark, sf_dir):
    return _links(spark, sf_dir).select("url", F.col("pos").cast("bigint").alias("pos"), "target")


def fetch_outcome(spark, sf_dir):
    links = _links(spark, sf_dir).where("target is not null").select(F.col("target").alias("url"))
    pages = table(spark, sf_dir, "pages")
    # The seeds are fetched too.
    return crawl.fetch_outcome(links.unionByName(pages.select("url")), pages).select("url", "ok")


def crawl_counters(spark, sf_dir):
    done = fetch_outcome(spark, sf_dir)
    return crawl.counters(done, table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.concat("url", F.lit("/old")).alias("url")))


def visited_dedupe(spark, sf_dir):
    links = _links(spark, sf_dir).select(F.col("target").alias("url")).where("url is not null")
    return crawl.unseen(links, table(spark, sf_dir, "pages").select("url"))


def visited_load(spark, sf_dir):
    """The pages, then the links that weren't among them, as a visited table that is appended to and read again."""
    path, pages = lineage.folder(spark, "visited"), table(spark, sf_dir, "pages").select("url")
    pages.write.mode("append").text(path)
    visited_dedupe(spark, sf_dir).write.mode("append").text(path)
    return files.read_visited(spark, path)


def streamed_index(spark, sf_dir):
    """Pages as a stream: new ones are indexed as they come, several of one URL too, and what is committed is read."""
    path = lineage.folder(spark, "stream")
    ingest.index_stream(ingest.page_stream(spark, f"{sf_dir}/pages.parque[t]", by="page_id"), f"{path}/index", f"{path}/checkpoint", "seed", by="page_id").awaitTermination()
    return index.read(spark, f"{path}/index").groupBy("word").agg(F.count("*").alias("n_pages"), F.sum("frequency").alias("total_frequency"))


def stream_segments(spark, sf_dir):
    """A stream of pages in which a third come twice, into an index of segments: each counts once."""
    path, pages = lineage.folder(spark, "segment-stream"), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    for k, part in enumerate((pages.where("page_id % 3 != 0"), pages.where("page_id % 3 != 1"))):
        part.write.mode("append").parquet(f"{path}/in/{k}")
    ingest.segment_stream(ingest.page_stream(spark, f"{path}/in/*", 1, by="page_id"), f"{path}/index", f"{path}/visited", f"{path}/checkpoint", "seed", by="page_id").awaitTermination()
    return index.read(spark, f"{path}/index").groupBy("word").agg(F.count("*").alias("n_pages"), F.sum("frequency").alias("total_frequency"))


def document_upsert(spark, sf_dir):
    """Documents stored, then a fifth of them with other texts, a seventh with older ones, and some for the first time."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc/"), "doc_id").alias("url"), F.col("source").alias("title"), "text", F.lit(100).alias("fetched_at"), F.col("doc_id").alias("k"))
    held = store.DocumentStore(spark, lineage.folder(spark, "documents"), buckets=16)
    held.upsert(docs.where("k % 10 != 9"))
    other = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" again")))
    held.upsert(other.where("k % 5 = 4").withColumn("fetched_at", F.lit(200)).unionByName(other.where("k % 7 = 1 and k % 5 != 4").withColumn("fetched_at", F.lit(50))))
    return held.read()


def canonical_urls(spark, sf_dir):
    """Documents as pages of a few hosts: one parameter never changes what is there, another does on every second host."""
    k = F.col("doc_id")
    url = F.format_string("http://H%d.example/p%d?b=%d&a=%d", k % 13, k % 17, k % 5, k % 3)
    pages = table(spark, sf_dir, "documents").select(url.alias("url"), F.concat_ws("/", k % 13, k % 17, F.when(k % 13 % 2 == 0, k % 3).otherwise(0)).alias("html"))
    return canonical.canonical(pages, canonical.neutral(pages, F.col("html")))


def _graph(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return crawl.lead_over(orders, "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("pos"), F.col("next").alias("dst"))


def _seed(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("url"))


def bfs_depth(spark, sf_dir):
    return crawl.bfs(_graph(spark, sf_dir), _seed(spark, sf_dir), 3).select("url", "depth")


def bfs_max_pages(spark, sf_dir):
    return crawl.bfs(_graph(spark, sf_dir), _seed(spark, sf_dir), 3, max_pages=40).select("url", "depth")


def bfs_visited(spark, sf_dir):
    """A crawl after another that had visited every fifth page, with failures."""
    every = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url")).distinct()
    old, bad = every.where("url % 5 = 1 and url % 10 != 1"), every.where("url % 7 = 2")
    return crawl.bfs(_graph(spark, sf_dir), _seed(spark, sf_dir), 3, visited=old, failed=bad).select("url", "depth", "ok")


def _load(spark, sf_dir):
    """Orders as a queue of each customer: enqueued by price, dequeued otherwise."""
    orders = table(spark, sf_dir, "orders").withColumn("change", F.when(F.col("o_totalprice") > 150000, 1).otherwise(-1).cast("bigint"))
    return crawl.queue_depth(orders, ["o_orderkey"], F.col("change"), "o_custkey")


def queue_depth(spark, sf_dir):
    return _load(spark, sf_dir).select("o_orderkey", "o_custkey", "waiting")


def throttle_delay(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 11).alias("waiting"))
    return orders.withColumn("delay_ms", F.round(S.throttle_delay(F.col("waiting"), F.lit(10)) * 1000).cast("bigint"))


def fetch_schedule(spark, sf_dir):
    """Each customer's orders as a host's pages, five a second."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return crawl.fetch_schedule(orders, ["o_orderkey"], 5.0, "o_custkey")


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("throttle: "), F.col("event_id"))).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id")))
    return e.select(
        F.col("user_id").alias("crawler_id"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), message.alias("message"), "event_type", (F.col("event_type") == "error").alias("failed")
    )


def _states(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "signup", "initializing").otherwise("running")
    return status.snapshots(_events(spark, sf_dir), state)


def state_snapshot(spark, sf_dir):
    s = _states(spark, sf_dir)
    return s.select("crawler_id", "state", "updated_at", "pages_processed", "pages_indexed", "pages_failed", F.element_at("logs", -1).alias("last_log"), F.size("logs").cast("bigint").alias("n_logs"))


def effective_state(spark, sf_dir):
    s = _states(spark, sf_dir)
    return s.select("crawler_id", S.effective_state(F.col("state"), F.col("updated_at"), F.col("crawler_id") % 3 == 0, F.lit(NOW)).alias("state"))


def back_pressure_status(spark, sf_dir):
    return _states(spark, sf_dir).select("crawler_id", S.back_pressure(F.col("logs")).alias("back_pressure"), S.back_pressure(F.slice("logs", 1, 3)).alias("at_start"))


def job_history(spark, sf_dir):
    s = _states(spark, sf_dir).withColumns({"origin": F.lit(None).cast("string"), "queue_size": F.lit(None).cast("bigint")})
    return status.history(s)


def state_scan(spark, sf_dir):
    """Snapshots as a folder of one JSON file a job, read again."""
    path, logs = lineage.folder(spark, "states"), F.col("logs")
    states = _states(spark, sf_dir).withColumns({"crawler_id": F.col("crawler_id").cast("string"), "logs": S.tail(logs, S.LOG_TAIL)})
    # Small rows, but a file each: all cores write, and each task commits its own.
    states = states.repartition(4 * spark.sparkContext.defaultParallelism)
    states.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
    return status.history(files.read_states(spark, path))


def crawler_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.crawler_id(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("user_id")).alias("crawler_id"))


def lenient_numbers(spark, sf_dir):
    """Whole numbers, fractions and words as text."""
    key = F.col("o_orderkey")
    said = F.when(key % 3 == 0, F.col("o_orderstatus")).when(key % 3 == 1, key.cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.whole(said).alias("number"))


def latest_job(spark, sf_dir):
    return status.latest(_states(spark, sf_dir))


def poll_delta(spark, sf_dir):
    d = status.poll_delta(_states(spark, sf_dir), NOW - 86400, 40, NOW)
    return d.select("crawler_id", "state", "log_count", "done", "back_pressure", "changed", F.size("new_logs").cast("bigint").alias("n_new"), F.element_at(F.concat("new_logs", F.array(F.lit(""))), 1).alias("first_new"))


def incremental_append(spark, sf_dir):
    both = index.incremental(*(_index(spark, sf_dir, f"doc_id % 2 = {k}") for k in range(2)))
    return both.groupBy("word").agg(F.count("*").alias("n_rows"), F.sum("frequency").alias("total_frequency"))


_NAMES = (
    tokenize, build_inverted_index, bucket_word, shard_stats, parse_query, term_filter, valid_postings, bucket_pruned_lookup, search_triples, search_frequency, search_relevance, search_page, search_page_past_end,
    first_origin, search_all_terms, document_frequency, html_tokens, extract_links, normalize_url, fetch_outcome, crawl_counters, visited_dedupe, bfs_depth, bfs_max_pages, bfs_visited, queue_depth, throttle_delay,
    fetch_schedule, state_snapshot, effective_state, back_pressure_status, job_history, latest_job, poll_delta, incremental_append, shard_scan, shard_lookup,
    search_request, visited_load, streamed_index, state_scan, crawler_ids, lenient_numbers,
    search_tfidf, search_snippets, search_updates, search_top_changes, segment_replay, visited_claims, robots_allowed, stream_segments, document_upsert, canonical_urls, search_json,
)
QUERIES = {f.__name__: f for f in _NAMES}

# SQL

_TOKENS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')"
_IDX = f"""idx AS (SELECT lower(w) AS word, doc_id, source AS origin_url, 'doc/' || doc_id AS url, CAST(doc_id % 7 AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS frequency,
  CASE WHEN regexp_matches(lower(w), '^[a-z]') THEN lower(w)[1] WHEN regexp_matches(w, '^[0-9]') THEN 'num' ELSE 'other' END AS bucket
  FROM (SELECT doc_id, source, unnest({_TOKENS}) AS w FROM documents) GROUP BY ALL)"""
_IN = "word IN (" + ", ".join(f"'{t}'" for t in TERMS) + ")"
#: The order in which documents arrive.
_ARRIVAL = f"(doc_id % {BATCHES}) || printf('%020d', doc_id)"
_HIT = f"""{_IDX}, hit AS (SELECT url, arg_min(origin_url, bucket || '/' || {_ARRIVAL}) AS origin_url, min(depth) AS depth, CAST(sum(frequency) AS BIGINT) AS frequency,
  CAST(sum(frequency) * 10 + 1000 - min(depth) * 5 AS BIGINT) AS relevance_score FROM idx WHERE {_IN} AND origin_url <> '' GROUP BY url)"""
_REL, _FREQ = "relevance_score DESC, frequency DESC, depth, url", "frequency DESC, depth, url"

_RESULT = "url, arg_min(origin_url, bucket || '/' || batch || printf('%020d', doc_id)) AS origin_url, min(depth) AS depth, CAST(sum(frequency) AS BIGINT) AS frequency, CAST(sum(frequency) * 10 + 1000 - min(depth) * 5 AS BIGINT) AS relevance_score FROM pages_idx"
_AGAIN = f"""{_IDX}, pages_idx AS (SELECT * REPLACE ('page/' || (doc_id % {AGAIN}) AS url), doc_id % {BATCHES} AS batch FROM idx WHERE {_IN} AND origin_url <> ''),
was AS (SELECT {_RESULT} WHERE batch < {BATCHES - 1} GROUP BY url), now AS (SELECT {_RESULT} GROUP BY url)"""


def _page_sql(page: int) -> str:
    return f"""WITH {_HIT}, r AS (SELECT *, row_number() OVER (ORDER BY {_REL}) AS rank, count(*) OVER () AS total FROM hit),
p AS (SELECT *, CAST(ceil(total / {SIZE}.0) AS BIGINT) AS total_pages, CAST(least({page}, ceil(total / {SIZE}.0)) AS BIGINT) AS page FROM r)
SELECT rank, url, relevance_score, page, CAST({SIZE} AS BIGINT) AS page_size, total, total_pages, page > 1 AS has_prev, page < total_pages AS has_next FROM p WHERE rank > (page - 1) * {SIZE} AND rank <= page * {SIZE}"""


_LINKS = """l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
links AS (SELECT url, CAST(pos AS BIGINT) AS pos, replace(h, '&amp;', '&') AS href, regexp_replace(regexp_replace(regexp_extract(url, '^(https?://[^/]+)', 1) || replace(h, '&amp;', '&'), '#.*$', ''), '\\?$', '') AS target FROM l)"""
_FETCH = f"{_LINKS}, fetched AS (SELECT DISTINCT u AS url, u IN (SELECT url FROM pages WHERE html IS NOT NULL) AS ok FROM (SELECT target AS u FROM links UNION ALL SELECT url FROM pages))"
_EDGES = "e AS (SELECT o_custkey AS src, o_orderkey AS pos, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders)"
_WORDS = """t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, 'var t="</p>"', 'var t=" p "'), '<!--.*?-->', ' ', 'gs'), '<[^<>]*>', ' ', 'g'), '&(copy|middot|quot|nbsp|lt|gt);', ' ', 'g'), '&amp;?', ' ', 'g') AS x FROM pages),
words AS (SELECT page_id, lower(w) AS word, CAST(count(*) AS BIGINT) AS frequency FROM (SELECT page_id, unnest(regexp_extract_all(x, '[A-Za-z0-9]+')) AS w FROM t) GROUP BY ALL)"""
_STATES = f"""ev AS (SELECT user_id AS crawler_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, CASE WHEN event_type = 'error' THEN 'throttle: ' || event_id ELSE event_type || ' ' || event_id END AS message FROM events),
st AS (SELECT crawler_id, CASE arg_max(event_type, seq) WHEN 'purchase' THEN 'finished' WHEN 'signup' THEN 'initializing' ELSE 'running' END AS state, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS pages_processed,
  CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS pages_indexed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS pages_failed, list(message ORDER BY seq)[-500:] AS logs FROM ev GROUP BY crawler_id)"""
_EFFECTIVE = "CASE WHEN state = 'finished' THEN state WHEN {alive} THEN state WHEN " + f"{NOW} - updated_at > 20 THEN 'interrupted' ELSE state END"
_PRESSURE = "CASE WHEN len(logs) = 0 THEN 'unknown' WHEN len(list_filter({logs}, lambda x: contains(lower(x), 'throttle:') OR contains(lower(x), 'back-pressure active'))) > 0 THEN 'active' ELSE 'normal' END"

SQL = {
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_transform(t, lambda x: lower(x)))) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "build_inverted_index": f"WITH {_IDX} SELECT word, doc_id, frequency FROM idx",
    "bucket_word": f"WITH {_IDX} SELECT DISTINCT word, bucket FROM idx",
    "shard_stats": f"WITH {_IDX} SELECT bucket, count(*) AS n_rows, count(DISTINCT word) AS n_words, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM idx GROUP BY bucket",
    "parse_query": f"""WITH t AS (SELECT conv_id, turn, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) AS i FROM conversations),
f AS (SELECT conv_id, turn, lower(w) AS term, min(i) AS i FROM t GROUP BY conv_id, turn, lower(w))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS BIGINT) AS pos, term FROM f""",
    "term_filter": f"WITH {_IDX} SELECT word, doc_id, frequency FROM idx WHERE {_IN}",
    "valid_postings": f"WITH {_IDX} SELECT word, doc_id, frequency - 1 AS frequency FROM idx WHERE frequency > 1 AND doc_id % 5 <> 0 AND origin_url <> ''",
    "bucket_pruned_lookup": f"WITH {_IDX} SELECT bucket, word, doc_id, frequency FROM idx WHERE word IN ('thou', '9')",
    "search_triples": f"WITH {_HIT} SELECT row_number() OVER (ORDER BY {_FREQ}) AS rank, url AS relevant_url, origin_url, depth FROM hit",
    "search_frequency": f"WITH {_HIT} SELECT row_number() OVER (ORDER BY {_FREQ}) AS rank, url, origin_url, depth, frequency FROM hit",
    "search_relevance": f"WITH {_HIT} SELECT row_number() OVER (ORDER BY {_REL}) AS rank, url, origin_url, depth, frequency, relevance_score FROM hit",
    "search_page": _page_sql(PAGE),
    "search_page_past_end": _page_sql(1_000_000),
    "first_origin": f"""WITH {_IDX} SELECT coalesce(lang, 'none') AS url, arg_min(origin_url, bucket || '/' || {_ARRIVAL.replace("doc_id", "idx.doc_id")}) AS origin_url, min(depth) AS depth, CAST(sum(frequency) AS BIGINT) AS frequency
FROM idx JOIN documents d ON idx.doc_id = d.doc_id WHERE {_IN} AND origin_url <> '' GROUP BY 1""",
    "search_all_terms": f"WITH {_IDX} SELECT url, CAST(sum(frequency) AS BIGINT) AS frequency FROM idx WHERE word IN ('the', 'thou') GROUP BY url HAVING count(DISTINCT word) = 2",
    "document_frequency": f"WITH {_IDX} SELECT word, count(DISTINCT url) AS df, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM idx GROUP BY word",
    "html_tokens": f"WITH {_WORDS} SELECT page_id, word, frequency FROM words",
    "extract_links": f"WITH {_LINKS} SELECT url, pos, href FROM links",
    "normalize_url": f"WITH {_LINKS} SELECT url, pos, target FROM links",
    "fetch_outcome": f"WITH {_FETCH} SELECT url, ok FROM fetched",
    "crawl_counters": f"""WITH {_FETCH} SELECT count(*) AS pages_processed, count(*) FILTER (ok) AS pages_indexed, count(*) FILTER (NOT ok) AS pages_failed,
  (SELECT count(DISTINCT u) FROM (SELECT url AS u FROM fetched UNION ALL SELECT url || '/old' FROM pages WHERE page_id % 3 = 0)) AS visited_count FROM fetched""",
    "visited_dedupe": f"WITH {_LINKS} SELECT DISTINCT target AS url FROM links WHERE target NOT IN (SELECT url FROM pages)",
    "bfs_depth": f"""WITH RECURSIVE {_EDGES}, b(url, k) AS (SELECT min(o_custkey), 0 FROM orders UNION SELECT dst, k + 1 FROM b JOIN e ON src = url WHERE k < 3 AND dst IS NOT NULL)
SELECT url, CAST(min(k) AS INTEGER) AS depth FROM b GROUP BY url""",
    "bfs_max_pages": f"""WITH RECURSIVE {_EDGES}, b(url, k, path) AS (SELECT min(o_custkey), 0, [CAST(0 AS BIGINT)] FROM orders UNION ALL SELECT dst, k + 1, list_append(path, pos) FROM b JOIN e ON src = url WHERE k < 3 AND dst IS NOT NULL),
m AS (SELECT url, min(k) AS k FROM b GROUP BY url), f AS (SELECT b.url, b.k, min(path) AS path FROM b JOIN m ON b.url = m.url AND b.k = m.k GROUP BY b.url, b.k)
SELECT url, CAST(k AS INTEGER) AS depth FROM f QUALIFY row_number() OVER (ORDER BY k, path) <= 40""",
    "bfs_visited": f"""WITH RECURSIVE {_EDGES}, b(url, k) AS (SELECT min(o_custkey), 0 FROM orders HAVING NOT (min(o_custkey) % 5 = 1 AND min(o_custkey) % 10 <> 1)
  UNION SELECT dst, k + 1 FROM b JOIN e ON src = url WHERE k < 3 AND dst IS NOT NULL AND url % 7 <> 2 AND NOT (dst % 5 = 1 AND dst % 10 <> 1))
SELECT url, CAST(min(k) AS INTEGER) AS depth, url % 7 <> 2 AS ok FROM b GROUP BY url""",
    "queue_depth": "SELECT o_orderkey, o_custkey, CAST(sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS waiting FROM orders",
    "throttle_delay": "SELECT o_orderkey, o_orderkey % 11 AS waiting, CAST(CASE WHEN o_orderkey % 11 < 7 THEN 0 ELSE (o_orderkey % 11 - 7) * 80 END AS BIGINT) AS delay_ms FROM orders",
    "fetch_schedule": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS DOUBLE) / CAST(5 AS DOUBLE) AS start_s FROM orders",
    "state_snapshot": f"WITH {_STATES} SELECT crawler_id, state, updated_at, pages_processed, pages_indexed, pages_failed, logs[-1] AS last_log, CAST(len(logs) AS BIGINT) AS n_logs FROM st",
    "effective_state": f"WITH {_STATES} SELECT crawler_id, {_EFFECTIVE.format(alive='crawler_id % 3 = 0')} AS state FROM st",
    "back_pressure_status": f"WITH {_STATES} SELECT crawler_id, {_PRESSURE.format(logs='logs[-25:]')} AS back_pressure, {_PRESSURE.format(logs='logs[1:3]')} AS at_start FROM st",
    "job_history": f"WITH {_STATES} SELECT crawler_id, '' AS origin, state, updated_at, pages_indexed, CAST(0 AS BIGINT) AS queue_size FROM st",
    "latest_job": f"WITH {_STATES} SELECT crawler_id, updated_at FROM st ORDER BY updated_at DESC, crawler_id DESC LIMIT 1",
    "poll_delta": f"""WITH {_STATES}, p AS (SELECT *, {_EFFECTIVE.format(alive='false')} AS now_state, pages_processed AS log_count, logs[greatest(40 - (pages_processed - len(logs)), 0) + 1:] AS new_logs FROM st)
SELECT crawler_id, now_state AS state, log_count, now_state IN ('finished', 'interrupted', 'unknown') AS done, {_PRESSURE.format(logs='logs[-25:]')} AS back_pressure,
  updated_at > {NOW - 86400} OR log_count > 40 OR now_state IN ('finished', 'interrupted', 'unknown') AS changed, CAST(len(new_logs) AS BIGINT) AS n_new, coalesce(new_logs[1], '') AS first_new FROM p""",
    "incremental_append": f"WITH {_IDX} SELECT word, count(*) AS n_rows, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM idx GROUP BY word",
    "shard_scan": f"WITH {_IDX} SELECT bucket, word, origin_url, url AS current_url, depth, frequency, CAST(0 AS BIGINT) AS ts FROM idx WHERE origin_url <> ''",
    "shard_lookup": f"WITH {_IDX} SELECT bucket, word, url AS current_url, frequency FROM idx WHERE {_IN} AND origin_url <> ''",
    "search_request": f"""WITH {_HIT}, r AS (SELECT *, row_number() OVER (ORDER BY {_FREQ}) AS rank, count(*) OVER () AS total FROM hit),
p AS (SELECT *, CAST(ceil(total / 100.0) AS BIGINT) AS total_pages, CAST(least({PAGE}, ceil(total / 100.0)) AS BIGINT) AS page FROM r)
SELECT url, origin_url, depth, frequency, relevance_score, total, page, CAST(100 AS BIGINT) AS page_size, total_pages, 'frequency' AS sort_by FROM p WHERE rank > (page - 1) * 100 AND rank <= page * 100""",
    "search_tfidf": f"""WITH {_IDX}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT word, count(*) AS df FROM idx WHERE {_IN} GROUP BY word), len AS (SELECT doc_id, len({_TOKENS}) AS length FROM documents),
s AS (SELECT url, CAST(sum(CAST(floor(1000000 * ln(1 + CAST(n AS DOUBLE) / df) * (frequency / sqrt(CAST(length AS DOUBLE)))) AS BIGINT)) AS BIGINT) AS score FROM idx JOIN df USING (word) JOIN len USING (doc_id), n WHERE origin_url <> '' GROUP BY url)
SELECT row_number() OVER (ORDER BY score DESC, url) AS rank, url, score FROM s QUALIFY rank <= 100""",
    "search_snippets": f"""WITH t AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS w FROM documents),
m AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos FROM t) WHERE word IN ('the', 'thou')),
p AS (SELECT doc_id, pos, least(max(CASE word WHEN 'the' THEN pos END) OVER w, max(CASE word WHEN 'thou' THEN pos END) OVER w) AS first, count(CASE word WHEN 'the' THEN 1 END) OVER w AS a, count(CASE word WHEN 'thou' THEN 1 END) OVER w AS b FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, first, pos AS last FROM p WHERE a > 0 AND b > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos - first, first) = 1)
SELECT 'doc/' || doc_id AS url, first, last, array_to_string(w[greatest(first - 5, 0) + 1 : last + 6], ' ') AS snippet FROM r JOIN t USING (doc_id)""",
    "search_updates": f"""WITH {_AGAIN}, old AS (SELECT DISTINCT url FROM pages_idx WHERE batch < {BATCHES - 1}), touched AS (SELECT DISTINCT url FROM pages_idx WHERE batch = {BATCHES - 1})
SELECT url, CASE WHEN url IN (SELECT url FROM old) THEN 'changed' ELSE 'entered' END AS change, origin_url, depth, frequency, relevance_score FROM now WHERE url IN (SELECT url FROM touched)""",
    "search_top_changes": f"""WITH {_AGAIN}, a AS (SELECT url, row_number() OVER (ORDER BY {_REL}) AS old_rank FROM was QUALIFY old_rank <= 50), b AS (SELECT url, row_number() OVER (ORDER BY {_REL}) AS new_rank FROM now QUALIFY new_rank <= 50)
SELECT coalesce(a.url, b.url) AS url, CASE WHEN old_rank IS NULL THEN 'entered' WHEN new_rank IS NULL THEN 'left' ELSE 'moved' END AS change, coalesce(old_rank, 0) AS old_rank, coalesce(new_rank, 0) AS new_rank FROM a FULL JOIN b ON a.url = b.url WHERE a.old_rank IS DISTINCT FROM b.new_rank""",
    "segment_replay": f"""WITH {_IDX}, ends AS (SELECT lower(w) AS word, doc_id, max(pos) AS last FROM (SELECT doc_id, unnest({_TOKENS}) AS w, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM documents) GROUP BY ALL)
SELECT word, count(*) AS n_rows, CAST(sum(frequency) AS BIGINT) AS total_frequency, CAST(sum(last) AS BIGINT) AS last_positions FROM idx JOIN ends USING (word, doc_id) GROUP BY word""",
    "visited_claims": f"""WITH {_LINKS}, c AS (SELECT url, 0 AS k FROM pages WHERE url IS NOT NULL UNION ALL SELECT target, CASE WHEN pos % 2 = 0 THEN 1 ELSE 2 END FROM links WHERE target IS NOT NULL)
SELECT url, ['pages', 'first', 'second'][min(k) + 1] AS claim FROM c GROUP BY url""",
    "robots_allowed": f"""WITH {_LINKS}, u AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM links WHERE target IS NOT NULL),
p AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS rest FROM u),
f AS (SELECT url, host, CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS path FROM p),
r AS (SELECT DISTINCT host, page_id % 2 = 0 AS allow, page_id % 3 AS k, CASE page_id % 3 WHEN 0 THEN path[1:4] WHEN 1 THEN path[1:7] ELSE right(path, 2) END AS x FROM pages JOIN f USING (url) WHERE NOT contains(path, '*') AND NOT contains(path, '$')),
m AS (SELECT url, length(x) + CASE k WHEN 2 THEN 3 ELSE 0 END AS n, allow FROM f JOIN r USING (host) WHERE CASE k WHEN 2 THEN ends_with(path, x) AND length(path) > length(x) ELSE starts_with(path, x) END)
SELECT url, coalesce(arg_max(allow, n * 2 + CAST(allow AS INTEGER)), true) AS allowed FROM f LEFT JOIN m USING (url) GROUP BY url""",
    "stream_segments": f"WITH {_WORDS} SELECT word, count(*) AS n_pages, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM words GROUP BY word",
    "document_upsert": """WITH d AS (SELECT doc_id AS k, source AS title, coalesce(text, '') AS t FROM documents),
u AS (SELECT k, title, CASE WHEN k % 5 = 4 OR k % 7 = 1 AND k % 10 = 9 THEN t || ' again' ELSE t END AS text, CASE WHEN k % 5 = 4 THEN 200 ELSE 100 END AS fetched_at FROM d WHERE k % 10 <> 9 OR k % 5 = 4)
SELECT CAST(k AS VARCHAR) AS doc_id, 'doc/' || k AS url, title, text, CAST(fetched_at AS BIGINT) AS fetched_at, sha256(text) AS content_hash, CAST(length(text) AS INTEGER) AS length FROM u""",
    "canonical_urls": """WITH p AS (SELECT DISTINCT doc_id % 13 AS h, doc_id % 17 AS x, doc_id % 5 AS b, doc_id % 3 AS a, concat_ws('/', doc_id % 13, doc_id % 17, CASE WHEN doc_id % 13 % 2 = 0 THEN doc_id % 3 ELSE 0 END) AS content FROM documents),
g AS (SELECT h, 'a' AS name, count(DISTINCT content) AS n FROM p GROUP BY h, x, b HAVING count(DISTINCT a) > 1 UNION ALL SELECT h, 'b', count(DISTINCT content) FROM p GROUP BY h, x, a HAVING count(DISTINCT b) > 1),
n AS (SELECT h, name FROM g GROUP BY h, name HAVING count(*) FILTER (n = 1) >= 2 AND count(*) FILTER (n > 1) = 0),
q AS (SELECT DISTINCT h, x, a, b, (h, 'a') IN (SELECT (h, name) FROM n) AS no_a, (h, 'b') IN (SELECT (h, name) FROM n) AS no_b FROM p)
SELECT 'http://H' || h || '.example/p' || x || '?b=' || b || '&a=' || a AS url,
  'http://h' || h || '.example/p' || x || CASE WHEN no_a AND no_b THEN '' WHEN no_a THEN '?b=' || b WHEN no_b THEN '?a=' || a ELSE '?a=' || a || '&b=' || b END AS canonical FROM q""",
    "search_json": f"WITH {_HIT} SELECT url, CAST(to_json(struct_pack(url := url, origin_url := origin_url, depth := depth, frequency := frequency, relevance_score := relevance_score)) AS VARCHAR) AS row FROM hit",
    "visited_load": f"WITH {_LINKS} SELECT target AS url FROM links WHERE target IS NOT NULL UNION SELECT url FROM pages",
    "streamed_index": f"WITH {_WORDS} SELECT word, count(*) AS n_pages, CAST(sum(frequency) AS BIGINT) AS total_frequency FROM words GROUP BY word",
    "state_scan": f"WITH {_STATES} SELECT CAST(crawler_id AS VARCHAR) AS crawler_id, '' AS origin, state, updated_at, CAST(pages_indexed AS INTEGER) AS pages_indexed, CAST(0 AS INTEGER) AS queue_size FROM st",
    "crawler_ids": "SELECT event_id, '[' || CAST(floor(epoch(ts)) AS BIGINT) || '_' || user_id || ']' AS crawler_id FROM events",
    "lenient_numbers": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS number FROM orders",
}
