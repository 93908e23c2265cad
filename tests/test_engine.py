import json

import pytest
from pyspark.sql import functions as F

from webloom.functions import pages as P
from webloom.functions import status as S
from webloom.functions import text as X
from webloom.operators import crawl, index, job, search, status
from webloom.sources import files, web
from webloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_query_terms_and_buckets(spark):
    assert X.query_terms("Quick, zebra QUICK-x1") == ["quick", "zebra", "x1"] and X.query_terms("ü !!") == []
    assert one(spark, X.parse_query(F.lit("Quick, zebra QUICK-x1"))) == ["quick", "zebra", "x1"]
    for w, b in (("apple", "a"), ("Zed", "z"), ("9lives", "num"), ("_x", "other"), ("", "other")):
        assert X.bucket_of(w) == b and one(spark, X.bucket(F.lit(w))) == b
    assert X.BUCKETS.index("n") < X.BUCKETS.index("num") < X.BUCKETS.index("o") < X.BUCKETS.index("other") < X.BUCKETS.index("p")


@pytest.mark.parametrize(
    "html, words, links",
    [
        ("foo<b>bar</b>baz", "foo bar baz", []), ('<script>var q=1;"a&amp;b"</script>x', "var q 1 a amp b x", []), ("<style>p{}</style>y", "p y", []), ("caf&eacute; &amp; t&nbsp;e", "caf t e", []),
        ("<!-- c --> z", "z", []), ("tail AT&T more", "tail at t more", []), ('<a href="x" href="y"/>k', "k", ["x", "y"]), ('<a href="">e', "e", []), ('<a HREF="a&amp;b">q</a>', "q", ["a&b"]),
        ('<area href="z"><link href=q>', "", []), ("Özbekcha İstanbul", "zbekcha stanbul", []), (None, "", []),
    ],
)
def test_page_parsing(html, words, links):
    assert P.words_and_links(html) == (words.split(), links)


def test_urls():
    base = "https://Ex.com/a/b?x=1"
    for href, want in {"#f": base, "": base, "?y=2": "https://Ex.com/a/b?y=2", "c": "https://Ex.com/a/c", "../../../d": "https://Ex.com/d", "/c#z": "https://Ex.com/c", "//h.org/p": "https://h.org/p", "HTTP://FOO.com/": "http://FOO.com/",
                       "http://e.com?": "http://e.com", " /sp ": "https://Ex.com/sp", "/a b": "https://Ex.com/a b", "mailto:a@b": None, "javascript:void(0)": None, "ftp://x/y": None, "http:///x": None, "http://[bad": None}.items():
        assert P.resolve(base, href) == want, href


def test_lenient_shards_and_search(spark, tmp_path):
    lines = [
        {"word": "a", "origin_url": "o", "current_url": "u", "depth": "3", "frequency": 2.0}, {"word": "a", "origin_url": "o", "current_url": "v", "frequency": 4}, {"word": "a", "origin_url": "", "current_url": "w", "frequency": 4},
        {"word": "a", "origin_url": "o", "current_url": "w", "depth": 1}, {"word": "A", "origin_url": "p", "current_url": "x", "depth": 2, "frequency": 4}, {"word": "a", "origin_url": "p", "current_url": "y", "depth": 3, "frequency": 5},
    ]
    (tmp_path / "a.data").write_text("{bad\n\n[1]\n" + "\n".join(map(json.dumps, lines)))
    (tmp_path / "x.data").write_text(json.dumps({"word": "x", "origin_url": "O2", "current_url": "U", "depth": 1, "frequency": 1}))
    (tmp_path / "z.data").write_text(json.dumps({"word": "zel", "origin_url": "O1", "current_url": "U", "depth": 0, "frequency": 2}))
    rows = {(r.word, r.origin_url, r.current_url, r.depth, r.frequency) for r in files.read_shards(spark, str(tmp_path), ["a", "q"]).collect()}
    assert rows == {("a", "o", "u", 3, 2), ("a", "o", "v", 0, 4), ("a", "p", "x", 2, 4), ("a", "p", "y", 3, 5)}
    engine = search.SearchEngine(spark=spark, storage_dir=str(tmp_path))
    assert [r["url"] for r in engine.search_api("a")["results"]] == ["v", "y", "x", "u"]
    assert [r["url"] for r in engine.search_api("a", " Frequency")["results"]] == ["y", "v", "x", "u"]
    assert engine.search_triples("zel x") == [("U", "O2", 0)]
    assert engine.search("!!") == {"query": "!!", "total": 0, "page": 1, "page_size": 20, "total_pages": 0, "results": []}
    assert engine.search_api("none", "odd")["sortBy"] == "relevance" and engine.search_api("", "odd")["sortBy"] == "odd"
    (tmp_path / "visited").write_text(" u \n\nv\nu\n")
    assert sorted(r.url for r in files.read_visited(spark, str(tmp_path / "visited")).collect()) == ["u", "v"]


def test_pages_of_results():
    assert [search.page_bounds(45, p, s) for p, s in ((1, 20), (99, 20), (0, 20), (-5, 20), (1, 0))] == [(1, 20, 3), (3, 20, 3), (1, 20, 3), (1, 20, 3), (1, 1, 45)] and search.page_bounds(0, 4, 20) == (1, 20, 0)
    assert S.clamped("7", 1, 5) == 5 and S.clamped(None, 1, 100, 20) == 20
    with pytest.raises(ValueError):
        S.clamped("x", 1)


EDGES = [("S", 0, "A"), ("S", 1, "B"), ("A", 0, "C"), ("B", 0, "C"), ("B", 1, "S"), ("C", 0, "D")]


@pytest.mark.parametrize(
    "how, want, counts",
    [({}, "S0 A1 B1 C2", (4, 4, 0)), ({"max_pages": 3}, "S0 A1 B1", (3, 3, 0)), ({"visited": ["B"]}, "S0 A1 C2", (3, 3, 0)), ({"failed": ["A"]}, "S0 A1 B1 C2", (4, 3, 1)), ({"visited": ["S"]}, "", (0, 0, 0))],
)
def test_bfs(spark, how, want, counts):
    edges, seeds = spark.createDataFrame(EDGES, "src string, pos int, dst string"), spark.createDataFrame([("S",)], "url string")
    how = {k: spark.createDataFrame([(x,) for x in v], "url string") if isinstance(v, list) else v for k, v in how.items()}
    out = crawl.bfs(edges, seeds, 2, **how)
    assert " ".join(f"{r.url}{r.depth}" for r in out.orderBy("depth", "key").collect()) == want
    c = crawl.counters(out).first()
    assert (c.pages_processed, c.pages_indexed, c.pages_failed) == counts


def test_crawl_of_a_site(spark):
    pages = spark.createDataFrame([("http://s/", '<a href="/a#x">one</a><a href="/gone">t</a> '), ("http://s/a", '<a href="/">x</a> two two ')], "url string, html string")
    reached, rows = crawl.crawl_site(pages, "http://s/", 2)
    assert {(r.url, r.depth, r.ok) for r in reached.collect()} == {("http://s/", 0, True), ("http://s/a", 1, True), ("http://s/gone", 1, False)}
    assert {(r.word, r.current_url, r.depth, r.frequency) for r in rows.collect()} >= {("two", "http://s/a", 1, 2), ("one", "http://s/", 0, 1)}


def test_states(spark):
    now = 1000
    for state, at, alive, want in (("finished", 0, False, "finished"), ("running", 0, True, "running"), ("running", 980, False, "running"), ("running", 979, False, "interrupted"), ("initializing", None, False, "interrupted"), (None, None, False, "unknown")):
        assert one(spark, S.effective_state(F.lit(state).cast("string"), F.lit(at).cast("bigint"), F.lit(alive), F.lit(now))) == want
    logs = lambda xs: F.lit(None).cast("array<string>") if xs is None else F.array(*map(F.lit, xs)).cast("array<string>")
    for xs, want in ((None, "unknown"), ([], "unknown"), (["Throttle: x"] + ["a"] * 25, "normal"), (["a", "throttle: x"] + ["a"] * 24, "active"), (["THROTTLE: x"], "active"), (["a"], "normal")):
        assert one(spark, S.back_pressure(logs(xs))) == want
    for n, want in ((5, 0), (8, 0.08), (9, 0.16), (10, 0.24)):
        assert one(spark, S.throttle_delay(F.lit(n), F.lit(10))) == pytest.approx(want)


def test_poll(spark):
    states = spark.createDataFrame([("j", "running", 95, 3, ["a", "b", "c"])], "crawler_id string, state string, updated_at long, log_count long, logs array<string>")
    r = status.poll_delta(states, 95, 1, 100).first()
    assert (r.new_logs, r.changed, r.done) == (["b", "c"], True, False)
    assert not status.poll_delta(states, 95, 3, 100).first().changed and status.poll_delta(states, 95, 3, 999).first().done


def test_index_is_pruned(spark, tmp_path):
    docs = spark.createDataFrame([("o", "u", 0, "apple Apple 9 zed")], "origin_url string, current_url string, depth int, text string")
    index.write(index.postings(docs, X.tokenize(F.col("text")), F.lit(0)), str(tmp_path / "i"))
    found = index.read(spark, str(tmp_path / "i"), ["apple"])
    assert [(r.word, r.frequency) for r in found.collect()] == [("apple", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(word,apple)" in plan


def test_streaming_matches_batch_and_restarts(spark, tmp_path):
    pages = [("u1", "one two "), ("u2", "two "), ("u1", "one two "), ("u3", None)]
    df = spark.createDataFrame(pages, "url string, html string")
    df.limit(2).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.index_stream(ingest.page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "ix"), str(tmp_path / "cp"), origin="o").awaitTermination()
    run()
    spark.createDataFrame(pages[2:] + [("u4", "two ")], "url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.word, r.current_url, r.frequency) for r in index.read(spark, str(tmp_path / "ix")).collect()}
    assert got == {("one", "u1", 1), ("two", "u1", 1), ("two", "u2", 1), ("two", "u4", 1)}
    assert search.SearchEngine(index.read(spark, str(tmp_path / "ix"))).search("two")["total"] == 3


def test_web_source_without_network(spark):
    assert web.decode(b"\xe9", "latin-1") == "é" and web.decode(b"\xff", "none-such") == "�"
    web.register(spark)
    r = spark.read.format("webpages").option("urls", "http://127.0.0.1:9/ http://[bad").option("rate", 0).load().collect()
    assert len(r) == 2 and all(x.html is None and x.error for x in r)


def test_clear(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    assert index.clear(spark, [str(tmp_path / "d"), str(tmp_path / "none")]) == (True, {str(tmp_path / "d"): 1, str(tmp_path / "none"): 0})


@pytest.fixture
def site():
    """A small web site: two levels, a page that isn't there, a page in another charset."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    pages = {"/": '<a href="/a">one</a><a href="/gone">t</a><a href="/b#x">b</a> ', "/a": '<a href="/">x</a><a href="/deep">y</a> two two ', "/b": "caf\xe9 ", "/deep": "deep "}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            found = pages.get(self.path)
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write((found or "no").encode("latin-1"))

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_crawl_that_fetches(spark, tmp_path, site):
    root, asked = site
    places = {"visited_file": f"{tmp_path}/visited", "storage_dir": f"{tmp_path}/index", "state_dir": f"{tmp_path}/states"}
    name, thread = job.start_crawler_job(spark, f"{root}/", 1, hit_rate=50, queue_capacity=3, **places)
    read = lambda n: job.read_state(spark, places["state_dir"], n)
    thread.join(120)
    got = job.poll_request(read, {"crawler_id": name, "since_log_index": "1"})
    assert (got["state"], got["done"], got["pages_processed"], got["pages_indexed"], got["pages_failed"], got["visited_count"], got["depth_limit"], got["back_pressure"]) == ("finished", True, 4, 3, 1, 4, 1, "active")
    assert got["log_count"] == len(got["new_logs"]) + 1 and any("/gone" in x for x in got["new_logs"])
    state = read(name)
    assert state["visited_pages"] == sorted(f"{root}{p}" for p in ("/", "/a", "/b", "/gone")) and state["queue"] == [] and sorted(asked) == ["/", "/a", "/b", "/gone"]
    assert [(r.crawler_id, r.visited_count) for r in files.read_states(spark, f"{places['state_dir']}/*.data").collect()] == [(name, 4)]
    engine = search.SearchEngine(index.read(spark, places["storage_dir"]))
    assert [(r["url"], r["frequency"], r["depth"]) for r in engine.search_api("two caf")["results"]] == [(f"{root}/a", 2, 1), (f"{root}/b", 1, 1)]
    # Again: nothing is fetched a second time, and max_pages holds.
    _, again = job.start_crawler_job(spark, f"{root}/", 2, hit_rate=0, **places)
    again.join(60)
    assert again.state["pages_processed"] == 0 and len(asked) == 4 and not job.alive(again.crawler_id)
    _, few = job.start_crawler_job(spark, f"{root}/", 3, hit_rate=0, max_pages=2, visited_file=f"{tmp_path}/v2", storage_dir=f"{tmp_path}/i2", state_dir=places["state_dir"])
    few.join(60)
    assert few.state["visited_pages"] == [f"{root}/", f"{root}/a"] and any("max_pages" in x for x in few.state["logs"])


def test_crawl_that_dies(spark, tmp_path, site, monkeypatch):
    """A job that can't write its index fails by state; what it had claimed is fetched and indexed by the next one, and counts once."""
    root, asked = site
    places = {"visited_file": f"{tmp_path}/visited", "storage_dir": f"{tmp_path}/index", "state_dir": f"{tmp_path}/states"}
    with monkeypatch.context() as m:
        m.setattr(job.Segments, "append_pages", lambda *a, **b: 1 / 0)
        name, dead = job.start_crawler_job(spark, f"{root}/", 1, hit_rate=0, **places)
        dead.join(60)
    got = job.poll_request(lambda n: job.read_state(spark, places["state_dir"], n), {"crawler_id": name})
    assert (got["state"], got["done"], got["pages_indexed"]) == ("failed", True, 0) and "ZeroDivisionError" in got["new_logs"][-1]
    assert [b["n"] for b in dead.visited.pending()] == [1]
    _, again = job.start_crawler_job(spark, f"{root}/b", 0, hit_rate=0, **places)
    again.join(120)
    assert again.state["state"] == "finished" and not again.visited.pending() and sorted(asked) == ["/", "/", "/a", "/b", "/gone"]
    rows = index.read(spark, places["storage_dir"])
    assert {(r.origin_url, r.current_url, r.depth) for r in rows.collect()} == {(f"{root}/", f"{root}{p}", d) for p, d in (("/", 0), ("/a", 1), ("/b", 1))}
    assert rows.where("word = 'two'").first().frequency == 2
    assert again.state["pages_processed"] == again.state["pages_indexed"] + again.state["pages_failed"] == 4


def test_two_crawls_at_once(spark, tmp_path, site):
    """Two jobs on the same visited URLs fetch no page twice; data aren't cleared while they run."""
    root, asked = site
    places = {"visited_file": f"{tmp_path}/visited", "storage_dir": f"{tmp_path}/index", "state_dir": f"{tmp_path}/states"}
    jobs = [job.start_crawler_job(spark, f"{root}/", 2, hit_rate=0, **places)[1] for _ in range(2)]
    assert index.clear(spark, [str(tmp_path)]) == (False, {})
    for j in jobs:
        j.join(180)
    assert sorted(asked) == ["/", "/a", "/b", "/deep", "/gone"] and {j.state["state"] for j in jobs} == {"finished"}
    assert sum(j.state["pages_processed"] for j in jobs) == 5 and index.read(spark, places["storage_dir"]).where("word = 'two'").count() == 1


def test_all_failures_are_lines(spark, tmp_path, monkeypatch):
    """A level with more failures than the log holds: all are counted, the last are held, and a client gets each held line once."""
    n = 620
    places = (f"{tmp_path}/visited", f"{tmp_path}/index", f"{tmp_path}/states")
    j = job.Job(spark, "http://127.0.0.1:9/", 0, 0, 10, None, places, 1.0)
    level = spark.range(n).select(F.concat(F.lit("http://127.0.0.1:9/"), "id").alias("url"), F.array("id").alias("key"))
    mine, k = j.visited.claim(level, "x", {"job": "x"})
    j._level(mine, {"name": "x", "n": k}, "o", 0)
    assert (j.state["pages_failed"], j.state["log_count"], len(j.state["logs"])) == (n, n + 1, 500) and j.state["logs"][-1].split()[3] == f"http://127.0.0.1:9/{n - 1}:"
    ask = lambda at: job.poll_request(lambda i: j.state, {"crawler_id": "x", "since_log_index": str(at), "since_updated": "9999999999", "timeout": "1"}, lambda i: True, pause=0.05)
    assert len(ask(0)["new_logs"]) == 500 and ask(n - 1)["new_logs"] == j.state["logs"][-2:] and ask(n + 1)["new_logs"] == []
    j._say("one more")
    j._save()
    assert ask(n + 1)["new_logs"] == j.state["logs"][-1:] and ask(n + 1)["log_count"] == n + 2


def test_requests(spark):
    with pytest.raises(ValueError):
        job.poll_request(lambda n: None, {})
    with pytest.raises(ValueError):
        job.start_request(spark, {"origin": " "})
    assert job.poll_request(lambda n: None, {"crawler_id": "x", "timeout": "0"}, pause=0.1) == {"crawler_id": "x", "state": "unknown", "done": True, "new_logs": [], "log_count": 0}
    old = {"state": "running", "updated_at": 5, "logs": ["a"]}
    assert job.poll_request(lambda n: old, {"crawler_id": "x"}, lambda n: False)["state"] == "interrupted"
    late = job.poll_request(lambda n: old, {"crawler_id": "x", "timeout": "1", "since_updated": "5", "since_log_index": "1"}, lambda n: True, pause=0.1)
    assert (late["state"], late["new_logs"], late["log_count"], late["done"]) == ("running", [], 1, False)
    rows = spark.createDataFrame([("w", "o", f"u{k:03}", 0, 1) for k in range(150)], "word string, origin_url string, current_url string, depth int, frequency bigint")
    engine = search.SearchEngine(rows.withColumn("bucket", X.bucket(F.col("word"))))
    ask = lambda **a: engine.request(a)
    assert (ask(query="w", page_size="900")["page_size"], ask(query="w", page="99")["page"], len(ask(query="w", page="99")["results"])) == (100, 8, 10)
    assert ask(q=" w ")["total"] == 150 and ask()["results"] == [] and ask(query="w", sortBy="Frequency")["sortBy"] == "frequency"
    assert engine.search("w", 600, 100) == engine.search("w", 2, 100) and engine.search("none")["total_pages"] == 0
    with pytest.raises(ValueError):
        ask(query="w", page="x")


def test_numbered_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("url"))
    keys = [F.desc("k"), F.asc("url")]
    got = {(r.url, r.rank, r.total) for r in search.numbered(rows.repartition(5), keys).collect()}
    assert got == {(u, i + 1, 1000) for i, (_, u) in enumerate(sorted((-(x % 7), str(x)) for x in range(1000)))}
    assert search.numbered(rows.where("k < 0"), keys).count() == 0


def test_shards_are_appended(spark, tmp_path):
    docs = spark.createDataFrame([("o", "u1", 0, "Apple 9lives apple \u212a"), ("o", "u2", 1, None), (None, "u3", 1, "apple")], "origin_url string, current_url string, depth int, text string")
    rows = index.postings(docs, X.tokenize(F.col("text")), F.lit(7))
    for _ in range(2):
        files.append_shards(rows, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith((".", "_"))) == ["a.data", "num.data"]
    # The Kelvin sign isn't an ASCII letter; a row without origin isn't valid.
    got = sorted((r.word, r.origin_url, r.current_url, r.frequency) for r in files.read_shards(spark, str(tmp_path)).collect())
    assert got == [("9lives", "o", "u1", 1)] * 2 + [("apple", "o", "u1", 2)] * 2


def test_occurrences_are_the_terms_of_all_words(spark):
    texts = ["The the-then THE9 9 the", "ethe \u212athe the\u0130the", "", None, "_the_9.9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = rows.select(F.filter(X.tokenize(F.col("t")), lambda w: w.isin("the", "9")).alias("x")).collect()
    assert rows.select(X.occurrences(F.col("t"), ["the", "9"]).alias("x")).collect() == want
    assert rows.select(X.occurrences(F.col("t"), ["!"]).alias("x")).collect() == [([],)] * 5
