"""Requests of hosts that are spaced, tried again, and allowed."""

import random
import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators import index, job, robots
from webloom.sources import web


class Clock:
    def __init__(self, at):
        self.at = at

    def __call__(self):
        return self.at

    def sleep(self, s):
        self.at += s


def test_turns_of_hosts():
    """A host's parts never ask within its delay, whenever their tasks start; other hosts don't wait for it; failures come again later, then less often."""
    rnd, asked = random.Random(3), []
    urls = {s: [(f"http://big/{s}/{k}", "big", s, 3) for k in range(30)] for s in range(3)}
    for s in range(3):
        clock = Clock(1000 + rnd.random() * 20)
        failing = {f"http://big/{s}/7": 2, f"http://big/{s}/9": 99}

        def get(u):
            asked.append((clock.at, u))
            clock.at += rnd.random() * 0.2
            failing[u] = failing.get(u, 0) - 1
            return (None, "status 503") if failing[u] >= 0 else ("page", None)

        mine = urls[s] + [(f"http://small{k}/", f"small{k}", 0, 1) for k in range(5)]
        out = {u: (h, n) for u, h, _, n in web.polite(mine, get, 0.0, 0.55, 3, 2.0, clock, clock.sleep)}
        assert len(out) == len(mine) and out[f"http://big/{s}/7"] == ("page", 3) and out[f"http://big/{s}/9"] == (None, 4) and out[f"http://big/{s}/1"] == ("page", 1)
        tries = [t for t, u in asked if u == f"http://big/{s}/9"]
        assert all(2 * 2**k <= b - a <= 4 * 2**k + 2 for k, (a, b) in enumerate(zip(tries, tries[1:])))
    big = sorted(t for t, u in asked if "big" in u)
    assert min(b - a for a, b in zip(big, big[1:])) > 0.5 and len(big) == 3 * (30 + 2 + 3)
    assert web.lasting("status 404") and web.lasting("HTTPError: HTTP Error 404: x") and not any(map(web.lasting, ("HTTPError: HTTP Error 503: x", "HTTPError: HTTP Error 429: x", "URLError: y")))


@pytest.fixture
def server():
    asked, fails = [], defaultdict(int)
    pages = {"/": "<a href=/a>a</a><a href=/b>b</a><a href=/secret/x>c</a><a href=/gone>d</a> ", "/a": "alpha ", "/b": "beta ", "/secret/x": "hidden ", "/robots.txt": "User-agent: *\nDisallow: /secret\nAllow: /secret/y\n"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.time(), self.headers["Host"], self.path))
            fails[self.path] += 1
            code = 503 if self.path == "/b" and fails["/b"] <= 2 else 200 if self.path in pages else 404
            self.send_response(code)
            self.end_headers()
            self.wfile.write(pages.get(self.path, "no").encode())

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_port, asked
    s.shutdown()


def test_fetches_are_spaced(spark, server, monkeypatch):
    """Two hosts, one in several tasks: no two requests of a host within the delay, and both hosts side by side."""
    port, asked = server
    monkeypatch.setattr(web, "EACH", 4)
    urls = [f"http://{h}:{port}/{k}" for h, n in (("127.0.0.1", 12), ("localhost", 5)) for k in range(n)]
    got = web.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), rate=0, parts=6, host_delay=0.6).collect()
    assert sorted(r.url for r in got) == sorted(urls) and {r.tries for r in got} == {1} and len(asked) == 17
    for host in ("127.0.0.1", "localhost"):
        times = sorted(t for t, h, _ in asked if h.startswith(host))
        assert min(b - a for a, b in zip(times, times[1:])) > 0.45


def test_job_with_retries_and_robots(spark, tmp_path, server):
    """A page that fails twice is indexed once; what robots.txt forbids isn't asked for; what can't be had is listed."""
    port, asked = server
    root = f"http://127.0.0.1:{port}"
    places = {"visited_file": f"{tmp_path}/visited", "storage_dir": f"{tmp_path}/index", "state_dir": f"{tmp_path}/states"}
    for _ in range(2):
        _, j = job.start_crawler_job(spark, f"{root}/", 1, hit_rate=0, retries=3, backoff=0.05, robots=True, **places)
        j.join(180)
        assert j.state["state"] == "finished"
        if not (j.state["pages_processed"]):
            break
        assert (j.state["pages_processed"], j.state["pages_indexed"], j.state["pages_failed"]) == (5, 3, 2)
    assert j.state["pages_processed"] == 0
    paths = [p for _, _, p in asked]
    assert sorted(paths) == ["/", "/a", "/b", "/b", "/b", "/gone", "/robots.txt"]
    rows = index.read(spark, places["storage_dir"])
    assert {r.word for r in rows.collect()} == {"a", "b", "c", "d", "alpha", "beta"} and rows.where("word = 'beta'").first().frequency == 1
    dead = {r.url: r.tries for r in spark.read.parquet(f"{places['state_dir']}/_dead").collect()}
    assert dead == {f"{root}/gone": 1, f"{root}/secret/x": 0}


def test_parsing_of_robots():
    text = "# x\nUser-agent: Webloom\nUser-agent: other\nDisallow: /a # y\nallow: b*\n\nUser-Agent: *\nDisallow: /\nSitemap: z\nDisallow:\n"
    assert robots.parse(text, "webloom/0.1") == [(False, "/a"), (True, "/b*")] and robots.parse(text, "mine/1") == [(False, "/")] and robots.parse("", "a") == []


def test_longest_rule(spark):
    """Generated rules and paths against each rule tried on each path."""
    rnd = random.Random(5)
    piece = lambda: "".join(rnd.choice("ab/.*+") for _ in range(rnd.randint(1, 5)))
    rules = [(f"http://h{k % 3}", rnd.random() < 0.5, "/" + piece() + rnd.choice(["", "", "$"])) for k in range(120)]
    urls = [f"http://H{k % 4}/{piece().replace('*', 'a')}{piece().replace('*', 'b')}{rnd.choice(['', '?a=b', '#ab'])}" for k in range(400)] + ["http://h1", "http://h1?a", None]
    got = {r.url: r.allowed for r in robots.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "host string, allow boolean, pattern string")).collect()}
    for u in filter(None, urls):
        host, _, path = u[7:].split("#")[0].replace("?", "/?", 1 if "/" not in u[7:] else 0).partition("/")
        fits = [(len(p), a) for h, a, p in rules if h[7:] == host.lower() and robots.matches(p, "/" + path)]
        assert got[u] == (max(fits)[1] if fits else True), u
    assert len(got) == len(set(filter(None, urls))) and {True, False} == set(got.values())


def test_rules_are_cached(spark, server):
    port, asked = server
    hosts = spark.createDataFrame([(f"http://127.0.0.1:{port}",), ("http://127.0.0.1:9",), ("http://old",)], "host string")
    known = spark.createDataFrame([("http://old", [(True, "/x")], 900), ("http://old", [(False, "/y")], 950), (f"http://127.0.0.1:{port}", [], 10)], "host string, rules array<struct<allow: boolean, pattern: string>>, at bigint")
    got = {r.host: ([tuple(x) for x in r.rules], r.at) for r in robots.cached(hosts, known, F.lit(1000), age=100, rate=0, timeout=1.0).collect()}
    assert got == {"http://old": ([(False, "/y")], 950), f"http://127.0.0.1:{port}": ([(False, "/secret"), (True, "/secret/y")], 1000), "http://127.0.0.1:9": ([(False, "/")], 1000)}
    assert [p for _, _, p in asked] == ["/robots.txt"]
