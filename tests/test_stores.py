"""Document store, URLs of one form, streams over shared tables, and their metrics."""

import random
from collections import defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from webloom.operators import canonical, index
from webloom.operators.store import DocumentStore
from webloom.sources.visited import Visited
from webloom.streaming import ingest, metrics

DOC = "doc_id string, url string, title string, text string, fetched_at long"


def test_upsert_rewrites_touched_buckets(spark, tmp_path):
    """The same rows as a merge; other buckets keep their folders, a reader its version, and writers at once all count."""
    rnd, s, want = random.Random(2), DocumentStore(spark, str(tmp_path), buckets=16), {}
    put = lambda rows, to=s: to.upsert(spark.createDataFrame(rows, DOC))

    def merged(rows):
        for r in rows:
            if r[0] is not None and (r[0] not in want or r[4] >= want[r[0]][4]):
                want[r[0]] = r

    first = [(f"d{k}", f"u{k}", None, f"text {k}" if k % 5 else None, 10) for k in range(200)] + [(None, "u", "t", "x", 1)]
    assert put(first) == list(range(16))
    merged(first)
    before, reader = s.manifests.load()["folders"], s.read()
    second = [("d3", "u3", "new", "other", 20), ("d4", "u4", "old", "older", 5), ("x", None, None, None, 7), ("d3", "u3", "mid", "between", 15)]
    touched = put(second)
    merged(sorted(second, key=lambda r: r[4]))
    after = s.manifests.load()["folders"]
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before[b]} == set(map(str, touched)) and reader.count() == 200
    commit, other = s.manifests.commit, DocumentStore(spark, str(tmp_path))

    def late(change):
        s.manifests.commit = commit
        put([("d3", "u3", "theirs", "theirs", 30), ("y", "u", "t", "t", 1)], other)
        return commit(change)

    s.manifests.commit = late
    third = [(f"d{rnd.randint(0, 150)}", "again", "t", f"t{k}", 25) for k in range(3)] + [("d3", "u3", "mine", "mine", 29)]
    third = list({r[0]: r for r in third}.values())
    put(third)
    merged([*third, ("d3", "u3", "theirs", "theirs", 30), ("y", "u", "t", "t", 1)])
    got = {r.doc_id: (r.doc_id, r.url, r.title, r.text, r.fetched_at) for r in s.read().collect()}
    assert got == {i: (*r[:3], r[3] or "", r[4]) for i, r in want.items()} and s.read(1).count() == 200
    assert {r.doc_id for r in s.get(["d7", "none", "x"]).collect()} == {"d7", "x"} and put([]) == []


def test_neutral_parameters(spark):
    """What is learned, against each pair of a host's pages that differ in one parameter."""
    rnd, rows = random.Random(4), []
    for _ in range(900):
        h, path = rnd.randint(0, 3), rnd.randint(0, 4)
        ps = {n: str(rnd.randint(0, 2)) for n in ("id", "ref", "sid", "v") if rnd.random() < 0.6}
        said = [f"{n}={v}" for n, v in ps.items()]
        rnd.shuffle(said)
        content = (path, ps.get("id"), ps.get("v") if h % 2 else None, ps.get("ref") if h == 3 else None)
        rows.append((f"http://H{h}.x/{path}{'?' if said else ''}{'&'.join(said)}{rnd.choice(['', '#f'])}", str(content) if rnd.random() < 0.97 else None))
    rows += [(None, "c"), ("nonsense", "c"), ("http://h9.x?a&a&b", "c")]
    pages = spark.createDataFrame(rows, "url string, html string")
    known, groups = [(u, c) for u, c in rows if u and c and "://" in u], defaultdict(list)
    for u, c in known:
        p = urlsplit(u)
        ps = tuple(sorted(x for x in p.query.split("&") if x))
        for n in ("id", "ref", "sid", "v", "a", "b"):
            groups[p.hostname, n, p.path, tuple(x for x in ps if x.split("=")[0] != n)].append((tuple(x for x in ps if x.split("=")[0] == n), c))
    votes = defaultdict(lambda: [0, 0])
    for (h, n, *_), g in groups.items():
        if len({x for x, _ in g}) > 1 and any(x for x, _ in g):
            votes[h, n][len({c for _, c in g}) > 1] += 1
    want = {k for k, (same, other) in votes.items() if same >= canonical.SUPPORT and not other}
    dropped = canonical.neutral(pages, F.col("html"))
    assert {(r.host.removeprefix("http://"), r.parameter) for r in dropped.collect()} == want and {n for _, n in want} == {"ref", "sid", "v"}
    got = {r.url: r.canonical for r in canonical.canonical(pages, dropped).collect()}
    for u, _ in rows:
        if u and "://" in u:
            p = urlsplit(u)
            ps = sorted(x for x in p.query.split("&") if x and (p.hostname, x.split("=")[0]) not in want)
            assert got[u] == f"http://{p.hostname}{p.path or '/'}{'?' if ps else ''}{'&'.join(ps)}"
    assert got["nonsense"] == "nonsense" and len(got) == len({u for u, _ in rows if u})


def test_stream_shares_visited_urls(spark, tmp_path):
    """A stream leaves out what a crawl has claimed, counts a batch that died and came again once, and its progress is rows."""
    pages = [("u1", "one two "), ("u2", "two "), ("u1", "one two "), ("u3", None), ("seen", "no ")]
    level = spark.createDataFrame([("seen", [0])], "url string, key array<bigint>")
    Visited(spark, str(tmp_path / "v")).claim(level, "crawl", {"job": "x"})
    for k, part in enumerate((pages[:2], pages[2:], [("u4", "two "), ("u2", "two ")])):
        spark.createDataFrame(part, "url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = metrics.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    run = lambda: ingest.segment_stream(ingest.page_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "ix"), str(tmp_path / "v"), str(tmp_path / "cp"), "o")
    append, died = ingest.Segments.append_pages, []

    def dies(self, rows, name, *a):
        out = append(self, rows, name, *a)
        if not died and name.endswith("-1"):
            died.append(name)
            raise RuntimeError("lost after the index, before the claim was done")
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ingest.Segments, "append_pages", dies)
        with pytest.raises(Exception, match="lost after"):
            run().awaitTermination()
        query = run()
        query.awaitTermination()
    assert not Visited(spark, str(tmp_path / "v")).batches()[-1]["pending"] and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == ingest_store(spark)
    got = sorted((r.word, r.current_url, r.frequency) for r in index.read(spark, str(tmp_path / "ix")).collect())
    assert got == [("one", "u1", 1), ("two", "u1", 1), ("two", "u2", 1), ("two", "u4", 1)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(log)
    rows = metrics.read_progress(spark, str(tmp_path / "log"))
    mine = {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
    assert {r.batch: r.input_rows for r in rows.where(F.col("run_id") == str(query.runId)).collect()} == mine and sum(mine.values()) >= 2
    assert "lost after" in "".join(r.error or "" for r in rows.collect())


def ingest_store(spark):
    with ingest.on_disk(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    return spark.conf.get("spark.sql.streaming.stateStore.providerClass")
