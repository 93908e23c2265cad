"""Stored index: segments, ranking by block bounds, snippets, updates, claims of URLs, appended shards."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.operators import index, ranking, search
from webloom.operators.segments import Segments
from webloom.sources import files, manifests
from webloom.sources.visited import Visited

DOCS = "origin_url string, current_url string, depth int, seq long, text string"


def append(s, rows, name):
    return s.append(s.spark.createDataFrame(rows, DOCS), X.tokenize(F.col("text")), name, F.lit(0))


def words(s, **how):
    return sorted((r.word, r.current_url or "", r.frequency) for r in s.read(**how).collect())


def test_batches_count_once(spark, tmp_path, monkeypatch):
    """A batch that dies before its commit, and one that comes twice, count as if they had come once; readers keep their version."""
    s = Segments(spark, str(tmp_path))
    one, two = [("o", "u1", 0, 1, "b a b"), ("o", "u2", 1, 2, None)], [("p", "u3", 0, 3, "a"), (None, None, None, None, "a")]
    assert append(s, one, "one") == 1
    reader = s.read()
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", lambda change: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            append(s, two, "two")
    assert words(s) == [("a", "u1", 1), ("b", "u1", 2)] and s.version() == 1
    assert s.recover() == 0 and s.recover(-60) == 3  # the lease, then its three tables
    for _ in range(2):
        assert append(s, two, "two") == 2
    first = [("a", "u1", 1), ("b", "u1", 2)]
    assert words(Segments(spark, str(tmp_path))) == sorted([*first, ("a", "u3", 1), ("a", "", 1)])
    assert words(s, version=1) == first and reader.count() == 2 and words(s, version=2, since=1) == [("a", "", 1), ("a", "u3", 1)]
    assert append(s, [], "empty") == 3 and s.read(3, since=2).count() == 0 and index.read(spark, str(tmp_path), ["b"]).count() == 1
    assert {r.positions for r in s.read().where("word = 'b'").select(F.concat_ws(",", "positions").alias("positions")).collect()} == {"0,2"}
    assert search.SearchEngine(index.read(spark, str(tmp_path))).search("a")["total"] == 2


def test_two_writers_of_versions(spark, tmp_path):
    """Writers at once make a version each, and all changes are in the last."""
    from concurrent.futures import ThreadPoolExecutor

    m = [manifests.Manifests(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: [m[k].commit(lambda last: {"seen": [*last.get("seen", []), (k, j)]}) for j in range(5)], range(4)))
    last = m[0].load()
    assert last["version"] == 20 and sorted(map(tuple, last["seen"])) == [(k, j) for k in range(4) for j in range(5)] and m[0].versions() == list(range(1, 21))


def test_first_origin_by_arrival(spark, tmp_path):
    """The first origin of a URL is that of the first append, however large the later ones are: in segments, and in JSON-line shards."""
    s, shards = Segments(spark, str(tmp_path / "s")), str(tmp_path / "j")
    late = [("second", "u", 0, k, "a " * 9) for k in range(2000)]
    for k, rows in enumerate(([("zz first", "u", 5, 9, "a")], late, [("another", "u", 0, 0, "a")])):
        append(s, rows, f"b{k}")
        made = index.postings(spark.createDataFrame([r for r in rows], DOCS).withColumn("current_url", F.concat("current_url", F.col("seq"))), X.tokenize(F.col("text")), F.lit(0))
        files.append_shards(made.withColumn("current_url", F.lit("u")), shards)
    for rows in (s.read(), files.read_shards(spark, shards)):
        r = search.match(rows, ["a"]).first()
        assert (r.origin_url, r.depth, r.frequency) == ("zz first", 0, 1 + 18000 + 1)


def test_shards_of_a_job_that_died(spark, tmp_path):
    """An append that was written but moved in part is finished by the next; one that wasn't written whole isn't read."""
    docs = spark.createDataFrame([("o", f"u{k}", 0, k, "apple zebra 9") for k in range(5)], DOCS)
    rows = index.postings(docs, X.tokenize(F.col("text")), F.lit(0))
    died, cut = tmp_path / "_new-00000000000000000001-x", tmp_path / "_new-00000000000000000002-y"
    for folder in (died, cut):
        rows.write.partitionBy("bucket").json(str(folder))
    (cut / "_SUCCESS").unlink()
    (tmp_path / "a.data").mkdir()
    for f in (died / "bucket=a").glob("part-*"):
        f.rename(tmp_path / "a.data" / f"00000000000000000001-{f.name}")
    files.append_shards(rows.where("false"), str(tmp_path))
    assert not died.exists() and cut.exists()
    assert sorted((r.word, r.current_url) for r in files.read_shards(spark, str(tmp_path)).collect()) == sorted((w, f"u{k}") for w in ("apple", "zebra", "9") for k in range(5))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [("o" if k % 11 else None, f"u{k:04}", k % 5, k, " ".join(rnd.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=int(2 ** rnd.uniform(0, 9))))) for k in range(1500)]
    rows += [("o", "empty", 0, 2000, ""), ("o", "none", 0, 2001, None), ("o", "both", 0, 2002, "w59 x w58 w59"), ("o", "twice", 0, 2003, "w5"), ("o", "twice", 0, 2003, "w5")]
    s = Segments(spark, str(tmp_path_factory.mktemp("corpus")))
    for k in range(2):
        append(s, [r for r in rows if r[3] % 2 == k], f"b{k}")
    return s, rows


@pytest.mark.parametrize("terms, k", [(["w0", "w40"], 10), (["w59"], 3), (["w1", "w2", "w3"], 2000), (["none"], 5)])
def test_ranking_skips_blocks(corpus, terms, k, monkeypatch):
    """The best k by the formula; for few results most blocks aren't read. By a filter on blocks and by a join."""
    s, rows = corpus
    held = {}
    for o, u, _, q, t in rows:
        if t:
            held.setdefault((u, q), [o, []])[1].extend(t.split())
    df = {t: sum(t in w for _, w in held.values()) for t in terms}
    score = {}
    for (u, q), (o, w) in held.items():
        n = len(w) if u != "twice" else 1
        found = sum(math.floor(1_000_000 * math.log(1 + len(rows) / df[t]) * (w.count(t) / math.sqrt(n))) for t in terms if t in w)
        if found and o:
            score[u] = score.get(u, 0) + found
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    for pushed in (ranking.PUSHED, 1):
        monkeypatch.setattr(ranking, "PUSHED", pushed)
        best, counts = ranking.top(s, terms, k)
        assert [(r.url, r.score) for r in best.collect()] == want
        assert counts["read"] <= counts["blocks"] and (terms[0] == "none" or counts["blocks"] > 10) and (k > 10 or terms[0] == "none" or 2 * counts["read"] < counts["blocks"])


def test_blocks_and_buckets_are_pushed_down(corpus):
    s, _ = corpus
    plan = ranking._filtered(index.lookup(s.read(), ["w0"]), s.read(table="blocks").limit(1).collect())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(word,w0)" in plan and "block" in plan.split("PushedFilters: [")[1]


def test_search_of_small_and_large_buckets(corpus, monkeypatch):
    """A search over small buckets is one task without a shuffle; its answer is that over large ones, and of the version when it is asked."""
    from webloom.operators import segments

    s, _ = corpus
    engine = search.SearchEngine(s)
    small, rows = engine.search_api("w3 w9", page=2, page_size=7), s.matching(["w3"])
    assert rows.rdd.getNumPartitions() == 1
    monkeypatch.setattr(segments, "SMALL", 0)
    assert engine.search_api("w3 w9", page=2, page_size=7) == small == search.SearchEngine(s.read()).search_api("w3 w9", page=2, page_size=7)
    assert small["total"] > 100 and s.matching(["w3"], 1).count() < s.matching(["w3"]).count()


def test_snippets(corpus):
    """The smallest window with all terms, by all windows."""
    s, rows = corpus
    for terms in (["w3", "w7"], ["w59", "w58", "x"], ["w0"]):
        want = {}
        for o, u, _, _, t in rows:
            w = (t or "").split()
            if u == "twice":
                continue
            spans = [(j - i, i, j) for j in range(len(w)) for i in [min(max((p for p in range(j + 1) if w[p] == t), default=-1) for t in terms)] if i >= 0 and w[j] in terms]
            if spans:
                n, i, j = min(spans)
                want[u] = (i, j, " ".join(w[max(0, i - 2) : j + 3]))
        assert {r.url: (r.first, r.last, r.snippet) for r in ranking.snippets(s, terms, around=2).where("url != 'twice'").collect()} == want


def test_updates_add_up(corpus):
    s, _ = corpus
    terms = ["w9", "w30"]
    whole = lambda rows: {r.url: (r.origin_url, r.depth, r.frequency) for r in search.match(rows, terms).collect()}
    old, new = whole(s.read(1)), whole(s.read(2))
    for r in search.updates(s.read(1), s.read(2, since=1), terms).collect():
        assert r.change == ("changed" if r.url in old else "entered")
        old[r.url] = (r.origin_url, r.depth, r.frequency)
    assert old == new
    first = lambda rows: [r.url for r in search.ranked(rows, terms).limit(20).collect()]
    was, now = first(s.read(1)), first(s.read(2))
    got = search.top_changes(s.read(1), s.read(2), terms, 20).collect()
    place = {u: k + 1 for k, u in enumerate(was)}
    for r in got:
        place[r.url] = r.new_rank
    assert sorted((k, u) for u, k in place.items() if k) == [(k + 1, u) for k, u in enumerate(now)] and {r.change for r in got} == {"entered", "left", "moved"}


def test_claims(spark, tmp_path):
    """A URL is claimed once; the filters spare buckets that have none of the asked; what another commits meanwhile counts."""
    level = lambda urls: spark.createDataFrame([(u, [k]) for k, u in enumerate(urls)], "url string, key array<bigint>")
    v, other = Visited(spark, str(tmp_path), buckets=64), Visited(spark, str(tmp_path))
    got, n = v.claim(level([f"u{k}" for k in range(300)] + ["u5", None]), "a", {"job": "j"})
    assert n == 300 and v.buckets == 64 and Visited(spark, str(tmp_path)).buckets == 64
    assert {r.url for r in v.new(level(["u7", "x1", "x2"])).collect()} == {"x1", "x2"} and 1 <= len(v.touched) <= 2
    assert v.new(level([f"y{k}" for k in range(40)])).count() == 40 and len(v.touched) <= 2
    other = Visited(spark, str(tmp_path))
    commit = v.manifests.commit

    def late(change):
        v.manifests.commit = commit
        assert other.claim(level(["z1"]), "b", {"job": "k"})[1] == 1
        return commit(change)

    v.manifests.commit = late
    got, n = v.claim(level(["z3", "z1", "u1", "z2"]), "c", {"job": "j"}, limit=2)
    assert n == 2 and {r.url for r in got.collect()} == {"z3", "z2"} and v.count() == 303
    assert v.claim(level(["z1"]), "d", {})[1] == 0 and [b["name"] for b in v.pending()] == ["a", "b", "c"]
    v.done("b")
    assert [b["name"] for b in other.pending()] == ["a", "c"] and v.read().count() == 303
