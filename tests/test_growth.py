"""What a task or worker holds is bounded, and pages of one URL are told apart."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.functions import counts, pages
from webloom.functions import text as X
from webloom.operators import index
from webloom.plans.registry import QUERIES, SQL
from webloom.sources import files

from .compare import assert_same


@pytest.mark.parametrize("name", ["streamed_index", "stream_segments"])
def test_pages_of_one_url(spark, sf, tmp_path, name):
    """Pages that share a URL, with the same or other HTML, in one batch and in several, count each."""
    some = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(12)
    again = some.withColumns({"page_id": F.col("page_id") + 100_000, "html": F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>once more</p>"))).otherwise(F.col("html"))})
    some.unionByName(again).coalesce(1).write.parquet(str(tmp_path / "out"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "out").glob("part-*.parquet")).rename(tmp_path / "sf/pages.parquet")
    assert_same(spark, str(tmp_path / "sf"), QUERIES[name], SQL[name])


def test_pages_are_counted_in_parts(monkeypatch):
    """Pages whose rows are dealt over parts and batches are whole, and no part has more words than it may."""
    monkeypatch.setattr(counts, "PART", 20)
    draw, most, was = random.Random(3), [], counts.counted
    monkeypatch.setattr(counts, "counted", lambda rows, *a: most.append(len(rows.column("words").flatten())) or was(rows, *a))
    rows = [(f"u{k // 7}" if k < 60 else None if k % 2 else "x", [draw.choice("abc") for _ in range(draw.randrange(6))] if k % 5 else None) for k in range(70)]
    rows.sort(key=lambda r: r[0] or "")
    found, batches = [], [pa.RecordBatch.from_pydict({"u": [u for u, _ in part], "words": pa.array([w for _, w in part], pa.list_(pa.string()))}) for part in (rows[:33], rows[33:34], rows[34:])]
    for b in counts.of_pages(["u"])(iter(batches)):
        found += [(r["word"], r["u"], r["frequency"]) for r in b.to_pylist()]
    assert sorted(found, key=str) == sorted(((w, u, n) for (w, u), n in Counter((w, u) for u, ws in rows for w in ws or []).items()), key=str)
    assert len(most) > 5 and max(most) < 20 + 6
    at = [(r["word"], r["positions"]) for b in counts.of_rows(["u"])(iter([pa.RecordBatch.from_pydict({"u": ["v", "v"], "words": [["a", "b", "a", "a"], ["b"]]})])) for r in b.to_pylist()]
    assert at == [("a", [0, 2, 1]), ("b", [1]), ("b", [0])]


def test_pages_are_parsed_in_parts(monkeypatch):
    """Of the pages of an Arrow batch only some are Python's strings at a time."""
    monkeypatch.setattr(pages, "PART", 1000)
    htmls, most = [None, "", *(f'<a href="/{k}">w{k}</a>' * 9 for k in range(99))], []
    source = pa.array(htmls)[1:]
    monkeypatch.setattr(pages, "runs", lambda *a: [most.append(r[1] - r[0]) or r for r in counts.runs(*a)])
    assert pages._lists(source, lambda h: pages._Words(h or "").words).to_pylist() == [pages.words_and_links(h)[0] for h in htmls[1:]]
    assert pages._lists(source, lambda h: pages._Words(h or "", words=False).links).to_pylist() == [pages.words_and_links(h)[1] for h in htmls[1:]]
    assert len(pages._lists(source[:0], str)) == 0 and max(most) < 9


def test_shards_are_compressed(spark, tmp_path):
    """Appended shards take a small part of the bytes of plain JSON lines, and are read beside these."""
    docs = spark.createDataFrame([("o", f"u{k}", 0, " ".join(f"a{j % 300}" for j in range(k, k + 200))) for k in range(100)], "origin_url string, current_url string, depth int, text string")
    rows = index.postings(docs, X.tokenize(F.col("text")), F.lit(0))
    files.append_shards(rows, str(tmp_path / "shards"))
    rows.write.json(str(tmp_path / "plain"))
    held = lambda root: sum(p.stat().st_size for p in (tmp_path / root).rglob("*part-*") if not p.name.startswith("."))
    assert held("shards") < held("plain") / 8
    (tmp_path / "shards/b.data").write_text('{"word": "b", "origin_url": "o", "current_url": "u", "depth": 0, "frequency": 2}\n')
    assert files.read_shards(spark, str(tmp_path / "shards")).count() == rows.count() + 1
