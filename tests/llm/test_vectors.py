"""Clustering and hard negatives by brute force in Python's integers."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, `a.b` int"
ODD = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 1.0], [-1.0, 0.5]]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(600, 8)) * rng.choice([0.2, 1, 3], size=(600, 1))).astype(np.float32)
    x[100:300] = x[100]  # a third are copies
    out = [(k, [float(c) for c in v], int(y)) for (k, v), y in zip(enumerate(x), np.where(np.arange(600) % 3, rng.integers(0, 4, 600), 1))]
    out += [(1000 + 50 * k, v, k % 3) for k, v in enumerate(ODD)] + [(None, out[0][1], 1), (5, out[5][1], out[5][2]), (5, out[5][1], out[5][2]), (2050, out[7][1], None), (2107, out[8][1], 2), (2200, [], 1), (2201, [], 1), (2202, [], 2)]
    return out


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def lloyd(rows, dim, k, rounds):
    kept = [(i, tuple(math.floor(1024 * c) for c in v)) for i, v, _ in rows if good(v) and len(v) == dim]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centres = [list(q) for _, q in starts]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, q in kept:
            own[near(q)[1]].append(q)
        centres = [[sum(c) // len(g) for c in zip(*g)] if g else c for g, c in zip(own, centres)]
    found = [(i, *near(q)) for i, q in kept]
    total = [sum(d for _, d, j in found if j == c) for c in range(len(centres))]
    return sorted((-1 if i is None else i, j, d, total[j], sum(total), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found)


@pytest.mark.parametrize("k, rounds", [(8, 10), (1, 2), (700, 1)])
def test_clusters(spark, rows, k, rounds):
    got = centroids.clustered(vectors(spark, rows), dim=8, k=k, rounds=rounds).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *tuple(r)[1:]) for r in got) == lloyd(rows, 8, k, rounds)


def test_clusters_of_few_rows(spark, rows):
    assert centroids.clustered(vectors(spark, rows).where("false")).collect() == []
    assert centroids.clustered(vectors(spark, rows[:3]), dim=8).count() == 3 and centroids.clustered(vectors(spark, rows), dim=64).count() == 0
    only = [(None, rows[0][1], 1)]
    assert centroids.clustered(vectors(spark, only), dim=8).count() == 0
    with pytest.raises(Exception, match="larger than"):
        centroids.clustered(vectors(spark, [(1, [1e9] * 8, 0)]), dim=8).collect()


def negatives(rows, positives=5, k=3, low=50, high=95):
    held = {}
    for i, v, y in rows:
        if i is not None and y is not None and good(v):
            q = tuple(math.floor(256 * c) for c in v)
            held[i] = min(held.get(i, (y, q)), (y, q))
    out = []
    for a, (y, q) in held.items():
        if a % 50:
            continue
        score = sorted((-sum(s * t for s, t in zip(q, p)), i, z) for i, (z, p) in held.items() if i != a and len(p) == len(q))
        for s, i, z in [x for x in score if x[2] == y][:positives]:
            window = [x for x in score if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_hard_negatives(spark, rows, bucket):
    got = hard_negatives.mined(vectors(spark, rows), F.col("id") % 50 == 0, bucket=bucket)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives(rows)


def test_hard_negatives_with_labels(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mined(vectors(spark, rows), F.col("id") % 50 == 0, label, low=-20, high=100)
    moved = [(i, v, y if y is None or i is None or i % 7 else (y + 1) % 10) for i, v, y in rows]
    assert sorted(map(tuple, got.collect())) == negatives(moved, low=-20, high=100)
    for some in (rows[:0], rows[1:3], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2)]):
        assert sorted(map(tuple, hard_negatives.mined(vectors(spark, some), F.col("id") % 50 == 0).collect())) == negatives(some)
    with pytest.raises(Exception, match="larger than"):
        hard_negatives.mined(vectors(spark, [(1, [1e9] * 8, 0)]), F.col("id") % 50 == 0).collect()


def test_short_buckets_are_skipped():
    """By the bound, an anchor that has its k best among long vectors looks at no short ones; results stay those of all."""
    rng = np.random.default_rng(6)
    q = np.sort(rng.integers(1, 1000, 400))[::-1, None] * rng.integers(0, 10, (400, 6))
    rows = lambda x, first: {"id": range(first, first + len(x)), "label": [0] * len(x), "norm2": (x**2).sum(1).tolist(), "q": x.tolist()}
    asked = pa.table({**rows(q[:20], 1000), "low": [[1]] * 20, "high": [[1 << 60]] * 20}).cast(pa.schema([("id", pa.int64()), ("label", pa.int64()), ("norm2", pa.int64()), ("q", pa.list_(pa.int32())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]))
    stripe = [{"dim": 6, "top": int((x**2).sum(1).max()), "bucket": k, "ids": np.arange(20 * k, 20 * k + 20).tobytes(), "labels": np.ones(20, np.int64).tobytes(), "rows": x.astype(np.int32).tobytes()} for k, x in enumerate(np.split(q, 20))]
    found, skipped = hard_negatives.top(asked, pa.Table.from_pylist(stripe), 3, False)
    want = [(1000 + i, int(s[j]), int(j)) for i, s in enumerate(q[:20] @ q.T) for j in np.lexsort((np.arange(400), -s))[:3]]
    assert [(r["anchor"], r["score"], r["id"]) for r in found.to_pylist()] == want and skipped > 100
    huge = q * (1 << 13)  # beyond what doubles hold
    asked = asked.set_column(3, "q", pa.array(huge[:20].tolist(), pa.list_(pa.int32()))).set_column(2, "norm2", pa.array((huge[:20].astype(object) ** 2).sum(1).astype(np.int64)))
    for s, x in zip(stripe, np.split(huge, 20)):
        s |= {"rows": x.astype(np.int32).tobytes(), "top": int((x.astype(np.int64) ** 2).sum(1).max())}
    odd = stripe[3]["rows"][:4]
    stripe[3]["rows"] = (int.from_bytes(odd, "little") + 1).to_bytes(4, "little") + stripe[3]["rows"][4:]
    found, _ = hard_negatives.top(asked, pa.Table.from_pylist(stripe), 3, False)
    all_rows = np.concatenate([np.frombuffer(s["rows"], np.int32).reshape(20, 6) for s in stripe]).astype(np.int64)
    scores = huge[:20].astype(np.int64) @ all_rows.T
    assert [r["score"] for r in found.to_pylist()] == [int(x) for s in scores for x in np.sort(s)[::-1][:3]]
