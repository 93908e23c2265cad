"""b-bit MinHash against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import bbit_minhash, ngram_join

from .test_operators import _components, documents, odd  # noqa: F401


def test_near_copies(spark, odd):  # noqa: F811
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = [(i, t) for i, t in odd if i is not None]
    for i in range(90):  # more than a band expands, some of them outside the largest component
        w = list(base)
        for _ in range(rnd.choice([0, 2, 5, 8, 14, 20, 40])):
            w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 5000)}"
        rows.append((100 + i, " ".join(w)))
    want = _components(rows, 2, 80)
    for block in (ngram_join.BLOCK, 50):
        got = bbit_minhash.near_copies(documents(spark, rows), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    assert len({c for _, c in want.values()}) < len(want) - 30


def _product(h, doc, percent=80):
    rows = ngram_join.packed_entries(np.array(h, np.uint64), np.array(doc, np.int64), np.full(len(doc), 50), 0)
    return ngram_join._product(percent)(pa.table([*map(list, zip(*rows))], names=["at", "part", "n", "h", "doc", "size"])).to_pylist()


def test_documents_of_a_long_list_make_few_rows():
    """They are paired only with neighbours where they meet in short runs, wherever in the block their list is."""
    rng, last = np.random.default_rng(5), (1 << 64) - 1
    h, doc = [last] * 400, [*range(400)]
    for band in range(20):
        for place, x in enumerate(rng.permutation(400).tolist()):
            h.append((1 + band * 20 + place // 20) << 50)
            doc.append(x)
    h += [7 << 50 | 1] * 20  # a short run whose documents are in no list
    doc += range(1000, 1020)
    rows = _product(h, doc)
    pairs = [(r["a"], r["b"]) for r in rows if r["star"] is False]
    assert len([p for p in pairs if p[0] < 400]) <= 20 * 20 * 19 and len([p for p in pairs if p[0] >= 1000]) == 190
    assert len([r for r in rows if r["star"]]) == 3 * 400 - 6
    assert sorted((r["list"], r["a"]) for r in rows if r["list"] is not None) == [(0, x) for x in range(400)]


def test_a_document_is_in_a_list_once():
    runs = [range(100), [0, *range(200, 299)], [0, *range(300, 399)]]  # the same smallest document, and little else in common
    rows = _product([1 + k for k, run in enumerate(runs) for _ in run], [x for run in runs for x in run])
    assert sorted((r["list"], r["a"]) for r in rows if r["list"] is not None) == [(0, x) for x in sorted({x for run in runs for x in run})]


@pytest.mark.parametrize("run, n, percent", [(bbit_minhash.near_copies, 2, 80), (ngram_join.linked, 4, 85)])
def test_links_inside_long_lists(spark, run, n, percent):
    """Texts that drift: far ones are linked only through those between them, and some not at all."""
    rnd, rows = random.Random(8), []
    w = [f"w{k}" for k in range(150)]
    for i in range(260):
        for _ in range(rnd.choice([0, 1, 1, 2, 9]) if i % 40 else 12):
            w[rnd.randrange(150)] = f"z{i}x{rnd.randrange(9)}"
        rows.append((rnd.randrange(10) * 1000 + i, " ".join(w)))
    want = _components(rows, n, percent)
    for block in (ngram_join.BLOCK, 2000):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(documents(spark, rows), block=block).collect()} == want
    assert 1 < len({c for _, c in want.values()}) < 100


def test_rows_without_id_link(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text), (None, text + " more"), (None, text + " more"), (None, "alone again"), (9, "x " + text), (None, None), (3, "")]
    for run in (bbit_minhash.near_copies, ngram_join.linked):
        got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in run(documents(spark, rows)).collect()), key=repr)
        assert got == sorted([(7, True, 7), (None, True, 7), (None, True, 7), (None, True, None), (9, True, 7), (None, False, None), (3, False, 3)], key=repr)
    assert bbit_minhash.near_copies(documents(spark, rows).where("false")).collect() == []


def test_estimates_are_corrected():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.8, 1.0):
        found, agree = [], []
        for _ in range(60):
            u = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            same, rest = u[: round(300 * share)], u[round(300 * share) :]
            x, y = np.r_[same, rest[::2]], np.r_[same, rest[1::2]]
            of, low = bbit_minhash.minima(np.r_[np.zeros(len(x), int), np.ones(len(y), int)], np.r_[x, y])
            s = bbit_minhash.signatures(low)
            assert of.tolist() == [0, 1] and s.shape == (2, 13)
            found.append(bbit_minhash.estimates(s[:1], s[1:])[0])
            agree.append((low[:, 0] == low[:, 1]).mean())
        assert abs(np.mean(found) - share) < 0.02 and abs(np.mean(agree) - share) < 0.02
        if share == 0.8:
            assert min(found) > bbit_minhash.least(80) > 0.5
