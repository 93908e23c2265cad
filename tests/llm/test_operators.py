import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from webloom.llm import ann, bpe, components, exact_dedup, html_extract, langid, mixing, ngram_join, queries, sentencepiece_codec, sharding, substring_dedup, token_counts
from webloom.llm.common import Scratch

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, score int, n int, ids string"


def documents(spark, texts, first=0):
    """(id, text) rows with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", None, "p", 1, 2, "i") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties."""
    rnd = random.Random(1)
    words = [f"w{rnd.randint(0, 300)}" for _ in range(4000)]
    shared = " ".join(words[:120])
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE two"), (6, "É é"), (7, "é é"), (8, " ".join(words)), (9, " ".join(words).upper()), (10, "x " + shared), (11, shared + " y"), (11, shared + " y"), (12, "a" * 30000), (None, "One two"), (13, "…")]
    rows += [(20 + k, " ".join([*words[200:300], *(f"u{k}x{j}" for j in range(3))])) for k in range(5)]
    return rows


EMPTY = [("op1", langid.predictions), ("op2", substring_dedup.remove_repeats), ("op4", ngram_join.linked), ("op5", lambda d: sentencepiece_codec.digests(d, PIECES)), ("op6", exact_dedup.exact_groups), ("op9", mixing.mix), ("op10", lambda d: token_counts.token_counts(d, BYTES))]


@pytest.mark.parametrize("name, run", EMPTY, ids=[n for n, _ in EMPTY])
def test_empty_table(spark, name, run):
    assert run(documents(spark, [(1, "a")]).where("false")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(spark, sf, queries.QUERIES[name], queries.SQL[name])


def test_exact_groups(spark, odd):
    got = exact_dedup.exact_groups(documents(spark, odd), block=64).collect()
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    groups = {}
    for i, t in odd:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((-1 if i is None else i, max(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in odd)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(documents(spark, odd))
    assert kept.count() == len(groups) and kept.columns == documents(spark, odd).columns


def test_substring_dedup(spark, odd):
    first, words = {}, {}
    key = lambda i: -1 if i is None else i
    for i, t in odd:
        w = words[key(i), t] = (t or "").encode().split()
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), 99), key(i))
    want = []
    for i, t in odd:
        w = words[key(i), t]
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone.update(range(k, k + 50))
        want.append((key(i), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    for how in ({}, {"chunk": 2000, "block": 500}):
        got = substring_dedup.remove_repeats(documents(spark, odd), **how).collect()
        assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_substring_dedup_of_many_rows(spark, odd):
    """Documents without windows don't count, and bound a chunk by their number."""
    import pyarrow as pa

    n, text = (1 << 20) + 2, " ".join(f"w{k}" for k in range(90))
    c = substring_dedup._Chunk(pa.table([pa.array(range(n)), pa.array([None] * (n - 2) + [text] * 2, pa.string())], ["doc_id", "text"]), 50)
    cells, several, place = c.cells(0, 40)
    want = np.unique(substring_dedup.mix(c.key + substring_dedup._ROW[0]) >> np.uint64(24))
    assert cells.tolist() == want.tolist() and several.all() and (place[:41] == place[41:]).all()
    one, many = (sorted(map(repr, substring_dedup.remove_repeats(documents(spark, odd), **how).collect())) for how in ({}, {"rows": 2}))
    assert one == many


def test_substring_dedup_of_equal_rows(spark):
    """Many rows of one id and text, and of none, are many tasks' and repeat nothing."""
    text = " ".join(f"w{k}" for k in range(70))
    rows = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit(text)).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(9, "x " + text), (3, "few words")], "doc_id long, text string"))
    got = substring_dedup.remove_repeats(rows, chunk=20_000).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 70, 0, 2000), (None, 0, 0, 1000), (9, 71, 70, 1), (3, 2, 0, 1)], key=str)


def _components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join(spark, odd):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = [(i, t) for i, t in odd if i is not None]
    for i in range(60):  # more near copies than a list expands
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 5000)}"
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(documents(spark, rows)).collect()}
    assert got == _components(rows)
    with_null = ngram_join.linked(documents(spark, [(4, "One two"), (None, "one two")])).collect()
    assert {r.component_id for r in with_null} == {4}


def test_pairs_of_a_block_are_emitted_once(monkeypatch):
    """Pairs of a family of near copies, which many shingles give again, are one row each with the whole count, however few are held at a time."""
    import pyarrow as pa

    for family in (20, 200):  # pairs of short lists, and of a long list's pivots
        h = np.repeat(np.arange(50, dtype=np.uint64), family)
        rows = ngram_join.packed_entries(h, np.tile(np.arange(family), 50), np.full(len(h), 60), 0)
        table = pa.Table.from_pylist([dict(zip(("at", "part", "n", "h", "doc", "size"), r)) for r in rows])
        want = ngram_join._product(85)(table)
        monkeypatch.setattr(ngram_join, "PAIRS", 2000)
        got = ngram_join._product(85)(table).to_pylist()
        pairs = [(r["a"], r["b"], r["shared"]) for r in got if r["b"] is not None]
        assert len({p[:2] for p in pairs}) == len(pairs) == (190 if family == 20 else 3 * 200 - 6) and {p[2] for p in pairs} <= {50, 100}
        assert sorted(map(str, got)) == sorted(map(str, want.to_pylist()))


def test_long_lists_are_of_like_sizes_and_do_not_chain():
    """Each pair that shares a shingle and may be similar by size is a pair, or in one long list; lists that overlap a little stay apart, and spread sizes make none."""
    import pyarrow as pa

    rnd = random.Random(5)
    of = {}
    for s in range(30):  # lists of one size, each sharing a quarter with the next, and with strangers of all sizes
        of[s] = {(30 * s + i, 100) for i in range(40)} | {(5000 + x, 20 + x) for x in rnd.sample(range(3000), 20)}
    for s in range(30, 60):  # spread sizes
        of[s] = {(5000 + x, 20 + x) for x in rnd.sample(range(3000), 60)}
    h = np.repeat(np.arange(60, dtype=np.uint64), [len(of[s]) for s in range(60)])
    doc, size = (np.array([e[k] for s in range(60) for e in sorted(of[s])]) for k in (0, 1))
    rows = ngram_join.packed_entries(h, doc, size, 0)
    got = ngram_join._product(85)(pa.Table.from_pylist([dict(zip(("at", "part", "n", "h", "doc", "size"), r)) for r in rows])).to_pylist()
    pairs = {(r["a"], r["b"]) for r in got if r["b"] is not None}
    lists = {}
    for r in got:
        if r["list"] is not None:
            lists.setdefault(r["list"], set()).add(r["a"])
    for entries in of.values():
        for (a, x), (b, y) in itertools.combinations(sorted(entries), 2):
            if 100 * min(x, y) >= 85 * max(x, y):
                assert (a, b) in pairs or any({a, b} <= m for m in lists.values())
    assert len(lists) == 30 and max(map(len, lists.values())) < 60


def test_counts_bound_the_overlap():
    """Counts by bin never discard a pair that is similar, sizes beyond a byte included."""
    import pyarrow as pa

    rnd = random.Random(8)
    texts = []
    for size in (5, 60, 400, 90_000):
        base = [f"w{rnd.randint(0, 10 * size)}" for _ in range(size)]
        for share in (0, 0.01, 0.03, 0.05, 0.5, 1):
            texts.append(" ".join(f"z{rnd.random()}" if rnd.random() < share else w for w in base))
    ids = list(range(len(texts)))
    rows = pa.Table.from_batches(ngram_join._counts(4)(iter([pa.record_batch([pa.array(ids), pa.array(texts)], ["doc_id", "text"])]))).to_pylist()
    assert [r["doc_id"] for r in rows] == ids and rows[-1]["bins"] is None and rows[0]["bins"] is not None
    pairs = [(a, b) for a in ids for b in ids if a < b and rows[a]["n"] and rows[b]["n"]]
    column = lambda name, side: pa.array([rows[p[side]][name] for p in pairs])
    batch = pa.record_batch([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), column("n", 0), column("n", 1), column("bins", 0), column("bins", 1)], ["a", "b", "na", "nb", "ba", "bb"])
    kept = {(r["a"], r["b"]) for b in ngram_join._possible(85)(iter([batch])) for r in b.to_pylist()}
    both = pa.record_batch([batch.column(0), batch.column(1), pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs])], ["a", "b", "ta", "tb"])
    similar = {(r["a"], r["b"]) for b in ngram_join._similar(4, 85)(iter([both])) for r in b.to_pylist()}
    assert similar and similar <= kept
    small = {p for p in pairs if max(p) < 18}
    assert len(kept & small) < len(small) / 2


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {i: low if c == high else c for i, c in label.items()}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {i: c for i, c in label.items() if sum(x == c for x in label.values()) > 1}


def _texts():
    rnd = random.Random(2)
    return ["".join(rnd.choice("aabc theing  \n\t'sré!éß日本½²Ⅷ  \r<|endoftext|>") for _ in range(rnd.randint(0, 200))) for _ in range(300)] + ["x" * 3000, "a" * 700 + "<|endoftext|>b", " " * 300, "", "don're'v 'll x'd", "日本" * 300]


def test_token_counts():
    from tokenizers import Tokenizer

    lib, counter = Tokenizer.from_file(BYTES), token_counts.Counter(open(BYTES, "rb").read())
    texts = _texts()
    assert counter.counts(texts) == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    for t in texts[:40]:
        if "<" not in t:
            p = token_counts.PrefixCounts(counter, t)
            assert all(p.at(k) == len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1))
            assert p.fit(20) == sum(len(counter.bpe.codes[i]) for i in lib.encode(t, add_special_tokens=False).ids[:20])
    assert counter.bpe.prefix_counts(b"hello")[-1] == 1


def test_prefix_counts_are_looked_up(monkeypatch):
    """Once the counts at each byte are stored, no prefix is encoded again."""
    from tokenizers import Tokenizer

    lib, counter = Tokenizer.from_file(BYTES), token_counts.Counter(open(BYTES, "rb").read())
    text = "It's unquestionably  straightforward, größte Überraschung<|endoftext|>antidisestablishmentarianism"
    p = token_counts.PrefixCounts(counter, text)
    first = [p.at(k) for k in range(len(text) + 1)], [p.fit(n) for n in range(p.tokens[-1] + 2)]
    assert first[0] == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    size = lambda t: len(t) if t in counter.added else 0
    ids = lib.encode(text, add_special_tokens=False).ids
    ends = np.cumsum([0, *(len(counter.bpe.codes[i]) if counter.bpe.codes[i] else size("<|endoftext|>") for i in ids)]).tolist()
    assert first[1] == [*ends, ends[-1]]
    monkeypatch.setattr(counter, "bpe", None)
    assert first == ([p.at(k) for k in range(len(text) + 1)], [p.fit(n) for n in range(p.tokens[-1] + 2)])


def test_sentencepiece(spark):
    import sentencepiece

    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(open(PIECES, "rb").read())
    texts = _texts()
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts, num_threads=1) and [codec.decode(x) for x in ids] == texts
    s, text, out = bpe.Stream(codec.bpe), "▁" + ("ab  the thing " * 200).replace(" ", "▁"), []
    for k in range(0, len(text), 7):
        out += s.feed(text[k : k + 7])
        assert len(s.text) <= 4 * codec.bpe.longest  # committed ids are forgotten
    assert out + s.finish() == lib.encode("ab  the thing " * 200)
    rows = [(1, None), (2, ""), (3, "Größe 日本\n")]
    coded = sentencepiece_codec.encode_documents(documents(spark, rows), PIECES)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode_documents(coded, PIECES).collect()} == {1: "", 2: "", 3: "Größe 日本\n"}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97 and sum(r.rejected for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs)
    assert model.predict(["12 …", ""]) == (["und", "und"], [0.0, 0.0])
    assert langid.fit([], []).predict(["a"]) == (["und"], [0.0])


def test_many_languages(spark):
    """Every language is learned, beyond the number up to which layers are multiplied, too."""
    rows = [(1000 * k + j, f"wort{k} " * 3, f"l{k:04}", "s", None, "p", 1, 2, "i") for k in range(1100) for j in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    model = langid.train(docs)
    assert len(learned) > 1023 and set(model.langs) == learned and model.head is not None
    assert langid.predictions(docs.limit(50)).count() == 50


def test_language_sample(spark):
    """The sample is bounded in rows and bytes, and doesn't hang on ids: one that repeats is as good as many."""
    words = {"de": "der die das und nicht", "en": "the and of not with", "zz": "qu qua que qui quo"}
    rnd = random.Random(9)
    rows = [(1 if lang == "zz" else 100 * j + k, " ".join(rnd.choices(w.split(), k=30)), lang, "s", None, "p", 1, 2, "i") for k, (lang, w) in enumerate(words.items()) for j in range(400)]
    rows += [(5, "same row " * 9, "de", "s", None, "p", 1, 2, "i")] * 3000 + [(7, "the and of " * 200_000, "en", "s", None, "p", 1, 2, "i")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, per_lang=60)
    assert model.langs == ["de", "en", "zz"] and model.predict(["der und das nicht die", "qua quo que"])[0] == ["de", "zz"]
    assert langid.train(docs, most_bytes=1).langs == ["de", "en", "zz"]
    long = "the and of " * 200_000
    assert np.allclose(model.of_bags([langid.bag(long[:9000])]), model.logits([long[:9000]]), atol=1e-4) and model.predict([long])[0] == ["en"]


def test_language_of_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows and clashing columns, by the query and by identify()."""
    docs, model = documents(spark, odd), langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(odd) and set(got[0].asDict()) == {*docs.columns, "lang_pred", "score", "rejected"}
    for r in got:
        none = not any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == none and (not none or r.score == 0.0 and r.rejected)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 11}) == 1
    kept = langid.identify(docs, model, ("a", "b", "c")).collect()
    assert {r.score for r in kept} == {1} and "lang_pred" not in kept[0].asDict()
    assert sorted(r.doc_id or 0 for r in langid.predictions(docs).collect()) == sorted(i or 0 for i, _ in odd)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, __id long, __sha string, score string, rejected int, `row` int, words int, gone int, ids int, copy int, `k``k` int"


def clashing(spark, odd):
    rows = [(i, t, "en", "s" if k % 3 else None, len(t or ""), "x.y", k, "z", f"s{k}", k, k, k, k, k, k, k) for k, (i, t) in enumerate(odd)]
    return spark.createDataFrame(rows, CLASH), rows


def test_operators_on_documents_keep_columns(spark, odd):
    docs, rows = clashing(spark, odd)
    whole = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    norm = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    last = {}
    for r in rows:
        k = last.get(norm(r[1]))
        last[norm(r[1])] = r if k is None or (-1 if r[0] is None else r[0]) > (-1 if k[0] is None else k[0]) else k
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and set(whole(kept)) <= set(map(repr, rows))
    key = lambda r: (r[0], norm(r[1]))  # noqa: E731 of the repeated row either stays
    assert sorted(map(repr, map(key, last.values()))) == sorted(repr(key(r)) for r in kept.collect())
    for n, percent in ((4, 85), (5, 80)):
        near, want = ngram_join.one_of_each(docs, n=n, percent=percent), _components([(r[0], r[1]) for r in rows if r[0] is not None], n, percent)
        assert near.columns == docs.columns and whole(near) == sorted(repr(r) for r in rows if r[0] is None or want[r[0]][1] == r[0])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r)[5:] for r in mixed.collect()} <= {r[5:] for r in rows}
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(len((r[1] or "").split()) for r in rows)
    coded = sentencepiece_codec.encode_documents(docs, PIECES)
    assert coded.columns == [*(c for c in docs.columns if c != "ids"), "ids"] and coded.count() == len(rows)
    for f in (exact_dedup.drop_copies, ngram_join.one_of_each, mixing.mix_documents, lambda d: sentencepiece_codec.encode_documents(d, PIECES)):
        assert f(docs.where("false")).collect() == []


def test_mixing(spark, odd):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)) if i % 9 else None, None, None if i % 50 == 0 else f"s{int(rnd.random() ** 2 * 6)}", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    sums = {}
    for r, src in ((r, r.source) for r in got):
        assert r.taken <= 3 * r.size
        sums.setdefault(src, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - s) <= 0.5 for t, s, _ in sums.values()) and sum(t for t, _, _ in sums.values()) == pytest.approx(sum(n for *_, n in sums.values()))
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mixed = mixing.mix_documents(docs)
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert mixed.columns == docs.columns and words == {s: v[1] for s, v in sums.items() if v[1]}
    assert [r.target for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()] == [0.0, 0.0]
    assert sum(r.taken for r in mixing.mix(documents(spark, odd)).collect()) == sum(len((t or "").split()) for _, t in odd)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[700]  # copies
    rows = [(k, x[k].tolist()) for k in range(1500)] + [(2000, None), (None, x[0].tolist()), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, []), (2250, [1.0, 2.0]), (2251, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.where("vec_id % 50 = 0")).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = n @ n[q]
        s[q] = -9
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(own, own[1:]))
        hits += sum(r.score >= np.sort(s)[-5] - 1e-12 for r in own)
    assert hits / 150 >= 0.9
    assert [(r.query_id, r.vec_id) for r in got if r.query_id >= 2000] == [(2250, 2251)]
    assert ann.nearest(v.where("false"), v.where("false")).collect() == []


def test_routed_search(spark):
    """Shards far larger than the search's view: recall on clustered vectors while a part of the shards is searched, a hot vector split."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(60, 24))
    x = (middle[rng.integers(0, 60, 12_000)] + 0.35 * rng.normal(size=(12_000, 24))).astype(np.float32)
    x[4000:8000] = x[4000]  # a third are copies
    v = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(x)], "vec_id long, embedding array<float>")
    index, cells = ann.build_index(v, "vec_id", "embedding", shard=1000)
    index = Scratch(spark, "t").write(index)
    sizes = [len(r.ids) // 8 for r in index.select("ids").collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 1500 and len(sizes) > len(cells[24]) >= 12
    q = v.where("vec_id % 50 = 0")
    asked, sent = ann._valid(q, "vec_id", "embedding"), spark.sparkContext.broadcast(cells)
    assert ann.probes(index, asked, sent, 5, ann.EF) < len(cells[24])
    got = {}
    for r in ann.search(index, cells, q, "vec_id", "embedding").collect():
        got.setdefault(r.query_id, []).append(r)
    n = x.astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 12_000, 50):
        s = n @ n[i]
        s[i] = -9
        own = sorted(got[i], key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(own, own[1:]))
        hits += sum(r.score >= np.sort(s)[-5] - 1e-9 for r in own)
    assert hits / (5 * 240) >= 0.93


def test_sample_of_long_vectors():
    """The sample that centroids are fitted on is bounded in bytes."""
    held = []

    class Rows:
        def groupBy(self, *a):
            return self

        def count(self):
            return self

        def collect(self):
            return [type("R", (), {"dim": 768, "__getitem__": lambda s, k: 1 << 33})()]

        def where(self, *a):
            return self

        def select(self, *a):
            return self

        def limit(self, n):
            held.append(n)
            return self

        def toArrow(self):
            import pyarrow as pa

            return pa.table({"v": pa.array(np.random.default_rng(1).normal(size=(64, 768)).tolist(), pa.list_(pa.float32()))})

    for most in (ann.BYTES, 1 << 20):
        assert len(ann.centroids(Rows(), ann.SHARD, most_bytes=most)[768]) <= ann.MOST
        assert held.pop() * 768 * 4 <= 2 * most


def test_html(spark):
    page = (
        '<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="wrap has-sidebar"><div id="sidebar-left"><p>{long}</p></div><div class="post p12"><h1>Head</h1><p>One &amp; two<b>bold</b> x<br>y</p><ul><li>a<li>b</ul>'
        '<table><tr><td>c<td>d</table><p>unclosed<div class="ad">buy</div><pre>k  l</pre></div><section id="comments"><p>{long}</p></section></div><footer>foot</footer><script>if (a<b) {{"</p>"}}</script></body></html>'
    ).format(long="w " * 90)
    short = '<body><div class="post p3"><p>tiny</p></div><div class="more"><p>much longer text in another place of the page</p></div>'
    rows = [(1, "http://h/1", page), (2, "http://h/2", page), (3, "http://h/3", short.replace('<div class="post', '<div class="wrap has-sidebar"><div class="post', 1)), (4, None, None), (5, "x", ""), (5, "x", ""), (6, "http://o/", "plain")]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1] == got[2] == "Head One & twobold x y a b c d unclosed k l" and (got[4], got[5], got[6]) == ("", "", "plain")
    assert got[3] == "tiny"  # the other pages of its host decide
    assert html_extract.extract("a < b &lt; c") == "a < b < c" and html_extract.extract("<div hidden>x</div><p>y") == "y"


def test_html_beside_the_best(spark):
    """Text beside the container with most points belongs to the article, by page and by host."""
    long, less = "long " * 100, "less " * 66
    pages = {
        f"<article><h1>Head</h1><div><p>{long}</div></article>": f"Head {long}",
        f"<main><div class=a><h1>Head</h1></div><div class=b><p>{long}</div></main><div class=c>{less}</div>": f"Head {long}",
        **{f"<div class=post><div class=in><p>Intro</p><{t}>{long}</{t}></div></div><div class=c>by me</div>": f"Intro {long}" for t in ("ul", "blockquote", "section", "div")},
        f"<div class=post><p>Intro</p><table><tr><td>{long}</table></div>": f"Intro {long}",
        f"<div><section><p>{long}</section><section><p>{less}</section></div>": f"{long}{less}",
        f"<div><section class=x><p>{long}</section><section class=y><p>{less}</section></div>": f"{long}{less}",
        f"<div><section class=x><p>{long}</section><section class=y><a href=z>{less}</a></section></div>": long,
        f"<div class=post><p>{long}</div><div class=post><p>{less}</div><div class=c>by me</div>": f"{long}{less}",
    }
    for source, want in pages.items():
        assert html_extract.extract("<body>" + source) == want.strip()
    rows = [(9 * h + k, f"http://h{h}/{k}", "<body>" + source) for h, source in enumerate(pages) for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {9 * h + k: want.strip() for h, want in enumerate(pages.values()) for k in range(3)}


def test_html_drawings():
    for drawing in ('<svg class="i"/>', "<svg/>", "<math />", "<SVG width=1 hidden/>", "<svg><svg><text>no</text></svg><text>no</text></svg>", "<svg><math/><title>no</title></svg>", "<svg><!-- </svg> --><text>no</text></svg>", "<svg href=/a/><text>no</text></svg>", "<svg class=i>", "<math>"):
        page = f"<article><p>one {drawing} two</p><p>three</p></article>"
        assert html_extract.extract(page) == "one two three"
        assert html_extract.extract(f"{page}<script>'<svg>'</script><article><p><svg><text>no</text></svg>four</p></article>") == "one two three four"


def test_html_forms_and_names():
    """A form around a page isn't a form within it; names count as a whole."""
    long = "long " * 150
    inner = f"<h1>Head</h1><p>{long}</p><label>L</label><input value=x><select><option>o</select><button>b</button>"
    assert html_extract.extract(f"<body><form id=aspnet><div class=post>{inner}</div></form>") == f"Head {long}".strip()
    assert html_extract.extract("<body><form><article><p>short</p></article></form>") == "short"
    assert html_extract.extract(f"<body><article><p>{long}</p><form><p>Leave a reply here</p><input></form><p>end</p></article>") == f"{long}end"
    for name in ("related-work", "notice-period", "menu_theory", "headerFields", "shareholders", "search-results-analysis"):
        assert html_extract.extract(f'<body><article><p>{long}</p><section id="{name}"><p>part</p></section><p class="{name}">more</p></article>') == f"{long}part more"
    for name in ("related", "related-posts", "notice", "share-buttons", "comments", "ad-slot-2", "cookie-bar", "headerSearch", "sidebarLeft", "site-notice"):
        assert html_extract.extract(f'<body><article><p>{long}</p><div id="{name}"><p>part</p></div></article>') == long.strip()


def test_html_of_any_depth():
    """Time and memory in proportion to the page, whatever is nested or left open."""
    import time
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    assert html_extract.extract(f"{'<div>' * n}deep") == "deep"
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    began = time.perf_counter()
    for source in ("<div>t " * n, "<div><p>t</p></span></li>" * n, f"<ul>{'<li><b>t ' * n}"):
        assert html_extract.extract(source) == ("t " * n).strip()
    assert time.perf_counter() - began < 120


def _generated(rnd, host):
    """(html, article): a page of a host's layout around an article of random blocks."""
    words = lambda k: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(k))
    blocks = [words(rnd.randint(30, 80)) for _ in range(rnd.randint(3, 9))]
    title, tag = words(5), ["p", "p", "blockquote", "div", "li"]
    body = "".join(f"<ul><li>{b}</li></ul>" if t == "li" else f"<{t}>{b}</{t}>" for b in blocks for t in [rnd.choice(tag)])
    menu = "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(rnd.randint(3, 30)))
    ad = f'<div class="ad-{rnd.randint(1, 9)}"><p>{words(40)}</p></div>'
    article = f"<h1>{title}</h1>{body[: (cut := body.find('<', len(body) // 2))]}{ad if rnd.random() < 0.5 and body[cut : cut + 2] != '</' and '<ul>' not in body else ''}{body[cut:]}"
    comments = f'<section id="comments"><p>{words(rnd.randint(20, 200))}</p></section>'
    side = f'<aside><p>{words(rnd.randint(10, 300))}</p></aside>'
    shell = [
        f"<header><ul>{menu}</ul></header><article>{article}</article>{side}{comments}<footer>{words(20)}</footer>",
        f'<nav>{menu}</nav><div class="wrap">{side}<div class="post p{rnd.randint(1, 99)}">{article}</div>{comments}</div><div id="footer">{words(20)}</div>',
        f'<form method=post><div id="menu"><ul>{menu}</ul></div><main>{article}</main><div class="newsletter-signup"><p>{words(30)}</p><input></div></form>',
        f'<table><tr><td class="sidebar"><ul>{menu}</ul><p>{words(60)}</p></td><td class="story">{article}</td></tr></table><script>"{words(400)}</p>"</script>',
    ][host % 4]
    return f"<!doctype html><html><head><title>{title}</title><style>p {{}}</style></head><body>{shell}</body></html>", " ".join([title, *blocks])


def test_html_of_known_articles(spark):
    """Generated pages of several hosts whose articles are known; joined by a broadcast, and by salted hosts."""
    rnd = random.Random(12)
    rows, want = [], {}
    for i in range(240):
        source, want[i] = _generated(rnd, i % 8)
        rows.append((i, f"https://h{i % 8}.example/{i}", source))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for most in (html_extract.MOST_HOSTS, 3):
        assert {r.page_id: r.text for r in html_extract.main_texts(pages, most_hosts=most).collect()} == want
        assert html_extract.main_texts(pages.where("false"), most_hosts=most).collect() == []


def test_sharding(spark, tmp_path):
    docs = documents(spark, [(k, f"text {k}" * 50) for k in range(400)] + [(None, None), (1, "x")])
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=40_000, fan=3)
    with pytest.raises(FileNotFoundError):
        store.read()
    for k in range(4):
        store.append(docs.where(f"coalesce(doc_id, 0) % 4 = {k}"))
    before, base = store.manifest(), store.read().count()
    after = store.compact()
    assert len(after["shards"]) < len(before["shards"]) and after["version"] == 5
    key = lambda d: sorted(map(repr, d.select(*docs.columns).collect()))
    assert key(store.read()) == key(docs) and base == 402 and store.read(4).count() == 402
    with pytest.raises(sharding.Conflict):
        store.commit(before, [], set())
    store.append(docs.where("false"))
    store.vacuum(1)
    assert key(store.read()) == key(docs)


def test_vacuum_spares_writers_and_readers(spark, tmp_path):
    """An append in flight keeps its files through a vacuum, and commits on the version that has come meanwhile; a reader keeps those of its version."""
    docs = documents(spark, [(k, f"text {k}" * 50) for k in range(60)])
    store, other = (sharding.Store(spark, f"file://{tmp_path}/s", target=40_000, fan=2) for _ in range(2))
    key = lambda d: sorted(map(repr, d.select(*docs.columns).collect()))
    for k in range(3):
        store.append(docs.where(f"doc_id % 4 = {k}"))
    publish = other.publish

    def late(*commit):
        # Written, not committed: others merge, append and clean up.
        assert store.compact()["version"] == 4 and store.vacuum() == 0
        store.append(docs.where("false"))
        assert store.vacuum() > 0 and store.vacuum() == 0
        return publish(*commit)

    other.publish = late
    assert other.append(docs.where("doc_id % 4 = 3"))["version"] == 6
    assert key(store.read()) == key(docs) and store.read(5).count() == 45
    with pytest.raises(Exception, match="manifest|exist"):
        store.read(1)
    # Files that nobody has listed go after their lease; a merge of shards that are gone doesn't commit.
    docs.write.parquet(f"file://{tmp_path}/s/shards/a-lost")
    assert store.vacuum() == 0 and store.vacuum(lease=-60) > 0 and key(store.read()) == key(docs)
    with pytest.raises(sharding.Conflict):
        store.publish([], {"a-lost/x"})


def test_two_writers(spark, tmp_path):
    """Of two commits of one version at once exactly one holds, on a file system whose renames replace files."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    store, rounds = sharding.Store(spark, f"file://{tmp_path}/s"), 12
    for v in range(rounds):
        gate = Barrier(3)

        def write(k, base=store.manifest()):
            gate.wait()
            try:
                return store.commit(base, [{"name": f"x/{k}", "rows": 1, "bytes": 1, "tier": 0}], set())
            except sharding.Conflict:
                return None

        with ThreadPoolExecutor(3) as pool:
            got = [x for x in pool.map(write, range(3)) if x]
        assert len(got) == 1 and store.version() == v + 1 and store.manifest()["shards"] == got[0]["shards"]
    assert [s["added"] for s in store.manifest()["shards"]] == list(range(1, rounds + 1))
    left = [x.name for d in (tmp_path / "s/manifests").iterdir() for x in d.iterdir()]
    assert {x for x in left if not x.endswith(".crc")} == {"manifest.json"} and len(list((tmp_path / "s/manifests").iterdir())) == rounds


def _tier(size, target, fan):
    return 0 if size * fan >= target else 1 + _tier(size * fan, target, fan)


def test_registered_sharding(spark, sf, monkeypatch):
    """The query's rows, and each version of its store against the rules, read from the files that manifests list."""
    import pyarrow.parquet as pq

    stores, sharded = [], sharding.sharded
    monkeypatch.setattr(sharding.Store, "vacuum", lambda *a: 0)
    monkeypatch.setattr(sharding, "sharded", lambda *a, **b: stores.append(sharded(*a, **b)) or stores[-1])
    got = queries.op7_sharding(spark, sf).collect()
    assert sorted(got[0].asDict()) == ["added", "doc_id", "n_chars", "shard", "shard_rows", "tier"]
    store = stores[0]
    path = lambda s: f"{store.root.removeprefix('file://')}/shards/{s['name']}"
    want = [(i, n, k, s["tier"], s["rows"], s["added"]) for k, s in enumerate(store.manifest()["shards"]) for i, n in zip(*(pq.read_table(path(s)).column(c).to_pylist() for c in ("doc_id", "n_chars")))]
    assert sorted((r.doc_id, r.n_chars, r.shard, r.tier, r.shard_rows, r.added) for r in got) == sorted(want)
    docs = pq.read_table(f"{sf}/documents.parquet")
    assert sorted(x[:2] for x in want) == sorted(zip(docs.column("doc_id").to_pylist(), docs.column("n_chars").to_pylist()))
    appends = merges = 0
    for v in range(1, store.version() + 1):
        old, new = ({s["name"]: s for s in store.manifest(k)["shards"]} for k in (v - 1, v))
        gone, come = old.keys() - new.keys(), [new[n] for n in new.keys() - old.keys()]
        for s in come:
            assert s["added"] == v and s["rows"] == pq.read_metadata(path(s)).num_rows
        if not gone:
            appends += 1
            assert all(s["tier"] == 0 and (s["bytes"] <= store.target // sharding.SMALL or s["rows"] == 1) for s in come)
            continue
        merges += 1
        assert sum(old[n]["rows"] for n in gone) == sum(s["rows"] for s in come)
        # What may be merged: small shards of one size class, of which there are enough or a target file's worth.
        small = [s for s in old.values() if 2 * s["bytes"] < store.target]
        classes = {}
        for s in small:
            classes.setdefault(_tier(s["bytes"], store.target, store.fan), []).append(s)
        full = {s["name"] for c in classes.values() if len(c) >= store.fan or sum(s["bytes"] for s in c) > store.target for s in c}
        assert gone <= full and len(come) < len(gone)
    assert appends == 16 and merges >= 4 and max(s["tier"] for s in store.manifest()["shards"]) >= 2
    again = queries.op7_sharding(spark, sf)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got)) and again.where("false").columns == again.columns


def test_sharding_without_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_sharding(spark, str(tmp_path)).collect() == []


def test_small_shards(spark, tmp_path):
    """Shards of an arrival are small in bytes, whatever its partitions; a row too long for one is alone."""
    rnd = random.Random(6)
    docs = documents(spark, [(k, f"{rnd.getrandbits(8000 if k < 300 else 80):x}") for k in range(600)] + [(900, f"{rnd.getrandbits(200_000):x}")]).orderBy("doc_id").coalesce(1)
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=160_000)
    for _ in range(2):
        shards = store.append(docs)["shards"]
        assert len(shards) > 8 and all(s["bytes"] <= 20_000 or s["rows"] == 1 for s in shards)
    key = lambda d: sorted(map(repr, d.select(*docs.columns).collect()))
    assert key(store.read()) == key(docs.union(docs))


def test_stages_on_odd_rows(spark, odd):
    """Each stage by brute force on nulls, empty and long texts, ties, repeated rows and clashing columns; and without rows."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    odd = odd + [(300 + k, f"the quick brown fox {k} jumps over the lazy dog and runs away") for k in range(40)]
    docs, rows = clashing(spark, odd)
    first = stages["language_id"](spark, docs, None)
    got = first.collect()
    strip = lambda r: (*r[:2], *r[3:])
    assert first.columns == docs.columns and {strip(tuple(r)) for r in got} <= {strip(r) for r in rows} and {r.score for r in got} <= {r[8] for r in rows}
    assert all(any(map(str.isalpha, r.text or "")) and r.lang == "en" for r in got) and len(got) >= 40
    for name in ("exact_dedup", "ngram_jaccard_join", "mixing"):
        assert stages[name](spark, docs, None).columns == docs.columns
    near = {r.doc_id for r in stages["ngram_jaccard_join"](spark, docs, None).collect() if r.doc_id is not None}
    assert near == {c for _, c in _components([(i, t) for i, t in odd if i is not None], 5, 80).values()}
    last = stages["sentencepiece"](spark, docs, None)
    assert last.columns == ["doc_id", "source", "lang", "ids"] and last.count() == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.where("false"), None).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, "/root/testdata/sf0.001"))
        if name == "ngram_jaccard_join":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == {c for _, c in _components([(r.doc_id, r.text) for r in before.collect()], 5, 80).values()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    codec = sentencepiece_codec.Codec(open(PIECES, "rb").read())
    assert [codec.decode(r.ids) for r in docs.orderBy("doc_id", F.size("ids")).collect()] == [r.text or "" for r in before.orderBy("doc_id", F.length("text")).collect()]


def test_token_queries_match_the_libraries(spark, odd):
    """Through the queries' functions: nulls, empty and long texts, repeated rows, clashing columns, added tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    rows = odd + [(60 + k, t) for k, t in enumerate(_texts()[::6])] + [(None, None), (200, "word " * 3000), (201, "a<|endoftext|>" * 300), (202, "日本" * 900)]
    docs, lib = documents(spark, rows), Tokenizer.from_file(BYTES)
    key = lambda i: -1 if i is None else i
    text = lambda t: (t or "").encode()
    ids = {t: lib.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    for limit in (512, 7):
        got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTES, limit).collect())
        assert got == sorted((key(i), len(text(t)), len(ids[t]), len(ids[t]) > limit) for i, t in rows)
        fit = sorted((key(r.doc_id), r.fit_bytes) for r in token_counts.token_counts(docs, BYTES, limit).collect())
        size = lambda x: len(lib.id_to_token(x)) if x != 50256 else len("<|endoftext|>")  # noqa: E731 a character stands for a byte
        assert fit == sorted((key(i), sum(map(size, ids[t][:limit]))) for i, t in rows)
        cut = sorted((key(r.doc_id), r.text) for r in token_counts.truncated(docs, BYTES, limit).collect())
        assert cut == sorted((key(i), text(t)[: sum(map(size, ids[t][:limit]))].decode(errors="ignore")) for i, t in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(key(i), len(x), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest(), sp.decode(x) == (t or "")) for i, t in rows for x in [sp.encode(t or "")]]
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.round_trip) for r in sentencepiece_codec.digests(docs, PIECES).collect()) == sorted(want)


def test_memo_is_bounded():
    m = bpe.Memo(20_000)
    for k in range(40):
        keys = {"hot", *(f"k{k}x{j}" for j in range(10))}
        m.put(new := m.missing(keys), [b"v"] * len(new))
        assert keys <= m.now.keys() and m.held <= 20_000 and len(m.old) <= 10_000 // m.EACH + len(keys)
    assert "hot" not in m.missing({"hot"})


def test_windows_and_streams_agree():
    b = sentencepiece_codec.Codec(open(PIECES, "rb").read()).bpe
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("▁aetinghsr日\0é") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    counts, ids = b.paths(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[7].tolist() == b.encode(texts[7])
    assert ids.tolist() == [t for x in texts for t in b.encode(x)]
    _, steps, n = b.windows(texts)
    for k, x in enumerate(texts[:50]):
        assert b.prefixes(x) == (n[: len(x) + 1, k].tolist(), steps[: len(x) + 1, k].tolist())
        assert b.prefix_counts(x).tolist() == [len(b.encode(x[:i])) for i in range(len(x) + 1)]
