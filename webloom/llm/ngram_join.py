"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document's row holds its distinct N-word shingles, as 64-bit hashes. Documents of equal sets (by size and a
128-bit sum over the set) are one class, whose smallest doc_id stands for it.

Two sets of sizes x <= y can only be similar if 100 x >= PERCENT y, and if they share a shingle among the
first x - ceil(PERCENT x / 100) + 1 of each in any order that all documents keep. The order here is by hash,
with shingles that many documents share at the end, rarest first. So the product needs only those columns
of each row. It is made by block, a range of shingles: each shingle's documents are paired if their sizes
allow it, and a pair's count of shared columns is added up over all blocks. If the order ends one row's
part first, all of its matches there are counted, so the overlap is at most that count and the rest of the
row: pairs that can't reach the overlap that their sizes ask for are discarded. For the others, each row's
shingles are counted in BINS by hash: two rows share at most the sum of the smaller counts, and pairs for
which that is too little go as well. What is left is compared whole, by their sets.

Of a shingle's documents, by size, one that could be similar to ALL or more of those after it isn't paired with
them: the run of documents that such ones reach is a long list. Some of its documents, a few in each range of
sizes, are compared with all the rest, and the list is kept, together with lists that share at least half of
their documents with it, but not with all that share one: chance would chain these. After components are found,
only documents of such a list that are outside its largest component are compared with the others, DOCS by
DOCS in a product of their whole rows that gives only links between components: none of these is lost, while
pairs inside a component are never made.
A block's long lists are found first: where documents of one list meet again in short runs, only neighbours are
paired, as all other links between them come from the list.

Order: the shingles that are found several times in slices of the input are counted over the whole input;
the FREQUENT most frequent are broadcast (8 bytes each). The order changes the work, never the result.

Null and empty texts, and texts without words, have empty sets and link with nothing. Texts of fewer than N
words have one shingle, all of them. Rows that repeat a doc_id are one document with the links of all. A row
with a null doc_id links like others, as a document of its own for each text; a component of such rows only has
a null component_id. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, free_name, give_back, small_batches, trimmed
from .components import components
from .token_counts import slices, texts_of
from .words import Words, differences, mix, pack, unpack

N, PERCENT = 4, 85
FREQUENT, SEVERAL, ALL, PIVOTS = 1 << 19, 2, 32, 3
#: Texts are handled so many characters at a time; entries of a block of the product.
SLICE, BLOCK = 2 << 20, 3_000_000
#: A block's entries are sorted and paired in 2^PARTS ranges, one after another; its long lists are joined over all of them.
PARTS = 3
#: New pairs of a block that are held before those that repeat are added up; twice as many sums are held.
PAIRS = 1 << 18
#: Rows and columns of the blocks in which the documents of a long list are compared.
DOCS, COLUMNS = 256, 8192
#: Counts of a row's shingles by hash, a byte each.
BINS = 256
_S2 = np.uint64(0xE7037ED1A0B428DB)
#: Rows without an id get ids from here on, by their text.
NAMELESS = 1 << 62


def sets(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, shingles): each text's distinct shingles, sorted."""
    w = Words([t.encode() for t in texts], lower=True)
    h = w.hashes()
    first, key = w.runs(n, 0, h)
    of = w.text[first] if len(first) else np.zeros(0, np.int64)
    few = np.flatnonzero((w.per_text > 0) & (w.per_text < n))
    if len(few):
        start = (np.cumsum(w.per_text) - w.per_text)[few]
        whole = np.array([mix(h[s : s + k] * np.arange(3, 3 + 2 * k, 2, dtype=np.uint64) + np.uint64(k)).sum(dtype=np.uint64) for s, k in zip(start, w.per_text[few])], np.uint64)
        of, key = np.r_[of, few], np.r_[key, whole]
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    if len(key):
        new = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])]
        of, key = of[new], key[new]
    return of, key


def _sets_of_many(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """sets() of any number of texts, made SLICE characters at a time."""
    found, at = [], 0
    for run in slices(texts, SLICE):
        of, key = sets(run, n)
        found.append((of + at, key))
        at += len(run)
    return tuple(map(np.concatenate, zip(*found)))


def _digests(of: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(of, minlength=k)
    total = [np.r_[np.uint64(0), np.cumsum(mix(key ^ s), dtype=np.uint64)] for s in (np.uint64(0), _S2)]
    end = np.cumsum(size)
    return size, *((t[end] - t[end - size]).view(np.int64) for t in total)


def _describe(n: int, often: bool = True):
    """A row for each document and, with often, a row for each shingle that several sets of a slice share."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id"), 0
            for texts in slices(texts_of(b), SLICE):
                of, key = sets(texts, n)
                size, d1, d2 = _digests(of, key, len(texts))
                h = c = np.zeros(0, np.int64)
                if often:
                    _, alone = np.unique(d1, return_index=True)
                    mark = np.zeros(len(texts), bool)
                    mark[alone] = True
                    h, c = np.unique(key[mark[of]], return_counts=True)
                    h, c = h[c >= SEVERAL].view(np.int64), c[c >= SEVERAL]
                k = len(texts)
                none = lambda m: pa.nulls(m, pa.int64())
                both = lambda x, m: pa.concat_arrays([pa.array(x, pa.int64()), none(m)])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([ids.slice(at, k).cast(pa.int64()), none(len(h))]), both(size, len(h)), both(d1, len(h)), both(d2, len(h)), *(pa.concat_arrays([none(k), pa.array(x, pa.int64())]) for x in (h, c))], schema=schema
                )
                at += k

    return run


def _needed(n, percent):
    return (percent * n + 99) // 100


def packed_entries(h: np.ndarray, doc: np.ndarray, size: np.ndarray, block_bits: int) -> list[tuple]:
    """Entries (hash, document, size) as rows (at, part, n, h, doc, size) of packed columns, by block."""
    order = np.argsort(h, kind="stable")
    h, doc, size = h[order], doc[order], size[order].astype(np.uint32)
    part = h >> np.uint64(64 - block_bits - PARTS)
    edges = np.flatnonzero(np.diff(part)) + 1
    return [(*divmod(int(part[x]), 1 << PARTS), int(y - x), pack(differences(h[x:y])), pack(doc[x:y]), pack(size[x:y])) for x, y in zip(np.r_[0, edges], np.r_[edges, len(h)]) if y > x]


def _columns(n: int, percent: int, frequent, block_bits: int):
    """Each slice's entries (shingle, document, size), by block."""
    schema = pa.schema([("at", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("doc", pa.binary()), ("size", pa.binary())])

    def run(batches):
        often, place = frequent.value
        for b in batches:
            ids, at = b.column("doc_id").to_pylist(), 0
            for texts in slices(texts_of(b), SLICE):
                own = ids[at : at + len(texts)]
                at += len(texts)
                of, key = sets(texts, n)
                size = np.bincount(of, minlength=len(texts))
                known = np.array([i is not None for i in own])
                late = np.zeros(len(key), np.int64)
                if len(often):
                    s = np.minimum(np.searchsorted(often, key), len(often) - 1)
                    late = np.where(often[s] == key, place[s] + 1, 0)
                order = np.lexsort((key, late, of))
                start = np.cumsum(size) - size
                rank = np.empty(len(key), np.int64)
                rank[order] = np.arange(len(key)) - start[of[order]]
                use = (rank < (size - _needed(size, percent) + 1)[of]) & known[of]
                rows = packed_entries(key[use], np.array([i or 0 for i in own], np.int64)[of[use]], size[of[use]], block_bits)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, documents and sizes of the entries whose shingle several documents have, in that order."""
    n = table.column("n").to_pylist()
    h, doc, size = (np.empty(sum(n), t) for t in (np.uint64, np.int64, np.uint32))
    at = 0
    for k, x, y, z in zip(n, table.column("h"), table.column("doc"), table.column("size")):
        np.cumsum(unpack(x.as_py(), k, np.uint64), out=h[at : at + k])
        doc[at : at + k] = unpack(y.as_py(), k, np.int64)
        size[at : at + k] = unpack(z.as_py(), k, np.uint32)
        at += k
    order = np.lexsort((doc, size, h))
    h = h[order]
    doc = doc[order]
    size = size[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    same = h[1:] == h[:-1]
    keep = new & (np.r_[False, same] | np.r_[same, False])
    return h[keep], doc[keep], size[keep].astype(np.int64)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("shared", pa.int64()), ("star", pa.bool_()), ("list", pa.int64())])


def _product(percent: int):
    """The product's share of one block: pairs with counts; for long lists, pairs with a few documents, and (list, document) rows as a, na."""

    def product(table: pa.Table) -> pa.Table:
        found, stars, out = [], [], []
        groups: dict[int, dict[int, int]] = {}  # documents of long lists, with sizes
        home: dict[int, int] = {}  # the first group of a document
        summed = {False: 0, True: 0}  # of the pairs held, how many are sums already

        def add_up(rows: list, star: bool, least: int = 0) -> None:
            """Adds up pairs that repeat once there are `least` new ones. Sums are held to the end of the block, unless they are many."""
            if sum(p.shape[1] for p in rows) - summed[star] <= least:
                return
            p = np.concatenate(rows, axis=1)
            rows.clear()
            swap = p[0] > p[1]
            p[:, swap] = p[:, swap][[1, 0, 3, 2, 4]]
            p = p[:, np.lexsort((p[1], p[0]))]
            first = np.flatnonzero(np.r_[True, (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])])
            p = np.concatenate([p[:4, first], np.add.reduceat(p[4:], first, axis=1)])
            if least and p.shape[1] <= 2 * PAIRS:
                rows.append(p)
                summed[star] = p.shape[1]
                return
            summed[star] = 0
            out.append(pa.table([*map(pa.array, p), pa.array([star] * p.shape[1], pa.bool_()), pa.nulls(p.shape[1], pa.int64())], schema=_PAIRS))

        def keep(d: np.ndarray, z: np.ndarray) -> None:
            """Keeps a long list: in the group that at least half of its documents came to first, else in a new one."""
            [(at, known)] = Counter(home[x] for x in d.tolist() if x in home).most_common(1) or [(None, 0)]
            if 2 * known < len(d):
                at = len(groups)
            group = groups.setdefault(at, {})
            for x, y in zip(d.tolist(), z.tolist()):
                group[x] = y
                home.setdefault(x, at)

        def with_pivots(d: np.ndarray, z: np.ndarray) -> None:
            lo = 0
            while lo < len(d):
                hi = int(np.searchsorted(percent * z, 100 * z[lo], side="right"))
                luck = np.argsort(mix(d[lo:hi].view(np.uint64)))[:PIVOTS] + lo
                for p in luck:
                    ok = (100 * np.minimum(z, z[p]) >= percent * np.maximum(z, z[p])) & (d != d[p])
                    m = int(ok.sum())
                    stars.append(np.stack([np.full(m, d[p]), d[ok], np.full(m, z[p]), z[ok], np.ones(m, np.int64)]))
                lo = hi

        def spans(z: np.ndarray) -> tuple[np.ndarray, list]:
            """Sizes ascend: a document may be similar to those after it, up to `end`. Also where long lists begin and end."""
            end = np.searchsorted(percent * z, 100 * z, side="right")
            many = end - np.arange(len(z)) > ALL
            cover = np.zeros(len(z) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(many), 1)
            np.add.at(cover, end[many], -1)
            edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(cover) > 0, 0])).tolist()
            return end, [*zip(edge[::2], edge[1::2])]

        def long_lists(start: np.ndarray, length: np.ndarray, doc: np.ndarray, size: np.ndarray) -> None:
            for s, k in zip(start[length > ALL].tolist(), length[length > ALL].tolist()):
                d, z = doc[s : s + k], size[s : s + k].astype(np.int64)
                for lo, hi in spans(z)[1]:
                    with_pivots(d[lo:hi], z[lo:hi])
                    keep(d[lo:hi], z[lo:hi])
                    add_up(stars, True, PAIRS)

        def pair_up(start: np.ndarray, length: np.ndarray, doc: np.ndarray, size: np.ndarray, own: np.ndarray) -> None:
            """Pairs outside long lists. own: each entry's list, which sees to its links: of its documents only neighbours are paired."""
            size = size.astype(np.int64)

            def pairs(x: np.ndarray, y: np.ndarray) -> None:
                ok = (doc[x] != doc[y]) & ((own[x] != own[y]) | (y == x + 1))
                if ok.any():
                    x, y = x[ok], y[ok]
                    found.append(np.stack([doc[x], doc[y], size[x], size[y], np.ones(len(x), np.int64)]))

            for k in np.unique(length):
                at = start[length == k]
                if k <= ALL:
                    for i in range(k - 1):
                        for j in range(i + 1, k):
                            ok = 100 * size[at + i] >= percent * size[at + j]
                            pairs(at[ok] + i, at[ok] + j)
                        add_up(found, False, PAIRS)
                    continue
                for s in at:
                    end, runs = spans(size[s : s + k])
                    # Pairs outside the runs, also of one document of a run and one after it.
                    begin = np.arange(1, k + 1)
                    for lo, hi in runs:
                        begin[lo:hi] = hi
                    made = np.maximum(end - begin, 0)
                    x = np.repeat(np.arange(k), made)
                    y = begin[x] + np.arange(len(x)) - np.repeat(np.cumsum(made) - made, made)
                    pairs(s + x, s + y)
                    add_up(found, False, PAIRS)

        # All long lists of the block come first.
        part, parts = table.column("part").to_numpy(), []
        for k in np.unique(part):
            h, doc, size = _shared(table.filter(pa.array(part == k)))
            if len(h):
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                parts.append((start, np.diff(np.r_[start, len(h)]), doc, size.astype(np.uint32)))
                long_lists(*parts[-1])
        lists: dict[int, dict[int, int]] = {}  # by their smallest documents
        for group in groups.values():
            lists.setdefault(min(group), {}).update(group)
        least_of = {at: min(group) for at, group in groups.items()}
        listed = np.array(sorted(home), np.int64)
        of_list = np.array([least_of[home[x]] for x in listed.tolist()], np.int64)
        groups.clear()
        home.clear()
        for start, length, doc, size in parts:
            own = -1 - np.arange(len(doc))
            if len(listed):
                at = np.minimum(np.searchsorted(listed, doc), len(listed) - 1)
                own = np.where(listed[at] == doc, of_list[at], own)
            pair_up(start, length, doc, size, own)
        for rows, star in ((found, False), (stars, True)):
            if rows:
                summed[star] = 0
                add_up(rows, star)
        for least, group in lists.items():
            m = len(group)
            out.append(pa.table([pa.array(list(group), pa.int64()), pa.nulls(m, pa.int64()), pa.array(list(group.values()), pa.int64()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_())), pa.array([least] * m, pa.int64())], schema=_PAIRS))
        return pa.concat_tables(out) if out else _PAIRS.empty_table()

    def run(table: pa.Table) -> pa.Table:
        try:
            return product(table)
        finally:
            give_back()

    return run


def _counts(n: int):
    """A row's size and its counts by bin; null where a count doesn't fit a byte."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bins", pa.binary())])

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id"), 0
            for texts in slices(texts_of(b), SLICE):
                of, key = sets(texts, n)
                k = len(texts)
                counts = np.bincount(of * BINS + (key % np.uint64(BINS)).astype(np.int64), minlength=k * BINS).reshape(k, BINS)
                fits = counts.max(1) < 256
                bins = [c.tobytes() if f else None for c, f in zip(counts.astype(np.uint8), fits)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, k), pa.array(np.bincount(of, minlength=k), pa.int64()), pa.array(bins, pa.binary())], schema=schema)
                at += k

    return run


def _possible(percent: int):
    """Keeps the pairs whose counts by bin allow the overlap that their sizes ask for."""

    def run(batches):
        for b in batches:
            left, right = b.column("ba").to_pylist(), b.column("bb").to_pylist()
            known = np.array([x is not None and y is not None for x, y in zip(left, right)], bool)
            x, y = (np.frombuffer(b"".join(v for v, k in zip(side, known) if k), np.uint8).reshape(-1, BINS) for side in (left, right))
            sizes = b.column("na").to_numpy() + b.column("nb").to_numpy()
            good = ~known
            good[known] = (100 + percent) * np.minimum(x, y).sum(1, dtype=np.int64) >= percent * sizes[known]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _similar(n: int, percent: int):
    """Keeps the pairs whose whole sets are similar."""

    def run(batches):
        for b in batches:
            left, right = b.column("ta").to_pylist(), b.column("tb").to_pylist()
            good = []
            both = [x for pair in zip(left, right) for x in pair]
            at = 0
            while at < len(both):
                end, room = at, SLICE
                while end < len(both) and (end == at or room > 0):
                    room -= len(both[end] or "") + len(both[end + 1] or "")
                    end += 2
                texts, at = [t or "" for t in both[at:end]], end
                of, key = sets(texts, n)
                ends = np.searchsorted(of, np.arange(len(texts) + 1))
                for k in range(0, len(texts), 2):
                    x, y = key[ends[k] : ends[k + 1]], key[ends[k + 1] : ends[k + 2]]
                    small, big = (x, y) if len(x) <= len(y) else (y, x)
                    i = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum()) if len(small) else 0
                    good.append(i > 0 and 100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _overlaps(x: tuple, kx: int, y: tuple, ky: int) -> np.ndarray:
    """The product of two blocks of rows: shared shingles of each pair, added up COLUMNS columns at a time."""
    both = np.intersect1d(x[1], y[1])
    out = np.zeros((kx, ky), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo : lo + COLUMNS]
        sides = []
        for (of, key), k in ((x, kx), (y, ky)):
            at = np.minimum(np.searchsorted(part, key), len(part) - 1)
            hit = part[at] == key
            m = np.zeros((k, len(part)), np.float32)
            m[of[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _cell(n: int, percent: int):
    """Links between a block of documents outside their list's largest component and a block of the list; only those that join components that the cell has not joined yet."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (dx, cx, x), (dy, cy, y) = ((t.column("doc").to_pylist(), t.column("component").to_pylist(), _sets_of_many(t.column("text").to_pylist(), n)) for t in (left, right))
        sx, sy = np.bincount(x[0], minlength=len(dx)), np.bincount(y[0], minlength=len(dy))
        shared = _overlaps(x, len(dx), y, len(dy)).astype(np.int64)
        near = (shared > 0) & (100 * shared >= percent * (sx[:, None] + sy[None, :] - shared))
        joined: dict[int, int] = {}

        def root(c):
            while joined.setdefault(c, c) != c:
                c = joined[c]
            return c

        out = []
        for i, j in zip(*(v.tolist() for v in np.nonzero(near))):
            p, q = root(cx[i]), root(cy[j])
            if p != q:
                joined[p] = q
                out.append((dx[i], dy[j]))
        return pa.table(list(map(list, zip(*out))) if out else [[]] * 2, schema=schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return cell(left, right)
        finally:
            give_back()

    return run


def _rows_of(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    ids = scratch.write(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    return docs.join(few(ids), "doc_id", "left_semi").select("doc_id", "text")


def _sided(table: DataFrame, side: str, names: dict) -> DataFrame:
    return table.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{x}{side}") for c, x in names.items()))


class Columns:
    """Candidates by the product's columns and counts by bin. A method gives the product's entries, and what may be similar of its pairs."""

    often = True

    def __init__(self, n: int, percent: int, block: int = BLOCK):
        self.n, self.percent, self.block = n, percent, block

    def entries(self, alone: DataFrame, described: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        often = described.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
        by_count = often.sort_values(["c", "h"])["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(by_count)
        frequent = scratch.spark.sparkContext.broadcast((by_count[order], order))
        entries = (classes.agg(F.sum(F.col("n") * (100 - self.percent) / 100 + 1).alias("e")).first().e or 0) // self.block
        return alone.mapInArrow(trimmed(_columns(self.n, self.percent, frequent, int(entries).bit_length())), "at long, part long, n long, h binary, doc binary, size binary")

    def possible(self, product: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """a, b"""
        pairs = product.where("b is not null").groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("na", "nb", "star")), F.sum("shared").alias("shared"))
        asked = F.expr(f"({self.percent} * (na + nb) + {99 + self.percent}) div {100 + self.percent}")
        rest = F.greatest(*(F.expr(f"({self.percent} * {c} + 99) div 100 - 1") for c in ("na", "nb")))
        pairs = scratch.write(pairs.where(F.col("star") | (F.col("shared") + rest >= asked)).select("a", "b"))
        counts = scratch.write(_rows_of(pairs, docs, scratch).mapInArrow(trimmed(_counts(self.n)), "doc_id long, n long, bins binary"))
        both = pairs
        for side in ("a", "b"):
            both = both.join(_sided(counts, side, {"n": "n", "bins": "b"}), side)
        pairs = scratch.write(both.mapInArrow(trimmed(_possible(self.percent)), "a long, b long").distinct())
        scratch.drop(counts)
        return pairs


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    texts, both = scratch.write(_rows_of(pairs, docs, scratch)), pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(_sided(texts, side, {"text": "t"}), side)
    links = scratch.write(both.mapInArrow(trimmed(_similar(n, percent)), "a long, b long").distinct())
    scratch.drop(texts)
    return links


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, method=None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    scratch, method = Scratch(docs.sparkSession, "ngram"), method or Columns(n, percent, block)
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS >> 1))
    docs = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc_id"), "text")
    described = scratch.write(docs.mapInArrow(trimmed(_describe(n, method.often)), "doc_id long, n long, d1 long, d2 long, h long, c long"))
    rows = described.where("n is not null").select("doc_id", "n", "d1", "d2")
    classes = scratch.write(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")))
    # Copies of a class are left out of the product, but for ids that also stand for a class.
    several = classes.where("m > 1").drop("m")
    copies = rows.join(several, ["n", "d1", "d2"]).where("doc_id != rep").select("doc_id").distinct()
    copies = scratch.write(copies.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    alone = docs.join(few(copies), "doc_id", "left_anti")
    product = scratch.write(method.entries(alone, described, classes, scratch).groupBy("at").applyInArrow(_product(percent), "a long, b long, na long, nb long, shared long, star boolean, list long"))
    links = _verified(method.possible(product, docs, scratch), docs, scratch, n, percent)
    scratch.drop(copies)
    # Rows that repeat a doc_id with another text tie their classes.
    ties = rows.where("n > 0").join(classes.drop("m"), ["n", "d1", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    edges = scratch.write(links.unionByName(ties))
    found = components(edges, scratch)
    lists = scratch.write(product.where("list is not null").select("list", F.col("a").alias("doc"), F.col("na").alias("size")).distinct().join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    parts = lists.groupBy("list", "component").agg(F.count("*").alias("m")).groupBy("list").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.sum("m").alias("k"), F.max("m").alias("most"), F.count("*").alias("parts"))
    blocks = lambda c: F.ceil(c / DOCS).cast("int")
    several = parts.where("parts > 1").select("list", "top", blocks(F.col("k")).alias("nb"), blocks(F.col("k") - F.col("most")).alias("no"))
    members = scratch.write(lists.join(several, "list"))
    scratch.drop(lists)
    scratch.drop(product)
    if members.limit(1).count():
        ids = scratch.write(members.select(F.col("doc").alias("doc_id")).distinct())
        texts = docs.join(few(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text")
        held = scratch.write(members.join(texts, "doc"))
        place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        odd = held.where("component != top").select("list", place("no").alias("i"), every("nb").alias("j"), "doc", "component", "text")
        against = held.select("list", place("nb").alias("j"), every("no").alias("i"), "doc", "component", "text")
        cell = ["list", "i", "j"]
        more = odd.groupBy(*cell).cogroup(against.groupBy(*cell)).applyInArrow(_cell(n, percent), "a long, b long")
        edges = edges.unionByName(scratch.write(more.distinct()))
        found = components(edges, scratch)
        scratch.drop(held)
    # Only classes in a component of several, or with several rows, say more than a row's own id.
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    named = scratch.write(named.where("m > 1 or component_id != rep").select("n", "d1", "d2", "component_id"))
    out = rows.join(named, ["n", "d1", "d2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    real = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is their component's; rows without an id or words stay. All columns, whatever their names."""
    own = free_name(docs.columns, "gone")
    gone = linked(docs, **how).where("component_id != doc_id").select(F.col("doc_id").alias(own)).distinct()
    gone = Scratch(docs.sparkSession, "gone").write(gone)
    return docs.join(few(gone), docs["doc_id"] == F.col(own), "left_anti")
