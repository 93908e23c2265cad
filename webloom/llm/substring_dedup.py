"""Substring dedup: repeated windows of WINDOW words by a count-min prefilter and an exact second pass.

Documents too short for a window, nulls among them, are read where they are. The others are dealt into chunks of
about CHUNK bytes, and of about ROWS rows at most, by a hash of id, text and the partition that they come from, so
that rows of a null or repeated id, or of the same text, spread too.

1. Each chunk makes its partition sketch: for each of DEPTH hash rows, which cells its windows fall in, and
   whether from one document or more (counts stop at two). A sketch is sparse, so a chunk sends sorted cells
   as differences, about two bytes a window and row, whatever the width; the width is SPARE cells for each
   window of the whole input, so the share of false alarms doesn't grow with the data.
2. Cells come together by block, a range of cells: counts are added, and each chunk gets back a bit for each
   of its cells that says whether the sum is two or more. That overestimates: a window that is in two
   documents can't have a lower count in any row, so none is lost.
3. Each chunk sends the windows whose least estimate is two or more, with two independent 64-bit hashes of
   all words and the smallest doc_id that it knows. They are grouped exactly by those 128 bits; a chunk
   learns which of its windows start in a smaller document elsewhere.
4. Each chunk marks the words that such windows cover, or windows with a smaller document of its own.

A window that is in a third of all documents is one row of 28 bytes for each chunk in step 3, and chunks are even:
that is the largest group there is, and it grows with the number of chunks. Texts are shuffled once: all three passes over chunks read the same exchange.

Null texts have no words. Null doc_ids count as smaller than all others. Rows of one doc_id are one
document, and their windows don't repeat each other. Texts of fewer words than WINDOW stay whole. Very long
texts are read whole. Tables without rows give none. Only doc_id and text are read, whatever other columns
are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import Words, differences, mix, pack, unpack

WINDOW, CHUNK, ROWS, DEPTH, SPARE, BLOCK = 50, 4 << 20, 1 << 16, 2, 4, 4 << 20
_ROW = (np.uint64(0), np.uint64(0x632BE59BD9B4E019), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D))


class _Chunk:
    """The windows of a chunk's documents, in order of doc_id."""

    def __init__(self, table: pa.Table, window: int):
        ids = [-(1 << 63) if i is None else i for i in table.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.rows = order
        self.texts = [(table.column("text")[k].as_py() or "").encode() for k in order]
        self.ids = np.array([ids[k] for k in order], np.int64)
        # Rows of the same doc_id are the same document.
        self.doc = np.cumsum(np.r_[0, self.ids[1:] != self.ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.first_row = np.searchsorted(self.doc, np.arange(len(self.doc) and self.doc[-1] + 1))
        self.words = Words(self.texts)
        self.first, self.key = self.words.runs(window)
        self.window_doc = self.doc[self.words.text[self.first]] if len(self.first) else np.zeros(0, np.int64)
        # Numbers of documents that have windows, however many have none: they share 64 bits with a cell.
        self.number = np.cumsum(np.r_[0, self.window_doc[1:] != self.window_doc[:-1]]) if len(self.first) else self.window_doc
        if len(self.number) and self.number[-1] >> 20:
            raise ValueError("a chunk has more than 2^20 documents with windows: choose a smaller chunk")

    def second(self, window: int) -> np.ndarray:
        return self.words.runs(window, 1)[1]

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct cells, whether several documents fall in each, each window's place among them)."""
        cell = mix(self.key + _ROW[row]) >> np.uint64(64 - bits)
        both = (cell << np.uint64(20)) | self.number.astype(np.uint64)
        both.sort()
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        of = both >> np.uint64(20)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        several = np.diff(np.r_[start, len(of)]) > 1
        return of[start], several, np.searchsorted(of[start], cell)


def _sketch(window, depth, bits, block_bits):
    def run(table: pa.Table) -> pa.Table:
        c, out = _Chunk(table, window), []
        for r in range(depth):
            cells, several, _ = c.cells(r, bits)
            block = cells >> np.uint64(bits - block_bits)
            edges = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(cells)]):
                if b > a:
                    out.append(((r << block_bits) | int(block[a]), table.column("chunk")[0].as_py(), int(b - a), pack(differences(cells[a:b])), pack(np.packbits(several[a:b]))))
        return pa.table(list(map(list, zip(*out))) if out else [[]] * 5, schema=pa.schema([("at", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), ("several", pa.binary())]))

    return run


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(b, (n + 7) // 8, np.uint8), count=n).astype(bool)


def _merge(table: pa.Table) -> pa.Table:
    """Adds up one block of all sketches."""
    n = table.column("n").to_pylist()
    cells = [np.cumsum(unpack(b.as_py(), k, np.uint64)) for b, k in zip(table.column("cells"), n)]
    several = [_bits(b.as_py(), k) for b, k in zip(table.column("several"), n)]
    all_cells = np.concatenate(cells)
    values, count = np.unique(all_cells, return_counts=True)
    often = values[count > 1]
    out = []
    for c, s in zip(cells, several):
        at = np.searchsorted(often, c)
        found = (often[np.minimum(at, len(often) - 1)] == c) if len(often) else np.zeros(len(c), bool)
        out.append(pack(np.packbits(found | s)))
    return pa.table([table.column("chunk"), table.column("at"), table.column("n"), pa.array(out, pa.binary())], ["chunk", "at", "n", "bits"])


def _candidates(window, depth, bits, key_bits):
    """Windows whose estimate is two or more in all rows: the first in the chunk of each word sequence."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        schema = pa.schema([("at", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("key1", pa.binary()), ("key2", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])
        if not table.num_rows:
            return schema.empty_table()
        c, out = _Chunk(table, window), []
        keep = np.ones(len(c.first), bool)
        rows = sorted(zip(*(found.column(x).to_pylist() for x in ("at", "n", "bits"))))
        said = [np.zeros(0, bool)] + [_bits(b, n) for _, n, b in rows]
        said, at = np.concatenate(said), 0
        for r in range(depth):
            cells, _, place = c.cells(r, bits)
            keep &= said[at : at + len(cells)][place]
            at += len(cells)
        k = np.flatnonzero(keep)
        key, second = c.key[k], c.second(window)[k]
        order = np.lexsort((k, second, key))  # windows are in order of doc_id
        k, key, second = k[order], key[order], second[order]
        if len(k):
            new = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
            k, key, second = k[new], key[new], second[new]
        doc = c.ids[c.first_row[c.window_doc[k]]] if len(k) else np.zeros(0, np.int64)
        block = key >> np.uint64(64 - key_bits) if key_bits else np.zeros(len(key), np.uint64)
        edges = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(k)]):
            if b > a:
                out.append((int(block[a]), table.column("chunk")[0].as_py(), int(b - a), pack(differences(key[a:b])), second[a:b].tobytes(), pack(doc[a:b]), pack(k[a:b].astype(np.uint32))))
        return pa.table(list(map(list, zip(*out))) if out else [[]] * 7, schema=schema)

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Groups windows exactly; gives each chunk the places of those that start in a smaller document."""
    n = table.column("n").to_pylist()
    key = np.concatenate([np.cumsum(unpack(b.as_py(), k, np.uint64)) for b, k in zip(table.column("key1"), n)])
    second = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("key2")])
    doc = np.concatenate([unpack(b.as_py(), k, np.int64) for b, k in zip(table.column("doc"), n)])
    order = np.lexsort((doc, second, key))
    key, second, sorted_doc = key[order], second[order], doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
    least = sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(doc), bool)
    later[order] = least < sorted_doc
    out, ends = [], np.cumsum(n)
    for chunk, k, b, end in zip(table.column("chunk").to_pylist(), n, table.column("place"), ends):
        places = np.sort(unpack(b.as_py(), k, np.uint32)[later[end - k : end]])
        if len(places):
            out.append((chunk, len(places), pack(differences(places))))
    return pa.table(list(map(list, zip(*out))) if out else [[]] * 3, schema=pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("places", pa.binary())]))


def _covered(c: _Chunk, window: int, places: np.ndarray) -> np.ndarray:
    """Which words to remove. places: windows that start in a smaller document of another chunk."""
    later = np.zeros(len(c.first), bool)
    if len(c.first):
        second = c.second(window)
        order = np.lexsort((second, c.key))  # stable: of equal windows the first is of the smallest document
        key, second = c.key[order], second[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
        group = np.cumsum(new) - 1
        least = c.window_doc[order][np.flatnonzero(new)]
        told = np.zeros(len(c.first), bool)
        told[places] = True
        known = np.zeros(len(least), bool)
        known[group[told[order]]] = True
        later[order] = (c.window_doc[order] > least[group]) | known[group]
    change = np.zeros(len(c.words.start) + 1, np.int64)
    np.add.at(change, c.first[later], 1)
    np.add.at(change, c.first[later] + window, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(window: int, texts: bool, id_type: pa.DataType):
    fields = [("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()) if texts else ("kept_sha256", pa.string())]

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(fields).empty_table()
        c = _Chunk(table, window)
        places = [np.cumsum(unpack(b.as_py(), n, np.uint32)) for b, n in zip(found.column("places"), found.column("n").to_pylist())]
        gone = _covered(c, window, np.concatenate(places) if places else np.zeros(0, np.int64))
        ends = np.cumsum(c.words.per_text)
        removed, kept = [], []
        for text, n, end in zip(c.texts, c.words.per_text.tolist(), ends.tolist()):
            g = gone[end - n : end]
            k = int(g.sum())
            words = text.split()
            left = b" ".join([w for w, x in zip(words, g.tolist()) if not x] if k else words)
            removed.append(k)
            kept.append(left.decode() if texts else hashlib.sha256(left).hexdigest())
        ids = table.column("doc_id").combine_chunks().take(pa.array(c.rows))
        return pa.table([ids, pa.array(c.words.per_text, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=pa.schema(fields))

    return run


def _untouched(window: int, texts: bool):
    """For mapInArrow: _kept() of documents without windows."""

    def run(batches):
        kept = _kept(window, texts, pa.int64())
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["n", "places"])
        for b in batches:
            if b.num_rows:
                yield from kept(pa.Table.from_batches([b]), none).to_batches()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, chunk: int = CHUNK, depth: int = DEPTH, spare: int = SPARE, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, or with texts the kept words joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A window is at least as many characters as words, and the spaces between.
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= 2 * window - 1
    out = f"doc_id long, n_words long, n_removed long, {'kept' if texts else 'kept_sha256'} string"
    short = small_batches(docs.where(~long)).mapInArrow(_untouched(window, texts), out)
    docs = docs.where(long)
    total = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows")).first()
    size = total.size or 0
    windows = max(1024, size // 6)
    bits = min(44, (spare * windows - 1).bit_length())
    block_bits = max(0, (windows // block).bit_length()) if windows > block else 0
    chunks = max(size // chunk, total.rows // rows) + 1
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("long").alias("chunk"), "doc_id", "text")
    by_chunk = lambda df: df.groupBy("chunk")
    sketch = by_chunk(dealt).applyInArrow(_sketch(window, depth, bits, block_bits), "at long, chunk long, n long, cells binary, several binary")
    often = sketch.groupBy("at").applyInArrow(_merge, "chunk long, at long, n long, bits binary")
    keys = by_chunk(dealt).cogroup(by_chunk(often)).applyInArrow(_candidates(window, depth, bits, block_bits), "at long, chunk long, n long, key1 binary, key2 binary, doc binary, place binary")
    later = keys.groupBy("at").applyInArrow(_smallest, "chunk long, n long, places binary")
    return by_chunk(dealt).cogroup(by_chunk(later)).applyInArrow(_kept(window, texts, pa.int64()), out).unionByName(short)
