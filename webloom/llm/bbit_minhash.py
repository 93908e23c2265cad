"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct N-word shingles, as 64-bit hashes. Of BANDS * ROWS hash functions of a shingle
the minimum over the set is taken for each: two sets agree in one with a probability that is their similarity.
The minima of ROWS functions are a band; documents that agree in a whole band are candidates. Of each minimum only
BITS low bits are retained, after mixing, and packed into a signature of BANDS * ROWS * BITS bits. Two different
minima agree in these with probability 2^-BITS, so the similarity of two candidates is estimated from the share of
fields that agree, counted as bits of the signatures' difference, and corrected for such collisions. Candidates
that are estimated SIGMAS standard deviations below the limit, or more, go. All others are confirmed on full sets.

Equal sets are one class, which has one row in the bands. A run of a band's documents by size, in which one could
be similar to ngram_join.ALL others or more, isn't expanded into all pairs: some of its documents are compared with
all the rest, and after components are found, those outside its largest component with all others, in blocks (ngram_join). So a group of thousands of
near copies costs its size times its bands, and none of its links is lost.

What chance can lose: a pair at the limit of 80 % misses all bands with probability (1 - 0.8^4)^50 = 4e-12, and is
estimated too low with 1e-12; more similar ones with less. Everything else is exact.

Null and empty texts, and texts without words, have empty sets and link with nothing. Texts of fewer than N words
have one shingle, all of them. Rows that repeat a doc_id are one document with the links of all; those without an
id are documents by their texts. Very long texts are read whole. Tables without rows give none. Only doc_id and
text are read, whatever the other columns' names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed
from .ngram_join import BLOCK, SLICE, _sided, linked, packed_entries, sets
from .token_counts import slices, texts_of
from .words import mix

N, PERCENT = 2, 80
BANDS, ROWS, BITS, SIGMAS = 50, 4, 4, 7.0
#: An odd factor for each function, from a fixed seed.
_FACTORS = np.random.default_rng(13).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: The lowest bit of each field of BITS bits in 64.
_LOWEST = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def minima(of: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, a row for each function with the minima of these texts). of: sorted."""
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    out = np.empty((len(_FACTORS), len(start)), np.uint64)
    held = np.empty_like(key)
    for k, a in enumerate(_FACTORS):
        np.multiply(key, a, out=held)
        if len(start):
            np.minimum.reduceat(held, start, out=out[k])
    return of[start], out


def signatures(low: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words that hold BITS bits of each of a text's minima."""
    per = 64 // BITS
    field = mix(low) & np.uint64((1 << BITS) - 1)
    field = np.concatenate([field, np.zeros((-len(field) % per, field.shape[1]), np.uint64)]).reshape(-1, per, field.shape[1])
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.ascontiguousarray(np.bitwise_or.reduce(field << shift, axis=1).T)


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The similarity of each pair of signatures, corrected for fields that agree by chance."""
    d = x ^ y
    for k in range(1, BITS):
        d = d | ((x ^ y) >> np.uint64(k))
    other = np.bitwise_count(d & _LOWEST).sum(1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - other / len(_FACTORS) - chance) / (1 - chance)


def least(percent: int) -> float:
    """The estimate below which a pair of that similarity practically never is."""
    s, chance = percent / 100, 2.0**-BITS
    p = s + (1 - s) * chance
    return s - SIGMAS * (p * (1 - p) / len(_FACTORS)) ** 0.5 / (1 - chance)


_HASHED = pa.schema([("at", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("doc", pa.binary()), ("size", pa.binary()), ("doc_id", pa.int64()), ("signature", pa.binary())])


def _hashed(n: int, block_bits: int):
    """Rows of packed entries (band, document, size), by block; and a row for each document with its signature."""

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id").to_numpy(zero_copy_only=False), 0
            for texts in slices(texts_of(b), SLICE):
                own = ids[at : at + len(texts)]
                at += len(texts)
                of, key = sets(texts, n)
                who, low = minima(of, key)
                doc, size = own[who], np.bincount(of, minlength=len(texts))[who]
                bands = np.zeros((BANDS, len(who)), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
                for k in range(ROWS):
                    bands = mix(bands ^ low[k::ROWS])
                rows = packed_entries(bands.ravel(), np.tile(doc, BANDS), np.tile(size, BANDS), block_bits)
                packed = [x.tobytes() for x in signatures(low)]
                columns = [*map(list, zip(*rows))] if rows else [[]] * 6
                k = len(who)
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(c, t), pa.nulls(k, t)]) for c, t in zip(columns, _HASHED.types)), pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(doc, pa.int64())]), pa.concat_arrays([pa.nulls(len(rows), pa.binary()), pa.array(packed, pa.binary())])], schema=_HASHED)

    return run


def _near(percent: int):
    """Keeps the pairs whose estimate allows the similarity."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            good = estimates(x, y) >= least(percent) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class Bands:
    """Candidates by bands and signatures, for ngram_join.linked."""

    often = False

    def __init__(self, n: int, percent: int, block: int = BLOCK):
        self.n, self.percent, self.block = n, percent, block

    def entries(self, alone: DataFrame, described: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
        bits = int(classes.count() * BANDS // self.block).bit_length()
        self.hashed = scratch.write(alone.mapInArrow(trimmed(_hashed(self.n, bits)), "at long, part long, n long, h binary, doc binary, size binary, doc_id long, signature binary"))
        return self.hashed.where("at is not null").drop("doc_id", "signature")

    def possible(self, product: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
        pairs = scratch.write(product.where("b is not null").select("a", "b").distinct())
        signed = self.hashed.where("signature is not null").select("doc_id", "signature")
        # An id that repeats with another text has several signatures: any may be near.
        for side in ("a", "b"):
            pairs = pairs.join(_sided(signed, side, {"signature": "s"}), side)
        near = scratch.write(pairs.mapInArrow(trimmed(_near(self.percent)), "a long, b long").distinct())
        scratch.drop(self.hashed)
        return near


def near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    found = linked(docs, n, percent, method=Bands(n, percent, block))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
