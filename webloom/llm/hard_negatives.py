"""Hard negatives by norm-bucketed search for the largest inner products.

Components become integers, floor(SCALE x), and a row's score is its inner product with the anchor, exactly.
The candidates are sorted by norm, in ranges, and cut into buckets of at most BUCKET rows: for positives, the
rows of a label, for negatives all rows. Buckets are dealt to stripes of STRIPE buckets, and anchors to blocks
of ANCHORS; each task has one stripe and one block. It walks through its buckets from the longest vectors on.
By Cauchy and Schwarz no score in a bucket is above the anchor's norm times the bucket's largest: an anchor
skips a bucket if that is below the lower limit of its window, or below the k-th best score it has so far.
For a bucket that isn't skipped, scores are one matrix product. What a task keeps is k rows for each window,
and the best of these over all stripes are the result, so nothing is lost to the bounds.

First each anchor's POSITIVES best rows of its label are found. Each of these makes a window of scores, from
LOW to HIGH hundredths of its own; then the K best rows of other labels within each window. A positive of a
negative score has an empty window; one of score 0 takes negatives of score 0.

The rows of an anchor's result are few; a label that a third of all rows have is only more buckets, and many
equal vectors are spread over buckets by their ids. Anchors are asked against all rows, in blocks: that is the
work, and buckets skipped are what saves of it. Where all norms are equal, only the limits save any.

Rows take no part if the id, label or vector is null, or the vector has a component that is null or not finite;
empty vectors have scores of 0 with each other. Rows that repeat an id are one, the least by label, then by components. Vectors of another
number of components are compared among themselves. Components beyond LARGEST after scaling, whose scores
might not fit a long, raise an error. Ties go to the smaller id. Tables without rows give none. Columns other
than the id, label and vector are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE, POSITIVES, K, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a bucket, buckets of a stripe, anchors of a block.
BUCKET, STRIPE, ANCHORS = 4096, 8, 1024
#: Scores that are held at a time.
HELD = 1 << 21
#: Of a component after scaling: inner products of 2^10 such components fit a long.
LARGEST = 1 << 26
_NONE = -(1 << 62)


def _rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, label: Column | None, scale: int) -> DataFrame:
    """dim, id, label, q, norm2 of the rows that take part."""
    v = F.col(vector_col)
    label = F.col(label_col) if label is None else label
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists(v, lambda x: F.abs(x.cast("double") * scale) > LARGEST)
    whole = F.when(far, F.raise_error(F.lit(f"a component is larger than {LARGEST // scale}")).cast("array<int>")).otherwise(F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(v.isNotNull() & ~odd, whole).alias("q"))
    rows = rows.where("id is not null and label is not null and q is not null").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.*")
    norm2 = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    return rows.select(F.size("q").alias("dim"), "id", "label", "q", norm2.alias("norm2"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of integers as doubles, which hold products of up to 2^53 exactly."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


_BUCKET = "dim int, label long, bucket long, top long, ids binary, labels binary, rows binary"


def buckets(rows: DataFrame, by_label: bool, n: int, size: int = BUCKET) -> DataFrame:
    """Rows of packed vectors, those of a bucket near each other in norm. label is 0 unless by_label; n: the number of rows."""
    key = ["dim", *(["label"] if by_label else [])]
    order = [*key, F.desc("norm2"), "id"]
    # The id makes ranges of equal vectors.
    ranges = rows.repartitionByRange(max(1, -(-n // (size * STRIPE))), *order).sortWithinPartitions(*order)
    kind = pa.schema([("dim", pa.int32()), ("label", pa.int64()), ("bucket", pa.int64()), ("top", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary())])

    def run(batches):
        made, held = TaskContext.get().partitionId() << 32, []

        def packed(rows: pa.Table):
            nonlocal made
            dim = rows.column("dim")[0].as_py()
            q = rows.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(rows.num_rows, dim)
            ids, labels, norm2 = (rows.column(c).to_numpy() for c in ("id", "label", "norm2"))
            at = np.argsort(ids)  # so that the first of equal scores has the smallest id
            made += 1
            row = [dim, int(labels[0]) if by_label else 0, made, int(norm2.max()), ids[at].tobytes(), labels[at].tobytes(), q[at].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kind.types)], schema=kind)

        def cut(rows: pa.Table, last: bool):
            """Full buckets, and with last those that aren't; (buckets, what is left)."""
            out, lo, ends = [], 0, np.zeros(max(0, rows.num_rows - 1), bool)
            for c in key:
                x = rows.column(c).to_numpy()
                ends |= x[1:] != x[:-1]
            for hi in [*(np.flatnonzero(ends) + 1).tolist(), rows.num_rows]:
                while lo < hi and (hi - lo >= size or hi < rows.num_rows or last):
                    out.append(packed(rows.slice(lo, min(size, hi - lo))))
                    lo = min(hi, lo + size)
            return out, rows.slice(lo)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= size:
                out, rest = cut(pa.concat_tables(held), False)
                yield from out
                held = [rest]
        if held:
            yield from cut(pa.concat_tables(held), True)[0]

    return ranges.mapInArrow(run, _BUCKET)


def top(asked: pa.Table, stripe: pa.Table, k: int, by_label: bool) -> tuple[pa.Table, int]:
    """(anchor, window, id, score of each window's k best in the stripe; pairs of an anchor and a bucket that were skipped).

    asked: id, label, norm2, q, and arrays low and high, the windows of each anchor.
    """
    n, dim = asked.num_rows, stripe.column("dim")[0].as_py()
    a = _matrix(asked.column("q"), dim)
    own, labels, norm = asked.column("id").to_numpy(), asked.column("label").to_numpy(), np.sqrt(asked.column("norm2").to_numpy().astype(np.float64))
    windows = max(len(x) for x in asked.column("low").to_pylist())
    low, high = (np.array([[*x, *[fill] * (windows - len(x))] for x in asked.column(c).to_pylist()], np.int64) for c, fill in (("low", 1 << 62), ("high", _NONE)))
    best = np.full((n, windows, k), _NONE, np.int64)
    ids = np.zeros((n, windows, k), np.int64)
    skipped = 0
    for x in sorted(stripe.to_pylist(), key=lambda r: (-r["top"], r["bucket"])):
        cand, of = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
        m = np.frombuffer(x["rows"], np.int32).reshape(len(cand), dim).astype(np.float64)
        exact = float(np.abs(m).max(initial=0)) * float(np.abs(a).max(initial=0)) * m.shape[1] < 2.0**53
        # A little above what it is, as the roots are rounded.
        bound = norm * np.sqrt(float(x["top"])) * (1 + 1e-9) + 1
        least = np.maximum(low, best[:, :, -1])
        use = np.flatnonzero((bound[:, None] >= least).any(1))
        skipped += n - len(use)
        for lo in range(0, len(use), max(1, HELD // len(cand))):
            at = use[lo : lo + max(1, HELD // len(cand))]
            s = (a[at] @ m.T).astype(np.int64) if exact else a[at].astype(np.int64) @ m.astype(np.int64).T
            s[(labels[at][:, None] == of) != by_label] = _NONE
            if by_label:
                s[own[at][:, None] == cand] = _NONE
            for w in range(windows):
                part = np.where((s >= least[at, w][:, None]) & (s <= high[at, w][:, None]), s, _NONE)
                rows = np.flatnonzero(part.max(1) > _NONE)
                if not len(rows):
                    continue
                part, on = part[rows], at[rows]
                found, who = np.empty((2, len(rows), k), np.int64)
                for j in range(k):
                    first = part.argmax(1)  # the smallest id of equal scores
                    found[:, j], who[:, j] = part[np.arange(len(rows)), first], cand[first]
                    part[np.arange(len(rows)), first] = _NONE
                both, whose = np.concatenate([best[on, w], found], 1), np.concatenate([ids[on, w], who], 1)
                order = np.lexsort((whose, -both), axis=1)[:, :k]
                best[on, w], ids[on, w] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)
    i, w, j = np.nonzero(best > _NONE)
    return pa.table({"anchor": own[i], "window": w, "id": ids[i, w, j], "score": best[i, w, j]}, schema=_TOP), skipped


_TOP = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _best(asked: DataFrame, packed: DataFrame, scratch: Scratch, k: int, by_label: bool) -> DataFrame:
    """anchor, window, id, score, rank: the k best of each window over all buckets of the anchor's key."""
    key = ["dim", *(["label"] if by_label else [])]
    stripes = packed.groupBy(*key).agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes"))
    blocks = asked.groupBy(*key).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("blocks"))
    # A row for each label at most.
    sizes = scratch.write(stripes.join(blocks, key))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, key).withColumn("block", deal("id", "blocks")).withColumn("stripe", every("stripes")).drop("stripes", "blocks")
    right = packed.join(sizes, key).withColumn("stripe", deal("bucket", "stripes")).withColumn("block", every("blocks")).drop("stripes", "blocks")
    cell = [*key, "block", "stripe"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return top(x, y, k, by_label)[0] if x.num_rows and y.num_rows else _TOP.empty_table()

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "anchor long, window long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, scale: int = SCALE, bucket: int = BUCKET,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors: which rows, by a condition on id; label: instead of the column."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.write(_rows(vectors, id_col, label_col, vector_col, label, scale))
    n = rows.count()
    asked = rows.where(anchors)
    every = F.array(F.lit(1 - (1 << 62)))
    packed = scratch.write(buckets(rows, True, n, bucket))
    near = scratch.write(_best(asked.withColumns({"low": every, "high": F.array(F.lit(1 << 62))}), packed, scratch, positives, True))
    scratch.drop(packed)
    # The windows of an anchor, `positives` at most, in order of rank.
    up = F.expr(f"case when ({low} * score) % 100 > 0 then ({low} * score) div 100 + 1 else ({low} * score) div 100 end")
    down = F.expr(f"case when ({high} * score) % 100 < 0 then ({high} * score) div 100 - 1 else ({high} * score) div 100 end")
    windows = near.select("anchor", "rank", up.alias("l"), down.alias("h")).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "l", "h"))).alias("w"))
    asked = asked.join(windows.select(F.col("anchor").alias("id"), F.col("w.l").alias("low"), F.col("w.h").alias("high")), "id")
    packed = scratch.write(buckets(rows, False, n, bucket))
    far = _best(asked, packed, scratch, k, False)
    pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("window"))
    return far.join(pairs, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
