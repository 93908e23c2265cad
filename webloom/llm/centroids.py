"""Centroid clustering with weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Vectors of `dim` components become integers, floor(SCALE x). Equal ones are grouped first, with the number of
rows that have them, so that a vector that comes a million times is worked on once; groups are counted before
they are shuffled. A round adds up, in each task, the components of its distinct vectors times their
multiplicity for each centroid; Spark adds up the tasks' sums, and k rows of sums reach the driver, whose
integers divide them exactly. All sums are of integers, so the order in which tasks end changes nothing. In the
end each row is joined to its vector's assignment; vectors that more than 1/HOT of all rows have are joined
through a broadcast of at most HOT vectors, the others by a shuffle.

The first centroids are those of the k rows whose sha256 of "<seed>:<id>" is smallest, in that order; rows that
repeat an id are told apart by their vectors. Fewer rows than k give fewer centroids. The nearest centroid has
the smallest squared distance, then the smallest number. A centroid without vectors stays where it is.

Rows take no part if the vector is null, has another number of components, or one that is null or not finite.
Rows with a null id are assigned like others, but are no first centroids. Repeated rows are rows like others.
Components beyond LARGEST, whose distances might not fit a long, raise an error. Tables without rows give
none. Columns other than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: At most so many distinct vectors are broadcast, each of which more than this fraction of all rows have.
HOT = 256
#: Of a component, after scaling: the squared distance of 2^10 such components is within a long.
LARGEST = 1 << 25
#: Distinct vectors that are compared with the centroids at a time.
AT_ONCE = 8192


def quantised(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) > LARGEST)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    whole = F.when(far, F.raise_error(F.lit(f"a component is larger than {LARGEST // scale}")).cast("array<int>")).otherwise(whole)
    return F.when(vector.isNotNull() & (F.size(vector) == dim) & ~odd, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; the smaller number of equally near ones."""
    best, at = None, np.zeros(len(x), np.int32)
    for k, c in enumerate(centres):
        d = ((x - c) ** 2).sum(1)
        if best is None:
            best = d
        else:
            at[d < best] = k
            np.minimum(best, d, out=best)
    return at, best


def _sums(centres):
    """For mapInArrow over (q, m): cluster, place, s: the sum of m times the component at each place, and of m at place -1."""

    def run(batches):
        c = centres.value
        total, rows = np.zeros((len(c), c.shape[1] + 1), np.int64), np.zeros(len(c), np.int64)
        for b in batches:
            x, m = _matrix(b.column("q")), b.column("m").to_numpy()
            for lo in range(0, len(x), AT_ONCE):
                part, w = x[lo : lo + AT_ONCE], m[lo : lo + AT_ONCE]
                at, _ = nearest(part, c)
                for k in np.unique(at):
                    own = at == k
                    total[k, 1:] += w[own] @ part[own]
                    total[k, 0] += w[own].sum()
                    rows[k] += own.sum()
        k, place = np.nonzero(np.broadcast_to(rows[:, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[k, place], pa.int64())], ["cluster", "place", "s"])

    return run


def _assigned(centres):
    def run(batches):
        for b in batches:
            at, d = nearest(_matrix(b.column("q")), centres.value)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("m"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["q", "m", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after that many rounds over (q, m), a written table."""
    sc = distinct.sparkSession.sparkContext
    centres = centres.copy()
    for _ in range(rounds):
        sent = sc.broadcast(centres)
        sums = distinct.mapInArrow(_sums(sent), "cluster int, place int, s long").groupBy("cluster", "place").agg(F.sum("s").alias("s"))
        # k rows: numbers of a centroid by place.
        for r in sums.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("s")).collect():
            centres[r.cluster] = [r.s[i] // r.s[-1] for i in range(centres.shape[1])]
        sent.unpersist()
    return centres


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row that takes part."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    rows = scratch.write(vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dim, scale).alias("q")).where("q is not null"))
    starts = rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    if not starts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).where("false")
    distinct = scratch.write(rows.groupBy("q").agg(F.count("*").alias("m")))
    centres = lloyd(distinct, np.array([r.q for r in starts], np.int64), rounds)
    known = scratch.write(distinct.mapInArrow(_assigned(spark.sparkContext.broadcast(centres)), "q array<int>, m long, cluster int, distance long"))
    # A row for each centroid; their sums are whole numbers in any order.
    sums = {r.cluster: r.s for r in known.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("m")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(c, int(s), sum(sums.values()), sha[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    n = known.agg(F.sum("m")).first()[0]
    hot = known.where(F.col("m") > max(64, n // HOT)).select("q", "cluster", "distance")
    few = hot.count()  # at most HOT
    if few:
        hot = scratch.write(hot)
        found = rows.join(F.broadcast(hot), "q", "left")
        cold = found.where("cluster is null").select("id", "q").join(known.select("q", "cluster", "distance"), "q")
        found = found.where("cluster is not null").select("q", "id", "cluster", "distance").unionByName(cold)
    else:
        found = rows.join(known.select("q", "cluster", "distance"), "q")
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
