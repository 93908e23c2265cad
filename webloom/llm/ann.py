"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to the nearest of some centroids, about one for SHARD rows, and a centroid's vectors by a
hash of their id into shards of about SHARD rows, so that many equal vectors spread too. Centroids come from a
few rounds of k-means in numpy on the driver, fitted on about SAMPLE vectors a centroid and BYTES of them, at most
MOST centroids in all; that is the only sample, and every row is indexed. A shard's graph has a layer for each level, a node's
level falling off geometrically by its hash. Nodes enter a layer in random order; each is linked to at most
LINKS of its nearest among those before it, leaving out one that is nearer to a link already chosen than to the
node, which keeps links in different directions. These nearest come from products within the shard, which is
bounded, rather than from a search. Links also go back; a node with more than twice as many keeps those that
the same rule chooses, and always its links to the nodes whose nearest it is, so all nodes can be reached from
the first. Neighbours of a layer are one flat array with offsets; a shard's arrays are one row of the index,
written to the shared folder.

A query meets the shards of its nearest centroids only. How many is measured: TRIED queries are searched for
in all shards, and the least number of centroids is taken at which a share RECALL of their neighbours is
found. So the work of a query doesn't grow with the number of shards where vectors have clusters; where they
have none, many shards are searched rather than neighbours lost. Each shard is searched from the top with EF
nodes in view, what it finds is scored in double precision on the original vectors, and the shards' results
are merged.

Rows take no part if the id or vector is null, or the vector is empty, zero or holds a null or a component
that isn't finite. Vectors of another length are compared among themselves. A query's own row is left out by
its id. Repeated vectors are rows like others, and repeated rows are one; of equal scores the smaller ids come
first. Tables without rows give none. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few
from .words import mix

SHARD, LINKS, BUILD, EF, QUERIES = 32768, 14, 64, 80, 50_000
#: Centroids: how many at least (but no more than one for FEW rows) and at most, vectors for each to fit on, rounds.
LEAST, FEW, MOST, SAMPLE, ROUNDS = 12, 32, 4096, 64, 8
#: Bytes of the sample that is fitted on, at most: long vectors have fewer for each centroid, 8 at least, and then fewer centroids.
BYTES = 256 << 20
#: Queries to measure on, and the share of their neighbours that is to be found.
TRIED, RECALL = 200, 0.98


def _choose(x: np.ndarray, node: int, found: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
    """found: by nearness to node. Leaves out what is nearer to a chosen one than to the node."""
    between = x[found] @ x[found].T
    chosen: list[int] = []
    for k in range(len(found)):
        if not chosen or sims[k] > between[k, chosen].max():
            chosen.append(k)
            if len(chosen) == most:
                break
    return found[chosen].tolist()


def _layer(x: np.ndarray, nodes: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, neighbours) for nodes of the shard, which enter in this order; neighbours by place in the shard."""
    own = x[nodes]
    out: list[list[int]] = [[] for _ in nodes]
    back: list[list[int]] = [[] for _ in nodes]
    held: list[list[int]] = [[] for _ in nodes]
    for lo in range(0, len(nodes), 512):
        hi = min(lo + 512, len(nodes))
        sims = own[lo:hi] @ own[:hi].T
        for i in range(max(lo, 1), hi):
            s = sims[i - lo, :i]
            near = np.argpartition(-s, BUILD)[:BUILD] if i > BUILD else np.arange(i)
            near = near[np.argsort(-s[near], kind="stable")]
            tied = near[s[near] >= s[near[0]] - 1e-6]
            first = int(tied[i % len(tied)])
            out[i] = list(dict.fromkeys([first, *_choose(own, i, near, s[near], links)]))
            held[first].append(i)
            for j in out[i]:
                back[j].append(i)
    final = []
    for i in range(len(nodes)):
        both = np.array(list(dict.fromkeys(out[i] + back[i])), np.int64)
        if len(both) > 2 * links:
            s = own[both] @ own[i]
            order = np.argsort(-s, kind="stable")[: 4 * BUILD]
            both = np.array(list(dict.fromkeys([*_choose(own, i, both[order], s[order], 2 * links), *held[i], *out[i][:1]])), np.int64)
        final.append(nodes[both] if len(both) else both)
    return np.cumsum([0, *map(len, final)]).astype(np.int64), (np.concatenate(final) if final else np.zeros(0)).astype(np.int32)


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS) -> dict:
    """A shard's index: ids, vectors, and for each layer from the bottom its nodes, offsets and neighbours."""
    order = np.argsort(mix(ids.view(np.uint64)), kind="stable")
    ids, vectors = ids[order], vectors[order]
    x = vectors.astype(np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    luck = ((mix(ids.view(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    level = np.floor(-np.log(luck) / np.log(links)).astype(np.int64)
    layers = []
    for k in range(int(level.max()) + 1 if len(level) else 0):
        nodes = np.flatnonzero(level >= k)
        layers.append((nodes, *_layer(x, nodes, links)))
    return {"ids": ids, "vectors": vectors, "layers": layers}


class Searcher:
    def __init__(self, index: dict):
        self.ids, self.vectors = index["ids"], index["vectors"].astype(np.float64)
        self.norm = np.linalg.norm(self.vectors, axis=1)
        self.x = (self.vectors / self.norm[:, None]).astype(np.float32)
        self.layers = []
        for nodes, offset, near in index["layers"]:
            place = np.full(len(self.ids), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            self.layers.append((nodes, place, offset, near))
        self.seen = np.zeros(len(self.ids), np.int64)
        self.turn = 0

    def _walk(self, q: np.ndarray, start: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        _, place, offset, near = self.layers[layer]
        self.turn += 1
        seen, turn = self.seen, self.turn
        seen[start] = turn
        sims = (self.x[start] @ q).tolist()
        best = [(s, n) for s, n in zip(sims, start)]
        heapq.heapify(best)
        todo = [(-s, n) for s, n in best]
        heapq.heapify(todo)
        while todo:
            s, n = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            p = place[n]
            nodes = near[offset[p] : offset[p + 1]]
            nodes = nodes[seen[nodes] != turn]
            if not len(nodes):
                continue
            seen[nodes] = turn
            sims = self.x[nodes] @ q
            if len(best) >= ef:
                far = sims > best[0][0]
                nodes, sims = nodes[far], sims[far]
            for v, m in zip(sims.tolist(), nodes.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (v, m))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, m))
                else:
                    continue
                heapq.heappush(todo, (-v, m))
        return best

    def nearest(self, own: int, vector: np.ndarray, k: int, ef: int = EF) -> list[tuple[int, float]]:
        if not self.layers:
            return []
        v = vector.astype(np.float64)
        norm = np.linalg.norm(v)
        q = (v / norm).astype(np.float32)
        at = [int(self.layers[-1][0][0])]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [max(self._walk(q, at, layer, 1))[1]]
        found = np.array([n for _, n in self._walk(q, at, 0, ef)], np.int64)
        found = found[self.ids[found] != own]
        score = (self.vectors[found] @ v) / (self.norm[found] * norm)
        ids = self.ids[found]
        order = np.lexsort((ids, -score))[:k]
        return list(zip(ids[order].tolist(), score[order].tolist()))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    v = F.col("v")
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    ).withColumn("dim", F.size("v"))


_INDEX = "dim int, cell int, shard int, ids binary, vectors binary, double boolean, layers array<struct<nodes: binary, offsets: binary, near: binary>>"


def _matrix(table) -> np.ndarray:
    """The vectors of a table or batch."""
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of rows of length one."""
    c = np.unique(x[np.random.default_rng(3).permutation(len(x))[: 2 * k]], axis=0)
    c = c[np.random.default_rng(4).permutation(len(c))[:k]]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = (total[size > 0] / size[size > 0, None]).astype(np.float32)
    return c


def centroids(rows: DataFrame, shard: int, least: int = LEAST, most_bytes: int = BYTES) -> dict[int, np.ndarray]:
    """For each length of vectors, its centroids. The counts by length, and a sample, reach the driver."""
    out = {}
    for r in rows.groupBy("dim").count().collect():
        k = max(1, min(MOST, max(least, -(-r["count"] // shard)), r["count"] // FEW))
        room = max(8, most_bytes // (4 * r.dim))
        k = min(k, room // 8)
        some = min(k * SAMPLE, room)
        chance = min(1.0, 1.5 * some / r["count"])
        mine = rows.where((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) <= int(chance * (1 << 30))))
        x = _unit(_matrix(mine.select(F.col("v").cast("array<float>").alias("v")).limit(2 * some).toArrow()).reshape(-1, r.dim)) if k > 1 else np.ones((1, r.dim), np.float32)
        out[r.dim] = _means(x, k) if len(x) else np.ones((1, r.dim), np.float32)
    return out


def _dealt(rows: DataFrame, cells, most: int | None) -> DataFrame:
    """dim, cell, id, v, nth: a row for each of the `most` nearest centroids of a vector (all if None), nearest first."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                if (own := cells.value.get(int(d))) is None:
                    continue
                part = b.filter(pa.array(dims == d))
                n = len(own) if most is None else min(most, len(own))
                order = np.argsort(-(_unit(_matrix(part)) @ own.T), axis=1, kind="stable")[:, :n]
                part = part.take(pa.array(np.repeat(np.arange(len(part)), n)))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(order.ravel(), pa.int32()), part.column("id"), part.column("v"), pa.array(np.tile(np.arange(n), len(order)), pa.int32())], ["dim", "cell", "id", "v", "nth"])

    return rows.select("dim", "id", "v").mapInArrow(run, f"dim int, cell int, id bigint, v {kind}, nth int")


def build_index(vectors: DataFrame, id_col: str, vector_col: str, shard: int = SHARD, links: int = LINKS, least: int = LEAST) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(a row for each shard, the centroids by length of vectors)"""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "cells")
    rows = _valid(vectors, id_col, vector_col)
    cells = centroids(rows, shard, least)
    dealt = scratch.write(_dealt(rows, spark.sparkContext.broadcast(cells), 1).drop("nth"))
    # A row for each centroid.
    shards = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = dealt.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shards")).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table)
        i = build(table.column("id").to_numpy().astype(np.int64), x, links)
        layers = [{"nodes": n.astype(np.int64).tobytes(), "offsets": o.tobytes(), "near": m.tobytes()} for n, o, m in i["layers"]]
        out = {"dim": x.shape[1], "cell": table.column("cell")[0].as_py(), "shard": table.column("shard")[0].as_py(), "ids": i["ids"].tobytes(), "vectors": np.ascontiguousarray(i["vectors"]).tobytes(), "double": x.dtype == np.float64, "layers": layers}
        part = pa.struct([("nodes", pa.binary()), ("offsets", pa.binary()), ("near", pa.binary())])
        return pa.Table.from_pylist([out], schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("double", pa.bool_()), ("layers", pa.list_(part))]))

    return dealt.drop("shards").groupBy("dim", "cell", "shard").applyInArrow(run, _INDEX), cells


def load(row: dict) -> dict:
    kind = np.float64 if row["double"] else np.float32
    layers = [(np.frombuffer(x["nodes"], np.int64), np.frombuffer(x["offsets"], np.int64), np.frombuffer(x["near"], np.int32)) for x in row["layers"]]
    return {"ids": np.frombuffer(row["ids"], np.int64), "vectors": np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"]), "layers": layers}


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("nth", pa.int32())])


def _found(index: DataFrame, asked: DataFrame, cells, most: int | None, k: int, ef: int) -> DataFrame:
    """query_id, vec_id, score, nth: what the shards of each query's `most` nearest centroids have."""
    sent = Scratch(index.sparkSession, "asked").write(_dealt(asked, cells, most))
    # A row for each centroid: its queries go in blocks.
    blocks = sent.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    every = few(index.select(F.col("dim").alias("of_dim"), F.col("cell").alias("of_cell"), F.col("shard").alias("to")))
    sent = sent.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    sent = sent.join(every, (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell"))).select(F.col("of_dim").alias("dim"), F.col("of_cell").alias("cell"), F.col("to").alias("shard"), "block", "id", "v", "nth")
    held = index.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["dim", "cell", "shard", "block"]

    def run(own: pa.Table, q: pa.Table) -> pa.Table:
        if not own.num_rows or not q.num_rows:
            return _FOUND.empty_table()
        s, out = Searcher(load(own.to_pylist()[0])), []
        for i, v, nth in zip(q.column("id").to_pylist(), _matrix(q), q.column("nth").to_pylist()):
            out += [(i, n, score, nth) for n, score in s.nearest(i, v, k, ef)]
        return pa.table(list(map(list, zip(*out))) if out else [[]] * 4, schema=_FOUND)

    return held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double, nth int")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, which has at most k from each shard."""
    rows = found.groupBy("query_id", "vec_id", "score").agg(F.min("nth").alias("nth"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes(index: DataFrame, asked: DataFrame, cells, k: int, ef: int, tried: int = TRIED, recall: float = RECALL) -> int:
    """The number of centroids whose shards hold that share of the neighbours of some queries."""
    some = asked.orderBy(F.xxhash64("id", F.lit(13)), "id").limit(tried)
    nth = np.array([r.nth for r in _best(_found(index, some, cells, None, k, ef), k).select("nth").collect()], np.int64)
    if not len(nth):
        return 1
    share = np.cumsum(np.bincount(nth)) / len(nth)
    return int(np.searchsorted(share, recall)) + 1


def search(index: DataFrame, cells: dict[int, np.ndarray], queries: DataFrame, id_col: str, vector_col: str, k: int = 5, ef: int = EF, most: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. index: a written table of build_index(); most: centroids to search, measured if None."""
    asked = _valid(queries, id_col, vector_col)
    sent = index.sparkSession.sparkContext.broadcast(cells)
    most = probes(index, asked, sent, k, ef) if most is None else most
    return _best(_found(index, asked, sent, most, k, ef), k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    scratch = Scratch(vectors.sparkSession, "ann")
    index, cells = build_index(vectors, id_col, vector_col)
    return search(scratch.write(index), cells, queries, id_col, vector_col, k)
