"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and of manifests, each a complete list of the shards of one
version. An arrival is appended as small shards of at most ROWS rows and a SMALL-th of the target in bytes;
files that come out larger are written again in pieces. Compaction looks for runs: shards of one tier
(sizes within a factor FAN) of which there are at least FAN, or that together fill a target file.
Each run is merged into one file of about TARGET bytes by one task that reads only that run, so nothing is
shuffled; a shard of half the target size or more is left alone. Files that no manifest lists are never
read, so a job that fails, or an executor that is lost, leaves the last version as it is.

A version is committed by writing the next manifest in a folder under a temporary name and renaming that
folder. A folder that isn't empty is never replaced: of two writers the first rename gives the version its
name, and the second fails or puts its folder inside. So each looks which manifest the version has, and the
one that finds another's raises Conflict. An append, or a merge whose shards are still listed, then commits to
the newer version instead, without writing its data again. That needs a file system whose renames of folders
are atomic (local, HDFS). Readers open the manifest with the highest number.

A manifest also names the shards that its version removed. vacuum() deletes those of versions before the last
`keep`, with their manifests, so whoever reads one of the last versions keeps its files; and files that no
manifest has ever listed if they are older than a lease, so an append or merge that isn't committed yet keeps
its files, too. A write that takes longer than the lease must ask for a longer one.

A manifest has a line for each shard, (name, rows, bytes, tier, version that added it), not for each row.
Rows are kept as they are, nulls, very long texts, repeated rows and all columns but one named shard, which
read() replaces. An empty arrival adds a version without new shards. Reading a store without a version, or
without rows, raises FileNotFoundError.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name

TARGET, FAN, SMALL, ROWS, AT_ONCE = 128 << 20, 4, 8, 1_000_000, 8
#: Seconds for which files that no manifest lists are left to their writer; versions that a commit tries, where others commit.
LEASE, TRIES = 24 * 3600, 20


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target, fan
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("shards", "manifests"):
            self.fs.mkdirs(self.path(f"{self.root}/{d}"))

    # Manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}"

    def version(self) -> int:
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.root}/manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return self._read(f"{self._manifest(v)}/manifest.json") if v else {"version": 0, "shards": []}

    def _read(self, file: str) -> dict:
        stream = self.fs.open(self.path(file))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, added: list[dict], removed: set[str]) -> dict:
        """A commit on the newest version there is, again if another writer is first. Raises Conflict if a removed shard isn't listed any more."""
        for k in range(TRIES):
            base = self.manifest()
            if not removed <= {s["name"] for s in base["shards"]}:
                raise Conflict("another writer has removed the same shards")
            try:
                return self.commit(base, added, removed)
            except Conflict:
                time.sleep(0.05 * k)
        raise Conflict(f"others committed {TRIES} times")

    def commit(self, base: dict, added: list[dict], removed: set[str]) -> dict:
        """The version after base. The first rename decides between writers."""
        v, writer = base["version"] + 1, uuid.uuid4().hex
        shards = [s for s in base["shards"] if s["name"] not in removed] + [s | {"added": v} for s in added]
        final, temp = self.path(self._manifest(v)), self.path(f"{self.root}/manifests/.{writer}")
        out = self.fs.create(self.path(f"{temp}/manifest.json"), True)
        out.write(json.dumps({"version": v, "writer": writer, "shards": shards, "removed": sorted(removed)}).encode())
        out.close()
        if not self.fs.exists(final):
            try:
                self.fs.rename(temp, final)
            except Py4JJavaError:
                if not self.fs.exists(final):
                    raise
        if not self.fs.exists(final) or self.manifest(v)["writer"] != writer:
            for left in (temp, self.path(f"{final}/.{writer}")):
                self.fs.delete(left, True)
            raise Conflict(f"version {v} is there already")
        return {"version": v, "shards": shards}

    # Data

    def _files(self, folder: str, tier: int) -> list[dict]:
        """The files that a write left, with their rows from the footers."""
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(f"{self.root}/shards/{folder}")) if x.getPath().getName().endswith(".parquet"))
        if not names:
            return []
        paths = [f"{self.root}/shards/{folder}/{n}" for n in names]
        counts = self.spark.read.parquet(*paths).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        rows = {r.f: r["count"] for r in counts}
        sizes = {n: self.fs.getFileStatus(self.path(p)).getLen() for n, p in zip(names, paths)}
        return [{"name": f"{folder}/{n}", "rows": rows[n], "bytes": sizes[n], "tier": tier} for n in names if rows.get(n)]

    def append(self, arrival: DataFrame) -> dict:
        """Adds an arrival as small shards: of each of its partitions, files of at most a SMALL-th of the target."""
        base, folder, most = self.manifest(), f"a-{uuid.uuid4().hex[:12]}", max(1, self.target // SMALL)
        # The rows there are say how many rows a file can hold; the first arrival has none to go by.
        rows, size = (sum(s[k] for s in base["shards"]) for k in ("rows", "bytes"))
        fit = min(ROWS, max(1, most * rows // size)) if size else ROWS
        arrival.write.option("compression", "zstd").option("maxRecordsPerFile", fit).parquet(f"{self.root}/shards/{folder}")
        added, todo = [], self._files(folder, 0)
        while todo:
            large = [s for s in todo if s["bytes"] > most and s["rows"] > 1]
            added += [s for s in todo if s not in large]
            with ThreadPoolExecutor(AT_ONCE) as pool:
                todo = [x for xs in pool.map(lambda s: self._pieces(s, most), large) for x in xs]
        return self.publish(added, set())

    def _pieces(self, shard: dict, most: int) -> list[dict]:
        """A shard that isn't listed yet, written again as at least two files of about `most` bytes; the old file goes."""
        path, folder = f"{self.root}/shards/{shard['name']}", f"a-{uuid.uuid4().hex[:12]}"
        fit = max(1, shard["rows"] // -(-shard["bytes"] // most))
        self.spark.read.parquet(path).coalesce(1).write.option("compression", "zstd").option("maxRecordsPerFile", fit).parquet(f"{self.root}/shards/{folder}")
        self.fs.delete(self.path(path), False)
        return self._files(folder, shard["tier"])

    def tier(self, size: int) -> int:
        t = 0
        while size * self.fan < self.target and t < 32:
            size *= self.fan
            t += 1
        return t  # 0: nearly as large as the target

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge, each for one file."""
        tiers = defaultdict(list)
        for s in shards:
            if 2 * s["bytes"] < self.target:
                tiers[self.tier(s["bytes"])].append(s)
        out = []
        for _, own in sorted(tiers.items()):
            own.sort(key=lambda s: s["added"])  # among equals, as the manifest has them
            run, size = [], 0
            for s in own:
                if run and size + s["bytes"] > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s["bytes"]
            if len(run) >= self.fan:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> dict:
        """Merges all runs there are, and commits them as one version."""
        base = self.manifest()
        runs = self.runs(base["shards"])
        if not runs:
            return base

        def merge(run: list[dict]) -> list[dict]:
            folder = f"m-{uuid.uuid4().hex[:12]}"
            rows = self.spark.read.parquet(*(f"{self.root}/shards/{s['name']}" for s in run))
            rows.coalesce(1).write.option("compression", "zstd").parquet(f"{self.root}/shards/{folder}")
            return self._files(folder, max(s["tier"] for s in run) + 1)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            added = [x for xs in pool.map(merge, runs) for x in xs]
        return self.publish(added, {s["name"] for r in runs for s in r})

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard (its name)."""
        shards = self.manifest(version)["shards"]
        if not shards:
            raise FileNotFoundError(f"{self.root} has no rows in that version")
        rows = self.spark.read.parquet(*(f"{self.root}/shards/{s['name']}" for s in shards))
        return rows.withColumn("shard", F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name")))

    def vacuum(self, keep: int = 2, lease: float = LEASE) -> int:
        """Deletes what none of the last `keep` versions lists, see above. The number of files deleted."""
        manifests = self.path(f"{self.root}/manifests")
        versions = sorted(int(n) for n in (x.getPath().getName() for x in self.fs.listStatus(manifests)) if n.isdigit())
        if not versions:
            return 0
        kept = [self.manifest(v) for v in versions[-keep:]]
        listed, gone, late = {s["name"] for m in kept for s in m["shards"]}, 0, time.time() * 1000 - lease * 1000
        delete = lambda path: bool(self.fs.delete(path, True))
        # What the first of the kept versions removed is listed by versions before it only.
        for name in (n for v in versions[1 : max(0, len(versions) - keep) + 1] for n in self.manifest(v)["removed"]):
            if name not in listed:
                gone += delete(self.path(f"{self.root}/shards/{name}"))
        for folder in self.fs.listStatus(self.path(f"{self.root}/shards")):
            files = [f for f in self.fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            old = [f for f in files if f.getModificationTime() < late and f"{folder.getPath().getName()}/{f.getPath().getName()}" not in listed]
            gone += sum(delete(f.getPath()) for f in old)
            if len(old) == len(files) and folder.getModificationTime() < late:
                delete(folder.getPath())
        for v in versions[:-keep]:
            delete(self.path(self._manifest(v)))
        return gone


def sharded(docs: DataFrame, root: str, arrivals: int = 1, target: int = TARGET, fan: int = FAN) -> Store:
    """A store of docs at root: after each of the arrivals (by a hash of doc_id) is appended, runs are merged until none is left.

    Docs are read once and dealt to a folder for each arrival, which goes as soon as it is appended. The last two versions stay readable.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, root, target, fan)
    path, own = Scratch(spark, "arrivals").root, free_name(docs.columns, "arrival")
    if arrivals > 1:
        docs.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")).write.option("compression", "zstd").partitionBy(own).parquet(path)
    for k in range(arrivals):
        mine = store.path(f"{path}/{own}={k}")
        if arrivals == 1:
            store.append(docs)
        elif store.fs.exists(mine):
            store.append(spark.read.schema(docs.schema).parquet(mine.toString()))
            store.fs.delete(mine, True)
        else:
            store.append(docs.where("false"))
        while (before := store.version()) != store.compact()["version"]:
            if store.version() > before:
                store.vacuum()
    return store
