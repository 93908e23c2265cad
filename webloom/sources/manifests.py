"""Versions of a stored table: for each a manifest, a JSON object that is committed as a whole or not at all.

A manifest is written in a folder under a temporary name, which is then renamed to the version's number. A folder
that isn't empty is never replaced, so of two writers one gives the version its name; the other finds a manifest
that isn't its own, and makes its change to that version instead. That needs a file system whose renames of
folders are atomic (local, HDFS). Readers take the highest number, or stay with one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TRIES = 30


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


def file_system(spark: SparkSession, path: str):
    """(the path as Hadoop's, its file system)"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.path, (at, self.fs) = spark._jvm.org.apache.hadoop.fs.Path, file_system(spark, f"{root.rstrip('/')}/manifests")
        self.root = at.toString()

    def versions(self) -> list[int]:
        at = self.path(self.root)
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def load(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last; before the first, {"version": 0}."""
        v = max(self.versions(), default=0) if version is None else version
        if not v:
            return {"version": 0}
        stream = self.fs.open(self.path(f"{self.root}/{v:012d}/manifest.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Commits what change makes of the last manifest; the last as it is where that is None. change may be asked several times."""
        for k in range(TRIES):
            last = self.load()
            if (new := change(dict(last))) is None:
                return last
            new |= {"version": last["version"] + 1, "writer": uuid.uuid4().hex}
            if self._named(new):
                return new
            time.sleep(0.02 * k)
        raise Conflict(f"{self.root}: others committed {TRIES} times")

    def _named(self, new: dict) -> bool:
        final, temp = self.path(f"{self.root}/{new['version']:012d}"), self.path(f"{self.root}/.{new['writer']}")
        out = self.fs.create(self.path(f"{temp}/manifest.json"), True)
        out.write(json.dumps(new).encode())
        out.close()
        if not self.fs.exists(final):
            try:
                self.fs.rename(temp, final)
            except Py4JJavaError:
                if not self.fs.exists(final):
                    raise
        mine = self.fs.exists(final) and self.load(new["version"])["writer"] == new["writer"]
        if not mine:
            for left in (temp, self.path(f"{final}/.{new['writer']}")):
                self.fs.delete(left, True)
        return mine
