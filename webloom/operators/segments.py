"""The index as immutable segments, with a manifest for each version.

A segment holds the pages of one batch: their words in order (pages), a row for each word of a page with its
count and positions (postings, by bucket), and for each word and block of pages the number of rows and the largest
impact, frequency / sqrt(length) (blocks, by bucket). Pages of a block are of like length, BLOCK of them or so.
Positions are differences: the first position, then each one's distance from the one before.

A batch has a name. Its tables are written to folders of their own first, and only then listed by the next
manifest. A job that dies on the way leaves files that nobody reads; when its batch comes again, it is written anew,
and one that is listed already isn't added a second time. So each batch counts once. recover() deletes files that no
manifest lists, once they are older than a lease. Readers stay on the version that they opened.

The folder of a segment is named by the version it was written on, so its name, as the column batch, orders
segments by arrival. Within a segment seq does: the pages' own, where they have one, or the place in the file.
Pages without words have no postings; each row of pages has postings of its own. Rows without a URL or origin are kept, and left out by searches.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from webloom.functions import counts
from webloom.functions import pages as P
from webloom.functions import text as X
from webloom.sources.manifests import Manifests, file_system

from . import index

BLOCK, LEASE = 512, 24 * 3600
#: Bytes of buckets up to which a search is one task, which spares it a shuffle.
SMALL = 8 << 20
#: Bytes of stored pages whose postings a task sorts: these take some twenty times as much.
SPLIT = 16 << 20
_PAGE = "origin_url string, current_url string, depth int, seq bigint, length int, block bigint, words array<string>, batch string"
_POSTING = "word string, origin_url string, current_url string, depth int, frequency bigint, ts bigint, seq bigint, length int, block bigint, positions array<int>, batch string, bucket string"
_BLOCKS = "word string, block bigint, n bigint, most double, batch string, bucket string"
_SCHEMAS = {"pages": _PAGE, "postings": _POSTING, "blocks": _BLOCKS}


@contextmanager
def _split(spark: SparkSession):
    """Files are read in tasks of SPLIT bytes at most meanwhile. The session's setting comes back."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(SPLIT))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def impact() -> Column:
    return F.col("frequency") / F.sqrt(F.col("length").cast("double"))


class Segments:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)
        self._open: tuple | None = None

    @staticmethod
    def at(spark: SparkSession, root: str) -> bool:
        path, fs = file_system(spark, f"{root.rstrip('/')}/manifests")
        return fs.exists(path)

    def version(self) -> int:
        return self.manifests.load()["version"]

    def listed(self, version: int | None = None) -> list[dict]:
        return self.manifests.load(version).get("segments", [])

    # Writing

    def append_pages(self, pages: DataFrame, batch: str, ts: Column | None = None) -> int:
        """append() of origin_url, current_url, depth, html."""
        return self.append(pages, P.page_words(F.col("html")), batch, ts)

    def append(self, docs: DataFrame, words: Column, batch: str, ts: Column | None = None) -> int:
        """Adds a batch of origin_url, current_url, depth (and seq) with a column of words; the version that has it."""
        if any(s["name"] == batch for s in self.listed()):
            return self.version()
        folder = f"{self.version():012d}-{uuid.uuid4().hex[:12]}"
        self._write(docs, words, folder, ts)
        n = self._read("pages", [folder]).agg(F.count("*").alias("pages"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()

        path, fs = file_system(self.spark, self._path("postings", folder))
        # A number for each bucket.
        sizes = {x.getPath().getName().removeprefix("bucket="): fs.getContentSummary(x.getPath()).getLength() for x in fs.listStatus(path) if x.isDirectory()}

        def add(last: dict) -> dict | None:
            held = last.get("segments", [])
            new = {"name": batch, "folder": folder, "pages": n.pages, "words": n.words, "bytes": sizes}
            return None if any(s["name"] == batch for s in held) else {"segments": [*held, new]}

        return self._commit(add)["version"]

    def _commit(self, change) -> dict:
        return self.manifests.commit(change)

    def _path(self, table: str, folder: str) -> str:
        return f"{self.root}/{table}/batch={folder}"

    def _write(self, docs: DataFrame, words: Column, folder: str, ts: Column | None) -> None:
        seq = F.col("seq").cast("bigint") if "seq" in docs.columns else F.monotonically_increasing_id()
        rows = docs.select("origin_url", "current_url", F.col("depth").cast("int").alias("depth"), seq.alias("seq"), words.alias("words"))
        draft = f"{self._path('pages', folder)}.draft"
        with _split(self.spark):
            rows.withColumn("length", F.coalesce(F.size("words"), F.lit(0))).write.option("parquet.block.size", SPLIT).parquet(draft)
            # Pages of like length; a row for each length class, of which there are at most 64.
            rows, kind = self.spark.read.parquet(draft), F.floor(2 * F.log2(F.col("length") + 1.0)).cast("bigint")
            parts = rows.groupBy(kind.alias("kind")).agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts"))
            rows = rows.withColumn("kind", kind).join(F.broadcast(parts), "kind")
            block = F.shiftleft("kind", 48) + F.pmod(F.xxhash64("current_url", "seq"), F.col("parts"))
            rows.withColumn("block", block).drop("kind", "parts").write.option("parquet.block.size", SPLIT).parquet(self._path("pages", folder))
            path, fs = file_system(self.spark, draft)
            fs.delete(path, True)

            # A page's words are counted, sorted and written where it is read: postings aren't shuffled, as each has its URL.
            keys = ["origin_url", "current_url", "depth", "seq", "length", "block"]
            each = self._read("pages", [folder]).select(*keys, "words")
            schema = StructType([StructField("word", StringType()), *each.drop("words").schema.fields, StructField("frequency", LongType()), StructField("positions", ArrayType(IntegerType()))])
            counted = each.mapInArrow(counts.of_rows(keys), schema)
            rows = counted.select("word", *keys, "frequency", (F.unix_timestamp() if ts is None else ts).cast("bigint").alias("ts"), "positions", X.bucket(F.col("word")).alias("bucket"))
            rows.sortWithinPartitions("bucket", "word", "block", "seq").write.partitionBy("bucket").parquet(self._path("postings", folder))
            blocks = self._read("postings", [folder]).groupBy("bucket", "word", "block").agg(F.count("*").alias("n"), F.max(impact()).alias("most"))
            blocks.sortWithinPartitions("bucket", "word", "most").write.partitionBy("bucket").parquet(self._path("blocks", folder))

    def recover(self, lease: float = LEASE) -> int:
        """Deletes folders that no manifest lists and that are older than the lease, which is their writer's time to commit. Their number."""
        listed, late, gone = {s["folder"] for s in self.listed()}, (time.time() - lease) * 1000, 0
        for table in _SCHEMAS:
            path, fs = file_system(self.spark, f"{self.root}/{table}")
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName().removeprefix("batch=") not in listed and f.getModificationTime() < late:
                    gone += bool(fs.delete(f.getPath(), True))
        return gone

    # Reading

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", f"{self.root}/{table}").parquet(*(self._path(table, f) for f in folders))

    def read(self, version: int | None = None, table: str = "postings", since: int = 0) -> DataFrame:
        """A version's rows; with since only those of segments that that version hadn't."""
        old = {s["folder"] for s in self.listed(since)} if since else set()
        return self._read(table, [s["folder"] for s in self.listed(version) if s["folder"] not in old])

    def matching(self, terms: list[str], version: int | None = None) -> DataFrame:
        """The postings of some terms; in one partition if their buckets are small."""
        buckets = {X.bucket_of(t) for t in terms}
        rows, sizes = self._opened(version)
        rows = index.lookup(rows, terms)
        return rows.coalesce(1) if sum(sizes.get(b, 0) for b in buckets) <= SMALL else rows

    def _opened(self, version: int | None) -> tuple[DataFrame, dict[str, int]]:
        """The rows of a version, whose files are listed once, and the bytes of each bucket."""
        v = self.version() if version is None else version
        if self._open is None or self._open[0] != v:
            sizes: dict[str, int] = {}
            for s in self.listed(v):
                for b, n in s["bytes"].items():
                    sizes[b] = sizes.get(b, 0) + n
            self._open = v, (self.read(v), sizes)
        return self._open[1]
