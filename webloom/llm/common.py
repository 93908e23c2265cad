"""What several operators share: scratch tables, ASCII normalisation and sizing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters, in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of documents in an Arrow batch, and what says so.
ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Ids that may be broadcast.
MOST_IDS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="webloom-")
    return f"file://{_own}"


_own: str | None = None


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of executors.

    They are removed by drop(), or when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    lower() maps every character, but fast. It gives the same where no character outside ASCII changes
    under it, which the text without its ASCII characters shows; translate() does the rest.
    """
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    plain = (F.octet_length(text) == F.char_length(text)) | (F.lower(rest) == rest)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def plain(df: DataFrame) -> DataFrame:
    """df with names that mapInArrow can take, by place, but for text."""
    return df.toDF(*("text" if c == "text" else f"c{k}" for k, c in enumerate(df.columns)))


def free_name(names: list[str], stem: str) -> str:
    """A column name that none of names is."""
    taken = {c.lower() for c in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of equal names where null equals null; the right side's key columns go."""
    renamed = right
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"__{c}")
    cond = [left[c].eqNullSafe(renamed[f"__{c}"]) for c in on]
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{c}" for c in on])


def few(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """For a join: a hint to broadcast ids, if they are at most `most`; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python ROWS at a time, unless the session has been given a number, be it Spark's default.

    Both the JVM and the worker hold a whole batch, and texts can be long: Spark's 10,000 rows take 100 MB and more.
    """
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(ROWS))
    return df


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task, beside later stages of the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function for mapInArrow that gives back memory when its task ends."""

    def ends(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ends
