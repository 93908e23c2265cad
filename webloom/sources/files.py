"""Readers of JSON-line shards, visited lists and state snapshots; lenient, as stored files may be cut or odd."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text
from .schema import RAW_POSTING, STATE


def whole(value: Column) -> Column:
    """A number written in any way, as a whole number; 0 for anything else."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"), F.lit(0))


def valid_postings(df: DataFrame) -> DataFrame:
    return df.where((F.coalesce("current_url", F.lit("")) != "") & (F.coalesce("origin_url", F.lit("")) != "") & (F.col("frequency") > 0))


def read_shards(spark: SparkSession, root: str, terms: list[str] | None = None) -> DataFrame:
    """Postings of the JSON-line shards under root, malformed lines left out. With terms only their buckets' files are listed; missing ones are skipped."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = text.BUCKETS if terms is None else sorted({text.bucket_of(t) for t in terms})
    paths = [p for p in (f"{root}/{b}.data" for b in names) if fs.exists(fs_path(p))]
    if paths:
        file = F.struct(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"))
        raw = spark.read.schema(RAW_POSTING).json(paths).withColumn("file", file)
    else:
        raw = spark.createDataFrame([], f"{RAW_POSTING}, file struct<name: string, start: bigint>")
    rows = raw.where(F.col("word").isNotNull()).select(
        F.lower("word").alias("word"), "origin_url", "current_url", whole(F.col("depth")).cast("int").alias("depth"), whole(F.col("frequency")).alias("frequency"), whole(F.col("ts")).alias("ts"), "file"
    )
    rows = valid_postings(rows).withColumn("bucket", text.bucket(F.col("word")))
    # The order of files by their names, which appends number, and of lines in a file: it decides the first origin of a URL.
    place = F.struct(F.col("file.name"), F.col("file.start"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("seq", place).drop("file")


def append_shards(rows: DataFrame, root: str) -> None:
    """Appends postings with their bucket to the JSON-line shards under root, one folder a bucket.

    Files are written aside and moved when all are complete, one after another: a reader may meet a part of an append.
    They are compressed, as JSON lines are many times the size of what they hold; plain ones are read all the same.
    If a job dies between two moves, the next append finishes them. Names of files begin with a number that grows.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    _move_complete(fs, path, root)
    new = path(f"{root}/_new-{time.time_ns():020d}-{uuid.uuid4().hex}")
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *(["seq"] if "seq" in rows.columns else []), "word", "current_url").drop("seq").write.option("compression", "gzip").partitionBy("bucket").json(new.toString())
    _move_complete(fs, path, root)


def _move_complete(fs, path, root: str) -> None:
    """Moves the files of all appends that are written whole, the earliest first."""
    drafts = sorted(x.getPath().getName() for x in fs.listStatus(path(root)) if x.getPath().getName().startswith("_new-")) if fs.exists(path(root)) else []
    for name in drafts:
        new = path(f"{root}/{name}")
        if not fs.exists(path(new, "_SUCCESS")):
            continue
        for made in fs.listStatus(new):
            if made.isDirectory():
                shard = path(f"{root}/{made.getPath().getName().removeprefix('bucket=')}.data")
                fs.mkdirs(shard)
                for part in fs.listStatus(made.getPath()):
                    if not fs.rename(part.getPath(), path(shard, f"{name.split('-')[1]}-{part.getPath().getName()}")):
                        raise OSError(f"not moved: {part.getPath().toString()}")
        fs.delete(new, True)


def read_visited(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''").distinct()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State snapshots under path, unreadable ones left out, with the time of each file."""
    rows = spark.read.schema(STATE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("file_time", F.col("_metadata.file_modification_time")).where("crawler_id is not null or state is not null")
