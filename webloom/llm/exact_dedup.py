"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into blocks of BLOCK bytes. The distinct blocks are sorted and numbered, so
equal blocks, and only those, have equal integer names. Then adjacent names are paired, distinct pairs are
sorted and numbered, and so on until each document has one name. (level, name) is then the same for two
documents exactly when their texts are: no digest takes part in that decision.

Skew: a block that holds more than 1/HOT of all blocks is named apart, through a broadcast table of at most
HOT blocks of BLOCK bytes; the others are joined by a shuffle. Names of pairs are small rows joined from
written tables, whose large partitions Spark can split.

Nulls count as empty texts. An empty text is one empty block. Rows with a null doc_id take part and sort
before all others. Of rows that repeat a doc_id and a text, one counts as kept. Very long texts are more
blocks, in more levels. Empty tables give no rows. Columns other than doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, few, free_name, quoted

BLOCK = 4096
#: At most so many blocks are broadcast, each of which holds at least this fraction of all blocks.
HOT = 256


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, sha (binary), n blocks, idx, block."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", F.encode("norm", "UTF-8").alias("b")).select(
        "doc_id", "b", F.greatest(F.lit(1), F.ceil(F.length("b") / block)).cast("long").alias("n")
    )
    return cut.select(
        "doc_id",
        F.unhex(F.sha2("b", 256)).alias("sha"),
        "n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("b"), (i * block + 1).cast("int"), F.lit(block)))).alias("idx", "block"),
    ).withColumn("idx", F.col("idx").cast("long"))


def _named(distinct: DataFrame, by: list[str], first: int = 0) -> DataFrame:
    """Numbers distinct rows in sorted order within each partition; the partition is part of the number."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id() + F.lit(first))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, sha, level, name, m: a row for each (doc_id, text), m times in the input."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    blocks = _blocks(docs, block)
    counts = scratch.write(blocks.groupBy(F.xxhash64("block").alias("h")).count())
    most = counts.agg(F.sum("count").alias("n"), F.max("count").alias("top")).first()
    least = max(64, (most.n or 0) // HOT)
    hot = [r.h for r in counts.where(F.col("count") > least).select("h").limit(HOT).collect()] if (most.top or 0) > least else []
    scratch.drop(counts)
    is_hot = F.xxhash64("block").isin(hot) if hot else F.lit(False)
    cold = blocks.where(~is_hot) if hot else blocks
    named = cold.join(_named(cold.select("block").distinct(), ["block"]), "block").select("doc_id", "sha", "n", "idx", "name")
    if hot:
        few = _named(blocks.where(is_hot).select("block").distinct(), ["block"]).withColumn("name", -F.col("name") - 2)
        few = scratch.write(few)
        named = named.unionByName(blocks.where(is_hot).join(F.broadcast(few), "block").select("doc_id", "sha", "n", "idx", "name"))
    cur = scratch.write(named.groupBy("doc_id", "sha", "n", "idx").agg(F.max("name").alias("name"), F.count("*").alias("m")))
    level, done = 0, []
    while True:
        done.append(cur.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "m"))
        if not cur.where("n > 1").limit(1).count():
            break
        even = F.col("idx") % 2 == 0
        pairs = (
            cur.where("n > 1")
            .groupBy("doc_id", "sha", F.expr("(n + 1) div 2").alias("n"), F.expr("idx div 2").alias("idx"))
            .agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"), F.max("m").alias("m"))
        )
        pairs = scratch.write(pairs)
        names = scratch.write(_named(pairs.select("l", "r").distinct(), ["l", "r"]))
        cur = scratch.write(pairs.join(names, ["l", "r"]).select("doc_id", "sha", "n", "idx", "name", "m"))
        scratch.drop(pairs)
        scratch.drop(names)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row. The largest doc_id of a group stays."""
    scratch = Scratch(docs.sparkSession, "groups")
    ids = scratch.write(identities(docs, block))
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.max(F.struct("doc_id", "sha")).alias("last"))
    # Only groups of several rows are joined: written first, so that a hot group's rows can be split.
    several = scratch.write(groups.where("group_size > 1").drop("last"))
    out = ids.join(several, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names.

    Where an id has one row, the ids that go are enough, and no text is shuffled. Rows of null or repeated ids
    are told apart by their text as well; of those that agree in both, the first by its JSON stays.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = scratch.write(exact_groups(docs, block).select("doc_id", "kept", "text_sha256"))
    ids = scratch.write(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).where("n > 1 or not kept or doc_id is null"))
    own = free_name(docs.columns, "gone")
    same = docs["doc_id"].eqNullSafe(F.col(own))
    stay = docs.join(few(ids.select(F.col("doc_id").alias(own))), same, "left_anti")
    unclear = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(own))
    if not unclear.limit(1).count():
        return stay
    unclear = few(unclear)
    kept = groups.where("kept").join(unclear, groups["doc_id"].eqNullSafe(F.col(own)), "left_semi").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    rows = docs.join(unclear, same, "left_semi").select(F.struct(*quoted(docs.columns)).alias("row"), "doc_id", sha.alias("text_sha256"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha")), "left_semi")
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stay.unionByName(rows.select("row.*"))
