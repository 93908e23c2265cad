"""Mixing sources to target weights, in DataFrame operations only.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share all words by weight. A
target stops at LIMIT times its source's size; the excess is shared again by weight among the others until
none is above. With exact integers this takes as many rounds as it caps sources anew, and each round is one
aggregate of the table of sources.

Cuts: a document's key is a hash of its id, so a source sorted by it is in random order. The keys are cut
into ranges of equal width (equal depth, as they are hashes). The words of each (source, range) give prefix
sums over ranges, at most MOST_RANGES for a source; these tell the one range where the source's budget
ends, and only the documents of that range are sorted to find the document where it ends. A budget of more
than the source's size takes whole epochs first. So no task ever holds a source: a source with a third of
all rows spreads over all ranges.

Every document before the cut is taken once more than those after it, and the document at the cut gives the
words that are left, so a source gives its rounded target exactly. No document exceeds LIMIT times its size.

Nulls: a null text has size 0; a null source is a source; a null doc_id has a key of its own. Rows that
agree in all of key, doc_id and size and lie at the cut share what is left of the budget in equal parts.
With no words at all every target is 0. A very long text is one document, and may be cut. A table without
rows gives none. Only doc_id, source and text are read; mix_documents() passes all columns, whatever their
names, and changes text and n_chars only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, quoted, word_count

WEIGHTS, LIMIT, MOST_RANGES = (5, 2, 1), 3, 65536


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank, from 0, by source in code-point order, null last: row numbers within ranges plus prefix sums over ranges."""
    table = scratch.write(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    # A row for each partition.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = table.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return table.join(parts, "part").select(*sources.columns, (F.col("before") + F.col("seq")).alias("rank"))


def targets(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, weight, target for each source."""
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = scratch.write(sources.withColumn("weight", weight).drop("rank"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    total = sources.agg(F.sum(exact("source_size")).alias("s")).first().s or 0
    held, share = F.lit(False), (int(total), 1)
    seen = -1
    while True:
        # Sums of what is held at its limit, and of the weights of the others: two numbers.
        r = sources.agg(
            F.sum(F.when(held, exact("source_size") * limit)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("w"), F.count_if(held).alias("n")
        ).first()
        left, w = int(total) - int(r.held or 0), int(r.w or 0)
        if r.n == seen or not w:
            break
        seen, share = r.n, (left, w)
        held = exact("source_size") * limit * F.lit(w).cast("decimal(18,0)") < F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")
    target = F.when(held, (F.col("source_size") * limit).cast("double")).otherwise(F.lit(share[0]).cast("double") * F.col("weight") / F.lit(share[1]).cast("double"))
    return sources.withColumn("target", target)


def cuts(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(sized documents, a row for each source: source, source_size, target, epochs, rest, cut_key, cut_id, cut_size, cut_words).

    rest is what the source gives beyond whole epochs; the cut columns are null where it is 0.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(_sized(docs))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    per = F.when(F.col("source_size") > 0, F.col("source_size"))
    sources = targets(sized, scratch, weights, limit).withColumns({"epochs": F.coalesce(F.least(F.expr("floor(target + 0.5)").cast("long"), F.col("source_size") * limit) / per, F.lit(0)).cast("long")})
    sources = scratch.write(sources.withColumn("rest", F.least(budget, F.col("source_size") * limit) - F.col("epochs") * F.col("source_size")).drop("weight"))
    # About 512 documents a range, by the first bits of the key.
    bits = max(4, min(MOST_RANGES.bit_length() - 1, (sized.count() // 512).bit_length()))
    ranges = sized.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits))
    sums = scratch.write(ranges.groupBy("source", "range").agg(F.sum("size").alias("words")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sources.where("rest > 0").select(F.col("source").alias("s"), "rest")
    last = sums.withColumn("before", before).join(open_, F.col("source").eqNullSafe(F.col("s"))).where("before < rest and rest <= before + words").select("s", F.col("range").alias("r"), "before", "rest")
    last = scratch.write(last)
    order = ["key", "doc_id", "size"]
    within = Window.partitionBy("s").orderBy(*order)
    here = (
        ranges.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .groupBy("s", "rest", "before", *order)
        .agg(F.count("*").alias("m"))
        .withColumn("lead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    cut = here.where("lead < rest and rest <= lead + size * m").select(
        "s", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.expr("(rest - lead) div m").alias("cut_words")
    )
    return sized, scratch.write(sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _taken(rows: DataFrame) -> DataFrame:
    """rows with key, size and the columns of cuts(): adds taken."""
    mine, cut = F.struct("key", "doc_id", "size"), F.struct("cut_key", F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("size"))
    more = F.when(F.col("rest") == 0, 0).when(mine.eqNullSafe(cut), F.col("cut_words")).when(mine < cut, F.col("size")).otherwise(0)
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long"))


def _with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    renamed = cut.withColumnRenamed("source", "__source")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row."""
    sized, cut = cuts(docs, weights, limit)
    return _taken(_with_cuts(sized, cut)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mix itself, with the columns of docs: each row once for each whole time it is taken, and once more cut to its first words, joined by one space, for what is left.

    n_chars, where docs has it, follows a text that was cut. Texts are not shuffled: each row finds its place from its key and its source's cut.
    """
    _, cut = cuts(docs, weights, limit)
    cols = docs.columns
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key")
    rows = docs.select(F.struct(*quoted(cols)).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), key)
    rows = _taken(_with_cuts(rows, cut)).where("taken > 0")
    whole, part = F.expr("taken div size"), F.expr("taken % size")
    times = F.transform(F.sequence(F.lit(1), whole + F.when(part > 0, 1).otherwise(0)), lambda i: F.when(i > whole, part).otherwise(F.lit(None).cast("long")))
    rows = rows.select("row", F.explode(times).alias("words"))
    text = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("words").cast("int"))), " "))
    out = {c: F.col("row").getField(c) for c in cols}
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("words").isNull(), out["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(k) for k, v in out.items()])
