"""Job status from an append-only table of events: snapshots, history, and what changed since a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import status as S

QUEUE_SHOWN = 200
TERMINAL = ("finished", "interrupted", "unknown", "failed")


def snapshots(events: DataFrame, state) -> DataFrame:
    """crawler_id, state, updated_at, pages_processed, pages_indexed, pages_failed, log_count, logs (the last 500) from crawler_id, seq, ts, message, failed.

    Only the last LOG_RING messages of a job are gathered: they are ranked first, so a long job's log never meets in one row.
    """
    from pyspark.sql import Window

    last = Window.partitionBy("crawler_id").orderBy(F.desc("seq"))
    tail = events.withColumn("k", F.row_number().over(last)).where(F.col("k") <= S.LOG_RING)
    logs = tail.groupBy("crawler_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("l")).select("crawler_id", F.col("l.message").alias("logs"))
    totals = events.groupBy("crawler_id").agg(
        F.max_by(state, "seq").alias("state"), F.max("ts").alias("updated_at"), F.count("*").alias("pages_processed"),
        F.count_if(~F.col("failed")).alias("pages_indexed"), F.count_if("failed").alias("pages_failed"), F.max("seq").alias("version"), F.count("*").alias("log_count"),
    )
    return totals.join(logs, "crawler_id")


def history(states: DataFrame) -> DataFrame:
    """Latest first; missing values as defaults."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default)).alias(name)
    return states.select("crawler_id", c("origin", ""), c("state", "unknown"), c("updated_at", 0), c("pages_indexed", 0), c("queue_size", 0)).orderBy(F.desc("updated_at"), "crawler_id")


def latest(states: DataFrame) -> DataFrame:
    return states.agg(F.max_by("crawler_id", F.struct("updated_at", "crawler_id")).alias("crawler_id"), F.max("updated_at").alias("updated_at"))


def poll_delta(states: DataFrame, since: int, since_log: int, now: int) -> DataFrame:
    """What a client at cursors (since, since_log) gets: new logs by their running number, so a full ring loses nothing that is still held."""
    state = S.effective_state(F.col("state"), F.col("updated_at"), F.lit(False), F.lit(now))
    rows = states.withColumn("state", state)
    held_from = F.col("log_count") - F.size("logs")
    start = F.greatest(F.lit(since_log) - held_from, F.lit(0)).cast("int")
    rows = rows.withColumn("new_logs", F.slice("logs", start + 1, F.greatest(F.size("logs") - start, F.lit(0))))
    rows = rows.withColumns({"done": F.col("state").isin(*TERMINAL), "back_pressure": S.back_pressure(F.col("logs"))})
    changed = (F.col("updated_at") > since) | (F.col("log_count") > since_log) | F.col("done")
    return rows.withColumn("changed", changed)
