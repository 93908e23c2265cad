"""Column builders for job telemetry and for admission control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STALE_SECONDS, MISSING_SECONDS, LOG_TAIL, LOG_RING = 20, 999_999, 25, 500


def tail(values: Column, n: int) -> Column:
    """The last n items of an array; all of a shorter one."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def effective_state(state: Column, updated_at: Column, alive: Column, now: Column) -> Column:
    state = F.coalesce(state, F.lit("unknown"))
    age = F.coalesce(now - updated_at, F.lit(MISSING_SECONDS))
    return (
        F.when(state == "finished", "finished")
        .when(F.coalesce(alive, F.lit(False)), state)
        .when(state.isin("running", "initializing") & (age > STALE_SECONDS), "interrupted")
        .otherwise(state)
    )


def back_pressure(logs: Column) -> Column:
    said = F.exists(tail(logs, LOG_TAIL), lambda x: F.lower(x).contains("back-pressure active") | F.lower(x).contains("throttle:"))
    return F.when(logs.isNull() | (F.size(logs) <= 0), "unknown").when(said, "active").otherwise("normal")


def throttle_delay(waiting: Column, capacity: Column) -> Column:
    occupied = waiting / F.greatest(capacity, F.lit(1))
    return F.when(occupied < 0.7, 0.0).otherwise(F.least(F.lit(0.4), (occupied - 0.7) * 0.8))


def crawler_id(epoch: Column, run: Column) -> Column:
    return F.concat(F.lit("["), epoch.cast("string"), F.lit("_"), run.cast("string"), F.lit("]"))


def clamped(value, least, most=None, default=None):
    """A driver-side parameter as a number within bounds; raises ValueError with the value for anything else."""
    if value is None or value == "":
        value = default if default is not None else least
    try:
        value = type(least)(value)
    except (TypeError, ValueError):
        raise ValueError(f"not a number: {value!r}") from None
    value = max(least, value)
    return value if most is None else min(most, value)
