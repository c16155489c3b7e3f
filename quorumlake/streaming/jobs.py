"""Job events: failures in a row, leases, budgets; as batches and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP_AFTER = 3


def failure_streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, longest, stopped): the longest run of failures in a row; a success ends one; STOP_AFTER of them stop."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = events.withColumn("_f", failed.cast("int")).withColumn("_streak", F.sum(1 - F.col("_f")).over(w))
    streaks = runs.groupBy(key, "_streak").agg(F.sum("_f").alias("_n"))
    return streaks.groupBy(key).agg(F.max("_n").alias("longest")).withColumn("stopped", F.col("longest") >= STOP_AFTER)


def expired_leases(events: DataFrame, key: str, ts: str, kind: str, lease: str, seconds: int) -> DataFrame:
    """Leases (events of kind ``lease``) with no later event of their key within ``seconds``."""
    following = events.withColumn("_next", F.lead(ts).over(Window.partitionBy(key).orderBy(ts)))
    late = F.col("_next").isNull() | (F.col("_next").cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double") > seconds)
    return following.where((F.col(kind) == lease) & late).groupBy(key).agg(F.count(F.lit(1)).alias("n_expired"))


def running_cost(events: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """By key, the events until its costs pass ``budget``."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_spent", spent).groupBy(key).agg(F.count_if(F.col("_spent") <= budget).alias("n_within"), F.count(F.lit(1)).alias("n"))


def poll(jobs: DataFrame, priority: str, ident: str, n: int = 1) -> DataFrame:
    """The next jobs: highest priority first, then the smallest id."""
    return jobs.orderBy(F.desc(priority), ident).limit(n)


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window, for a stream (with a watermark) as for a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def streaming_streaks(events: DataFrame, key: str, failed: str) -> DataFrame:
    """(key, streak, stopped) updates of a stream of (key, failed): the count of failures since the last success, kept
    by key; the update that reaches STOP_AFTER says so."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for batch in batches:
            good = np.flatnonzero(~batch[failed].fillna(False).to_numpy(bool))
            streak = len(batch) - 1 - good[-1] if len(good) else streak + len(batch)
        state.update((int(streak),))
        yield pd.DataFrame({key: [k[0]], "streak": [int(streak)], "stopped": [bool(streak >= STOP_AFTER)]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, streak long, stopped boolean", "streak long", "update", "NoTimeout")
