"""Keyed stream state with event-time timers: leases and failures of job events, as streams and as batches.

Rows wait in the state of their bucket of keys and slot of time until the watermark has passed all that could still come
for them; a timer then settles the slot once, in order of time whatever the order of arrival was, and clears its state. A
key of any size is spread over its slots, and no state outlives its slot. A call of the state costs milliseconds, so
that keys share it: ``buckets`` is to be chosen so that what a slot's time brings to one of them fits a task. Rows later than the watermark come too late,
as in any stream; rows without a time have no place in one and are left out of streams and batches alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quorumlake.sources.tables import shared_dir
from quorumlake.streaming.jobs import STOP_AFTER

SECOND = 1_000_000
DAY = 86_400
BUCKETS = 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Slots(StatefulProcessor):
    """Keeps the rows of a (bucket, slot) until event time has reached the slot's end, then gives ``settle`` of them."""

    def __init__(self, names: list[str], schema: StructType, reach: int, length: int, settle: Callable[[pd.DataFrame], pd.DataFrame]):
        self.names, self.schema, self.reach, self.length, self.settle = names, schema, reach, length, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            self.handle.registerTimer(((int(key[1]) + 1) * self.length + self.reach) * 1000)
        for table in rows:
            self.waiting.appendList(list(zip(*(table[n].tolist() for n in self.names), strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        table = pd.DataFrame(list(self.waiting.get()), columns=self.names).sort_values(self.names, kind="stable", ignore_index=True)
        self.waiting.clear()
        yield self.settle(table).assign(slot=int(key[1]))

    def close(self) -> None:
        pass


def _timed(events: DataFrame, key: str, ts: str, length: int, late: str) -> DataFrame:
    """Events that have a time, with it in microseconds, its slot of ``length`` seconds and their key as a text (a null
    one is empty)."""
    rows = events.where(F.col(ts).isNotNull()).withColumn("_time", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_time", late) if events.isStreaming else rows
    rows = rows.withColumn("at", F.unix_micros("_time")).withColumn("who", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return rows.withColumn("slot", F.expr(f"(at - pmod(at, {length * SECOND})) div {length * SECOND}"))


def _settled(rows: DataFrame, names: list[str], out: str, key: str, kind: str, buckets: int, reach: int, length: int, settle: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Settled slots of a stream of (who, slot, names), ``who`` as the key it stands for."""
    processor = Slots(names, rows.select(*names).schema, reach, length, settle)
    keyed = rows.withColumn("bucket", F.pmod(F.hash("who"), F.lit(buckets))).groupBy("bucket", "slot")
    told = keyed.transformWithStateInPandas(processor, f"who string, {out}, slot long", "append", "eventTime")
    return told.select(F.when(F.col("who") != "", F.substr("who", F.lit(2))).cast(kind).alias(key), "slot", *[c for c in told.columns if c not in ("who", "slot")])


# --- leases ----------------------------------------------------------------------------------------------------------


def _asked(events: DataFrame, key: str, ts: str, lease: Column, seconds: int, late: str) -> DataFrame:
    """Events in their slot, and those of a slot's first ``seconds`` also in the one before, as answers to its leases."""
    length = max(DAY, seconds)
    timed = _timed(events.withColumn("lease", F.coalesce(lease, F.lit(False))), key, ts, length, late)
    part = lambda s, x: F.struct(s.alias("s"), x.alias("l"))
    own, before = part(F.col("slot"), F.col("lease")), part(F.col("slot") - 1, F.lit(False))
    early = F.pmod("at", F.lit(length * SECOND)) <= seconds * SECOND
    return timed.withColumn("_p", F.explode(F.when(early, F.array(own, before)).otherwise(F.array(own)))).withColumns({"slot": F.col("_p.s"), "lease": F.col("_p.l")})


def _answers(table: pd.DataFrame, seconds: int) -> pd.DataFrame:
    at = table["at"].to_numpy(np.int64)
    who = pd.factorize(table["who"])[0]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(who) != 0)]))  # of equal (who, at)
    asked = np.flatnonzero(table["lease"].to_numpy(bool))
    place = np.append(starts, len(at))[np.searchsorted(starts, asked, side="right")]
    after = np.minimum(place, len(at) - 1)
    met = (place < len(at)) & (who[after] == who[asked]) & (at[after] - at[asked] <= seconds * SECOND)
    return pd.DataFrame({"who": table["who"].to_numpy()[asked], "leased_at": at[asked], "answered_at": pd.Series(at[after], dtype="Int64").where(met)})


def lease_stream(events: DataFrame, key: str, ts: str, lease: Column, seconds: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, slot, leased_at, answered_at) in microseconds from a stream: each lease (an event of which ``lease`` is true)
    with the next event of its key that is later than it by at most ``seconds``; null where the lease ran out. A slot (a
    day, or ``seconds`` if those are more) is told once the watermark is ``seconds`` past its end. A null key is a key."""
    rows = _asked(events, key, ts, lease, seconds, late).select("who", "slot", "at", "lease", "_time")
    kind = events.schema[key].dataType.simpleString()
    return _settled(rows, ["who", "at", "lease"], "leased_at long, answered_at long", key, kind, buckets, seconds, max(DAY, seconds), lambda table: _answers(table, seconds))


def leases(events: DataFrame, key: str, ts: str, lease: Column, seconds: int) -> DataFrame:
    """What ``lease_stream`` tells, of a batch: of all slots."""
    rows = _asked(events, key, ts, lease, seconds, "").select(key, "slot", "at", "lease")
    ahead = Window.partitionBy(key, "slot").orderBy("at").rangeBetween(1, seconds * SECOND)
    return rows.withColumn("answered_at", F.min("at").over(ahead)).where("lease").select(key, "slot", F.col("at").alias("leased_at"), "answered_at")


# --- failures in a row ------------------------------------------------------------------------------------------------


def _runs(table: pd.DataFrame) -> pd.DataFrame:
    run = (~table["failed"].astype(bool)).groupby(table["who"]).cumsum().rename("run")  # 0: before the first success
    counts = table["failed"].astype(int).groupby([table["who"], run]).sum().rename("f").reset_index()
    by = counts.groupby("who")
    lead = counts[counts["run"] == 0].set_index("who")["f"]
    out = pd.DataFrame({"n": table.groupby("who").size(), "n_good": by["run"].max(), "tail": by["f"].last(), "longest": by["f"].max()})
    return out.assign(lead=lead.reindex(out.index).fillna(0).astype(int)).reset_index()[["who", "n", "n_good", "lead", "tail", "longest"]]


def streak_stream(events: DataFrame, key: str, ts: str, order: str, failed: Column, length: int = DAY, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, slot, n, n_good, lead, tail, longest) from a stream: of the events of a key in a slot of ``length`` seconds, in
    order of (ts, order), their number, that of successes, the failures before the first success and after the last one,
    and the most in a row. A slot is told once the watermark has passed its end; ``streaks`` puts slots together. A null
    ``failed`` is no failure, a null ``order`` comes first."""
    timed = _timed(events.withColumn("failed", F.coalesce(failed, F.lit(False))), key, ts, length, late)
    rows = timed.select("who", "slot", "at", F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("ord"), "failed", "_time")
    kind = events.schema[key].dataType.simpleString()
    return _settled(rows, ["who", "at", "ord", "failed"], "n long, n_good long, lead long, tail long, longest long", key, kind, buckets, 0, length, _runs)


def streaks(slots: DataFrame, key: str) -> DataFrame:
    """(key, n, longest, stopped) of settled slots: runs of failures go on from slot to slot; STOP_AFTER in a row stop.
    A key has one row a slot here, so that its window is as long as time has slots, not as it has events."""
    w = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda r, f: F.struct(r.alias("r"), F.col(f).alias("f"))
    last = F.col("_run")  # the runs that end in the slot's first success and that begin after its last one
    parts = F.when(F.col("n_good") > 0, F.array(part(last - F.col("n_good"), "lead"), part(last, "tail"))).otherwise(F.array(part(last, "n")))
    runs = slots.withColumn("_run", F.sum("n_good").over(w)).withColumn("_p", F.explode(parts))
    across = runs.groupBy(key, F.col("_p.r").alias("_r")).agg(F.sum("_p.f").alias("longest")).select(key, F.lit(0).cast("long").alias("n"), "longest")
    longest = F.max("longest")
    return across.unionByName(slots.select(key, "n", "longest")).groupBy(key).agg(F.sum("n").alias("n"), longest.alias("longest"), (longest >= STOP_AFTER).alias("stopped"))


# --- running a stream over what there is -----------------------------------------------------------------------------


def drained(spark: SparkSession, source: str, schema: StructType, plan: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The table that the stream ``plan`` of Parquet files (a folder's or a glob's) writes when it has read all there are (available-now trigger).
    Called again with the same ``out`` and ``checkpoint``, it goes on with the files that are new since. The stream runs
    in a session of its own, whose state is in RocksDB; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{folder}/out", checkpoint or f"{folder}/checkpoint"
    stream = plan(own.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
