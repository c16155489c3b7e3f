"""Streams with timers against batches: after a restart, out of order, with late, null and repeated rows."""

import datetime
import random

from pyspark.sql import functions as F

from quorumlake.streaming import jobs, timers

SCHEMA = "job long, ts timestamp, id long, kind string"
DAY = datetime.datetime(2024, 3, 1)


def made(rng, days, n):
    kinds = ["lease", "error", "ok", None]
    at = lambda: DAY + datetime.timedelta(days=rng.choice(days), seconds=rng.randrange(0, 86_400, 600))
    return [(rng.choice([1, 2, 3, None]), at(), rng.randrange(10**6), rng.choice(kinds)) for _ in range(n)]


def settled(spark, rows, until):
    return spark.createDataFrame([r for r in rows if r[1] is not None and r[1] < until], SCHEMA)


def test_restarted_streams_equal_batches(spark, tmp_path):
    rng = random.Random(3)
    first, second = made(rng, [0, 1, 2], 200), made(rng, [3, 4, 5], 200)
    first += [(1, None, 1, "lease"), first[0]]
    late = [(1, DAY, 7, "lease")]  # two days behind the watermark when it comes
    mark = [(9, DAY + datetime.timedelta(days=7), 1, "ok")]
    lease, failed = F.col("kind") == "lease", F.col("kind") == "error"
    plans = {"leases": lambda s: timers.lease_stream(s, "job", "ts", lease, 3600, buckets=3), "streaks": lambda s: timers.streak_stream(s, "job", "ts", "id", failed, buckets=3)}
    told, schema = {}, spark.createDataFrame([], SCHEMA).schema
    for k, rows in enumerate((first, second + late, mark)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, plan in plans.items():
            told[name] = timers.drained(spark, str(tmp_path / "in"), schema, plan, str(tmp_path / name), str(tmp_path / f"{name}-state"))
            assert k or told[name].where("slot is null").count() == 0
    whole = settled(spark, first + second, DAY + datetime.timedelta(days=6))
    got = sorted(map(str, told["leases"].collect()))
    assert got and got == sorted(map(str, timers.leases(whole, "job", "ts", lease, 3600).collect()))
    want = jobs.failure_streaks(whole, "job", ["ts", "id"], F.coalesce(failed, F.lit(False))).select("job", "longest", "stopped")
    assert sorted(map(str, timers.streaks(told["streaks"], "job").drop("n").collect())) == sorted(map(str, want.collect()))
    assert timers.streaks(told["streaks"], "job").agg(F.sum("n")).first()[0] == whole.count()


def test_streams_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "in"))
    got = timers.drained(spark, str(tmp_path / "in"), empty.schema, lambda s: timers.lease_stream(s, "job", "ts", F.col("kind") == "lease", 60))
    assert got.count() == 0 and got.columns == ["job", "slot", "leased_at", "answered_at"]
    assert timers.leases(empty, "job", "ts", F.col("kind") == "lease", 60).count() == 0


def test_lease_by_hand(spark):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 1, "lease"), (1, at(0), 2, "ok"), (1, at(60), 3, "ok"), (1, at(100), 4, "lease"), (1, at(161), 5, "ok"), (1, at(86_390), 6, "lease"), (1, at(86_410), 7, "lease")]
    got = timers.leases(spark.createDataFrame(rows, SCHEMA), "job", "ts", F.col("kind") == "lease", 60).orderBy("leased_at").collect()
    base = 19_783 * 86_400 * 10**6
    assert [(r["leased_at"] - base, r["answered_at"] and r["answered_at"] - base) for r in got] == [(0, 60 * 10**6), (100 * 10**6, None), (86_390 * 10**6, 86_410 * 10**6), (86_410 * 10**6, None)]
