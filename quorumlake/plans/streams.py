"""Queries that run as streams, over all of a table's files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.plans.registry import query
from quorumlake.sources.tables import table
from quorumlake.streaming import timers

# what the last watermark (ten minutes behind the latest event) has passed is told
_TOLD = "w as (select epoch_ms(max(ts)) - 600000 as w from events), e as (select *, epoch_us(ts) as us, floor(epoch_us(ts) / 86400000000)::bigint as slot from events where ts is not null)"


@query(f"""with {_TOLD}, a as (select user_id, slot, event_type, us as leased_at,
  min(us) over (partition by user_id order by us range between 1 following and 7200000000 following) as answered_at from e)
select user_id, slot, leased_at, answered_at from a, w where event_type = 'signup' and (slot + 1) * 86400000 + 7200000 <= w""")
def lease_stream(spark, d):
    lease = F.col("event_type") == "signup"
    plan = lambda events: timers.lease_stream(events, "user_id", "ts", lease, 7200, buckets=16)
    return timers.drained(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema, plan)


@query(f"""with {_TOLD}, f as (select user_id, us, event_id, (coalesce(event_type, '') = 'error')::int as f from e, w where (slot + 1) * 86400000 <= w),
s as (select *, sum(1 - f) over (partition by user_id order by us, event_id rows unbounded preceding) as g from f),
r as (select user_id, g, sum(f) as longest, count(*) as n from s group by 1, 2)
select user_id, sum(n)::bigint as n, max(longest)::bigint as longest, max(longest) >= 3 as stopped from r group by 1""")
def streak_stream(spark, d):
    failed = F.col("event_type") == "error"
    plan = lambda events: timers.streak_stream(events, "user_id", "ts", "event_id", failed, buckets=16)
    return timers.streaks(timers.drained(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema, plan), "user_id")
