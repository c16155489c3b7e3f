"""The queries over the driver's tables, one per operator, with their SQL.

A supplier stands for a run (its lines are the run's rows), a market segment or a return flag for a model, a part or an
order for an entity. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.functions.similarity import with_similarity
from quorumlake.operators import extract, fusion, fuzzy_join, growing_master, mart, matching, metrics, provenance, quality, ranking, resampling, selection, stats
from quorumlake.plans.registry import query, r4, rounded
from quorumlake.sources.tables import merge_mart, shared_dir, table, written
from quorumlake.streaming import jobs

TAUS = (0.0, 0.25, 0.5, 0.75)
THRESHOLDS = (75.0, 80.0, 85.0, 90.0, 95.0)
BANNED = ("example.com", "example.org")


# --- quality without a reference -------------------------------------------------------------------------------------


@query("""
with per as (
  select l_suppkey, count(*) as n_rows,
    sum((l_returnflag <> '')::int + (l_linestatus <> '')::int + (l_quantity is not null)::int) / (count(*) * 3.0) as completeness,
    avg((l_returnflag in ('A', 'R'))::int::double) as l_returnflag_in_vocabulary, avg((l_linestatus in ('O'))::int::double) as l_linestatus_in_vocabulary,
    least(count(distinct l_partkey) / 20.0, 1.0) as source_diversity, avg((l_quantity >= 0)::int::double) as capacity_nonnegative
  from lineitem group by 1),
m as (select l_suppkey, 1 - max(n) / sum(n)::double as source_spread from (select l_suppkey, l_partkey, count(*) as n from lineitem group by all) group by 1)
select l_suppkey, n_rows, round(completeness::double, 4) as completeness, round(l_returnflag_in_vocabulary, 4) as l_returnflag_in_vocabulary,
  round(l_linestatus_in_vocabulary, 4) as l_linestatus_in_vocabulary, round(source_diversity::double, 4) as source_diversity, round(capacity_nonnegative, 4) as capacity_nonnegative, round(source_spread, 4) as source_spread
from per join m using (l_suppkey)""")
def mechanical_scores(spark, d):
    return rounded(quality.mechanical_scores(table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus", "l_quantity"], {"l_returnflag": ["A", "R"], "l_linestatus": ["O"]}, "l_partkey", "l_quantity"))


_VETO_SQL = """select user_id, count(distinct round(value)) as capacity_distinct, count(distinct lower(event_type)) as status_distinct,
  (count(distinct round(value)) <= 4 or count(distinct lower(event_type)) <= 1)::int::bigint as veto from events group by 1"""


@query(_VETO_SQL)
def variability_veto(spark, d):
    return quality.variability_veto(table(spark, d, "events"), "user_id", F.round("value"), F.col("event_type")).withColumn("veto", F.col("veto").cast("long"))


@query("""with v as (select c_custkey, c_mktsegment, ((count(distinct o_orderpriority) <= 4) or (count(distinct lower(o_orderstatus)) <= 1))::int as veto
  from customer join orders on o_custkey = c_custkey group by 1, 2)
select c_mktsegment, count(*) as n_runs, round(avg(veto), 4) as veto_fraction, min(veto) = 1 as all_vetoed from v group by 1""")
def reliability_grade(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    vetoes = quality.variability_veto(rows, "c_custkey", F.col("o_orderpriority"), F.col("o_orderstatus"))
    return rounded(quality.reliability_grade(vetoes.join(table(spark, d, "customer"), "c_custkey"), "c_mktsegment"))


def _run_scores(spark, d):
    lines = table(spark, d, "lineitem")
    scores = quality.mechanical_scores(lines, "l_suppkey", ["l_returnflag"], {"l_returnflag": ["A", "R"], "l_linestatus": ["O"]}, "l_partkey", "l_quantity")
    return scores.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))


_RUN_SQL = """with s as (select l_suppkey, s_nationkey, avg((l_returnflag in ('A', 'R'))::int::double) as flag, avg((l_linestatus = 'O')::int::double) as stat
  from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)"""


@query(f"""{_RUN_SQL}, t as (select unnest([0.0, 0.25, 0.5, 0.75])::double as tau)
select tau, s_nationkey::bigint as s_nationkey, count(*) as n_runs, count(*) filter (least(flag, stat) > tau) as n_good, count(*) filter (least(flag, stat) > tau) = 0 as disqualified from s, t group by 1, 2""")
def gate_sensitivity(spark, d):
    return rounded(quality.gate_sensitivity(_run_scores(spark, d), "s_nationkey", ["l_returnflag_in_vocabulary", "l_linestatus_in_vocabulary"], list(TAUS)))


@query(f"""{_RUN_SQL}, m as (select s_nationkey, avg(flag) as flag, avg(stat) as stat from s group by 1),
x as (select 'l_returnflag_in_vocabulary' as dimension, max(flag) - min(flag) as spread from m union all select 'l_linestatus_in_vocabulary', max(stat) - min(stat) from m)
select dimension, round(spread, 4) as spread from x where spread >= 0.01""")
def discriminating_dimensions(spark, d):
    return rounded(quality.discriminating_dimensions(_run_scores(spark, d), "s_nationkey", ["l_returnflag_in_vocabulary", "l_linestatus_in_vocabulary"], 0.01))


@query("""select o_orderkey, unnest(list_filter([case when o_totalprice <= 1000 then 'low_price' end, case when o_orderstatus = 'P' then 'open_status' end,
  case when o_orderpriority = '4-NOT SPECIFIED' then 'no_priority' end], lambda x: x is not null)) as issue from orders""")
def row_coherence(spark, d):
    rules = {"low_price": F.col("o_totalprice") <= 1000, "open_status": F.col("o_orderstatus") == "P", "no_priority": F.col("o_orderpriority") == "4-NOT SPECIFIED"}
    return quality.row_issues(table(spark, d, "orders"), "o_orderkey", rules)


@query("select lower(trim(p_name)) as key_0, lower(p_brand) as key_1, count(*) as n, min(p_partkey) as first_row, max(p_partkey) as last_row from part group by 1, 2 having count(*) > 1")
def duplicate_entities(spark, d):
    return quality.duplicates(table(spark, d, "part"), [F.lower(F.trim("p_name")), F.lower("p_brand")], "p_partkey")


_TOTALS = [(1, None, None, 2_900_000.0), (2, "Brand#2", None, 110_000.0), (3, None, "PROMO", 500_000.0), (4, "Brand#17", "SMALL", 0.0), (5, "Brand#3", "LARGE", 20_000.0)]


@query("""with t(total_id, p_brand, p_type, declared) as (values (1, null, null, 2900000.0), (2, 'Brand#2', null, 110000.0), (3, null, 'PROMO', 500000.0), (4, 'Brand#17', 'SMALL', 0.0), (5, 'Brand#3', 'LARGE', 20000.0)),
s as (select t.total_id, t.p_brand, t.p_type, t.declared, coalesce(sum(p_retailprice), 0) as observed from t left join part p on (t.p_brand is null or t.p_brand = p.p_brand) and (t.p_type is null or t.p_type = p.p_type) where declared <> 0 group by all)
select total_id::bigint as total_id, p_brand, p_type, declared::double as declared, round(observed, 2) as observed, round(abs(observed - declared) / declared, 4) as deviation,
  case when abs(observed - declared) / declared > 0.2 then 'error' when abs(observed - declared) / declared > 0.05 then 'warning' else 'ok' end as severity from s""")
def control_totals(spark, d):
    totals = spark.createDataFrame(_TOTALS, "total_id long, p_brand string, p_type string, declared double")
    out = quality.control_totals(table(spark, d, "part"), totals, ["p_brand", "p_type"], "p_retailprice")
    return out.withColumn("observed", F.round("observed", 2)).withColumn("deviation", r4("deviation"))


@query("""select l_orderkey as plant, sum(l_quantity::bigint)::bigint as capacity, max(case l_linestatus when 'O' then 2 when 'F' then 1 else 0 end)::bigint as status_rank, count(*) as n_units,
  string_agg(lpad(l_linenumber::varchar, 4, '0'), ',' order by l_linenumber) as units from lineitem group by 1""")
def unit_rollup(spark, d):
    rank = F.when(F.col("l_linestatus") == "O", 2).when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return rounded(quality.unit_rollup(table(spark, d, "lineitem"), F.col("l_orderkey"), "l_quantity", rank, "l_linenumber"))


@query("select l_orderkey, count(distinct l_linestatus) as n_values from lineitem group by 1 having count(distinct l_linestatus) > 1")
def rollup_invariants(spark, d):
    return quality.not_unique(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


@query("select p_type, count(*) as n from part where p_type not in ('PROMO', 'SMALL', 'LARGE') group by 1")
def outside_vocabulary(spark, d):
    return quality.outside_vocabulary(table(spark, d, "part"), "p_type", spark.createDataFrame([("PROMO",), ("SMALL",), ("LARGE",)], "p_type string"))


@query("""with s as (select l_returnflag, case when l_discount > 0.09 then 0 when l_tax = 0 then 1 when l_tax < 0.03 then 2 when l_tax < 0.06 then 3 else 4 end as score from lineitem)
select l_returnflag, round(avg(score), 4) as mean_score, count(*) filter (score = 0) as n_0, count(*) filter (score = 1) as n_1, count(*) filter (score = 2) as n_2, count(*) filter (score = 3) as n_3, count(*) filter (score = 4) as n_4 from s group by rollup(l_returnflag)""")
def evidence_summary(spark, d):
    score = F.when(F.col("l_discount") > 0.09, 0).when(F.col("l_tax") == 0, 1).when(F.col("l_tax") < 0.03, 2).when(F.col("l_tax") < 0.06, 3).otherwise(4)
    return rounded(quality.evidence_summary(table(spark, d, "lineitem").withColumn("score", score), "l_returnflag"))


@query("""with s as (select p_brand, case p_type when 'SMALL' then p_retailprice <= 1350 when 'PROMO' then p_retailprice <= 3200 when 'MEDIUM' then p_retailprice >= 1300 when 'LARGE' then p_retailprice > 0 end as ok from part)
select p_brand, round(avg(ok::int), 4) as share, count(ok) as n_told from s group by 1""")
def level_scores(spark, d):
    level = F.when(F.col("p_type") == "SMALL", "unit").when(F.col("p_type") == "PROMO", "Plant").when(F.col("p_type") == "MEDIUM", "block").when(F.col("p_type") == "LARGE", "complex").otherwise("unknown")
    rows = table(spark, d, "part").withColumn("ok", tx.capacity_plausible(level, F.col("p_retailprice")))
    return rounded(quality.level_scores(rows, "p_brand", "ok"))


@query("""with y as (select o_orderpriority, year(o_orderdate) as y from orders)
select o_orderpriority, 1.0::double as presence, round(avg((y between 1980 and 2100)::int), 4) as in_range, count(distinct y) as years, case when count(distinct y) <= 1 then 0.0 else round(avg((y between 1980 and 2100)::int), 4) end as plausible from y group by 1""")
def temporal_scores(spark, d):
    return rounded(quality.temporal_scores(table(spark, d, "orders"), "o_orderpriority", "o_orderdate"))


@query("select p_partkey, row_number() over (order by p_name, p_partkey) - 1 as row_no from part")
def numbered_rows(spark, d):
    return quality.numbered(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"]).select("p_partkey", F.col("row_no").cast("long").alias("row_no"))


# --- metrics ----------------------------------------------------------------------------------------------------------


def _matches(spark, d):
    """Orders as reference, their lines rolled up as the system's entities (returned ones go by a name that no order has);
    a match is exact, near or far by total."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_linestatus").alias("ls"), F.count(F.lit(1)).alias("n"), F.min("l_returnflag").alias("rf"))
    lines = lines.withColumn("l_orderkey", F.when(F.col("rf") == "R", -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey")))
    both = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    gap = F.abs(F.col("total") - F.col("o_totalprice")) / F.col("o_totalprice")
    status = F.when(F.col("l_orderkey").isNull(), "ref_only").when(F.col("o_orderkey").isNull(), "sys_only").when(gap < 0.25, "exact").when(gap < 1, "fuzzy").otherwise("fuzzy_diff")
    return both.select(
        F.coalesce("o_orderpriority", F.lit("none")).alias("run"), status.alias("status"), (F.col("o_orderstatus") == F.col("ls")).alias("status_ok"), (F.col("n") > 2).alias("fuel_ok"), (gap < 0.5).alias("capacity_ok"), (100 - 10 * gap).alias("score")
    )


_MATCHES_SQL = """with l as (select case when min(l_returnflag) = 'R' then -1 - l_orderkey else l_orderkey end as l_orderkey, round(sum(l_extendedprice), 2) as total, max(l_linestatus) as ls, count(*) as n from lineitem x group by x.l_orderkey),
b as (select *, abs(total - o_totalprice) / o_totalprice as gap from orders o full join l on o_orderkey = l_orderkey),
m as (select coalesce(o_orderpriority, 'none') as run, case when l_orderkey is null then 'ref_only' when o_orderkey is null then 'sys_only' when gap < 0.25 then 'exact' when gap < 1 then 'fuzzy' else 'fuzzy_diff' end as status,
  o_orderstatus = ls as status_ok, n > 2 as fuel_ok, gap < 0.5 as capacity_ok, 100 - 10 * gap as score from b)"""


@query(f"""{_MATCHES_SQL}, p as (select run, count(*) filter (status in ('exact', 'fuzzy', 'fuzzy_diff')) as tp, count(*) filter (status = 'sys_only') as fp, count(*) filter (status = 'ref_only') as fn,
  count(*) filter (status = 'exact') as n_exact, count(*) filter (status in ('fuzzy', 'fuzzy_diff')) as n_fuzzy, avg(fuel_ok::int) as fuel_accuracy, avg(status_ok::int) as status_accuracy, avg(capacity_ok::int) as capacity_accuracy from m group by 1)
select run, tp, fp, fn, n_exact, n_fuzzy, round(fuel_accuracy, 4) as fuel_accuracy, round(status_accuracy, 4) as status_accuracy, round(capacity_accuracy, 4) as capacity_accuracy,
  round(case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end, 4) as coverage, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end, 4) as precision, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0.0 end, 4) as f1 from p""")
def match_metrics(spark, d):
    return rounded(metrics.match_metrics(_matches(spark, d), "run"))


@query(f"""{_MATCHES_SQL}, t as (select unnest([75.0, 80.0, 85.0, 90.0, 95.0])::double as threshold),
x as (select run, threshold, status, status in ('fuzzy', 'fuzzy_diff') as fuzzy, status in ('fuzzy', 'fuzzy_diff') and not coalesce(score >= threshold, false) as falls from m, t),
p as (select run, threshold, count(*) filter (status = 'exact' or (fuzzy and not falls)) as tp, count(*) filter (status = 'sys_only' or falls) as fp, count(*) filter (status = 'ref_only' or falls) as fn from x group by 1, 2)
select *, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0.0 end, 4) as f1 from p""")
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_rescore(_matches(spark, d), "run", list(THRESHOLDS)))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(median(l_extendedprice), 4) as l_extendedprice_median, round(coalesce(stddev_samp(l_extendedprice), 0), 4) as l_extendedprice_sd, min(l_extendedprice) as l_extendedprice_min, max(l_extendedprice) as l_extendedprice_max from lineitem group by 1, 2""")
def group_medians(spark, d):
    return rounded(metrics.group_medians(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"]))


@query("""with r as (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as k, count(*) over (partition by p_brand) as n from part)
select p_brand, p_partkey, p_retailprice from r where n <= 3 or k in (0, n // 2, n - 1)""")
def low_middle_high(spark, d):
    return metrics.low_middle_high(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", ["p_retailprice", "p_partkey"])


@query("""select o_orderpriority, count(*) as n_runs, count(*) filter (o_orderstatus = 'F') as n_ok, round(sum(o_totalprice), 3) as cost_total, round(avg(o_totalprice) filter (o_totalprice > 0), 3) as cost_mean,
  round(median(o_totalprice) filter (o_orderstatus = 'F'), 3) as value_median, min(o_totalprice) filter (o_orderstatus = 'F') as value_min, max(o_totalprice) filter (o_orderstatus = 'F') as value_max from orders group by 1""")
def cost_summary(spark, d):
    return rounded(metrics.cost_summary(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_totalprice", F.col("o_orderstatus") == "F"), 3)


@query("""select coalesce(o_orderstatus, 'All') as o_orderstatus, count(*) as n, count(*) filter (o_totalprice > 250000) as covered, round(avg((o_totalprice > 250000)::int), 4) as coverage from orders group by rollup(o_orderstatus)""")
def recall_bar(spark, d):
    big = F.col("o_totalprice") > 250000
    return rounded(metrics.with_total(table(spark, d, "orders"), "o_orderstatus", [F.count(F.lit(1)).alias("n"), F.count_if(big).alias("covered"), F.avg(big.cast("double")).alias("coverage")]))


@query("select event_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from events group by 1")
def triage_shares(spark, d):
    return rounded(metrics.shares(table(spark, d, "events"), "event_type"))


@query("""with f as (select user_id as lab, event_type as s, min(ts) as t from events group by 1, 2)
select a.s as a, b.s as b, round(avg(case when a.t < b.t then 1.0 when a.t = b.t then 0.5 else 0.0 end), 4) as share, count(*) as labs from f a join f b on a.lab = b.lab and a.s <> b.s group by 1, 2 having count(*) >= 2""")
def precedence(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    return rounded(metrics.precedence_share(first, "user_id", "event_type", "t"))


@query("select o_orderpriority, round(exp(avg(ln(o_totalprice))), 2) as g from orders group by 1")
def geometric_means(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(metrics.geometric_mean("o_totalprice"), 2).alias("g"))


# --- votes and fusion -------------------------------------------------------------------------------------------------


def _assertions(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_orderkey", "l_linenumber", F.year("l_shipdate").cast("long").alias("year"))


_A_SQL = "with a as (select l_partkey, l_suppkey, l_returnflag, l_tax, l_orderkey, l_linenumber, year(l_shipdate)::bigint as year from lineitem)"


@query(f"{_A_SQL} select distinct l_partkey from a")
def union_merge(spark, d):
    return fusion.union_of(_assertions(spark, d), "l_partkey")


@query(f"{_A_SQL} select l_partkey, count(distinct l_suppkey) as n_runs from a group by 1 having count(distinct l_suppkey) >= 25")
def quorum_merge(spark, d):
    return fusion.quorum(_assertions(spark, d), "l_suppkey", "l_partkey", 25)


@query(f"{_A_SQL} select l_partkey, count(distinct l_returnflag) as n_runs from a group by 1 having count(distinct l_returnflag) >= 2")
def two_models(spark, d):
    return fusion.quorum(_assertions(spark, d), "l_returnflag", "l_partkey", 2)


@query(f"""{_A_SQL}, r as (select l_suppkey, l_partkey, arg_max(case l_returnflag when 'A' then 3.0 when 'R' then 2.0 else 1.0 end, l_orderkey * 10 + l_linenumber) as w from a group by 1, 2)
select l_partkey, sum(w)::double as weight from r group by 1 having sum(w) >= 50""")
def confidence_weighted(spark, d):
    weight = F.when(F.col("l_returnflag") == "A", fusion.CONFIDENCE["HIGH"]).when(F.col("l_returnflag") == "R", fusion.CONFIDENCE["MEDIUM"]).otherwise(fusion.CONFIDENCE["LOW"])
    rows = _assertions(spark, d).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return fusion.confidence_weighted(rows, "l_suppkey", "l_partkey", weight, "ord", 50.0)


@query(f"""{_A_SQL}, s as (select l_suppkey, count(distinct l_partkey) as size from a group by 1),
v as (select l_partkey, count(distinct l_suppkey) as n_runs from a group by 1 having count(distinct l_suppkey) >= 26),
b as (select *, row_number() over (partition by l_partkey order by size desc, l_suppkey, l_returnflag, l_tax) as rn from a join s using (l_suppkey))
select l_partkey, n_runs, l_returnflag, l_tax from v join b using (l_partkey) where rn = 1""")
def majority_merge(spark, d):
    return fusion.majority(_assertions(spark, d), "l_suppkey", "l_partkey", ["l_returnflag", "l_tax"], 50)


@query(f"""{_A_SQL}, f as (select *, case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end as tier, l_orderkey * 10 + l_linenumber as seq from a)
select l_partkey, 'tax' as field, (array_agg(l_tax order by tier desc, year desc, seq desc))[1] as value, count(distinct l_tax) as n_values from f group by 1""")
def authority_fusion(spark, d):
    return fusion.highest_authority(_facts(spark, d), "l_partkey", "field", "l_tax", ["tier", "year", "seq"])


def _facts(spark, d):
    return _told(table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "seq")


def _told(lines, order):
    tier = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return lines.select("l_partkey", "l_tax", F.year("l_shipdate").cast("long").alias("year"), tier.alias("tier"), order, F.lit("tax").alias("field"))


_FOLD_SQL = _A_SQL + """, f as (select l_partkey, l_tax as v, case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end as tier, year, l_orderkey * 10 + l_linenumber as seq from a),
g as (select l_partkey, list(struct_pack(v := v, tier := tier, year := year, seq := seq) order by seq) as l from f where v is not null group by 1),
p as (select l_partkey, l, unnest(range(1, len(l) + 1)) as k from g),
s as (select l_partkey, l[k] as x, case when k > 1 then list_reduce(l[1:k - 1], lambda s, x: case when x.v <> s.v and (x.tier > s.tier or (x.tier = s.tier and x.year >= s.year)) then x else s end) end as s from p),
c as (select l_partkey, x.seq as seq, x.v as value, case when s is null then 'set' when x.v = s.v then 'confirmed' when x.tier > s.tier or (x.tier = s.tier and x.year >= s.year) then 'replaced' else 'refused' end as change from s)"""


@query(f"{_FOLD_SQL} select l_partkey, seq, round(value, 4) as value, change from c")
def authority_steps(spark, d):
    return rounded(_changes(spark, d).select("l_partkey", "place.seq", "value", "change"))


def _placed(spark, d):
    """Facts whose order is full: lines of one ``seq`` as they stand in the file."""
    lines = table(spark, d, "lineitem").select("*", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    return _told(lines, "place")


def _changes(spark, d):
    return fusion.authority_changes(_placed(spark, d), "l_partkey", "field", "l_tax", "tier", "year", "place")


@query(f"{_FOLD_SQL} select l_partkey, 'tax' as field, round(arg_max(value, seq), 4) as value, count(*) as n_changes from c where change in ('set', 'replaced') group by 1")
def authority_fold(spark, d):
    return rounded(fusion.authority(_placed(spark, d), "l_partkey", "field", "l_tax", "tier", "year", "place"))


@query(f"""{_FOLD_SQL}, r as (select l_partkey, arg_min(l_tax, 1000 * l_tax - 1e6 * n) as r from (select l_partkey, l_tax, count(*) as n from a where l_partkey % 3 <> 0 group by 1, 2) group by 1),
m as (select *, seq // 1000 as step from (select l_partkey, seq, value from c where change in ('set', 'replaced'))),
t as (select distinct seq // 1000 as step from c), e as (select l_partkey, step, arg_max(value, seq) as value from m group by 1, 2),
i as (select e.*, lead(step) over (partition by e.l_partkey order by step) as until from e),
n as (select t.step, count(i.l_partkey) as n_entities, count(r.l_partkey) as n_found, count(*) filter (i.value = r.r) as n_right from t left join i on i.step <= t.step and (until is null or until > t.step) left join r on r.l_partkey = i.l_partkey group by 1)
select step::bigint as step, n_entities, n_found, n_entities as n_facts, n_right, round(coalesce(n_found / nullif(n_entities, 0), 0), 4) as precision, round(n_found / (select count(*) from r), 4) as coverage,
  round(2.0 * n_found / (n_entities + (select count(*) from r)), 4) as f1, round(coalesce(n_right / nullif(n_entities, 0), 0), 4) as field_accuracy from n""")
def prefix_scores(spark, d):
    changes = _changes(spark, d).where("change in ('set', 'replaced')").withColumn("step", F.floor(F.col("place.seq") / 1000))
    last = changes.groupBy("l_partkey", "field", "step").agg(F.max_by("value", "place").alias("value"), F.lit("set").alias("change"))
    steps = _facts(spark, d).where("l_tax is not null").select(F.floor(F.col("seq") / 1000).alias("step")).distinct()
    last = last.union(steps.select(F.lit(None).cast("long"), F.lit("tax"), "step", F.lit(None).cast("double"), F.lit("confirmed")))
    most = table(spark, d, "lineitem").where("l_partkey % 3 <> 0").groupBy("l_partkey", "l_tax").count().groupBy("l_partkey").agg(F.min(F.struct((-F.col("count")).alias("n"), "l_tax")).alias("m"))
    reference = most.select("l_partkey", F.lit("tax").alias("field"), F.col("m.l_tax").alias("r"))
    return rounded(fusion.prefix_scores(last, reference, "l_partkey", "field", "step", "r"))


@query()
def incremental_fusion(spark, d):
    rows = table(spark, d, "clients").withColumns({"tier": F.element_at(F.create_map(*map(F.lit, ("crm", 3, "partner", 2, "store", 2, "web", 1))), F.col("source")), "year": F.month("updated_at")})
    steps, _ = growing_master.incremental_fusion(rows.where("source is not null"), "source", "client_id", "name", ["segment", "city"], "tier", "year")
    return rounded(steps)


@query(f"""{_RUN_SQL} select s_nationkey::bigint as s_nationkey, round(avg(flag), 6) as mean from s group by 1 order by avg(flag) desc, s_nationkey limit 1""")
def best_model(spark, d):
    return rounded(fusion.best_group(_run_scores(spark, d), "s_nationkey", "l_returnflag_in_vocabulary"), 6)


@query(f"""{_A_SQL}, runs as (select s_suppkey as l_suppkey, s_nationkey, s_acctbal from supplier),
alt as (select l_suppkey, row_number() over (partition by s_nationkey order by l_suppkey) as k, s_nationkey from runs),
pool as ((select 'first' as rule, l_suppkey from runs order by l_suppkey limit 10) union all (select 'cheapest', l_suppkey from runs order by s_acctbal, l_suppkey limit 10)
  union all (select 'dearest', l_suppkey from runs order by s_acctbal desc, l_suppkey limit 10) union all (select 'alternating', l_suppkey from alt order by k, s_nationkey limit 10)),
votes as (select rule, l_partkey, count(distinct l_suppkey) as n from pool join a using (l_suppkey) group by 1, 2),
ref as (select p_partkey as l_partkey from part where p_retailprice > 950), g as (select unnest([1, 2, 3]) as quorum),
per as (select rule, quorum, count(*) as candidates, count(ref.l_partkey) as tp from votes join g on n >= quorum left join ref on ref.l_partkey = votes.l_partkey group by 1, 2)
select rule, quorum::bigint as quorum, candidates, tp, round(tp / nullif((select count(*) from ref), 0)::double, 4) as recall, round(tp / candidates::double, 4) as precision from per""")
def aggregation_sweep(spark, d):
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    chosen = fusion.pools(runs, "s_nationkey", "l_suppkey", "s_acctbal", 10)
    reference = table(spark, d, "part").where("p_retailprice > 950").select(F.col("p_partkey").alias("l_partkey"))
    return rounded(fusion.quorum_sweep(_assertions(spark, d), chosen, reference, "l_suppkey", "l_partkey", [1, 2, 3]))


@query()
def latent_truth(spark, d):
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_retailprice") > 1000).alias("anchored"), F.col("p_type").alias("stratum"))
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("model"))
    assertions = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("entity"))
    return rounded(fusion.latent_truth(assertions, entities, runs)[0], 6)


# --- statistics -------------------------------------------------------------------------------------------------------

_MID = "rank() over (partition by {g} order by {v}) + (count(*) over (partition by {g}, {v}) - 1) / 2.0"


@query(f"""with r as (select event_type, {_MID.format(g="event_type", v="user_id")} as x, {_MID.format(g="event_type", v="value")} as y from events)
select event_type, round(corr(x, y), 4) as rho, count(*) as n from r group by 1""")
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "events"), "user_id", "value", ["event_type"]))


@query("""with p as (select sum((a.p_retailprice < b.p_retailprice)::int) as c, sum((a.p_retailprice > b.p_retailprice)::int) as d from part a join part b on a.p_brand = b.p_brand and a.p_size < b.p_size and a.p_retailprice <> b.p_retailprice)
select c::bigint as concordant, d::bigint as discordant, round((c - d) / (c + d)::double, 4) as gamma from p""")
def kendall_stratified(spark, d):
    return rounded(stats.stratified_gamma(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", "p_retailprice"))


@query("""with m as (select s_nationkey, (s_acctbal < 5000)::int as veto, s_suppkey, s_acctbal % 1000 as v from supplier),
p as (select s_nationkey, avg(v) filter (veto = 0) as a, avg(v) filter (veto = 1) as b from m group by 1)
select round(avg(a - b), 4) as gap, count(*) as models from p where a is not null and b is not null""")
def within_model_gap(spark, d):
    rows = table(spark, d, "supplier").withColumn("veto", (F.col("s_acctbal") < 5000).cast("int")).withColumn("v", F.col("s_acctbal") % 1000)
    return rounded(stats.within_gap(rows, "s_nationkey", "veto", "v"))


@query("""with t as (select s_suppkey, s_nationkey, case when s_suppkey % 9 = 0 then null else s_acctbal / 20000 end as p from supplier where s_acctbal > 0),
k as (select *, row_number() over (partition by s_nationkey order by p, s_suppkey) as r, count(*) over (partition by s_nationkey) as m from t where p is not null)
select s_suppkey, s_nationkey::bigint as s_nationkey, round(p, 6) as p, round(least(min(p * m / r) over (partition by s_nationkey order by r desc rows unbounded preceding), 1.0), 6) as p_adjusted from k
union all select s_suppkey, s_nationkey::bigint, null, null from t where p is null""")
def bh_fdr(spark, d):
    tests = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 20000).alias("p"))
    return rounded(stats.bh_adjusted(tests, "p", ["s_nationkey"], "s_suppkey").select("s_suppkey", "s_nationkey", "p", "p_adjusted"), 6)


@query("""with z as (select event_type, abs(value - avg(value) over (partition by event_type)) as z from events),
g as (select event_type, count(*) as n, avg(z) as zb, var_pop(z) as v from z group by 1), t as (select sum(n) as n, count(*) as k, sum(n * zb) / sum(n) as gm, sum(n * v) as w from g)
select round(((select n from t) - (select k from t)) / ((select k from t) - 1) * sum(n * (zb - (select gm from t)) ** 2) / (select w from t), 4)::double as w, (select n from t)::bigint as n, (select k from t) as k from g""")
def levene(spark, d):
    return rounded(stats.levene(table(spark, d, "events"), "event_type", "value"))


def _design(spark, d):
    """Priority by status, every cell drawn down to the size of the smallest; totals in thousands."""
    return ranking.balanced(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey").withColumn("v", F.col("o_totalprice") / 1000)


_DESIGN_SQL = """with s as (select *, o_totalprice / 1000 as v, row_number() over (partition by o_orderpriority, o_orderstatus order by md5('0:' || o_orderkey::varchar), o_orderkey) as rn, count(*) over (partition by o_orderpriority, o_orderstatus) as c from orders),
x as (select * from s where rn <= (select min(c) from s))"""


@query(f"""{_DESIGN_SQL}, g as (select count(*) as n, sum(v) as s, sum(v * v) as q from x),
a as (select sum(s * s / n) as t, count(*) as k from (select o_orderpriority, sum(v) as s, count(*) as n from x group by 1)), b as (select sum(s * s / n) as t, count(*) as k from (select o_orderstatus, sum(v) as s, count(*) as n from x group by 1)),
c as (select sum(s * s / n) as t from (select o_orderpriority, o_orderstatus, sum(v) as s, count(*) as n from x group by 1, 2)),
e as (select 'o_orderpriority' as effect, a.t - g.s * g.s / g.n as ss, a.k - 1 as df from a, g union all select 'o_orderstatus', b.t - g.s * g.s / g.n, b.k - 1 from b, g
  union all select 'interaction', c.t - a.t - b.t + g.s * g.s / g.n, (a.k - 1) * (b.k - 1) from a, b, c, g union all select 'residual', g.q - c.t, g.n - a.k * b.k from a, b, c, g)
select effect, round(ss, 2) as ss, df::bigint as df, case when effect <> 'residual' then round(ss / df / (select ss / df from e where effect = 'residual'), 4) end as f, round(ss / (select sum(ss) from e), 6) as eta2 from e""")
def anova_two_way(spark, d):
    out = stats.two_way_anova(_design(spark, d), "o_orderpriority", "o_orderstatus", "v")
    return out.select("effect", F.round("ss", 2).alias("ss"), "df", r4("f").alias("f"), F.round("eta2", 6).alias("eta2"))


@query("""with r as (select quality::varchar as x, toxic::varchar as y from labels where quality is not null and toxic is not null), n as (select count(*) as n, sum((x = y)::int) as same from r),
m as (select sum(a * coalesce(b, 0)) as ab from (select x as v, count(*) as a from r group by 1) left join (select y as v, count(*) as b from r group by 1) using (v))
select n.n, round(same / n::double, 4) as observed, round(ab / n::double / n, 4) as expected, round(case when ab / n::double / n = 1 then 1 else (same / n::double - ab / n::double / n) / (1 - ab / n::double / n) end, 4) as kappa from n, m""")
def kappa(spark, d):
    return rounded(stats.kappa(table(spark, d, "labels"), "quality", "toxic"))


@query("""select p_brand, round(regr_slope(p_retailprice, p_size), 4) as slope, round(regr_intercept(p_retailprice, p_size), 4) as intercept, count(*) as n from part group by 1""")
def slopes(spark, d):
    return rounded(stats.slopes(table(spark, d, "part"), "p_brand", "p_size", "p_retailprice"))


@query("""with p as (select c_mktsegment as m, year(o_orderdate) as t, avg(o_totalprice) as v from orders join customer on c_custkey = o_custkey group by 1, 2)
select a.m as a, b.m as b, count(distinct sign(a.v - b.v)) as signs from p a join p b on a.t = b.t and a.m < b.m group by 1, 2 having count(distinct sign(a.v - b.v)) > 1""")
def rank_flips(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    points = rows.groupBy("c_mktsegment", F.year("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("v"))
    return stats.rank_flips(points, "c_mktsegment", "t", "v")


@query("""with r as (select user_id, (event_id % 2) as docs, (event_id // 2 % 2) as mode, value from events),
c as (select user_id, avg(value) filter (docs = 0 and mode = 0) as c00, avg(value) filter (docs = 0 and mode = 1) as c01, avg(value) filter (docs = 1 and mode = 0) as c10, avg(value) filter (docs = 1 and mode = 1) as c11 from r group by 1),
k as (select * from c where c00 is not null and c01 is not null and c10 is not null and c11 is not null),
e as (select 'docs' as effect, (c10 + c11 - c00 - c01) / 2 as d from k union all select 'mode', (c01 + c11 - c00 - c10) / 2 from k union all select 'interaction', c11 - c10 - c01 + c00 from k)
select effect, round(avg(d), 4) as mean, count(*) filter (d > 0) as n_up, count(*) as n from e group by 1""")
def contrasts(spark, d):
    rows = table(spark, d, "events").withColumn("docs", F.col("event_id") % 2).withColumn("mode", F.floor(F.col("event_id") / 2) % 2)
    return rounded(stats.contrasts(rows, "user_id", "docs", "mode", "value"))


@query("""with p as (select s_nationkey, avg(s_acctbal - 4500) as d, count(*) as n from supplier group by 1 having count(*) >= 3), c as (select count(*) filter (d > 0) as k, count(*) filter (d <> 0) as n from p)
select k, n, round((select sum(gamma(n + 1) / (gamma(i + 1) * gamma(n - i + 1))) from range(0, 200) t(i) where i between k and n) / 2.0 ** n, 6) as p from c""")
def sign_test(spark, d):
    return rounded(stats.sign_test(table(spark, d, "supplier").withColumn("x", F.col("s_acctbal") - 4500), "s_nationkey", "x"), 6)


_KINDS_SQL = "['click', 'error', 'purchase', 'signup', 'view']"


@query(f"""with h as (select user_id, sum(distinct 1 << (list_position({_KINDS_SQL}, event_type) - 1)) as mask from events where value > 90 and event_type is not null group by 1),
s as (select m.mask, bit_count(m.mask) as k, count(*) as n from range(1, 32) m(mask) join h on (h.mask::bigint & m.mask) = m.mask group by 1, 2),
t as (select n, k, array_to_string(list_filter({_KINDS_SQL}, lambda x: mask & (1 << (list_position({_KINDS_SQL}, x) - 1)) <> 0), ' ') as methods from s)
select methods, k::bigint as n_methods, n as n_models, k * n as score from t order by k * n desc, k desc, methods limit 1""")
def balanced_methods(spark, d):
    rows = table(spark, d, "events").where("value > 90")
    return selection.balanced_subset(rows, "user_id", "event_type").withColumn("methods", F.array_join("methods", " "))


@query()
def bootstrap(spark, d):
    return rounded(resampling.bootstrap_ci(_run_scores(spark, d), "s_nationkey", "l_returnflag_in_vocabulary"))


@query("""with recursive d as (select s_nationkey, cast(round((s_acctbal - 4500) * 100) as bigint) as d, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i from supplier where s_acctbal is not null),
n as (select s_nationkey, count(*) as n, sum(d) as total, least(sum(greatest(d, 0)), sum(greatest(-d, 0)))::bigint as r from d group by 1),
g as (select s_nationkey, part, 0::bigint as k, 0::bigint as x, 1::double as w from n, range(0, 4) p(part) union all
  select g.s_nationkey, part, k + 1, x + flip * abs(d.d), sum(w) / 2 from g join d on d.s_nationkey = g.s_nationkey and d.i = 4 * k + part, range(0, 2) f(flip) group by 1, 2, 3, 4),
q as (select g.* from g join n using (s_nationkey) where k = (n.n + 3 - part) // 4),
h as (select a.s_nationkey, a.part, a.x + b.x as x, sum(a.w * b.w) as w from q a join q b on a.s_nationkey = b.s_nationkey and a.part in (0, 1) and b.part = a.part + 2 group by 1, 2, 3),
b as (select s_nationkey, side, w, sum(w * (1 - side)) over (partition by s_nationkey order by x, side rows unbounded preceding) as below
  from (select s_nationkey, part as side, case when part = 0 then x else r - x end as x, w from h join n using (s_nationkey))),
p as (select s_nationkey, sum(w * below) as p from b where side = 1 group by 1), m as (select s_nationkey, avg(s_acctbal - 4500) as m from supplier group by 1)
select s_nationkey::bigint as s_nationkey, coalesce(round(m, 4), 0) as mean, coalesce(round(case when total = 0 then 1 else 2 * p end, 6), 1) as p from m left join n using (s_nationkey) left join p using (s_nationkey)""")
def paired_test(spark, d):
    rows = table(spark, d, "supplier").withColumn("x", F.col("s_acctbal") - 4500)
    out = resampling.paired_test(rows, "s_nationkey", "x", unit=0.01)
    return out.select(F.col("s_nationkey").cast("long").alias("s_nationkey"), r4("mean").alias("mean"), F.round("p", 6).alias("p"))


@query("""with b as (select user_id, avg(value / 1000) as mean, coalesce(stddev_samp(value / 1000), 0) as sd, count(*) as n from events where event_type = 'view' group by 1),
c as (select user_id, avg(value / 1000) as now from events where event_type = 'click' group by 1)
select coalesce(b.user_id, c.user_id) as user_id, round(mean, 10) as mean, round(sd, 10) as sd, n, round(now, 10) as now,
  case when now is null then 'declined' when n is null or n < 2 then 'skip' when now between greatest(mean - 2 * greatest(sd, 0.005), 0) and least(mean + 2 * greatest(sd, 0.005), 1) then 'pass' else 'drift' end as verdict from b full join c on b.user_id = c.user_id""")
def drift_gate(spark, d):
    events = table(spark, d, "events").withColumn("v", F.col("value") / 1000)
    return rounded(stats.drift_gate(events.where("event_type = 'view'"), events.where("event_type = 'click'"), "user_id", "v"), 10)


# --- windows, samples, set operations ------------------------------------------------------------------------------------


@query("""with h as (select l_orderkey, l_linenumber, l_returnflag, row_number() over (partition by l_returnflag order by md5('7:' || (l_orderkey * 10 + l_linenumber)::varchar), l_orderkey * 10 + l_linenumber) as rn from lineitem)
select l_returnflag, l_orderkey * 10 + l_linenumber as id from h where rn <= 5""")
def stratified_sample(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return ranking.stratified_sample(rows, "l_returnflag", "id", 5, 7)


@query("select o_orderkey from orders order by md5('3:' || o_orderkey::varchar), o_orderkey limit 20")
def seeded_sample(spark, d):
    return ranking.seeded_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20, 3)


@query("select p_name, count(*) as n from part group by 1 order by n desc, md5(p_name) limit 15")
def top_counts(spark, d):
    return ranking.top_counts(table(spark, d, "part"), "p_name", 15)


@query("select s_nationkey::bigint as s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) where rn = 1")
def best_of_each(spark, d):
    return rounded(ranking.best_of_each(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey").select("s_nationkey", "s_suppkey", "s_acctbal"), 2)


@query("""with l as (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem group by 1, 2), n as (select *, lead(l_linenumber) over w as nl, lead(q) over w as nq from l window w as (partition by l_orderkey order by l_linenumber))
select l_orderkey, l_linenumber::bigint as l_linenumber, nq - q as delta from n where nl = l_linenumber + 1""")
def adjacent_deltas(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return rounded(ranking.adjacent_deltas(lines, "l_orderkey", "l_linenumber", "l_quantity"))



@query("select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)")
def core_models(spark, d):
    return ranking.in_every(table(spark, d, "events"), "user_id", "event_type")


@query("""with f as (select l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1), n as (select l_suppkey, count(*) as n_new from f group by 1) select l_suppkey, n_new, (sum(n_new) over (order by l_suppkey))::bigint as n_known from n""")
def growth_curve(spark, d):
    return ranking.growth(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""with l as (select c_custkey as k, c_nationkey::double as v from customer), r as (select o_custkey as k, count(*)::double as v from orders group by 1),
b as (select l.k as lk, r.k as rk, l.v as lv, r.v as rv from l full join r on l.k = r.k)
select 'left_only' as "column", count(*) filter (rk is null) as n_differ from b union all select 'right_only', count(*) filter (lk is null) from b union all select 'v', count(*) filter (abs(lv - rv) > 0.001) from b""")
def parity(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("v"))
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return ranking.parity(left, right, ["k"], ["v"])


@query("""select s_nationkey::bigint as s_nationkey, count(*) filter (s_suppkey % 2 = 0) as even, count(*) filter (s_suppkey % 2 = 1) as odd from supplier group by 1""")
def pivot_counts(spark, d):
    rows = table(spark, d, "supplier").withColumn("kind", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd"))
    return rounded(ranking.pivoted(rows, "s_nationkey", "kind", ["even", "odd"], F.count(F.lit(1)))).na.fill(0)


# --- joins and matching --------------------------------------------------------------------------------------------------


@query("""with h as (select distinct c_nationkey, c_mktsegment from customer where c_acctbal > 9000), s as (select distinct c_mktsegment from customer)
select n_nationkey::bigint as n_nationkey, s.c_mktsegment, h.c_nationkey is not null as hit from nation cross join s left join h on h.c_nationkey = n_nationkey and h.c_mktsegment = s.c_mktsegment""")
def recognition_matrix(spark, d):
    customers = table(spark, d, "customer")
    hits = customers.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return rounded(matching.recognition_matrix(table(spark, d, "nation"), customers, hits, "n_nationkey", "c_mktsegment"))


@query("""with h as (select distinct c_nationkey, c_mktsegment from customer where c_acctbal > 9000), s as (select distinct c_mktsegment from customer),
m as (select n_nationkey, n_regionkey, s.c_mktsegment, (h.c_nationkey is not null)::int as hit from nation cross join s left join h on h.c_nationkey = n_nationkey and h.c_mktsegment = s.c_mktsegment)
select n_regionkey::bigint as n_regionkey, count(distinct n_nationkey) as n_entities, round(avg(hit), 4) as rate from m group by 1""")
def status_difficulty(spark, d):
    return rounded(recognition_matrix(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_regionkey"), "n_nationkey").groupBy("n_regionkey").agg(F.count_distinct("n_nationkey").alias("n_entities"), F.avg(F.col("hit").cast("double")).alias("rate")))


@query("""select p_partkey, (exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A' and l_quantity > 49))::int::bigint as in_a, (exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 49))::int::bigint as in_r from part""")
def layer_membership(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey")
    return rounded(matching.membership(table(spark, d, "part").select("p_partkey"), "p_partkey", {"a": lines.where("l_returnflag = 'A'"), "r": lines.where("l_returnflag = 'R'")}))


@query("""with sc as (select s_nationkey as n, s_suppkey % 3 as run, s_acctbal as v from supplier where s_suppkey % 2 = 0), one as (select n, any_value(v) as v from sc group by 1 having count(*) = 1), ex as (select n, run, max(v) as v from sc group by 1, 2)
select s.s_suppkey, round(coalesce(ex.v, one.v), 2) as v from supplier s left join ex on ex.n = s_nationkey and ex.run = s_suppkey % 3 left join one on one.n = s_nationkey""")
def score_resolution(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 3).alias("run"), F.col("s_acctbal").alias("v"))
    out = matching.resolve_by_key_or_only(suppliers.drop("v"), suppliers.where("s_suppkey % 2 = 0"), ["n", "run"], "n", "v")
    return out.select("s_suppkey", F.round("v", 2).alias("v"))


@query("""with n as (select p_partkey, p_type, p_name || case when p_size <= 2 then ' 2' else ' 1' end as nm from part)
select p_partkey, case when nm like '% 1' and b.n is not null then regexp_replace(nm, ' 1$', '') else nm end as name from n
left join (select regexp_replace(nm, ' [0-9]+$', '') as base, count(*) as n from (select distinct nm from n where p_type = 'PROMO') group by 1 having count(*) = 1) b on b.base = regexp_replace(nm, ' 1$', '')""")
def single_unit_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.concat("p_name", F.when(F.col("p_size") <= 2, " 2").otherwise(" 1")).alias("name"))
    return matching.single_unit_names(rows, rows.where("p_type = 'PROMO'").select("name").distinct(), "name").select("p_partkey", "name")


@query("""select p_partkey, unnest(case when p_partkey % 4 = 0 then [p_name || ' 3', p_name || ' 4'] when p_partkey % 4 = 1 then [p_name || ' 1', p_name || ' 2'] else [p_name] end) as name from part""")
def expand_units(spark, d):
    suffix = F.when(F.col("p_partkey") % 4 == 0, " 3 & 4").when(F.col("p_partkey") % 4 == 1, " 1 va 2").otherwise("")
    return matching.expand_units(table(spark, d, "part").select("p_partkey", F.concat("p_name", suffix).alias("name")), "name")


@query("select p_name, p_partkey from (select *, row_number() over (partition by p_name order by p_partkey) as rn from part) where rn = 1")
def first_by_name(spark, d):
    return matching.first_by_name(table(spark, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


def _sides(spark, d):
    """Parts of a brand and type: those of even key as reference, the others, with some names changed, as the system's."""
    part = table(spark, d, "part").withColumn("group", F.concat_ws("/", "p_brand", "p_type"))
    is_ref = F.col("p_partkey") % 2 == 0
    unit = F.when(is_ref | (F.col("p_size") % 4 > 0), (F.col("p_size") % 3).cast("string"))
    name = F.concat_ws(" ", F.when(is_ref, F.col("p_name")).otherwise(F.regexp_replace("p_name", "e", "a")), unit)
    return part.select("group", F.when(is_ref, "ref").otherwise("sys").alias("side"), F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").cast("double").alias("capacity"))


@query()
def optimal_match(spark, d):
    return matching.split_mismatches(matching.optimal_match(_sides(spark, d), "group")).select("group", "ref_id", "sys_id", "status", r4("score").alias("score"))


@query()
def phased_match(spark, d):
    return matching.phased_match(_sides(spark, d), "group").select("group", "ref_id", "sys_id", "status", r4("score").alias("score"))


@query()
def phase_collisions(spark, d):
    return rounded(matching.close_pairs(table(spark, d, "part"), "p_name", 70.0))


@query()
def nearest_reference(spark, d):
    references = table(spark, d, "part").where("p_type = 'PROMO'")
    return rounded(fuzzy_join.nearest(table(spark, d, "part").select(F.col("p_name").alias("query")), references, "query", "p_name", "token_sort_ratio", 60.0))


@query("""with v as (select distinct name, length(name) as n from vendors where name is not null),
m as (select v.name, any_value(n) as n, map(list(c), list(k)) as masks from v, lateral (select c, sum(1::hugeint << (i - 1)::int) as k from (select unnest(range(1, v.n + 1)) as i, unnest(string_split(v.name, '')) as c) group by c) group by v.name),
c as (select distinct name, length(name) as n from clients where name is not null),
p as (select m.name as vendor, c.name as client, m.n as x, c.n as y, list_reduce(list_prepend((1::hugeint << m.n::int) - 1, list_transform(string_split(c.name, ''), lambda ch: coalesce(m.masks[ch], 0::hugeint))),
  lambda s, k: ((s + (s & k)) | (s - (s & k))) & ((1::hugeint << m.n::int) - 1)) as s from m, c)
select vendor, client, round(200.0 * (x - bit_count(s)) / (x + y), 4) as score from p where 200.0 * (x - bit_count(s)) / (x + y) >= 60""")
def alike_names(spark, d):
    vendors, clients = table(spark, d, "vendors").select(F.col("name").alias("vendor")), table(spark, d, "clients").select(F.col("name").alias("client"))
    return rounded(fuzzy_join.alike(vendors, clients, "vendor", "client", "ratio", 60.0))


@query()
def scored_pairs(spark, d):
    parts = table(spark, d, "part")
    return rounded(with_similarity(parts.select("p_partkey", "p_name", F.lit("blue bolt").alias("other")), "ratio", "p_name", "other"))


# --- texts ------------------------------------------------------------------------------------------------------------

_CAT_SQL = "case when trim(coalesce(text, '')) = '' then 'empty' when role = 'system' then 'truncated_output' when length(text) // 4 > 0.9 * 500 then 'truncated_input' else 'ok' end"


@query(f"select conv_id, turn, {_CAT_SQL} as category, role <> 'system' and length(trim(text)) < 200 as short from conversations")
def validate_runs(spark, d):
    turns = table(spark, d, "conversations")
    finish = F.when(F.col("role") == "system", "length").otherwise("stop")
    return turns.select("conv_id", "turn", tx.run_category(F.lit(False), F.col("text"), finish, tx.token_estimate(F.col("text")), F.lit(500)).alias("category"), tx.short_stop(F.col("text"), finish).alias("short"))


@query("select conv_id, max(turn) as last_turn, arg_max(text, turn) as text from conversations where role = 'assistant' and trim(coalesce(text, '')) <> '' group by 1")
def last_turn(spark, d):
    return extract.last_turn(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("select conv_id, count(*) as n_turns, string_agg(coalesce(text, ''), chr(10) order by turn, text) as text from conversations where role = 'assistant' group by 1")
def assistant_concat(spark, d):
    return extract.joined_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").withColumn("n_turns", F.col("n_turns").cast("long"))


@query("""select conv_id, turn, regexp_matches(substr(ltrim(t), 1, 400), '(?i)^\\s*(I cannot|I can''t|I am unable to|I will not|Critical Limitation)') as refused from
(select conv_id, turn, case when turn % 5 = 1 then '  I cannot ' || text when turn % 5 = 2 then 'Critical limitation: ' || text else text end as t from conversations)""")
def refusals(spark, d):
    said = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("  I cannot "), "text")).when(F.col("turn") % 5 == 2, F.concat(F.lit("Critical limitation: "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.refusal(said).alias("refused"))


@query("""with u as (select page_id, unnest(regexp_extract_all(url || ' ' || html, 'https?://[^\\s)\\]>"'']+')) as url from pages), h as (select page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) as host from u)
select host, count(*) as n, count(distinct page_id) as n_docs, (host = 'example.com' or host like '%.example.com' or host = 'example.org' or host like '%.example.org') as banned from h group by 1""")
def url_domains(spark, d):
    return extract.url_domains(table(spark, d, "pages").withColumn("t", F.concat_ws(" ", "url", "html")), "page_id", "t", BANNED)


@query("""with t as (select page_id, case page_id % 6 when 0 then 'https://www.moit.gov.vn/x' when 1 then 'see https://en.wikipedia.org/wiki/X' when 2 then 'EVN annual report 2020' when 3 then 'none' when 4 then 'short' else 'table 5' end as s from pages)
select page_id, s, case page_id % 6 when 0 then 'primary' when 1 then 'secondary' when 2 then 'primary' when 3 then 'none' when 4 then 'none' else 'secondary' end as kind from t""")
def source_class(spark, d):
    cases = F.array(*map(F.lit, ("https://www.moit.gov.vn/x", "see https://en.wikipedia.org/wiki/X", "EVN annual report 2020", "none", "short", "table 5")))
    s = F.element_at(cases, (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", s.alias("s"), tx.source_by_text(s).alias("kind"))


@query("""with x as (select l_orderkey, list(case when l_tax < 0.01 then 'hallucinated' when l_returnflag = 'A' then 'primary' when l_returnflag = 'R' then 'secondary' else 'none' end) as t from lineitem group by 1)
select l_orderkey, (case when list_contains(t, 'hallucinated') then 0 when len(list_filter(t, lambda y: y = 'primary')) >= 2 then 4 when list_contains(t, 'primary') then 3 when list_contains(t, 'secondary') then 2 else 1 end)::bigint as score from x""")
def evidence_scores(spark, d):
    kind = F.when(F.col("l_tax") < 0.01, "hallucinated").when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "R", "secondary").otherwise("none")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(tx.evidence_score(F.collect_list(kind)).cast("long").alias("score"))


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def grounding(spark, d):
    return extract.contained(table(spark, d, "benchmark"), table(spark, d, "documents"), "text", "text", "item_id", "doc_id")


@query("""with f as (select doc_id, (select count(*) from benchmark b where contains(d.text, b.text)) > 0 as found, source in ('src0', 'src1', 'src2') as claimed from documents d)
select count(*) filter (claimed and found) as both, count(*) filter (claimed and not found) as claimed_only, count(*) filter (not claimed and found) as found_only, count(*) filter (not claimed and not found) as neither from f""")
def grounding_summary(spark, d):
    hits = grounding(spark, d).select("doc_id").distinct().withColumn("found", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id", "source").join(hits, "doc_id", "left")
    return quality.grounding(rows, F.col("source").isin("src0", "src1", "src2"), F.coalesce("found", F.lit(False)))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
h as (select *, regexp_matches(trim(line), '^[A-Z][a-z]+[.]$') as head from l), s as (select *, sum(head::int) over (partition by doc_id order by n) as section from h)
select doc_id, section::bigint as section, max(case when head then regexp_extract(trim(line), '^([A-Z][a-z]+)[.]$', 1) end) as title, count(*) filter (not head) as n_lines, coalesce(sum(length(line)) filter (not head), 0)::bigint as n_chars from s group by 1, 2""")
def text_sections(spark, d):
    return extract.sections(table(spark, d, "documents"), "doc_id", "text", r"^([A-Z][a-z]+)[.]$")


@query(r"""with l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) - 1 as n from (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from documents where text is not null)),
p as (select doc_id, n, trim(line) as line, length(line) - length(replace(line, '|', '')) as pipes from l where length(line) - length(replace(line, '|', '')) >= 2),
g as (select *, case when line like '%|' and line not like '|%' and pipes >= 3 then substr(line, strpos(line, '|')) else line end as cut, n - row_number() over (partition by doc_id order by n) + 1 as table_no from p),
r as (select doc_id, table_no, n, list_transform(string_split(regexp_replace(cut, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) as cells from g where pipes >= 3 and not regexp_matches(cut, '^[\s\-:|]+$')),
w as (select *, first_value(len(cells)) over (partition by doc_id, table_no order by n) as width from r),
k as (select *, row_number() over (partition by doc_id, table_no order by n) - 1 as row_no, count(*) over (partition by doc_id, table_no) as c from w where len(cells) = width)
select doc_id, table_no::bigint as table_no, row_no::bigint as row_no, array_to_string(cells, ';') as cells from k where c >= 2""")
def document_tables(spark, d):
    rows = extract.pipe_table_rows(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "table_no", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", ";").alias("cells"))


@query("""with w as (select doc_id, regexp_split_to_array(text, '\\s+')[1] as word from documents where text is not null)
select doc_id, 1::bigint as table_no, unnest([0, 1, 2])::bigint as row_no, unnest(['Plant name;Fuel;Capacity (MW)', trim(word) || ';coal;1.200', 'Unit 3;gas;300']) as cells from w""")
def pipe_tables(spark, d):
    made = F.concat(F.lit("Intro | text\n"), F.lit("See.| Plant name | Fuel | Capacity (MW) |\n|---|---|---|\n| "), F.element_at(F.split("text", r"\s+"), 1), F.lit(" | coal | 1.200 |\n| **Gas** |\n| Unit 2 | gas | 300 | extra |\n| Unit 3 | gas | 300 |\n\n| a | b | c |\n"), F.translate("text", "|", "/"))
    return extract.pipe_table_rows(table(spark, d, "documents").withColumn("text", made), "doc_id", "text").select("doc_id", "table_no", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", ";").alias("cells"))


@query("""with o as (select o_custkey as k, count(*) as n_first, sum(o_totalprice) as v_first, count(*) filter (o_orderkey % 3 <> 0) as n_again, sum(o_totalprice) filter (o_orderkey % 3 <> 0) as v_again from orders group by 1)
select case when k % 2 = 0 and n_again > 0 then 'again' else 'first' end as record_kind, count(*) as n_records, round(sum(case when k % 2 = 0 and n_again > 0 then v_again else v_first end), 2) as total, 0::bigint as n_differ from o group by 1""")
def mart_replay(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    sums = lambda df, kind: df.groupBy("k").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("record_kind", F.lit(kind))
    path = f"{shared_dir(spark)}/mart-{uuid.uuid4().hex}"
    again = sums(orders.where("k % 2 = 0 and o_orderkey % 3 <> 0"), "again")
    merge_mart(sums(orders, "first"), path, ["k"])
    merge_mart(again, path, ["k"])
    once = written(spark.read.parquet(path), "mart-once")
    merge_mart(again, path, ["k"])  # a batch that comes twice changes nothing
    differ = ranking.parity(once.withColumn("x", F.xxhash64("total", "record_kind").cast("double")), spark.read.parquet(path).withColumn("x", F.xxhash64("total", "record_kind").cast("double")), ["k"], ["x"])
    rows = once.groupBy("record_kind").agg(F.count(F.lit(1)).alias("n_records"), F.round(F.sum("total"), 2).alias("total"))
    return rows.crossJoin(F.broadcast(differ.agg(F.sum("n_differ").alias("n_differ"))))


@query("""select page_id, length(html) - length(replace(html, chr(10), '')) as n_lines, len(regexp_extract_all(html, '(?i)<table'))::bigint as n_tables, len(regexp_extract_all(html, '(?i)<tr'))::bigint as n_rows, len(regexp_extract_all(html, '(?i)<li'))::bigint as n_items,
  len(regexp_extract_all(html, '(?i)<a\\s'))::bigint as n_links, len(regexp_extract_all(html, '(?i)<h[1-6]'))::bigint as n_headings from pages""")
def converter_counters(spark, d):
    return rounded(table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in extract.counters(F.col("html")).items()]))


@query("""with n(i, s, v) as (values (0, '1,200.5', 1200.5), (1, '1.200,5', 1200.5), (2, '1 200', 1200.0), (3, '1.200', 1200.0), (4, '1,5', 1.5), (5, 'x', null), (6, '', null)) select p_partkey, s, v::double as number from part join n on i = p_partkey % 7""")
def numbers(spark, d):
    cases = F.array(*map(F.lit, ("1,200.5", "1.200,5", "1 200", "1.200", "1,5", "x", "")))
    s = F.element_at(cases, (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", s.alias("s"), tx.number(s, True).alias("number"))


@query("""with n(i, s, status, fuel) as (values (0, '6 operating', 'operational', 'gas'), (1, 'Under Construction', 'constructing', 'coal'), (2, '10 retired', 'retired', 'unknown'), (3, '7 odd', 'unknown', 'imported lng'), (4, 'shelved', 'cancelled', 'oil'), (5, '', 'unknown', 'unknown'))
select p_partkey, status, fuel from part join n on i = p_partkey % 6""")
def categories(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", tx.status(pick("6 operating", "Under Construction", "10 retired", "7 odd", " shelved", "")).alias("status"), tx.fuel(pick("Local gas", "COAL", "peat", "LNG", "oil ", "")).alias("fuel"))


@query("""with n(i, h, c) as (values (0, 'Plant Name (VN / EN)', 'name'), (1, 'Capacity [MW]', 'capacity_mwe'), (2, 'Fuel-type', 'fuel'), (3, 'Référence', 'source_1'), (4, 'Remarks', null)) select p_partkey, c as canonical from part join n on i = p_partkey % 5""")
def header_names(spark, d):
    h = F.element_at(F.array(*map(F.lit, ("Plant Name (VN / EN)", "Capacity [MW]", "Fuel-type", "Référence", "Remarks"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", tx.canonical_header(h).alias("canonical"))


@query("select doc_id, strip_accents(replace(replace(lower(trim(text)), 'đ', 'd'), 'Đ', 'D')) as folded from documents")
def folded_names(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fold(F.lower(F.trim("text"))).alias("folded"))


@query("select doc_id, strip_accents(replace(replace(lower(trim(text)), 'đ', 'd'), 'Đ', 'D')) as folded from documents")
def folded_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fold(F.lower(F.trim("text"))).alias("folded"))


@query("select s_suppkey, substr(sha256(concat_ws(':', 'sweep', s_name, s_suppkey::varchar)), 1, 12) as job_id from supplier")
def job_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", tx.job_id(F.lit("sweep"), F.col("s_name"), F.col("s_suppkey").cast("string")).alias("job_id"))


# --- mart, jobs -----------------------------------------------------------------------------------------------------------


def _mart(spark, d):
    run = mart.tagged("run", table(spark, d, "orders"), "o_orderkey", {"total": F.col("o_totalprice")})
    probe = mart.tagged("probe", table(spark, d, "events"), "event_id", {"value": F.col("value"), "user": F.col("user_id")})
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return mart.union(run, probe, mart.tagged("score", lines, "l_orderkey", {"quantity": F.col("q"), "lines": F.col("n")}))


@query("""select 'run' as record_kind, count(*) as n, round(sum(o_totalprice), 2) as total from orders union all select 'probe', 2 * count(*), round(sum(value) + sum(user_id), 2) from events union all select 'score', 2 * count(distinct l_orderkey), round(sum(l_quantity) + count(*), 2) from lineitem""")
def mart_union(spark, d):
    return _mart(spark, d).groupBy("record_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select l_orderkey::varchar as record_key, sum(l_quantity) as quantity, count(*)::double as lines from lineitem group by 1")
def mart_views(spark, d):
    return mart.view(_mart(spark, d), "score", ["quantity", "lines"])


@query("""with r as (select s_suppkey, s_nationkey from supplier), c as (select s_nationkey, avg(s_acctbal) / 10000 as coverage from supplier where s_acctbal > 0 group by 1)
select s_suppkey, round(coverage, 6) as coverage, round(coverage * 177)::bigint as n_matched from r left join c using (s_nationkey)""")
def coverage_view(spark, d):
    suppliers = table(spark, d, "supplier")
    coverage = suppliers.where("s_acctbal > 0").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 10000).alias("coverage"))
    return mart.coverage_view(suppliers.select("s_suppkey", "s_nationkey"), coverage, ["s_nationkey"], 177).select("s_suppkey", F.round("coverage", 6).alias("coverage"), "n_matched")


@query("""with f as (select user_id, event_id, (event_type = 'error')::int as f from events), s as (select *, sum(1 - f) over (partition by user_id order by event_id) as g from f), n as (select user_id, g, sum(f) as n from s group by 1, 2)
select user_id, max(n)::bigint as longest, max(n) >= 3 as stopped from n group by 1""")
def failure_streaks(spark, d):
    return rounded(jobs.failure_streaks(table(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "error"))


@query("""with n as (select user_id, event_type, ts, lead(ts) over (partition by user_id order by ts) as nx from events) select user_id, count(*) as n_expired from n where event_type = 'signup' and (nx is null or epoch(nx) - epoch(ts) > 7200) group by 1""")
def expired_leases(spark, d):
    return jobs.expired_leases(table(spark, d, "events"), "user_id", "ts", "event_type", "signup", 7200)


@query("""with s as (select o_custkey, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as spent from orders) select o_custkey, count(*) filter (spent <= 1000000) as n_within, count(*) as n from s group by 1""")
def budget(spark, d):
    return jobs.running_cost(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice", 1_000_000.0)


@query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10")
def job_poll(spark, d):
    return jobs.poll(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 10).select("o_orderkey")


@query("select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, d):
    return jobs.windowed_counts(table(spark, d, "events"), "ts", ["event_type"]).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


# --- provenance and selection -----------------------------------------------------------------------------------------


@query("""select p_partkey, p_name || case p_partkey % 5 when 0 then ' 3 & 4' when 1 then ' 2' when 2 then ' 1-3' when 3 then ' II+III' else '' end as name,
  case p_partkey % 5 when 1 then true when 4 then true else false end as atomic,
  case when p_type not in ('SMALL', 'PROMO', 'MEDIUM', 'LARGE') then null when p_type = 'SMALL' then false when p_type = 'PROMO' then p_partkey % 5 <> 4 else true end as consistent from part""")
def level_names(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, (" 3 & 4", " 2", " 1-3", " II+III", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    level = F.when(F.col("p_type") == "SMALL", "unit").when(F.col("p_type") == "PROMO", "plant").when(F.col("p_type") == "MEDIUM", "block").when(F.col("p_type") == "LARGE", "complex").otherwise("unknown")
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", suffix).alias("name"), level.alias("level"))
    return rows.select("p_partkey", "name", provenance.atomic(F.col("name")).alias("atomic"), provenance.level_consistent(F.col("name"), F.col("level")).alias("consistent"))


@query("""select case when trim(url) = '' then 'tertiary' when regexp_matches(url, '/en/|/de/') then 'primary' when regexp_matches(url, '[?]page=') then 'secondary' else 'tertiary' end as tier, count(*) as n from pages group by 1""")
def source_tiers(spark, d):
    return table(spark, d, "pages").groupBy(provenance.tier(F.col("url"), "/en/|/de/", "[?]page=").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("""select user_id, round(avg((event_type = 'purchase')::int) filter (event_type <> 'error'), 4) as rate, count(*) filter (event_type <> 'error') as n from events group by 1""")
def verdict_rates(spark, d):
    verdict = F.when(F.col("event_type") == "purchase", "supported").when(F.col("event_type") == "error", "error").otherwise("unsupported")
    return rounded(provenance.verdict_rate(table(spark, d, "events").withColumn("v", verdict), "user_id", "v"))


@query("""select event_id, (props::json ->> 'k')::bigint as k from events""")
def json_replies(spark, d):
    reply = F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```\n"))
    return table(spark, d, "events").select("event_id", F.element_at(provenance.json_array(reply, "struct<k: bigint>"), 1)["k"].alias("k"))


@query("""with m as (select s_suppkey, case when s_suppkey % 4 = 0 then 'local' else 'frontier' end as kind, s_nationkey, s_acctbal, s_suppkey % 17 as cost from supplier),
b as (select s_suppkey from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from m where kind = 'frontier') where rn = 1),
c as (select s_suppkey from m where kind = 'frontier' and s_suppkey not in (select s_suppkey from b) and s_acctbal > (select max(s_acctbal) from m where kind = 'local') - 2000 order by cost, s_suppkey limit 5)
select s_suppkey, 'best_of_country' as tier from b union all select s_suppkey, 'local' from m where kind = 'local' union all select s_suppkey, 'cheap_frontier' from c""")
def model_tiers(spark, d):
    kind = F.when(F.col("s_suppkey") % 4 == 0, "local").otherwise("frontier")
    models = table(spark, d, "supplier").withColumn("kind", kind).withColumn("cost", F.col("s_suppkey") % 17)
    models = models.withColumn("s_acctbal", F.when(F.col("kind") == "local", F.col("s_acctbal") - 2000).otherwise(F.col("s_acctbal")))
    return selection.frontier_and_local(models, "kind", "s_nationkey", "s_acctbal", "cost", "s_suppkey", 5)


@query("""with p as (select l_suppkey, median(l_extendedprice) filter (l_linestatus = 'F') as b, median(l_extendedprice) filter (l_linestatus = 'O') as a, count(*) filter (l_linestatus = 'F') as nb, count(*) filter (l_linestatus = 'O') as na from lineitem group by 1)
select l_suppkey, round(b, 3) as before, round(a, 3) as after, nb as n_before, na as n_after, round(a - b, 3) as delta from p where nb > 0 and na > 0""")
def condition_comparison(spark, d):
    return rounded(selection.comparison(table(spark, d, "lineitem"), "l_suppkey", "l_linestatus", "l_extendedprice", "F", "O"), 3)


@query("""with i as (select s_suppkey, s_acctbal / 10000 as m, s_acctbal / 10000 - 0.01 as lo, s_acctbal / 10000 + 0.01 as hi from supplier)
select a.s_suppkey as a, b.s_suppkey as b, round(abs(a.m - b.m), 6) as difference from i a join i b on a.s_suppkey < b.s_suppkey and abs(a.m - b.m) < 0.05 and a.lo <= b.hi and b.lo <= a.hi""")
def unstable_pairs(spark, d):
    m = F.col("s_acctbal") / 10000
    return rounded(selection.unstable_pairs(table(spark, d, "supplier").select("s_suppkey", m.alias("mean"), (m - 0.01).alias("low"), (m + 0.01).alias("high")), "s_suppkey"), 6)


@query("""with p as (select event_type, value, (row_number() over (partition by event_type order by value, event_id) - 0.375) / (count(*) over (partition by event_type) + 0.25) as p from events),
t as (select *, sqrt(-2 * ln(least(p, 1 - p))) as t from p), z as (select *, t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308))) as z from t)
select event_type, count(*) as n, round(power(corr(value, case when p < 0.5 then -z else z end), 2), 4) as w from z group by 1""")
def normality(spark, d):
    return rounded(selection.approximate_w(table(spark, d, "events"), "event_type", "value", "event_id"))


@query("""with s as (select conv_id, turn, length(text) // 4 as tok, length(text) // 4 - lag(length(text) // 4) over (partition by conv_id order by turn) as dd from conversations),
p as (select conv_id, arg_max(tok, turn) as last, max(turn) as last_turn, coalesce(avg(dd), 0.0) as growth from s group by 1)
select conv_id, last, last_turn, round(growth, 4) as growth, round(last + greatest(12 - last_turn - 1, 0) * growth, 4) as projected from p""")
def token_projection(spark, d):
    turns = table(spark, d, "conversations").withColumn("tok", tx.token_estimate(F.col("text")))
    return rounded(selection.token_projection(turns, "conv_id", "turn", "tok", 12))


@query("""with n as (select p_brand, case when p_size > 45 then null else p_type end as t, p_name || ' ' || (p_size % 3)::varchar as nm, p_size::bigint as c from part)
select p_brand, t, sum(c)::bigint as capacity, count(*) as n_units, min(nm) as name from n where nm like 'small%' group by 1, 2 union all select p_brand, t, c, 1, nm from n where nm not like 'small%'""")
def phase_rollup(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") <= 45, F.col("p_type")).alias("t"), F.col("p_name").alias("nm"), (F.col("p_size") % 3).cast("string").alias("ph"), F.col("p_size").cast("long").alias("c"))
    return selection.rollup_with_phases(rows, ["p_brand", "t"], "nm", "ph", "^small", "c")


@query("""with s as (select n_nationkey::bigint as n_nationkey, n_regionkey::bigint as n_regionkey, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey group by 1, 2), a as (select n_regionkey, avg(n) as m, stddev_samp(n) as sd from s group by 1)
select n_nationkey, n_regionkey, n, round(m, 4) as m, round(sd, 4) as sd from s join a using (n_regionkey)""")
def region_baseline(spark, d):
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    n = table(spark, d, "nation").join(suppliers, "n_nationkey", "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("s_suppkey").alias("n"))
    return rounded(n.join(n.groupBy("n_regionkey").agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("sd")), "n_regionkey"))


@query("""with t as (select role, turn, length(text)::double as v from conversations), l as (select role, max(struct_pack(turn := turn, v := v)).v as last from t group by 1)
select role, median(v) filter (turn = 0) as turn_0, median(v) filter (turn = 1) as turn_1, median(v) filter (turn = 2) as turn_2, any_value(last) as last from t join l using (role) group by 1""")
def turn_profile(spark, d):
    turns = table(spark, d, "conversations").withColumn("v", F.length("text").cast("double"))
    return metrics.turn_profile(turns, "role", "turn", "v", [0, 1, 2])


@query("""select c_nationkey::bigint as c_nationkey, count(*) filter (c_mktsegment in ('BUILDING', 'MACHINERY')) as base_n, round(avg(c_acctbal) filter (c_mktsegment in ('BUILDING', 'MACHINERY')), 3) as base_mean, round(coalesce(stddev_samp(c_acctbal) filter (c_mktsegment in ('BUILDING', 'MACHINERY')), 0), 3) as base_sd,
  count(*) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')) as topup_n, round(avg(c_acctbal) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')), 3) as topup_mean, round(coalesce(stddev_samp(c_acctbal) filter (c_mktsegment not in ('BUILDING', 'MACHINERY')), 0), 3) as topup_sd from customer group by 1""")
def cohort_summary(spark, d):
    cohort = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "base").otherwise("topup")
    out = rounded(metrics.cohort_summary(table(spark, d, "customer"), "c_nationkey", cohort, ["base", "topup"], "c_acctbal"), 3)
    return out.na.fill(0, ["base_n", "topup_n"]).na.fill(0.0, ["base_sd", "topup_sd"])


@query("""select o_orderpriority, case when d is null then 'missing' when d < 10 then 'b0' when d < 30 then 'b1' when d < 365 then 'b2' else 'b3' end as bucket, count(*) as n
from (select o_orderkey, o_orderpriority, min(date_diff('day', o_orderdate::date, l_shipdate::date))::double as d from orders left join lineitem on l_orderkey = o_orderkey and l_shipdate >= o_orderdate group by 1, 2) group by 1, 2""")
def delay_buckets(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left")
    days = joined.groupBy("o_orderkey", "o_orderpriority").agg(F.min(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).cast("double").alias("d"))
    return metrics.buckets(days, "o_orderpriority", "d", [10.0, 30.0, 365.0])


@query("""select l_returnflag, l_linestatus, sum(case when l_discount > 0.05 then l_quantity else 0 end) as hit, sum(l_quantity) as total, round(sum(case when l_discount > 0.05 then l_quantity else 0 end) / sum(l_quantity), 6) as rate from lineitem group by 1, 2""")
def cache_hits(spark, d):
    return rounded(metrics.hit_rate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05, F.col("l_quantity")), 6)
