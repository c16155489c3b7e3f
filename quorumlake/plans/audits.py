"""More queries over the driver's tables: provenance axes, sweeps, records, panels, orders and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.operators import fusion, inventory, metrics, provenance, quality, ranking, reconcile, records, stats
from quorumlake.plans.registry import query, r4, rounded
from quorumlake.sources.tables import table

# --- quality axes ---------------------------------------------------------------------------------------------------------

_SOURCES_SQL = """with s as (select *, case when l_returnflag <> 'N' then l_returnflag end as s1, case when l_linestatus = 'O' then ' ' || l_linestatus else ' ' end as s2, case when l_discount > 0.08 then ' high' when l_discount > 0.04 then 'LOW' end as conf from lineitem)"""


def _sources(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.withColumns({"s1": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "s2": F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), "l_linestatus")).otherwise(" "), "conf": F.when(F.col("l_discount") > 0.08, " high").when(F.col("l_discount") > 0.04, "LOW")})


@query(f"""{_SOURCES_SQL}, p as (select l_suppkey, avg((s1 is not null or trim(s2) <> '')::int) as a, avg((s1 is not null and trim(s2) <> '')::int) filter (conf = ' high') as b from s group by 1)
select l_suppkey, round(a, 4) as source_presence, round(b, 4) as high_dual_source, case when b is null then 'no_high_confidence' end as high_note from p""")
def provenance_presence(spark, d):
    return rounded(quality.provenance_scores(_sources(spark, d), "l_suppkey", "s1", "s2", "conf"))


_COD_SQL = "with c as (select o_orderpriority, o_custkey, case when o_orderstatus = 'F' then '' when o_orderstatus = 'P' then '19x5' else (year(o_orderdate) + 32)::varchar || '-01' end as cod from orders)"


def _cods(spark, d):
    cod = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", "19x5").otherwise(F.concat((F.year("o_orderdate") + 32).cast("string"), F.lit("-01")))
    return table(spark, d, "orders").select("o_orderpriority", "o_custkey", cod.alias("cod"))


@query(f"""{_COD_SQL}, y as (select *, try_cast(regexp_extract(cod, '((?:19|20)[0-9][0-9])', 1) as int) as y from c)
select o_custkey, round(case when count(*) filter (cod <> '') = 0 then null when count(distinct cod) filter (cod <> '') <= 1 then 0.0 else count(*) filter (cod <> '' and y between 1960 and 2035) / (count(*) filter (cod <> ''))::double end, 4) as cod_plausible from y group by 1""")
def cod_plausible(spark, d):
    return rounded(quality.cod_plausible(_cods(spark, d), "o_custkey", "cod"))


_ROWS_SQL = """with r as (select p_partkey, p_brand, p_size - 2 as cap, case when p_type = 'PROMO' then 'unknown' else 'coal' end as fuel, case when p_size % 7 = 0 then 'unknown' when p_size % 7 = 1 then 'retired' else 'operational' end as status,
  case when p_size % 3 = 0 then ' North' when p_size % 3 = 1 then 'south' else 'Nowhere' end as province, (2000 + p_size)::varchar || '-01' as cod from part)"""


def _plants(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", "p_brand", (size - 2).alias("cap"), F.when(F.col("p_type") == "PROMO", "unknown").otherwise("coal").alias("fuel"), F.when(size % 7 == 0, "unknown").when(size % 7 == 1, "retired").otherwise("operational").alias("status"),
        F.when(size % 3 == 0, " North").when(size % 3 == 1, "south").otherwise("Nowhere").alias("province"), F.concat((F.lit(2000) + size).cast("string"), F.lit("-01")).alias("cod"),
    )


_ISSUES_SQL = f"""{_ROWS_SQL}, i as (select p_partkey, p_brand, unnest(list_filter([case when cap <= 0 then 'zero_or_negative_capacity' end, case when fuel = 'unknown' then 'unknown_fuel' end, case when status = 'unknown' then 'unknown_status' end,
  case when lower(trim(province)) not in ('north', 'south') then 'unknown_province' end, case when status = 'retired' and substr(cod, 1, 4)::int > 2025 then 'retired_future_cod' end], lambda x: x is not null)) as issue from r)"""


def _issues(spark, d):
    return quality.row_issues(_plants(spark, d), "p_partkey", quality.coherence_rules("p_partkey", "cap", "fuel", "status", "province", "cod", ["North", "South"]))


@query(f"{_ISSUES_SQL} select p_partkey, issue from i")
def coherence_rules(spark, d):
    return _issues(spark, d)


@query(f"""{_ISSUES_SQL}, b as (select p_brand, p_partkey % 5 as run, count(*) as n from part group by all), f as (select p_brand, p_partkey % 5 as run, count(distinct p_partkey) as flawed from i group by all),
u as (select b.p_brand, b.n, coalesce(flawed, 0) as flawed from b left join f using (p_brand, run))
select p_brand, floor(median(n))::bigint as n_rows, floor(median(flawed))::bigint as n_flawed, round(median((n - flawed) / n::double), 4) as coherence_rate from u group by 1""")
def coherence_medians(spark, d):
    rows = _plants(spark, d).withColumn("run", F.col("p_partkey") % 5)
    flawed = _issues(spark, d).select("p_partkey").distinct().withColumn("bad", F.lit(1))
    runs = rows.join(flawed, "p_partkey", "left").groupBy("p_brand", "run").agg(F.count(F.lit(1)).alias("total"), F.count("bad").alias("flawed"))
    return rounded(quality.coherence_medians(runs, "p_brand", "total", "flawed"))


@query("""with r as (select case p_type when 'SMALL' then 'unit' when 'PROMO' then 'plant' when 'MEDIUM' then 'block' else 'complex' end as level, p_retailprice as cap, case when p_size % 2 = 0 then 'operational' else 'planned' end as status from part)
select level, count(*) as n, count(*) filter ((level = 'plant' and status = 'operational' and cap > 1600) or (level = 'unit' and cap > 1350)) as n_violations from r group by 1""")
def taxonomy_audit(spark, d):
    level = F.when(F.col("p_type") == "SMALL", "unit").when(F.col("p_type") == "PROMO", "plant").when(F.col("p_type") == "MEDIUM", "block").otherwise("complex")
    rows = table(spark, d, "part").withColumns({"level": level, "status": F.when(F.col("p_size") % 2 == 0, "operational").otherwise("planned")})
    return quality.taxonomy_audit(rows, "level", "p_retailprice", "status")


@query(f"""{_SOURCES_SQL}, a as (select l_suppkey, round(avg((s1 is not null or trim(s2) <> '')::int), 4) as source_presence, round(avg((s1 is not null and trim(s2) <> '')::int) filter (conf = ' high'), 4) as high_dual_source from s group by 1),
b as (select l_suppkey, count(*) as n_rows, least(count(distinct l_partkey) / 20.0, 1.0)::double as source_diversity from lineitem where l_quantity > 48 group by 1)
select l_suppkey, a.source_presence, a.high_dual_source, b.n_rows, round(b.source_diversity, 4) as source_diversity from a full join b using (l_suppkey)""")
def row_scores(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 48")
    mechanical = quality.mechanical_scores(lines, "l_suppkey", ["l_returnflag"], {"l_linestatus": ["O"]}, "l_partkey", "l_quantity").select("l_suppkey", "n_rows", "source_diversity")
    return rounded(quality.row_scores("l_suppkey", quality.provenance_scores(_sources(spark, d), "l_suppkey", "s1", "s2", "conf").drop("high_note"), mechanical))


# --- metrics --------------------------------------------------------------------------------------------------------------


@query("select o_orderpriority, o_orderstatus, round(avg(o_totalprice), 2) as mean, min(o_totalprice) as low, max(o_totalprice) as high, round(stddev_pop(o_totalprice), 2) as sd, count(o_totalprice) as n from orders group by 1, 2")
def spread_summary(spark, d):
    return rounded(metrics.summary(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), 2)


@query("""select l_returnflag, l_linestatus, metric, round(avg(value), 4) as mean from (select l_returnflag, l_linestatus, 'l_discount' as metric, l_discount::double as value from lineitem union all select l_returnflag, l_linestatus, 'l_tax', case when l_tax > 0 then l_tax::double end from lineitem) where value is not null group by 1, 2, 3""")
def rung_means(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_discount").cast("double").alias("l_discount"), F.when(F.col("l_tax") > 0, F.col("l_tax").cast("double")).alias("l_tax"))
    return rounded(metrics.rung_means(lines, "l_returnflag", "l_linestatus", ["l_discount", "l_tax"]))


@query("""with e as (select s_nationkey as mode, l_suppkey, l_partkey, max(l_linenumber) as score from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3), t as (select unnest([1, 2, 3, 4, 9]) as threshold),
ref as (select p_partkey from part where p_retailprice > 950), n as (select count(*) as total from ref),
p as (select mode, l_suppkey, threshold, count(*) as n_total, count(*) filter (score >= threshold) as kept, count(*) filter (score >= threshold and ref.p_partkey is not null) as tp from e cross join t left join ref on ref.p_partkey = l_partkey group by 1, 2, 3),
m as (select mode, threshold, avg(kept) as n_retained, avg(n_total) as n_total, avg(case when kept > 0 then tp / kept::double else 0 end) as precision, avg(coalesce(tp / nullif(total, 0)::double, 0)) as coverage, count(*) as n_runs from p, n group by 1, 2)
select mode::bigint as mode, threshold::bigint as threshold, round(n_retained, 4) as n_retained, round(n_total, 4) as n_total, round(precision, 4) as precision, round(coverage, 4) as coverage, n_runs, round(100 * n_retained / n_total, 4) as retention from m""")
def verification_tradeoff(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = lines.groupBy(F.col("s_nationkey").alias("mode"), "l_suppkey", F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("score"))
    return rounded(metrics.tradeoff(rows, "mode", "l_suppkey", "p_partkey", "score", table(spark, d, "part").where("p_retailprice > 950"), [1, 2, 3, 4, 9]))


@query("""with p as (select c_mktsegment, c_nationkey, o_orderstatus as s, o_totalprice as v from orders join customer on c_custkey = o_custkey)
select c_nationkey::bigint as c_nationkey, count(*) filter (s = 'F') as "n_F", round(median(v) filter (s = 'F'), 3) as "median_F", max(v) filter (s = 'F') as "best_F", count(*) filter (s = 'P') as "n_P", round(median(v) filter (s = 'P'), 3) as "median_P", max(v) filter (s = 'P') as "best_P" from p group by 1 having count(*) filter (s = 'F') > 0 and count(*) filter (s = 'P') > 0""")
def decomposition(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rounded(metrics.two_conditions(rows, "c_nationkey", "o_orderstatus", "o_totalprice", "F", "P"), 3)


@query("select event_type, round(avg(case when value > 10 then (value > 50)::int end), 4) as share, count(*) filter (value > 10) as n from events group by 1")
def tier_calibration(spark, d):
    return rounded(metrics.calibration(table(spark, d, "events"), "event_type", F.when(F.col("value") > 10, F.col("value") > 50)))


@query("""with m as (select l_suppkey, case when l_quantity > 45 then 'ref_only' when l_returnflag = 'R' then 'sys_only' else 'exact' end as status from lineitem)
select l_suppkey, count(*) filter (status = 'sys_only') as n_false, round(avg((status = 'sys_only')::int), 4) as rate from m where status <> 'ref_only' group by 1""")
def false_rates(spark, d):
    status = F.when(F.col("l_quantity") > 45, "ref_only").when(F.col("l_returnflag") == "R", "sys_only").otherwise("exact")
    return rounded(records.turnover(table(spark, d, "lineitem").select("l_suppkey", status.alias("status")), "l_suppkey"))


_MIDRANK = "rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0"


@query(f"""with a as (select o_custkey, median(o_totalprice) as x from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey, median(o_totalprice) as y from orders where o_orderstatus = 'O' group by 1),
j as (select x, y from a join b using (o_custkey)), r as (select {_MIDRANK.format(v="x")} as x, {_MIDRANK.format(v="y")} as y from j) select round(corr(x, y), 4) as rho, count(*) as n from r""")
def ranking_robustness(spark, d):
    orders = table(spark, d, "orders")
    return rounded(stats.ranking_robustness(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey", "o_totalprice"))


@query("""with p as (select c_nationkey as m, year(o_orderdate) // 3 as t, avg(o_totalprice) as v from orders join customer on c_custkey = o_custkey group by 1, 2),
f as (select a.m as a, b.m as b from p a join p b on a.t = b.t and a.m < b.m group by 1, 2 having count(distinct sign(a.v - b.v)) > 1)
select distinct m::bigint as m from p where m not in (select a from f union select b from f)""")
def stable_core(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    points = rows.groupBy(F.col("c_nationkey").cast("long").alias("m"), F.floor(F.year("o_orderdate") / 3).alias("t")).agg(F.avg("o_totalprice").alias("v"))
    return stats.stable_core(points, "m", "t", "v")


@query("select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders where o_totalprice > 200000")
def common_models(spark, d):
    return ranking.common(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey from customer except select o_custkey from orders")
def missing_models(spark, d):
    return ranking.only_left(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- fusion ---------------------------------------------------------------------------------------------------------------

_POOLS_SQL = """with runs as (select s_suppkey as run, s_nationkey as model, s_acctbal as cost from supplier), sizes as (select unnest([3, 5, 60])::int as size),
ranked as (select *, row_number() over (partition by model order by run) as k, count(*) over (partition by model) as n from runs),
means as (select model, avg(cost) as c, min(run) as run from runs group by 1),
placed as (select *, row_number() over (order by c, model) as lo, row_number() over (order by c desc, model) as hi from means), turns as (select *, row_number() over (order by least(2 * lo - 1, 2 * hi)) as tu from placed),
allp as (select size, 'intra_model' as rule, model::varchar as pool, run from ranked, sizes where k <= size and n >= size union all select size, 'cross_model_low', 'all', run from turns, sizes where lo <= size
  union all select size, 'cross_model_high', 'all', run from turns, sizes where hi <= size union all select size, 'cross_model_mixed', 'all', run from turns, sizes where tu <= size),
pools as (select a.* from allp a join (select size, rule, pool from allp group by all having count(*) = any_value(size)) using (size, rule, pool))"""


def _model_pools(spark, d):
    runs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("model"), F.col("s_acctbal").alias("cost"))
    return runs, fusion.model_pools(runs, "model", "run", "cost", [3, 5, 60])


@query(f"{_POOLS_SQL} select size::bigint as size, rule, pool, run from pools")
def model_pools(spark, d):
    return rounded(_model_pools(spark, d)[1].select("size", "rule", "pool", "run"))


@query(f"""{_POOLS_SQL}, a as (select l_suppkey as run, l_partkey as entity, max(case when s_nationkey % 2 = 0 then case l_returnflag when 'A' then 3.0 when 'R' then 2.0 else 1.0 end end) as w from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
votes as (select size, rule, pool, entity, count(*) as n, sum(w) as w from pools join a using (run) group by 1, 2, 3, 4), sure as (select size, rule, pool, max((w is not null)::int) as sure from pools join a using (run) group by 1, 2, 3),
ref as (select p_partkey as entity from part where p_retailprice > 950), total as (select count(*) as total from ref), m as (select unnest(['union', 'majority_2', 'majority_3', 'confidence_weighted']) as merge),
each as (select m.merge, p.size, p.rule, p.pool, p.cost, count(v.entity) as n_entities, count(ref.entity) as tp from (select size, rule, pool, sum(cost) as cost from pools join runs using (run) group by 1, 2, 3) p join sure using (size, rule, pool) cross join m
  left join votes v on v.size = p.size and v.rule = p.rule and v.pool = p.pool and case m.merge when 'union' then true when 'majority_2' then v.n >= 2 when 'majority_3' then v.n >= 3 else coalesce(v.w, 0) >= 0.5 * p.size end left join ref on ref.entity = v.entity
  where m.merge <> 'confidence_weighted' or sure = 1 group by 1, 2, 3, 4, 5),
g as (select merge, size, rule, count(*) as n_pools, avg(coalesce(tp / nullif(total, 0)::double, 0)) as recall, avg(coalesce(tp / nullif(n_entities, 0)::double, 0)) as precision, avg(2 * tp / (n_entities + total)::double) as f1, avg(n_entities) as n_entities, avg(cost) as cost from each, total group by 1, 2, 3),
rules as (select unnest(['intra_model', 'cross_model_low', 'cross_model_high', 'cross_model_mixed']) as rule)
select m.merge, s.size::bigint as size, rules.rule, coalesce(n_pools, 0) as n_pools, round(recall, 4) as recall, round(precision, 4) as precision, round(f1, 4) as f1, round(n_entities, 4) as n_entities, round(cost, 4) as cost from (select distinct size from pools) s cross join rules cross join m left join g on g.merge = m.merge and g.size = s.size and g.rule = rules.rule""")
def full_sweep(spark, d):
    runs, chosen = _model_pools(spark, d)
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    level = F.when(F.col("s_nationkey") % 2 == 0, F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "R", " Medium").otherwise("LOW"))
    assertions = lines.select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("entity"), level.alias("confidence"))
    reference = table(spark, d, "part").where("p_retailprice > 950").select(F.col("p_partkey").alias("entity"))
    return rounded(fusion.aggregation_sweep(assertions, chosen, reference, "run", "entity", "confidence", runs, "cost"))


@query("select s_nationkey::bigint as s_nationkey, coalesce(bool_or(case when s_acctbal > 9000 then 'HIGH' else ' ' end <> ' '), false) as has_confidence from supplier group by 1")
def has_confidence(spark, d):
    rows = table(spark, d, "supplier").withColumn("c", F.when(F.col("s_acctbal") > 9000, "HIGH").otherwise(" "))
    return rounded(fusion.has_confidence(rows, ["s_nationkey"], "c"))


# --- records --------------------------------------------------------------------------------------------------------------


@query("""with c as (select l_suppkey, count(*) filter (l_returnflag = 'A') as tp, count(*) filter (l_returnflag = 'R') as fp, count(*) filter (l_returnflag = 'N') as fn, count(*) filter (l_linestatus = 'O') as calls from lineitem group by 1)
select case when l_suppkey % 3 = 0 then '' else 'v' || (l_suppkey % 3)::varchar || '/' end || 'run' || l_suppkey::varchar as label, 'm' || (l_suppkey % 4)::varchar as model, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 4) as coverage, round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 4) as precision,
  tp as n_matched, fp as n_hallucinated, fn as n_missed, case when l_suppkey % 2 = 0 then least(calls, 5) end as n_web_search_calls, case when l_suppkey % 2 = 0 then '7' end as seed from c""")
def flat_measurements(spark, d):
    n = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(n("A").alias("tp"), n("R").alias("fp"), n("N").alias("fn"), F.count_if(F.col("l_linestatus") == "O").alias("calls"))
    even, key, known = F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string"), {f.name: f.dataType for f in spark.createDataFrame([], records.SCHEMA).schema}
    version = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")))
    made = {
        "result_file": F.when(even, F.concat(F.lit("a/b.c/run"), key, F.lit(".json"))), "run_id": F.concat(F.lit("run"), key), "web_search_calls": F.when(even, F.array_repeat(F.lit("q"), F.least("calls", F.lit(5)).cast("int"))),
        "method_params": F.struct(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"), version.alias("prompt_version"), F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("long").alias("max_tokens"), F.when(even, F.create_map(F.lit("seed"), F.lit("7"))).alias("extra")),
        "result_summary": F.struct("tp", "fp", "fn", *(F.lit(None).cast("double").alias(c) for c in ("f1", "fuel_accuracy", "status_accuracy", "province_accuracy"))),
    }
    rows = counts.select(*((made[c] if c in made else F.lit(None)).cast(t).alias(c) for c, t in known.items()))
    out = records.measurements(rows).select("label", "model", "coverage", "precision", "n_matched", "n_hallucinated", "n_missed", "n_web_search_calls", "seed")
    return rounded(out)


_FOLDER_SQL = """(case p_size % 9 when 0 then 'multiturn_web' when 1 then 'x_verification' when 2 then 'web' when 3 then 'rag_1' when 4 then 'rag_sourced' when 5 then 'decomposed_2' when 6 then 'sourced' when 7 then 'frontier' else 'census' end || '_' || p_brand)"""


@query(f"""with f as (select p_partkey, {_FOLDER_SQL} as folder from part)
select p_partkey, case when contains(folder, 'multiturn') then 'direct+multiturn' when contains(folder, 'verification') then 'rag+verification' when contains(folder, 'web') then 'rag_livesearch' when contains(folder, 'rag') or contains(folder, 'decomposed') or contains(folder, 'sourced') then 'rag' else 'direct' end as method from f""")
def folder_methods(spark, d):
    names = F.array(*map(F.lit, ("multiturn_web", "x_verification", "web", "rag_1", "rag_sourced", "decomposed_2", "sourced", "frontier", "census")))
    folder = F.concat_ws("_", F.element_at(names, (F.col("p_size") % 9 + 1).cast("int")), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", records.method_of_folder(folder).alias("method"))


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_quantity * coalesce(s_acctbal, 0) + l_extendedprice * coalesce(s_nationkey, 0), 2) as millionths from lineitem left join supplier on s_suppkey = l_suppkey and s_acctbal > 0""")
def token_costs(spark, d):
    registry = table(spark, d, "supplier").where("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey")
    runs = records.with_registry(table(spark, d, "lineitem"), registry, "l_suppkey")
    cost = records.token_cost(F.col("l_quantity"), F.col("l_extendedprice"), F.col("s_acctbal"), F.col("s_nationkey"))
    return runs.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(cost * 1e6, 2).alias("millionths"))


@query("""with t as (select conv_id, turn, case turn % 5 when 0 then '' when 1 then 'I cannot do it ' || coalesce(text, '') when 2 then 'See' || chr(10) || '| a | b | c |' || chr(10) || '| 1 | 2 | 3 |' || chr(10) when 3 then '```csv' || chr(10) || 'x' || chr(10) || '```' else 'plain words' end as said from conversations)
select conv_id, turn, case turn % 5 when 0 then 'empty' when 1 then 'refusal' when 2 then 'error' when 3 then 'error' else 'refusal' end as kind from t""")
def orphan_classes(spark, d):
    texts = [F.lit(""), F.concat(F.lit("I cannot do it "), F.coalesce("text", F.lit(""))), F.lit("See\n| a | b | c |\n| 1 | 2 | 3 |\n"), F.lit("```csv\nx\n```"), F.lit("plain words")]
    said = F.element_at(F.array(*texts), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", records.orphan_class(said).alias("kind"))


@query("""select event_id, case when event_type = 'error' then 'PERMANENT_SKIP' when event_type = 'signup' then 'SOFT_RETRY' when user_id % 6 = 0 then 'HARD_STOP' when user_id % 5 = 0 then 'HARD_STOP' when user_id % 6 = 1 and event_id % 2 = 0 then 'HARD_STOP' when user_id % 6 = 2 then 'PERMANENT_SKIP' else 'SOFT_RETRY' end as disposition,
  case when event_type not in ('error', 'signup') and user_id % 6 = 0 then 'router' else 'model' end as scope from events""")
def failure_classes(spark, d):
    kind = F.when(F.col("event_type") == "error", "connection_refused").when(F.col("event_type") == "signup", "timeout").otherwise("http")
    status = F.element_at(F.array(*map(F.lit, (402, 429, 404, 500, 503, 200))), (F.col("user_id") % 6 + 1).cast("int"))
    code = F.when(F.col("user_id") % 5 == 0, 402)
    message = F.when(F.col("event_id") % 2 == 0, "Daily limit reached").otherwise("slow down")
    return table(spark, d, "events").select("event_id", records.failure_class(kind, status, code, F.lit(None).cast("string"), message, bodies=False).alias("x")).select("event_id", "x.*")


@query()
def document_inventories(spark, d):
    return inventory.ingested(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")[1]


@query("""with e as (select event_id, event_type, [429, 500, 503, 200, 404][user_id % 5 + 1] as status, ['Daily limit reached', 'insufficient credit', 'see BILLING page', 'slow down', 'payment of fees', 'quota exceeded', 'per minute'][event_id % 7 + 1] as message from events),
k as (select *, event_id % 7 in (1, 2) as spent, event_id % 7 in (0, 5) as quota from e)
select event_id, case when status = 404 then 'PERMANENT_SKIP' when status = 503 then 'SOFT_RETRY' when spent or quota then 'HARD_STOP' else 'SOFT_RETRY' end as disposition, case when spent and status not in (404, 429, 503) then 'router' else 'model' end as scope from k""")
def hard_stops(spark, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    status, nothing = pick((429, 500, 503, 200, 404), F.col("user_id") % 5), F.lit(None)
    message = pick(("Daily limit reached", "insufficient credit", "see BILLING page", "slow down", "payment of fees", "quota exceeded", "per minute"), F.col("event_id") % 7)
    return table(spark, d, "events").select("event_id", records.failure_class(F.lit("http"), status, nothing.cast("int"), nothing.cast("string"), message).alias("x")).select("event_id", "x.*")


@query("""with n as (select conv_id, turn, coalesce(text, '') || [' Conflicting sources on capacity', ' estimated', ' unverified', ' Planned, but not built', ' planned but not built', ' no source'][turn % 6 + 1] as note from conversations)
select conv_id, count(*) as n_notes, count(*) filter (regexp_matches(note, 'uncertain|conflicting|no data|unclear|estimated|approximate|planned but|discrepancy|unconfirmed', 'i')) as n_honest from n group by 1""")
def honest_notes(spark, d):
    ends = F.array(*map(F.lit, (" Conflicting sources on capacity", " estimated", " unverified", " Planned, but not built", " planned but not built", " no source")))
    notes = table(spark, d, "conversations").select("conv_id", F.concat(F.coalesce("text", F.lit("")), F.element_at(ends, (F.col("turn") % 6 + 1).cast("int"))).alias("note"))
    return notes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_notes"), F.count_if(provenance.honest(F.col("note"))).alias("n_honest"))


@query("""with v as (select c_custkey as k, case when c_acctbal > 0 then c_acctbal end as v from customer), p as (select o_custkey as k, max(case when o_orderstatus <> 'P' then o_orderstatus end) as p from orders group by 1),
b as (select coalesce(v.k, p.k) as k, v.v, p.p, v.k is not null as l, p.k is not null as r from v full join p on v.k = p.k)
select k, case when not l then 'value_missing' when not r then 'provenance_missing' when v is null then 'value_null' else 'provenance_null' end as issue from b where not l or not r or (v is null) <> (p is null)""")
def sidecar_parity(spark, d):
    values = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    source = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("p"))
    return records.sidecar_issues(values, source, "k", "v", "p")


@query("""with r as (select distinct l_suppkey, l_shipdate::date as day, upper('D' || dayofmonth(l_shipdate)::varchar) as name from lineitem where l_quantity > 49),
s as (select l_suppkey, 'd' || dayofmonth(l_shipdate)::varchar as name, l_returnflag as verifier, arg_max(l_linenumber, (l_linestatus = 'O')::int * 1000 + l_linenumber) as score, max((l_linestatus = 'O')::int) as hit from lineitem where l_quantity > 47 group by 1, 2, 3),
v as (select distinct l_suppkey, l_returnflag as verifier from lineitem where l_quantity > 47),
e as (select r.l_suppkey, lower(r.name) as name, v.verifier, coalesce(s.score, 1) as score, coalesce(s.hit, 0) as hit from (select distinct l_suppkey, name from r) r join v using (l_suppkey) left join s on s.l_suppkey = r.l_suppkey and s.name = lower(r.name) and s.verifier = v.verifier),
t as (select l_suppkey, name, count(*) as n_verifiers, sum(hit)::bigint as matched_verifiers, floor(coalesce(median(score) filter (hit = 1), median(score)))::bigint as evidence_score from e group by 1, 2)
select r.l_suppkey, r.name, n_verifiers, matched_verifiers, evidence_score, coalesce(evidence_score >= 3, false) as verified from (select distinct l_suppkey, name from r) r left join t on t.l_suppkey = r.l_suppkey and t.name = lower(r.name)""")
def verifier_panel(spark, d):
    lines = table(spark, d, "lineitem").withColumn("day", F.dayofmonth("l_shipdate").cast("string"))
    rows = lines.where("l_quantity > 49").select("l_suppkey", F.concat(F.lit("D"), "day").alias("name")).distinct()
    said = lines.where("l_quantity > 47").select("l_suppkey", F.concat(F.lit(" d"), "day").alias("name"), F.col("l_returnflag").alias("verifier"), "l_linenumber", (F.col("l_linestatus") == "O").alias("matched"))
    said = said.groupBy("l_suppkey", "name", "verifier", "matched").agg(F.max("l_linenumber").alias("score"))
    return rounded(records.verifier_panel(rows, said, "name", ["l_suppkey"]))


@query("""select p_partkey, row_number() over (order by p_brand, case when p_size > 5 then p_size end nulls last, p_name || p_partkey::varchar) - 1 as place from part""")
def census_order(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return records.census_order(rows, "p_brand", "size", "name").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("""with b as (select s_nationkey, list(s_acctbal order by s_acctbal) as "values", count(*) as n from supplier join nation on n_nationkey = s_nationkey where n_regionkey < 3 group by 1)
select s_nationkey::bigint as s_nationkey, array_to_string(list_transform("values", lambda x: (x * 100)::bigint::varchar), ',') as "values", n from b""")
def scaling_lists(spark, d):
    registry = table(spark, d, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "s_nationkey")
    out = records.scaling(table(spark, d, "supplier"), registry, "s_nationkey", ["s_nationkey"], "s_acctbal")
    return rounded(out.select("s_nationkey", F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("values"), "n"))


@query("""select n_nationkey::bigint as n_nationkey, round(coalesce(max(s_acctbal), -1), 2) as best from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by 1""")
def best_or_constant(spark, d):
    runs = table(spark, d, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    spare = table(spark, d, "nation").select("n_nationkey", F.lit(-1.0).alias("s_acctbal"))
    return rounded(records.best_with_fallback(runs, "n_nationkey", "s_acctbal", spare), 2)


@query("""select s_suppkey, round(coalesce(case when s_acctbal > 5000 then s_acctbal end, s_nationkey::double), 2) as cost, coalesce(n, 0) as n_rows from supplier left join (select l_suppkey, count(*) as n from lineitem where l_quantity > 49 group by 1) on l_suppkey = s_suppkey""")
def run_table(spark, d):
    meta = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    counts = table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(records.run_table(meta, counts, "s_suppkey", ["a", "b"]), 2)


@query("""select page_id from pages where regexp_matches(url, '^https://example[.]com(/|$)') and not ends_with(url, '7')
union all select page_id from pages where not regexp_matches(url, '^https://example[.]com(/|$)') and not exists (select 1 from pages where regexp_matches(url, '^https://example[.]com(/|$)') and not ends_with(url, '7'))""")
def folder_rows(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    try:
        return records.under(pages, "url", "https://example[.]com", ("7",)).select("page_id")
    except ValueError:
        return pages.select("page_id")


# --- end to end -----------------------------------------------------------------------------------------------------------


@query("""with d as (select doc_id from documents)
select doc_id, 'P' || doc_id::varchar as name, 'coal' as fuel, 'planned' as status, '1200' as capacity_mwe from d where doc_id % 3 = 0 union all select doc_id, 'Q', 'gas', 'operating', '300' from d where doc_id % 3 = 0
union all select doc_id, 'R, S', 'gas', '', '12.5' from d where doc_id % 3 = 1 union all select doc_id, 'T', 'oil', '', '0' from d where doc_id % 3 = 1""")
def inventory_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    pipe = F.concat(F.lit("Here:\n| Plant name | Fuel | Status | Capacity (MW) |\n|---|---|---|---|\n| P"), F.col("doc_id").cast("string"), F.lit(" | coal | planned | 1,200 |\n| Q | gas | operating | ~300 |\n|  | gas | none | 1 |\n"))
    text = F.when(F.col("doc_id") % 3 == 0, pipe).when(F.col("doc_id") % 3 == 1, "a table\n```csv\nname,fuel_type,installed_capacity\n\"R, S\",gas,12.5\nT,oil,none\n```\n").otherwise("no table in here")
    return inventory.ingested(docs.withColumn("t", text), "doc_id", "t")[0].select("doc_id", "name", "fuel", "status", "capacity_mwe")


def _nations(spark, d):
    """Nations as a reference list; each customer segment's named and changed nations as a run."""
    entity = lambda df, ident, name, size: df.select(*ident, name.alias("name"), F.lit(None).cast("string").alias("province"), F.lit("coal").alias("fuel"), F.lit("").alias("status"), size.cast("double").alias("capacity"), F.lit(None).cast("string").alias("source_ref"))
    nation = table(spark, d, "nation")
    reference = entity(nation, [F.col("n_nationkey").cast("long").alias("id")], F.col("n_name"), F.col("n_regionkey") + 1)
    held = table(spark, d, "customer").select(F.col("c_mktsegment").alias("run"), F.col("c_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    name = F.when(F.xxhash64("run", "n_nationkey") % 4 == 0, F.concat(F.lower("n_name"), F.lit(" power"))).when(F.xxhash64("run", "n_nationkey") % 4 == 1, F.reverse("n_name")).otherwise(F.initcap("n_name"))
    return reference, entity(held, ["run", F.col("n_nationkey").cast("long").alias("id")], name, F.col("n_regionkey") + 1 + F.xxhash64("n_nationkey") % 2)


@query()
def reconcile_runs(spark, d):
    return rounded(reconcile.reconcile(*_nations(spark, d), "run"))


@query()
def reconcile_errors(spark, d):
    return rounded(reconcile.errors(reconcile.reconcile(*_nations(spark, d), "run"), "run"))


@query()
def reconcile_accuracy(spark, d):
    return rounded(reconcile.accuracy(reconcile.reconcile(*_nations(spark, d), "run"), "run"))


@query()
def unmatched_audit(spark, d):
    reference, system = _nations(spark, d)
    out = reconcile.false_positives(reconcile.reconcile(reference, system, "run"), reference, "run")
    return out.select("clean_name", "n_appearances", "n_runs", r4("now").alias("now"), r4("folded").alias("folded"), "verdict")


@query("""with r as (select user_id, (event_id % 2) as docs, (event_id // 2 % 2) as mode, value + 1 as v from events),
c as (select user_id, ln(avg(v) filter (docs = 0 and mode = 0)) as c00, ln(avg(v) filter (docs = 0 and mode = 1)) as c01, ln(avg(v) filter (docs = 1 and mode = 0)) as c10, ln(avg(v) filter (docs = 1 and mode = 1)) as c11 from r group by 1),
k as (select * from c where c00 is not null and c01 is not null and c10 is not null and c11 is not null),
e as (select 'docs' as effect, (c10 + c11 - c00 - c01) / 2 as d from k union all select 'mode', (c01 + c11 - c00 - c10) / 2 from k union all select 'interaction', c11 - c10 - c01 + c00 from k)
select effect, round(avg(d), 6) as mean, count(*) filter (d > 0) as n_up, count(*) as n, round(exp(avg(d)), 6) as ratio from e group by 1""")
def log_contrasts(spark, d):
    rows = table(spark, d, "events").withColumns({"docs": F.col("event_id") % 2, "mode": F.floor(F.col("event_id") / 2) % 2, "v": F.col("value") + 1})
    return rounded(stats.contrasts(rows, "user_id", "docs", "mode", "v", log=True), 6)


@query("""select c_nationkey::bigint as c_nationkey, count(*) filter (c_acctbal > 9000) as n_good, round(coalesce(avg(c_custkey) filter (c_acctbal > 9000), avg(c_custkey)), 4) as mean from customer group by 1""")
def good_run_means(spark, d):
    return rounded(quality.good_run_means(table(spark, d, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal") > 9000))


@query("""with s as (select l_returnflag, l_suppkey, l_linenumber % 5 as score from lineitem)
select l_returnflag, l_suppkey, count(*) as n, round(avg(score), 4) as mean, round(avg((score >= 3)::int), 4) as share_primary from s group by rollup(l_returnflag, l_suppkey)""")
def evidence_rollup(spark, d):
    return rounded(quality.evidence_rollup(table(spark, d, "lineitem").withColumn("score", F.col("l_linenumber") % 5), "l_returnflag", "l_suppkey", "score"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, (l_linenumber % 5)::bigint as score from lineitem where l_linenumber % 5 >= 3")
def evidence_filter(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_linenumber") % 5).alias("score"))
    return rounded(quality.evidence_at_least(rows, "score", 3))


@query("""with sc as (select s_suppkey::varchar as k, max(case when s_suppkey % 4 = 0 then null else s_acctbal end) as v from supplier where s_suppkey % 3 > 0 group by 1)
select l_orderkey, l_linenumber::bigint as l_linenumber, round(v, 2) as score from lineitem left join sc on sc.k = l_suppkey::varchar""")
def score_lookup(spark, d):
    scores = table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.concat(F.col("s_suppkey").cast("string")).alias("l_suppkey"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.format_string("%.2f", "s_acctbal")).alias("score"))
    out = records.with_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), scores, ["l_suppkey"], "score")
    return rounded(out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "score"), 2)


@query("""with q as (select o_custkey, o_orderstatus, count(*) filter (o_totalprice > 200000) as n_supported, count(*) filter (o_totalprice > 100000) as n_rows from orders group by 1, 2), m as (select c_custkey, c_nationkey as n_matched from customer where c_acctbal > 0)
select o_custkey, o_orderstatus, n_matched::bigint as n_matched, n_supported from q join m on c_custkey = o_custkey where o_orderstatus in ('F', 'O') and not (n_supported = 0 and n_rows = 0)""")
def coverage_certainty(spark, d):
    found = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("n_supported"), F.count_if(F.col("o_totalprice") > 100000).alias("n_rows"))
    matched = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("n_matched"))
    out = records.coverage_certainty(found, matched.join(found.select("o_custkey", "o_orderstatus").distinct(), "o_custkey"), ["o_custkey", "o_orderstatus"], ["F", "O"], "o_orderstatus")
    return rounded(out)


@query("""select p_brand, p_type, array_to_string(list(p_size order by p_size), ',') as "values" from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#13') and p_type in ('SMALL', 'PROMO') and not ends_with(p_brand, '3') and p_size > 10 group by 1, 2""")
def regime_lists(spark, d):
    rows = table(spark, d, "part").withColumn("v", F.when(F.col("p_size") > 10, F.col("p_size")))
    out = records.regimes(rows, "p_brand", "p_type", "v", ["Brand#1", "Brand#2", "Brand#13"], ["SMALL", "PROMO"], ("3",))
    return out.select("p_brand", "p_type", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"))


@query("""select p_partkey, case p_type when 'SMALL' then 'C1' when 'PROMO' then 'C2' else '' end as code, case p_type when 'SMALL' then 'Small ones' when 'PROMO' then 'Promoted' else '' end as label, case p_type when 'SMALL' then 'rail' else '' end as carrier from part""")
def classification(spark, d):
    classes = spark.createDataFrame([("SMALL", "C1", "Small ones", "rail"), ("PROMO", "C2", "Promoted", None)], "p_type string, code string, label string, carrier string")
    return records.classified(table(spark, d, "part").select("p_partkey", "p_type"), classes, "p_type").select("p_partkey", "code", "label", "carrier")


@query("""select doc_id, 1::bigint as row_no, 'https://a.org/' || doc_id::varchar as url from documents union all select doc_id, 2, 'http://b.org/x' from documents union all select doc_id, 3, null from documents""")
def source_urls(spark, d):
    from quorumlake.operators import extract, provenance

    ident = F.col("doc_id").cast("string")
    head = "| Name | Fuel | Status | COD | Province | MW | Source 1 | Source 2 |\n|--|--|--|--|--|--|--|--|\n"
    text = F.concat(F.lit("| a | b | c |\n| 1 | 2 | 3 |\n\n" + head + "| A | c | o | 1 | p | 5 | [1] | |\n| B | c | o | 1 | p | 5 | see http://b.org/x) | |\n| C | c | o | 1 | p | 5 | [9] | |\n\n## Annotated bibliography\n**[1]** Title. URL: `https://a.org/"), ident, F.lit("`\n[2] no url\n"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("t"))
    rows = provenance.source_tables(extract.pipe_table_rows(docs, "doc_id", "t"), "doc_id").withColumn("cell", F.get("cells", F.lit(6)))
    return provenance.source_urls(rows, "doc_id", "cell", provenance.coded_bibliography(docs, "doc_id", "t")).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "url")
