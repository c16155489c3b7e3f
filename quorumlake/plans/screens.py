"""Queries of screens and comparisons: bibliographies of three forms, the sweep of the gate, conditions with their test."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.operators import extract, ingestion, provenance, quality, selection
from quorumlake.plans.registry import query, r4
from quorumlake.sources.tables import table


@query(r"""with l as (select doc_id, doc_id % 3 as f, unnest(string_split(coalesce(text, ''), chr(10))) as x from documents)
select doc_id, case any_value(f) when 0 then 'table' when 1 then 'numbered' else 'bold' end as form, count(*) as n_entries,
  count(*) filter (regexp_matches(x, '(?i)the|le ')) as n_primary from l group by 1""")
def bibliography_counts(spark, d):
    # each document's lines as the entries of a bibliography, in one of the three forms; no character or end of a line may
    # turn into a blank, or be lost as one, since the pattern tells blanks
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), "|\x01", "//"), "\n")
    form = F.col("doc_id") % 3
    entry = lambda x, i: F.when(form == 0, F.concat(F.lit("| S"), (i % 100).cast("string"), F.lit(" | "), x, F.lit(". |"))).when(form == 1, F.concat((i + 1).cast("string"), F.lit(". **"), x, F.lit("**"))).otherwise(F.concat(F.lit("**[S"), (i % 100).cast("string"), F.lit("]**\n\n> "), x, F.lit(".")))
    text = F.concat(F.lit("# Report\n1. **not one of them**\n## Annotated bibliography\n### Sources\n| Code | Source |\n|---|---|\n"), F.array_join(F.transform(lines, entry), "\n"), F.lit("\n## Annex\n| S1 | after the end |\n"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("t"))
    return extract.bibliography_counts(docs, "doc_id", "t", "(?i)the|le ", "zzzz")


@query("""with r as (select s_suppkey, s_nationkey, s_acctbal / 10000 as f1, count(distinct l_partkey) / count(*)::double - 0.7 as spread,
    avg((l_returnflag = 'A')::int::double) - 0.2 as flag, avg((l_linestatus = 'O')::int::double) as stat
  from supplier join lineitem on l_suppkey = s_suppkey group by all),
v as (select s_suppkey, s_nationkey, f1, 'spread' as d, spread as v from r union all select s_suppkey, s_nationkey, f1, 'flag', flag from r union all select s_suppkey, s_nationkey, f1, 'stat', stat from r),
k as (select d from (select d, s_nationkey, avg(v) as m from v group by all) group by d having max(m) - min(m) >= 0.1),
sets as (select 'all' as s, unnest(['spread', 'flag', 'stat']) as d union all select 'coherence', unnest(['flag', 'stat']) union all select 'discriminating', d from k),
names as (select unnest(['all', 'coherence', 'discriminating']) as s), taus as (select unnest([0.0, 0.1, 0.2, 0.3])::double as tau),
g as (select n.s, t.tau, r.s_suppkey, r.s_nationkey, r.f1, coalesce(bool_and(v.v > t.tau), true) as good
  from names n cross join taus t cross join r left join (sets join v using (d)) v on v.s = n.s and v.s_suppkey = r.s_suppkey group by all),
b as (select s_nationkey, count(*) filter (least(spread, flag, stat) > 0) <= 1 as floor from r group by 1),
m as (select s, tau, s_nationkey, count(*) filter (good) as n_good, round(coalesce(avg(f1) filter (good), avg(f1)), 12) as a from g group by all),
c as (select s, tau, count(*) filter (n_good <= 1) as n_disqualified, count(*) filter ((n_good <= 1) <> floor) = 0 as equals_floor from m join b using (s_nationkey) group by all),
k2 as (select s, tau, rank() over (partition by s, tau order by n_good) + (count(*) over (partition by s, tau, n_good) - 1) / 2.0 as x, rank() over (partition by s, tau order by a) + (count(*) over (partition by s, tau, a) - 1) / 2.0 as y from m),
rho as (select s, tau, case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then round(corr(x, y), 4) end as spearman from k2 group by all)
select c.s as indicator_set, (select count(*) from sets where sets.s = c.s) as n_dims, c.tau, n_disqualified, equals_floor, spearman from c join rho on rho.s = c.s and rho.tau = c.tau""")
def gate_sweep(spark, d):
    share = lambda c, v: F.avg((F.col(c) == v).cast("double"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    runs = lines.groupBy("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 10000).alias("f1")).agg(
        (F.count_distinct("l_partkey") / F.count(F.lit(1)) - 0.7).alias("spread"), (share("l_returnflag", "A") - 0.2).alias("flag"), share("l_linestatus", "O").alias("stat")
    )
    models = quality.gate_models(runs, "s_nationkey", "f1", {"all": ["spread", "flag", "stat"], "coherence": ["flag", "stat"]}, [0.0, 0.1, 0.2, 0.3])
    return quality.gate_sweep(models).select("indicator_set", F.col("n_dims").cast("long").alias("n_dims"), "tau", "n_disqualified", "equals_floor", r4("spearman").alias("spearman"))


@query("""with o as (select o_custkey, o_orderkey, case o_orderstatus when 'F' then 'b' when 'O' then 'a' end as c, floor(o_totalprice) as v from orders where o_orderstatus in ('F', 'O') and o_totalprice is not null and o_custkey is not null),
s as (select o_custkey, median(v) filter (c = 'b') as before, median(v) filter (c = 'a') as after, count(*) filter (c = 'b') as n_before, count(*) filter (c = 'a') as n_after from o group by 1),
i as (select *, row_number() over (partition by o_custkey, c order by o_orderkey, v) as i from o),
e as (select * from s where n_before = n_after and n_before > 1),
q as (select x.o_custkey, x.i, e.n_before as n, y.v - x.v as d from i x join i y on x.o_custkey = y.o_custkey and x.i = y.i and x.c = 'b' and y.c = 'a' join e on e.o_custkey = x.o_custkey),
k as (select o_custkey, unnest(range(1::bigint << n_before::int)) as mask from e),
f as (select o_custkey, mask, abs(sum(case when (mask >> (i - 1)::int) & 1 = 1 then -d else d end)) as t from q join k using (o_custkey) group by 1, 2),
p as (select o_custkey, avg((t >= u - 1e-9)::int) as p from f join (select o_custkey, abs(sum(d)) as u from q group by 1) using (o_custkey) group by 1),
r as (select *, row_number() over (order by p, o_custkey) as r, count(*) over () as m from p),
h as (select o_custkey, p, least(min(p * m / r) over (order by r desc rows unbounded preceding), 1.0) as p_adjusted from r)
select s.o_custkey, round(before, 4) as before, round(after, 4) as after, round(after - before, 4) as delta, n_before, n_after, round(p, 4) as p, round(p_adjusted, 4) as p_adjusted, s.o_custkey % 7 in (0, 3) as unstable
from s left join h using (o_custkey) where n_before > 0 and n_after > 0""")
def tested_comparison(spark, d):
    orders = table(spark, d, "orders").withColumn("o_totalprice", F.floor("o_totalprice"))
    keys = orders.select("o_custkey").distinct()
    unstable = keys.where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 3).alias("b"))
    unstable = unstable.union(keys.where("o_custkey % 7 = 3").select((F.col("o_custkey") - 3).alias("a"), F.col("o_custkey").alias("b")))
    told = selection.tested_comparison(orders, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", "F", "O", unstable)
    return told.select("o_custkey", *[r4(c).alias(c) for c in ("before", "after", "delta")], "n_before", "n_after", r4("p").alias("p"), r4("p_adjusted").alias("p_adjusted"), "unstable")


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x from documents), n as (select doc_id, count(*) as n from l group by 1),
e as (select doc_id, n, case doc_id % 12 when 0 then 'unknown_arm' when 1 then 'invalid_parity_row' when 2 then 'invalid_parity_row' when 3 then 'run_not_found' when 4 then 'ambiguous_run'
  when 5 then 'missing_markdown' when 6 then 'invalid_encoding' when 7 then 'no_table' when 8 then 'parse_failed' end as error from n)
select doc_id, n + (doc_id % 12 = 9)::int as expected_rows, case when error is null then n end as observed_rows, error is null and doc_id % 12 <> 9 as matches, error,
  case doc_id % 12 when 0 then 'arm none' when 1 then 'run r' || doc_id when 2 then 'missing model' when 3 then 'no run arm3 m ' || doc_id
    when 4 then '2 files: ' || doc_id || '.md to ' || doc_id || 'b.md' when 5 then doc_id || '.md' when 6 then doc_id || '.md' when 7 then doc_id || '.md' when 8 then doc_id || '.md' end as detail from e""")
def run_parity(spark, d):
    # each document as the report of a run, its lines as the rows of the report's table; one in twelve for each fault
    docs = table(spark, d, "documents").select("doc_id", F.split(F.translate(F.coalesce("text", F.lit("")), '|"', "  "), "\n").alias("_l")).withColumn("_k", F.col("doc_id") % 12)
    ident, is_ = F.col("doc_id").cast("string"), lambda *k: F.col("_k").isin(*k)
    declared = docs.select("doc_id", F.when(is_(0), "none").otherwise("arm3").alias("arm"), F.when(is_(2), "").otherwise("m").alias("model"), F.when(is_(1), F.concat(F.lit("r"), ident)).otherwise(ident).alias("run"), (F.size("_l") + is_(9).cast("int")).cast("string").alias("inventory_rows"))
    files = F.when(is_(3), F.array().cast("array<string>")).when(is_(4), F.array(F.concat(ident, F.lit(".md")), F.concat(ident, F.lit("b.md")))).otherwise(F.array(F.concat(ident, F.lit(".md"))))
    runs = docs.select(F.lit("arm3").alias("arm"), F.lit("m").alias("model"), F.col("doc_id").alias("run_no"), F.explode(files).alias("file"))
    body = F.array_join(F.transform("_l", lambda x, i: F.concat(F.lit("| N"), i.cast("string"), F.lit(" "), x, F.lit(" | coal | operating |"))), "\n")
    head = F.when(is_(8), "| Qty | Rank | Note |\n|---|---|---|\n").otherwise("| Name | Fuel | Status |\n|---|---|---|\n")
    content = F.when(is_(6), F.concat(F.lit(b"\xff"), body.cast("binary"))).when(is_(7), F.array_join("_l", "\n").cast("binary")).otherwise(F.concat(head, body).cast("binary"))
    reports = docs.where(~is_(3, 5)).select(F.concat(ident, F.lit(".md")).alias("file"), content.alias("content"))
    parity = ingestion.run_parity(declared, runs, ingestion.report_counts(reports, "file", "content"), ["naive", "arm3"])
    return parity.select("doc_id", "expected_rows", "observed_rows", "matches", "error", "detail")


@query("""with c as (select user_id, event_id, event_type, value, case when event_type = 'error' then 'not found' when event_type = 'view' then '-' else 'S' || (event_id % 100) end as v from events),
s as (select user_id, count(*) filter (v like 'S%') > 0.5 * count(*) filter (v <> '-') as key_ref from c group by 1)
select user_id, 'v' as cell, case when key_ref then 'key_ref' else 'inline' end as style, count(*) filter (v = '-') as n_empty, count(*) filter (v = 'not found') as n_not_found,
  count(*) filter (v like 'S%') as n_present, case when key_ref then count(*) filter (v like 'S%' and event_id % 100 < 50) end as n_valid,
  count(*) filter (v like 'S%' and key_ref and event_id % 100 < 50 and event_id % 100 % 2 = 0) as n_primary from c join s using (user_id) group by user_id, key_ref""")
def source_cell_quality(spark, d):
    # each user's events as the source cells of a text; every text lists fifty sources, every other one primary
    kind = F.col("event_type")
    cell = F.when(kind == "error", "not found").when(kind == "view", "-").otherwise(F.concat(F.lit("S"), (F.col("event_id") % 100).cast("string")))
    rows = table(spark, d, "events").select("user_id", cell.alias("v"))
    section = "\n".join(f"S{k} {'Ministry' if k % 2 == 0 else 'Reuters'}" for k in range(50))
    texts = rows.select("user_id").distinct().withColumn("b", F.lit(section))
    return provenance.source_cell_quality(rows, "user_id", ["v"], texts, "b", "(?i)ministry", "(?i)reuters")
