"""Metrics of matches and runs: one grouped aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.ordered import Ordered, medians, null_safe


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def match_metrics(matches: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn, coverage, precision, f1 and attribute accuracies by ``key`` from (status, fuel_ok, status_ok,
    capacity_ok): accuracies skip nulls and are null where none is known."""
    tp = F.count_if(F.col("status").isin("exact", "fuzzy", "fuzzy_diff"))
    per = matches.groupBy(key).agg(
        tp.alias("tp"),
        F.count_if(F.col("status") == "sys_only").alias("fp"),
        F.count_if(F.col("status") == "ref_only").alias("fn"),
        F.count_if(F.col("status") == "exact").alias("n_exact"),
        F.count_if(F.col("status").isin("fuzzy", "fuzzy_diff")).alias("n_fuzzy"),
        F.avg(F.col("fuel_ok").cast("double")).alias("fuel_accuracy"),
        F.avg(F.col("status_ok").cast("double")).alias("status_accuracy"),
        F.avg(F.col("capacity_ok").cast("double")).alias("capacity_accuracy"),
    )
    per = per.withColumn("coverage", _ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return per.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def threshold_rescore(matches: DataFrame, key: str, thresholds: list[float]) -> DataFrame:
    """Metrics by key and threshold: a fuzzy pair below it (or without a score) is a miss and an invention."""
    grid = matches.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    fuzzy = F.col("status").isin("fuzzy", "fuzzy_diff")
    falls = fuzzy & ~F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    per = matches.join(F.broadcast(grid)).groupBy(key, "threshold").agg(
        F.count_if((F.col("status") == "exact") | (fuzzy & ~falls)).alias("tp"),
        F.count_if((F.col("status") == "sys_only") | falls).alias("fp"),
        F.count_if((F.col("status") == "ref_only") | falls).alias("fn"),
    )
    return per.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def group_medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median, sample deviation (0 for one row), least and most of each value, and the number of rows."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggregates += [F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    found = null_safe(rows.groupBy(*keys).agg(*aggregates), medians(rows, keys, {f"{v}_median": F.col(v) for v in values}), keys)
    return found.select(*keys, "n", *[f"{v}_{x}" for v in values for x in ("median", "sd", "min", "max")])


def low_middle_high(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first, upper-median and last row of each key by ``order``; all rows where there are three or fewer."""
    ranked = Ordered(rows, [key], order).place("_p").size("_n").done().withColumn("_k", F.col("_p") - 1).drop("_p")
    keep = (F.col("_n") <= 3) | F.col("_k").isin(0) | (F.col("_k") == F.floor(F.col("_n") / 2)) | (F.col("_k") == F.col("_n") - 1)
    return ranked.where(keep).drop("_k", "_n")


def cost_summary(runs: DataFrame, key: str, cost: str, value: str, ok: Column) -> DataFrame:
    """Totals, mean of positive costs, and value spread over the runs that are ``ok``."""
    sums = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(ok).alias("n_ok"),
        F.sum(cost).alias("cost_total"),
        F.avg(F.when(F.col(cost) > 0, F.col(cost))).alias("cost_mean"),
        F.min(F.when(ok, F.col(value))).alias("value_min"),
        F.max(F.when(ok, F.col(value))).alias("value_max"),
    )
    return null_safe(sums, medians(runs, [key], {"value_median": F.when(ok, F.col(value))}), [key])


def with_total(rows: DataFrame, key: str, aggregates: list[Column], label: str = "All") -> DataFrame:
    """The aggregates by key, and a row for all."""
    rolled = rows.rollup(key).agg(F.grouping(key).alias("_g"), *aggregates)
    return rolled.withColumn(key, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key))).drop("_g")


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Counts by key and their percentage of all."""
    from pyspark.sql import Window

    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def precedence_share(events: DataFrame, lab: str, stage: str, at: str, least: int = 2) -> DataFrame:
    """For stages a, b: the share of labs that reach a before b (ties count a half), where ``least`` labs have both."""
    x = events.select(F.col(lab).alias("_lab"), F.col(stage).alias("a"), F.col(at).alias("_x"))
    y = events.select(F.col(lab).alias("_lab"), F.col(stage).alias("b"), F.col(at).alias("_y"))
    both = x.join(y, "_lab").where("a <> b")
    share = F.avg(F.when(F.col("_x") < F.col("_y"), 1.0).when(F.col("_x") == F.col("_y"), 0.5).otherwise(0.0))
    return both.groupBy("a", "b").agg(share.alias("share"), F.count(F.lit(1)).alias("labs")).where(F.col("labs") >= least)


def geometric_mean(c: str) -> Column:
    return F.exp(F.avg(F.log(c)))


def turn_profile(rows: DataFrame, key: str, turn: str, value: str, turns: list[int]) -> DataFrame:
    """Median by turn, a column a turn, and the value of the last turn (the largest of equals)."""
    medians = rows.groupBy(key).pivot(turn, turns).agg(F.median(value))
    medians = medians.select(key, *[F.col(str(t)).alias(f"turn_{t}") for t in turns])
    return medians.join(rows.groupBy(key).agg(F.max(F.struct(turn, value)).getField(value).alias("last")), key)


def cohort_summary(rows: DataFrame, key: str, cohort: Column, labels: list[str], value: str) -> DataFrame:
    """Number, mean and deviation (0 for one row) of each cohort, side by side."""
    return rows.withColumn("_c", cohort).groupBy(key).pivot("_c", labels).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def buckets(rows: DataFrame, key: str, value: str, edges: list[float]) -> DataFrame:
    """Counts by key and bucket: below the first edge, between edges, from the last on, or missing."""
    bucket = F.when(F.col(value).isNull(), "missing")
    for k, edge in enumerate(edges):
        bucket = bucket.when(F.col(value) < edge, f"b{k}")
    return rows.groupBy(key, bucket.otherwise(f"b{len(edges)}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hit_rate(rows: DataFrame, keys: list[str], hit: Column, weight: Column) -> DataFrame:
    """Weight of hits and of all, and their ratio (null without weight), by keys."""
    per = rows.groupBy(*keys).agg(F.sum(F.when(hit, weight).otherwise(0)).alias("hit"), F.sum(weight).alias("total"))
    return per.withColumn("rate", F.try_divide("hit", "total"))


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least and most of a value, its population deviation and how many rows have one."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def rung_means(rows: DataFrame, agent: str, rung: str, names: list[str]) -> DataFrame:
    """(agent, rung, metric, mean): means of each metric over the runs that have it."""
    return rows.unpivot([agent, rung], names, "metric", "value").groupBy(agent, rung, "metric").agg(F.avg("value").alias("mean")).where("mean is not null")


def tradeoff(rows: DataFrame, mode: str, run: str, entity: str, score: str, reference: DataFrame, thresholds: list[int]) -> DataFrame:
    """(mode, threshold, n_retained, n_total, retention, precision, coverage, n_runs): what is left of runs when entities
    below a threshold go, averaged over the runs of a mode; a run of which nothing is left counts as 0."""
    grid = rows.sparkSession.createDataFrame([(int(t),) for t in thresholds], "threshold int")
    known = reference.select(entity).distinct().withColumn("_ref", F.lit(1))
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    marked = rows.join(known, entity, "left").join(F.broadcast(grid))
    stays = F.col(score) >= F.col("threshold")
    per = marked.groupBy(mode, run, "threshold").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(stays).alias("n_retained"), F.count_if(stays & F.col("_ref").isNotNull()).alias("_tp")).join(F.broadcast(total))
    per = per.withColumn("precision", _ratio(F.col("_tp"), F.col("n_retained"))).withColumn("coverage", _ratio(F.col("_tp"), F.col("_total")))
    out = per.groupBy(mode, "threshold").agg(F.avg("n_retained").alias("n_retained"), F.avg("n_total").alias("n_total"), F.avg("precision").alias("precision"), F.avg("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_runs"))
    return out.withColumn("retention", _ratio(100 * F.col("n_retained"), F.col("n_total")))


def two_conditions(rows: DataFrame, model: str, condition: str, value: str, a: str, b: str) -> DataFrame:
    """Number, median and best of models' values in two conditions, for models that have both."""
    of = lambda c: F.when(F.col(condition) == c, F.col(value))
    per = rows.groupBy(model).agg(*(f(of(c)).alias(f"{n}_{c}") for c in (a, b) for n, f in (("n", F.count), ("median", F.median), ("best", F.max))))
    return per.where((F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") > 0))


def calibration(rows: DataFrame, tier: str, verified: Column) -> DataFrame:
    """Share of verified rows of each tier, unknown ones left out, and how many are known."""
    return rows.groupBy(tier).agg(F.avg(verified.cast("double")).alias("share"), F.count(verified).alias("n"))
