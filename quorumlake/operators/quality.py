"""Quality of runs without a reference: mechanical scores, screens, coherence, control totals, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.ordered import medians
from quorumlake.operators.stats import spearman
from quorumlake.sources.tables import written

# Clips and cut-offs of the scores.
DIVERSITY_CLIP, CAPACITY_KINDS, STATUS_KINDS, WARN, ERROR, DISCRIMINATING, FLOOR_MOST = 20, 4, 1, 0.05, 0.20, 0.10, 1


def filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def mechanical_scores(rows: DataFrame, key: str, core: list[str], vocab: dict[str, list[str]], source: str, capacity: str) -> DataFrame:
    """By run: completeness of the core cells, share of values in each vocabulary, source diversity and spread, and the
    share of capacities that aren't negative."""
    cells = sum((filled(c).cast("int") for c in core), F.lit(0))
    per = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum(cells) / (F.count(F.lit(1)) * len(core))).alias("completeness"),
        *[F.avg(F.col(c).isin(values).cast("double")).alias(f"{c}_in_vocabulary") for c, values in vocab.items()],
        F.least(F.count_distinct(source) / DIVERSITY_CLIP, F.lit(1.0)).alias("source_diversity"),
        F.avg((F.col(capacity) >= 0).cast("double")).alias("capacity_nonnegative"),
    )
    modal = rows.groupBy(key, source).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg((1 - F.max("_n") / F.sum("_n")).alias("source_spread"))
    return per.join(modal, key)


def variability_veto(rows: DataFrame, key: str, capacity: Column, status: Column) -> DataFrame:
    """A run with few distinct capacities or one status only is vetoed."""
    per = rows.groupBy(key).agg(F.count_distinct(capacity).alias("capacity_distinct"), F.count_distinct(F.lower(status)).alias("status_distinct"))
    return per.withColumn("veto", ((F.col("capacity_distinct") <= CAPACITY_KINDS) | (F.col("status_distinct") <= STATUS_KINDS)).cast("int"))


def reliability_grade(vetoes: DataFrame, model: str, veto: str = "veto") -> DataFrame:
    return vetoes.groupBy(model).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(veto).alias("veto_fraction"), (F.min(veto) == 1).alias("all_vetoed"))


def gate_sensitivity(runs: DataFrame, model: str, dimensions: list[str], taus: list[float]) -> DataFrame:
    """For each tau: how many runs of a model pass (no known dimension at or below tau), and whether the model has none."""
    from quorumlake.functions.text import passes_gate

    grid = runs.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    good = passes_gate(F.col("tau"), *[F.col(d) for d in dimensions])
    per = runs.join(F.broadcast(grid)).groupBy("tau", model).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(good).alias("n_good"))
    return per.withColumn("disqualified", F.col("n_good") == 0)


def gate_models(runs: DataFrame, model: str, accuracy: str, sets: dict[str, list[str]], taus: list[float], floor_most: int = FLOOR_MOST) -> DataFrame:
    """(indicator_set, n_dims, tau, model, n_runs, n_good, accuracy, disqualified, floor) for each set of dimensions and tau.

    A run is good unless a known dimension of the set is at or below tau. ``accuracy`` is the mean of the good runs', of all
    runs' where none is good. A model with ``floor_most`` good runs or fewer is disqualified; ``floor`` says whether it is
    by all dimensions of all sets at tau 0. The set ``discriminating`` is added: those of all dimensions whose model means
    differ by DISCRIMINATING or more. A null model is a model.
    """
    every = sorted({x for dims in sets.values() for x in dims})
    kept = discriminating_dimensions(runs, model, every).agg(F.array_sort(F.collect_set("dimension")).alias("_dims"))  # no more than columns
    fixed = runs.sparkSession.createDataFrame(sorted(sets.items()), "indicator_set string, _dims array<string>")
    grid = fixed.union(kept.select(F.lit("discriminating"), "_dims")).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    values = F.array(*[F.struct(F.lit(x).alias("d"), F.col(x).cast("double").alias("v")) for x in every])
    fails = F.exists("_values", lambda x: F.array_contains("_dims", x["d"]) & F.coalesce(x["v"] <= F.col("tau"), F.lit(False)))
    doubted = F.exists("_values", lambda x: F.coalesce(x["v"] <= 0, F.lit(False)))
    crossed = runs.select(model, F.col(accuracy).cast("double").alias("_a"), values.alias("_values")).join(F.broadcast(grid))
    per = crossed.withColumns({"_good": ~fails, "_base": ~doubted}).groupBy("indicator_set", F.size("_dims").alias("n_dims"), "tau", model)
    counted = per.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("_good").alias("n_good"), F.coalesce(F.avg(F.when(F.col("_good"), F.col("_a"))), F.avg("_a")).alias("accuracy"), F.count_if("_base").alias("_n_base"))
    return counted.withColumns({"disqualified": F.col("n_good") <= floor_most, "floor": F.col("_n_base") <= floor_most}).drop("_n_base")


def gate_sweep(models: DataFrame) -> DataFrame:
    """(indicator_set, n_dims, tau, n_disqualified, equals_floor, spearman) of ``gate_models``: whether the disqualified
    models are those of the floor, and the rank correlation of good runs and accuracy over models (null where one of the
    two is constant). Accuracies count as tied when they are equal to 12 digits."""
    cell = ["indicator_set", "tau"]
    rho = spearman(models.where("accuracy is not null").withColumn("_a", F.round("accuracy", 12)), "n_good", "_a", cell).select(*cell, F.col("rho").alias("spearman"))
    counts = models.groupBy("indicator_set", "n_dims", "tau").agg(F.count_if("disqualified").alias("n_disqualified"), (F.count_if(F.col("disqualified") != F.col("floor")) == 0).alias("equals_floor"))
    return counts.join(rho, cell, "left")


def discriminating_dimensions(scores: DataFrame, model: str, dimensions: list[str], least: float = DISCRIMINATING) -> DataFrame:
    """(dimension, spread): those whose model means differ by ``least`` or more."""
    long = scores.unpivot([model], dimensions, "dimension", "value")
    means = long.groupBy(model, "dimension").agg(F.avg("value").alias("_mean"))
    return means.groupBy("dimension").agg((F.max("_mean") - F.min("_mean")).alias("spread")).where(F.col("spread") >= least)


def row_issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks."""
    issues = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return rows.select(key, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def duplicates(rows: DataFrame, keys: list[Column], ordinal: str) -> DataFrame:
    """Groups of more than one row with equal keys: their number and first and last row."""
    named = [k.alias(f"key_{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_row"), F.max(ordinal).alias("last_row")).where("n > 1")


def control_totals(rows: DataFrame, totals: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Sums against declared totals; a null dimension of a total stands for all values. Totals of 0 are skipped.

    Rows are summed by their dimensions first, so that the one theta join is of those sums with a short declared list.
    """
    cube = rows.groupBy(*dims).agg(F.sum(value).alias("_sum"))
    keyed = totals.where("declared <> 0")
    on = F.lit(True)
    right = cube.select(*[F.col(d).alias(f"_{d}") for d in dims], "_sum")
    for d in dims:
        on = on & (F.col(d).isNull() | (F.col(d) == F.col(f"_{d}")))
    per = keyed.join(right, on, "left").groupBy("total_id", *dims, "declared").agg(F.coalesce(F.sum("_sum"), F.lit(0.0)).alias("observed"))
    per = per.withColumn("deviation", F.abs(F.col("observed") - F.col("declared")) / F.col("declared"))
    return per.withColumn("severity", F.when(F.col("deviation") > ERROR, "error").when(F.col("deviation") > WARN, "warning").otherwise("ok"))


def unit_rollup(units: DataFrame, key: Column, capacity: str, rank: Column, unit: str) -> DataFrame:
    """Units to plants: whole capacities summed, the furthest status rank, the units in order."""
    return units.groupBy(key.alias("plant")).agg(
        F.sum(F.col(capacity).cast("long")).alias("capacity"),
        F.max(rank).alias("status_rank"),
        F.count(F.lit(1)).alias("n_units"),
        F.array_join(F.array_sort(F.collect_list(F.lpad(F.col(unit).cast("string"), 4, "0"))), ",").alias("units"),
    )


def not_unique(rows: DataFrame, key: str, invariant: str) -> DataFrame:
    """Keys with more than one value where one is due."""
    return rows.groupBy(key).agg(F.count_distinct(invariant).alias("n_values")).where("n_values > 1")


def outside_vocabulary(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    return rows.join(vocabulary.select(F.col(vocabulary.columns[0]).alias(column)).distinct(), column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def evidence_summary(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Mean score and how often each of 0 to 4 occurs, by key and over all (key null)."""
    return rows.rollup(key).agg(F.avg(score).alias("mean_score"), *[F.count_if(F.col(score) == k).alias(f"n_{k}") for k in range(5)])


def level_scores(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Share of true among the rows that can be told."""
    return rows.groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias("share"), F.count(flag).alias("n_told"))


def grounding(rows: DataFrame, claimed: Column, found: Column) -> DataFrame:
    """The four cells of claimed against found."""
    return rows.agg(F.count_if(claimed & found).alias("both"), F.count_if(claimed & ~found).alias("claimed_only"), F.count_if(~claimed & found).alias("found_only"), F.count_if(~claimed & ~found).alias("neither"))


def temporal_scores(rows: DataFrame, key: str, date: str) -> DataFrame:
    """Share of rows with a date, and of dated rows with a year in [1980, 2100]; the latter is 0 where all are equal."""
    year = F.year(date)
    per = rows.groupBy(key).agg(F.avg(F.col(date).isNotNull().cast("double")).alias("presence"), F.avg(year.between(1980, 2100).cast("double")).alias("in_range"), F.count_distinct(year).alias("years"))
    return per.withColumn("plausible", F.when(F.col("years") <= 1, 0.0).otherwise(F.col("in_range")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_no`` from 0 by partition-wise counts, so that no task numbers all rows. The ranges are written before they
    are counted: their bounds are sampled, and two samples may differ."""
    n = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = n.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return n.join(F.broadcast(base), "_part").withColumn("row_no", F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_base")


def provenance_scores(rows: DataFrame, key: str, first: str, second: str, confidence: str | None) -> DataFrame:
    """Share of rows with a source, and of HIGH rows with both; null with a reason where the column is missing or nothing
    is HIGH."""
    high = F.upper(F.trim(F.coalesce(F.col(confidence), F.lit("")))) == "HIGH" if confidence else F.lit(False)
    per = rows.groupBy(key).agg(F.avg((filled(first) | filled(second)).cast("double")).alias("source_presence"), F.avg(F.when(high, (filled(first) & filled(second)).cast("double"))).alias("high_dual_source"))
    return per.withColumn("high_note", F.lit("column_missing") if not confidence else F.when(F.col("high_dual_source").isNull(), "no_high_confidence"))


def cod_plausible(rows: DataFrame, key: str, cod: str, first: int = 1960, last: int = 2035) -> DataFrame:
    """Share of filled dates with a year from ``first`` to ``last``: 0 where all are the same, null where none is filled."""
    year = F.regexp_extract(cod, r"((?:19|20)\d{2})", 1).try_cast("int")
    per = rows.groupBy(key).agg(F.count_if(filled(cod)).alias("_n"), F.count_distinct(F.when(filled(cod), F.trim(F.col(cod).cast("string")))).alias("_kinds"), F.count_if(filled(cod) & year.between(first, last)).alias("_fits"))
    return per.select(key, F.when(F.col("_n") == 0, None).when(F.col("_kinds") <= 1, 0.0).otherwise(F.col("_fits") / F.col("_n")).alias("cod_plausible"))


def coherence_rules(name: str, capacity: str, fuel: str, status: str, province: str, cod: str, provinces: list[str], year: int = 2025) -> dict[str, Column]:
    """The rules that a row must keep, for ``row_issues``: capacity above 0, fuel, status and province known, and no
    retired entity that starts after ``year``."""
    low = F.lower(F.trim(F.coalesce(F.col(province), F.lit(""))))
    return {
        "zero_or_negative_capacity": F.col(capacity) <= 0,
        "unknown_fuel": F.col(fuel) == "unknown",
        "unknown_status": F.col(status) == "unknown",
        "unknown_province": ~low.isin([p.lower() for p in provinces]),
        "retired_future_cod": (F.col(status) == "retired") & (F.substring(cod, 1, 4).try_cast("int") > year),
    }


def coherence_medians(runs: DataFrame, model: str, total: str, flawed: str) -> DataFrame:
    """By model, over its runs: the median of rows, of rows with an issue, and of the share without one (0 of none)."""
    share = F.when(F.col(total) > 0, (F.col(total) - F.col(flawed)) / F.col(total)).otherwise(0.0)
    found = medians(runs, [model], {"_rows": F.col(total), "_flawed": F.col(flawed), "coherence_rate": share})
    return found.select(model, F.floor("_rows").cast("long").alias("n_rows"), F.floor("_flawed").cast("long").alias("n_flawed"), "coherence_rate")


def taxonomy_audit(rows: DataFrame, level: str, capacity: str, status: str, plant_cap: float = 1600.0, unit_cap: float = 1350.0) -> DataFrame:
    """(level, n, n_violations): rows by level, and those too large for it: units, and plants that run or are built."""
    big = ((F.col(level) == "plant") & F.col(status).isin("operational", "constructing") & (F.col(capacity) > plant_cap)) | ((F.col(level) == "unit") & (F.col(capacity) > unit_cap))
    return rows.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(big, F.lit(False))).alias("n_violations"))


def row_scores(key: str, *axes: DataFrame) -> DataFrame:
    """One row a run with all axes (tables by ``key``); a run that an axis does not know has nulls there."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.join(axis, key, "full")
    return out


def good_run_means(runs: DataFrame, model: str, value: str, good: Column) -> DataFrame:
    """(model, n_good, mean): how many runs of a model are good, and the mean of their values; of all its runs where none
    is."""
    return runs.groupBy(model).agg(F.count_if(good).alias("n_good"), F.coalesce(F.avg(F.when(good, F.col(value))), F.avg(value)).alias("mean"))


def evidence_at_least(rows: DataFrame, score: str, least: int) -> DataFrame:
    return rows.where(F.col(score) >= least)


def evidence_rollup(rows: DataFrame, folder: str, run: str, score: str) -> DataFrame:
    """(folder, run, n, mean, share_primary) by run, by folder (run null) and over all (both null); a folder's figures are
    sums over its rows, not means of its runs."""
    out = rows.rollup(folder, run).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.avg((F.col(score) >= 3).cast("double")).alias("share_primary"))
    return out
