"""Reconciling runs with a reference list, end to end, and the audits of what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators import matching
from quorumlake.operators.fuzzy_join import nearest
from quorumlake.sources.tables import written

#: Columns of an entity, besides its id.
ENTITY = ("name", "province", "fuel", "status", "capacity", "source_ref")
MATCHED = ("exact", "fuzzy", "fuzzy_diff")
# Scores from which a forced pair is a hard case, names are alike, and are variants of each other.
HARD, ALIKE, VARIANT, BORDERLINE = 80.0, 90.0, 88.0, 75.0


def cleaned(rows: DataFrame, drops: tuple[str, ...] = (), substitutions: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Adds name_clean, province_clean, fuel_clean, status_clean (empty: null) and capacity_clean to entities."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return rows.withColumns(
        {
            "name_clean": tx.clean_name(F.col("name"), drops, substitutions),
            "province_clean": filled(tx.clean(F.col("province"))),
            "fuel_clean": filled(tx.clean_fuel(F.col("fuel"))),
            "status_clean": filled(tx.clean(F.col("status"))),
            "capacity_clean": tx.clean_capacity(F.col("capacity").cast("string")),
        }
    )


def matched_names(reference: DataFrame, system: DataFrame, key: str, drops: tuple[str, ...] = (), substitutions: tuple[tuple[str, str], ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, reference, system) of a reference list (id, ENTITY) and of runs (key, id, ENTITY): both cleaned, numbers of
    the reference's single units left out on both sides, the runs' names of two units expanded (``sys_id`` tells them
    apart), and each run matched with the whole list."""
    ref = cleaned(reference, drops, substitutions)
    known = ref.select(F.col("name_clean")).distinct()
    ref = matching.single_unit_names(ref, known, "name_clean").withColumnRenamed("id", "ref_id")
    own = matching.single_unit_names(cleaned(system, drops, substitutions), known, "name_clean")
    own = own.select("*", F.posexplode(matching.unit_names(F.col("name_clean"))).alias("_at", "_unit"))
    own = own.withColumn("sys_id", F.col("id") * 2 + F.col("_at")).withColumn("name_clean", F.col("_unit")).drop("_at", "_unit", "id")
    side = lambda df, s, i: df.select(key, F.lit(s).alias("side"), F.col(i).cast("long").alias("id"), F.col("name_clean").alias("name"), F.col("capacity_clean").alias("capacity"))
    asked = system.select(key).distinct().crossJoin(ref.select("ref_id", "name_clean", "capacity_clean"))
    return matching.optimal_match(side(asked, "ref", "ref_id").union(side(own, "sys", "sys_id")), key), ref, own


def _side(df: DataFrame, by: list[str], ident: str, label: str) -> DataFrame:
    """An entity's own name and capacity; its other attributes are those of the first row of its clean name."""
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "name_clean").orderBy(ident))).where("_rn = 1")
    first = first.select(*by, F.col("name_clean").alias("_name"), *(F.col(f"{c}_clean").alias(f"{label}_{c}") for c in ("province", "fuel", "status")), F.nullif("source_ref", F.lit("")).alias(f"{label}_source_ref"))
    own = df.select(*by, ident, F.col("name_clean").alias("_name"), F.col("name").alias(f"{label}_name"), F.col("capacity").try_cast("double").alias(f"{label}_capacity_mwe"))
    return own.join(first, [*by, "_name"]).drop("_name")


#: The columns of a reconciliation, in the order of its files.
COLUMNS = (
    "match_type", "reference_name", "system_name", "reference_province", "system_province", "reference_fuel", "system_fuel", "reference_capacity_mwe", "system_capacity_mwe", "capacity_diff_pct", "fuel_match", "status_match", "province_match",
    "reference_source_ref", "system_source_ref", "similarity_score",
)


def gap_percent(reference: Column, system: Column) -> Column:
    """Their difference in percent of the reference's, to a tenth; null where that is not above 0."""
    return F.when(reference > 0, F.round(F.abs(system - reference) / reference * 100, 1))


def reconcile(reference: DataFrame, system: DataFrame, key: str, drops: tuple[str, ...] = (), substitutions: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(key, COLUMNS): each run of ``system`` (key, id, ENTITY) against the list ``reference`` (id, ENTITY).

    A matched pair is one row; an entity without a partner is one (ref_only or sys_only), and so is each side of a pair
    that the match had to force. Attributes are compared where both sides have one, else the flag is null.
    """
    matches, ref, own = matched_names(reference, system, key, drops, substitutions)
    parts = matching.split_mismatches(matches.withColumn("score", F.when(F.col("status") != "mismatched", F.col("score"))))
    out = parts.join(_side(ref, [], "ref_id", "reference"), "ref_id", "left").join(_side(own, [key], "sys_id", "system"), [key, "sys_id"], "left")
    paired = F.col("status").isin(*MATCHED)
    same = lambda c: F.when(paired, F.col(f"reference_{c}") == F.col(f"system_{c}")).alias(f"{c}_match")
    out = out.withColumn("capacity_diff_pct", F.when(paired, gap_percent(F.col("reference_capacity_mwe"), F.col("system_capacity_mwe"))))
    out = out.select("*", F.col("status").alias("match_type"), F.when(paired, F.col("score")).alias("similarity_score"), same("fuel"), same("status"), same("province"))
    return out.select(key, *COLUMNS)


def errors(entries: DataFrame, key: str) -> DataFrame:
    """How a run's entries go wrong, by kind, and the share of pairs with equal capacities."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    paired = F.col("match_type").isin(*MATCHED)
    same = F.col("match_type").isin("exact", "fuzzy")
    return entries.groupBy(key).agg(
        count(F.col("match_type") == "sys_only").alias("hallucinated"),
        count(F.col("match_type") == "ref_only").alias("missed"),
        count(~F.col("fuel_match")).alias("wrong_fuel"),
        count(~F.col("status_match")).alias("wrong_status"),
        count(~F.col("province_match")).alias("wrong_province"),
        count(F.col("match_type") == "fuzzy_diff").alias("capacity_mismatch"),
        F.avg(F.when(paired, same.cast("double"))).alias("capacity_match_rate"),
    )


def accuracy(entries: DataFrame, key: str) -> DataFrame:
    """Match metrics and attribute accuracies of runs from their entries."""
    from quorumlake.operators.metrics import match_metrics

    flags = entries.select(key, F.col("match_type").alias("status"), F.col("fuel_match").alias("fuel_ok"), F.col("status_match").alias("status_ok"), F.when(F.col("match_type").isin(*MATCHED), F.col("match_type").isin("exact", "fuzzy")).alias("capacity_ok"), "province_match")
    province = flags.groupBy(key).agg(F.avg(F.col("province_match").cast("double")).alias("province_accuracy"))
    return match_metrics(flags, key).join(province, key)


def forced_mismatches(matches: DataFrame, reference: DataFrame, system: DataFrame, key: str) -> DataFrame:
    """The pairs that the match had to force, from what ``matched_names`` returns: both names, the score to a tenth, the
    capacities' difference, and whether the pair is a hard case (HARD alike or more) or clear."""
    forced = matches.where("status = 'mismatched'")
    pick = lambda df, i, p: df.select(*([key] if p == "sys" else []), i, F.col("name").alias(f"{p}_name"), F.col("name_clean").alias(f"{p}_name_clean"), F.col("capacity").try_cast("double").alias(f"{p}_capacity"))
    out = forced.join(pick(reference, "ref_id", "ref"), "ref_id").join(pick(system, "sys_id", "sys"), [key, "sys_id"])
    verdict = F.when(F.col("score") >= HARD, "hard").otherwise("clear")
    return out.select(key, "ref_name", "sys_name", "ref_name_clean", "sys_name_clean", F.round("score", 1).alias("score"), "ref_capacity", "sys_capacity", gap_percent(F.col("ref_capacity"), F.col("sys_capacity")).alias("capacity_diff_pct"), verdict.alias("verdict"))


def best_scores(names: DataFrame, reference: DataFrame, name: str, like: str, out: str) -> DataFrame:
    """Adds ``out``: the highest partial ratio of each name to any of a reference list (0 without one)."""
    best = nearest(names, reference.select(F.col(like).alias("_like")), name, "_like").select(name, F.col("score").alias(out))
    return names.join(best, name, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def false_positive_verdict(name: Column, now: Column, folded: Column, n: Column, other: tuple[str, ...] = (), invented: tuple[str, ...] = (), holes: tuple[str, ...] = ()) -> Column:
    """Why a name was matched with nothing, by the first rule that holds: a reviewed list has it, another spelling of it is
    in the reference, the veto or a combined name kept it apart, or it is known from several runs or from few."""
    listed = lambda words: F.lit(False) if not words else F.greatest(*(F.contains(name, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(name, F.lit(words[0]))
    return (
        F.when(listed(other), "other")
        .when(listed(invented), "likely_hallucination")
        .when(listed(holes), "reference_hole")
        .when((folded >= VARIANT) & (now < ALIKE), "matcher_fail_normalization")
        .when(now >= ALIKE, "matcher_fail_lp_veto")
        .when(F.contains(name, F.lit("&")), "matcher_fail_combined_units")
        .when((n <= 2) & (folded >= BORDERLINE) & (folded < VARIANT), "statistical_borderline")
        .when((folded < BORDERLINE) & (n >= 3), "reference_hole")
        .otherwise("statistical_borderline")
    )


def false_positives(entries: DataFrame, reference: DataFrame, key: str, other: tuple[str, ...] = (), invented: tuple[str, ...] = (), holes: tuple[str, ...] = ()) -> DataFrame:
    """(clean_name, n_appearances, n_runs, now, folded, verdict) of the system's names without a partner, each clean name
    once: how near the reference's clean and folded names come, and why it stayed alone."""
    from quorumlake.operators.concordance import folded_name

    alone = entries.where("match_type = 'sys_only'").withColumn("clean_name", tx.clean_name(F.col("system_name")))
    names = alone.groupBy("clean_name").agg(F.count(F.lit(1)).alias("n_appearances"), F.count_distinct(key).alias("n_runs"), F.min("system_name").alias("_raw"))
    names = written(names.withColumn("_folded", folded_name(F.col("_raw"))), "alone")
    known = reference.select(tx.clean_name(F.col("name")).alias("clean"), folded_name(F.col("name")).alias("fold"))
    scored = best_scores(best_scores(names, known, "clean_name", "clean", "now"), known, "_folded", "fold", "folded")
    verdict = false_positive_verdict(F.col("clean_name"), F.col("now"), F.col("folded"), F.col("n_appearances"), other, invented, holes)
    return scored.withColumn("verdict", verdict).select("clean_name", "n_appearances", "n_runs", "now", "folded", "verdict")


def miss_worksheet(entries: DataFrame, key: str, best_run, reference: DataFrame, layer: DataFrame, narrative: DataFrame, text: str) -> DataFrame:
    """(name, attributes, n_runs_missed, in_layer, mentioned): what the best run misses, with how many runs miss it too,
    whether ``layer`` (name) knows it, and whether a text of ``narrative`` mentions it; most missed first."""
    from quorumlake.operators.concordance import in_list, mentioned

    missed = entries.where("match_type = 'ref_only'").select(key, F.col("reference_name").alias("name"))
    counts = missed.groupBy("name").agg(F.count(F.lit(1)).alias("n_runs_missed"), F.max((F.col(key) == F.lit(best_run)).cast("int")).alias("_best"))
    sheet = counts.where("_best = 1").drop("_best").join(reference.select("name", "fuel", "status", "capacity", "province").dropDuplicates(["name"]), "name", "left")
    sheet = mentioned(in_list(sheet, layer, "name", "name", "in_layer"), narrative, "name", text, "mentioned")
    return sheet.orderBy(F.desc("n_runs_missed"), "name")
