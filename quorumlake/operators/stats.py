"""Statistics on grouped rows. All relational but the incomplete beta function, which gets a row a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.distributions import binomial_tail, f_tail
from quorumlake.operators.ordered import Ordered, medians
from quorumlake.sources.tables import written


def midrank(rows: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """Rank from 1, ties sharing their mean rank, inside each group ``by``.

    Ranks come from the counts of distinct values, so a value that many rows share is one row, summed up over ranges.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = Ordered(counts, by, [value]).sum_before("_c", "_b").done().withColumn(out, F.col("_b") + (F.col("_c") + 1) / 2).drop("_c", "_b")
    return rows.join(ranks, [*by, value])


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of mid-ranks by group; null for fewer than two rows or a constant."""
    ranked = midrank(midrank(rows.select(*by, x, y), x, "_rx", by), y, "_ry", by)
    rho = F.when(F.count(F.lit(1)) > 1, F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")))
    return ranked.groupBy(*by).agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))


def stratified_gamma(rows: DataFrame, stratum: str, ident: str, x: str, y: str) -> DataFrame:
    """(concordant, discordant, gamma) over pairs inside a stratum, ties left out; 0 without pairs. Rows with a null in
    stratum, x or y pair with none.

    Rows are counted by (stratum, x, y) first. The places of a stratum's y make a binary tree of blocks: two cells of
    different y lie in sibling blocks of one level. So each cell asks, at each level, how many rows of the sibling block
    have a smaller x; those of a lower block are concordant, those of a higher one discordant. The answers are sums over
    ordered ranges; every exchange has a row for each cell and level, never one for each pair.
    """
    cells = rows.where(F.col(stratum).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = written(cells.groupBy(F.col(stratum).alias("_s"), F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(ident).alias("_n")), "cells")
    places = written(Ordered(cells.select("_s", "_y").distinct(), ["_s"], ["_y"]).place("_k").done(), "places")
    depth = max(1, ((places.agg(F.max("_k")).first()[0] or 1) - 1).bit_length())
    tree = cells.join(places, ["_s", "_y"]).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("_b", F.expr("shiftright(_k - 1, _l)"))
    held = tree.groupBy("_s", "_l", "_b", "_x").agg(F.sum("_n").alias("_w")).select("_s", "_l", "_b", "_x", F.lit(1).alias("_held"), "_w", F.lit(0).cast("long").alias("_n"))
    asks = tree.withColumn("_b", F.col("_b").bitwiseXOR(F.lit(1).cast("long"))).groupBy("_s", "_l", "_b", "_x").agg(F.sum("_n").alias("_n")).select("_s", "_l", "_b", "_x", F.lit(0).alias("_held"), F.lit(0).cast("long").alias("_w"), "_n")
    told = Ordered(held.union(asks), ["_s", "_l", "_b"], ["_x", "_held"]).sum_before("_w", "_less").done()
    lower = F.col("_b") % 2 == 0
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n") * F.col("_less"))), F.lit(0))
    out = told.agg(sums(lower).alias("concordant"), sums(~lower).alias("discordant"))
    total = F.col("concordant") + F.col("discordant")
    return out.withColumn("gamma", F.when(total > 0, (F.col("concordant") - F.col("discordant")) / total).otherwise(0.0))


def within_gap(rows: DataFrame, model: str, veto: str, value: str) -> DataFrame:
    """Mean over models with both classes of (mean of survivors - mean of vetoed)."""
    per = rows.groupBy(model).agg(F.avg(F.when(F.col(veto) == 0, F.col(value))).alias("a"), F.avg(F.when(F.col(veto) == 1, F.col(value))).alias("b"))
    return per.where("a is not null and b is not null").agg(F.avg(F.col("a") - F.col("b")).alias("gap"), F.count(F.lit(1)).alias("models"))


def bh_adjusted(tests: DataFrame, p: str, family: list[str], ident: str) -> DataFrame:
    """Benjamini-Hochberg within each family; a null p stays null."""
    known = tests.where(F.col(p).isNotNull())
    step = Ordered(known, family, [p, ident]).place("_r").size("_m").with_column("_q", F.col(p) * F.col("_m") / F.col("_r"))
    out = step.least_from("_q", "_least").done().withColumn("p_adjusted", F.least("_least", F.lit(1.0)))
    return out.drop("_r", "_m", "_q", "_least").unionByName(tests.where(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def levene(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Levene's W around means, from sums by group; null where deviations don't vary inside groups."""
    z = rows.join(rows.groupBy(group).agg(F.avg(value).alias("_m")), group).withColumn("_z", F.abs(F.col(value) - F.col("_m")))
    per = z.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("_z").alias("zbar"), F.var_pop("_z").alias("v"))
    tot = per.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("zbar")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = per.join(F.broadcast(tot)).agg(F.sum(F.col("n") * F.pow(F.col("zbar") - F.col("grand"), 2)).alias("between"), F.first("total").alias("total"), F.first("k").alias("k"), F.first("within").alias("within"))
    w = F.when(F.col("within") > 1e-12, (F.col("total") - F.col("k")) / (F.col("k") - 1) * F.col("between") / F.col("within"))
    return between.select(w.alias("w"), F.col("total").alias("n"), "k")


def two_way_anova(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(effect, ss, df, f, eta2, omega2, p) of a balanced two-way design: a, b, interaction and residual, from sums by
    cell; only the eight totals of the cells reach the driver. f, omega2 and p are null where they are not defined."""
    cells = rows.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    margin = lambda k: cells.groupBy(k).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias(f"t{k}"), F.count(F.lit(1)).alias(f"k{k}"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"))
    x = whole.join(F.broadcast(margin("_a"))).join(F.broadcast(margin("_b"))).first()
    kind = "effect string, ss double, df long, f double, eta2 double, omega2 double, p double"
    if not x["n"]:
        return rows.sparkSession.createDataFrame([], kind)
    centre = float(x["s"]) ** 2 / x["n"]
    main = float(x["t_a"]) - centre, float(x["t_b"]) - centre
    parts = {a: (main[0], x["k_a"] - 1), b: (main[1], x["k_b"] - 1)}
    parts["interaction"] = float(x["t"]) - centre - sum(main), parts[a][1] * parts[b][1]
    parts["residual"] = float(x["q"]) - float(x["t"]), x["n"] - x["k_a"] * x["k_b"]
    total, (rest, free) = sum(s for s, _ in parts.values()), parts["residual"]
    error, out = rest / free if free > 0 else 0.0, []
    for name, (ss, df) in parts.items():
        known = name != "residual" and df and error
        f = ss / df / error if known else None
        omega = max(0.0, (ss - df * error) / (total + error)) if known else None
        out.append((name, ss, int(df), f, ss / total if total else None, omega, f_tail(f, df, free) if f is not None else None))
    return rows.sparkSession.createDataFrame(out, kind)


def kappa(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Cohen's kappa of two ratings, 1 where chance agreement is certain."""
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    left, right = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("a")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("b"))
    chance = left.join(right, "v", "left").agg(F.sum(F.col("a") * F.coalesce("b", F.lit(0))).cast("double").alias("ab"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / F.col("n") / F.col("n")
    return seen.join(F.broadcast(chance)).select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def slopes(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def rank_flips(points: DataFrame, model: str, threshold: str, value: str) -> DataFrame:
    """Pairs of models whose order changes between thresholds. Pairs of models, whose list is short, by threshold."""
    x = points.select(F.col(model).alias("a"), F.col(threshold).alias("_t"), F.col(value).alias("_x"))
    y = points.select(F.col(model).alias("b"), F.col(threshold).alias("_t"), F.col(value).alias("_y"))
    signs = x.join(y, "_t").where("a < b").groupBy("a", "b").agg(F.count_distinct(F.signum(F.col("_x") - F.col("_y"))).alias("signs"))
    return signs.where("signs > 1")


def contrasts(rows: DataFrame, agent: str, docs: str, mode: str, value: str, log: bool = False) -> DataFrame:
    """(effect, mean, n_up, n): main effects and interaction of a 2x2 design, averaged over agents with all four cells, and
    how many agents have a positive one. ``log``: of the cells' logarithms, and ``ratio``, what the mean multiplies by."""
    cell = lambda d, m: F.avg(F.when((F.col(docs) == d) & (F.col(mode) == m), F.col(value)))
    per = rows.groupBy(agent).agg(cell(0, 0).alias("c00"), cell(0, 1).alias("c01"), cell(1, 0).alias("c10"), cell(1, 1).alias("c11")).na.drop()
    if log:
        per = per.select(*(F.log(c).alias(c) for c in ("c00", "c01", "c10", "c11")))
    effects = {"docs": "(c10 + c11 - c00 - c01) / 2", "mode": "(c01 + c11 - c00 - c10) / 2", "interaction": "c11 - c10 - c01 + c00"}
    each = per.select(F.explode(F.array(*[F.struct(F.lit(name).alias("effect"), F.expr(e).alias("d")) for name, e in effects.items()])).alias("e")).select("e.*")
    out = each.groupBy("effect").agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("n_up"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ratio", F.exp("mean")) if log else out


def sign_test(rows: DataFrame, agent: str, difference: str, least: int = 3) -> DataFrame:
    """Agents with ``least`` runs whose mean difference is positive, of all that differ, and the binomial tail."""
    per = rows.groupBy(agent).agg(F.avg(difference).alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    k, n = per.agg(F.count_if(F.col("d") > 0), F.count_if(F.col("d") != 0)).first()
    return rows.sparkSession.createDataFrame([(int(k), int(n), binomial_tail(k, n) if n else 1.0)], "k long, n long, p double")


def drift_gate(baseline: DataFrame, current: DataFrame, key: str, value: str, floor: float = 0.005) -> DataFrame:
    """Every key of either side with its verdict against mean +- 2 max(sd, floor), clipped to [0, 1]."""
    base = baseline.groupBy(key).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))
    now = current.groupBy(key).agg(F.avg(value).alias("now"))
    half = 2 * F.greatest("sd", F.lit(floor))
    verdict = (
        F.when(F.col("now").isNull(), "declined")
        .when(F.col("n").isNull() | (F.col("n") < 2), "skip")
        .when(F.col("now").between(F.greatest(F.col("mean") - half, F.lit(0.0)), F.least(F.col("mean") + half, F.lit(1.0))), "pass")
        .otherwise("drift")
    )
    return base.join(now, key, "full").withColumn("verdict", verdict)


def agreement(matches: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of equal values among the rows where both sides have one."""
    return matches.agg(*[F.avg((a == b).cast("double")).alias(name) for name, (a, b) in pairs.items()])


def ranking_robustness(left: DataFrame, right: DataFrame, model: str, value: str, least: int = 3) -> DataFrame:
    """(rho, n): Spearman's correlation of models' medians in two tables, over the models in both; null below ``least``."""
    median = lambda df, n: medians(df, [model], {n: F.col(value)})
    both = median(left, "_x").join(median(right, "_y"), model).withColumn("_all", F.lit(1))
    out = spearman(both, "_x", "_y", ["_all"])
    return out.select(F.when(F.col("n") >= least, F.col("rho")).alias("rho"), "n")


def stable_core(points: DataFrame, model: str, threshold: str, value: str) -> DataFrame:
    """Models that keep their order to all others at every threshold."""
    flips = rank_flips(points, model, threshold, value)
    moving = flips.select(F.col("a").alias(model)).union(flips.select("b")).distinct()
    return points.select(model).distinct().join(moving, model, "left_anti")
