"""Choosing models, comparing conditions, normality and growth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.ordered import Ordered, medians
from quorumlake.operators.resampling import paired_test
from quorumlake.operators.stats import bh_adjusted
from quorumlake.sources.tables import written

# Assumption thresholds; Abramowitz and Stegun 26.2.23.
W_LEAST, LEVENE_MOST, UNSTABLE = 0.9, 2.0, 0.05
#: Models of a block, and pairs of blocks of a task.
BLOCK, TILES = 512, 16
AS_C, AS_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def frontier_and_local(models: DataFrame, kind: str, country: str, score: str, cost: str, name: str, n: int) -> DataFrame:
    """The best frontier model of each country, all local ones, and the ``n`` cheapest frontier ones that beat them."""
    frontier, local = models.where(F.col(kind) == "frontier"), models.where(F.col(kind) == "local")
    rank = F.row_number().over(Window.partitionBy(country).orderBy(F.desc(score), name))
    best = frontier.withColumn("_rn", rank).where("_rn = 1").select(name, F.lit("best_of_country").alias("tier"))
    top = local.agg(F.max(score).alias("_top"))
    cheap = frontier.join(best.select(name), name, "left_anti").join(F.broadcast(top)).where(F.col(score) > F.coalesce("_top", F.lit(float("-inf")))).orderBy(cost, name).limit(n)
    return best.union(local.select(name, F.lit("local"))).union(cheap.select(name, F.lit("cheap_frontier")))


def comparison(rows: DataFrame, model: str, condition: str, value: str, a: str, b: str) -> DataFrame:
    """Medians of models that have both conditions, and their difference."""
    of = lambda c: F.when(F.col(condition) == c, F.col(value))
    per = rows.groupBy(model).agg(F.median(of(a)).alias("before"), F.median(of(b)).alias("after"), F.count(of(a)).alias("n_before"), F.count(of(b)).alias("n_after"))
    return per.where("n_before > 0 and n_after > 0").withColumn("delta", F.col("after") - F.col("before"))


def tested_comparison(rows: DataFrame, model: str, condition: str, value: str, order: str, a: str, b: str, unstable: DataFrame | None = None) -> DataFrame:
    """(model, before, after, delta, n_before, n_after, p, p_adjusted, unstable) of models that have both conditions.

    Medians and their difference; the paired sign-flip test of runs in ``order``, first with first, for models with equally
    many of both, more than one (p is null for others); p adjusted over all models that have one (Benjamini-Hochberg); and
    whether the model is in one of the ``unstable`` pairs (a, b). Rows without a value, and null models, are left out; rows of
    equal order pair by value.
    """
    known = rows.where(F.col(value).isNotNull() & F.col(model).isNotNull()).select(model, F.when(F.col(condition) == a, "before").when(F.col(condition) == b, "after").alias("_c"), F.col(value).cast("double").alias("_v"), F.col(order).alias("_o")).where("_c is not null")
    placed = written(Ordered(known.withColumn("_id", F.monotonically_increasing_id()), [model, "_c"], ["_o", "_v", "_id"]).place("_i").done(), "placed")
    middle = medians(placed, [model], {c: F.when(F.col("_c") == c, F.col("_v")) for c in ("before", "after")})
    size = lambda c: F.count_if(F.col("_c") == c)
    sizes = placed.groupBy(model).agg(size("before").alias("n_before"), size("after").alias("n_after")).where("n_before > 0 and n_after > 0")
    even = sizes.where("n_before = n_after and n_before > 1").select(model)
    of = lambda c: placed.where(F.col("_c") == c).select(model, "_i", F.col("_v").alias(c))
    pairs = of("before").join(of("after"), [model, "_i"]).join(even, model, "left_semi").select(model, (F.col("after") - F.col("before")).alias("_d"))
    p = paired_test(pairs, model, "_d").select(model, "p", F.lit(1).alias("_family"))
    adjusted = bh_adjusted(p, "p", ["_family"], model).select(model, "p", "p_adjusted")
    out = sizes.join(middle, model).join(adjusted, model, "left").withColumn("delta", F.col("after") - F.col("before"))
    if unstable is None:
        return out.withColumn("unstable", F.lit(False)).select(model, "before", "after", "delta", "n_before", "n_after", "p", "p_adjusted", "unstable")
    flagged = unstable.select(F.explode(F.array("a", "b")).alias(model)).distinct().withColumn("unstable", F.lit(True))
    out = out.join(flagged, model, "left").withColumn("unstable", F.coalesce("unstable", F.lit(False)))
    return out.select(model, "before", "after", "delta", "n_before", "n_after", "p", "p_adjusted", "unstable")


def unstable_pairs(intervals: DataFrame, model: str) -> DataFrame:
    """Pairs of models (mean, low, high) whose means differ by less than UNSTABLE and whose intervals overlap.

    Their number is quadratic by nature where means are dense. Models are cut into blocks of BLOCK by mean; pairs of blocks
    that may hold such a pair are dealt to tasks, whose number grows with that of the pairs of blocks.
    """
    rows = intervals.select(F.col(model).alias("id"), "mean", "low", "high").where("mean is not null")
    placed = Ordered(rows.withColumn("_id", F.monotonically_increasing_id()), [], ["mean", "_id"]).place("_k").done()
    placed = written(placed.withColumn("_block", F.floor((F.col("_k") - 1) / BLOCK)).drop("_k", "_id"), "intervals")
    ends = {"_least": F.min("mean"), "_most": F.max("mean"), "_low": F.min("low"), "_high": F.max("high")}
    blocks = placed.groupBy("_block").agg(*(v.alias(c) for c, v in ends.items()))
    of = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    # blocks are in order of their means, so that each pair of them meets once, the earlier first
    near = (F.col("x_block") <= F.col("y_block")) & (F.col("y_least") - F.col("x_most") < UNSTABLE) & (F.col("x_low") <= F.col("y_high")) & (F.col("y_low") <= F.col("x_high"))
    tiles = written(of(blocks, "x").join(of(blocks, "y"), near).select("x_block", "y_block", F.monotonically_increasing_id().alias("_tile")), "tiles")
    parts = max(tiles.count() // TILES, 4 * intervals.sparkSession.sparkContext.defaultParallelism)
    side = lambda p: of(placed, p).join(tiles.select("_tile", f"{p}_block"), f"{p}_block").repartition(parts, "_tile")
    met = side("x").join(side("y").drop("x_block"), "_tile").where(f"xid <> yid and (x_block < y_block or xid < yid) and abs(xmean - ymean) < {UNSTABLE} and xlow <= yhigh and ylow <= xhigh")
    return met.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b"), F.abs(F.col("xmean") - F.col("ymean")).alias("difference"))


def normal_quantile(p: Column) -> Column:
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    top = AS_C[0] + t * (AS_C[1] + t * AS_C[2])
    z = t - top / (1 + t * (AS_D[0] + t * (AS_D[1] + t * AS_D[2])))
    return F.when(p < 0.5, -z).otherwise(z)


def approximate_w(rows: DataFrame, key: str, value: str, ident: str) -> DataFrame:
    """Squared correlation of ordered values and Blom's normal scores, by key: near 1 for normal samples."""
    placed = Ordered(rows.select(key, value, ident), [key], [value, ident]).place("_k").size("_n").done()
    scored = placed.withColumn("_p", (F.col("_k") - 0.375) / (F.col("_n") + 0.25))
    r = F.corr(value, normal_quantile(F.col("_p")))
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.stddev_pop(value) > 0, r * r).alias("w"))


def assumptions(w: Column, levene: Column) -> Column:
    return F.when(w <= W_LEAST, "not_normal").when(levene >= LEVENE_MOST, "unequal_variance").otherwise("ok")


def token_projection(turns: DataFrame, key: str, turn: str, tokens: str, upto: int) -> DataFrame:
    """Tokens after ``upto`` turns if the mean growth from turn to turn goes on."""
    w = Window.partitionBy(key).orderBy(turn)
    steps = turns.withColumn("_d", F.col(tokens) - F.lag(tokens).over(w))
    per = steps.groupBy(key).agg(F.max_by(tokens, turn).alias("last"), F.max(turn).alias("last_turn"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("growth"))
    more = F.greatest(F.lit(upto) - F.col("last_turn") - 1, F.lit(0))
    return per.withColumn("projected", F.col("last") + more * F.col("growth"))


def balanced_subset(have: DataFrame, model: str, method: str, least: int = 1) -> DataFrame:
    """(methods, n_methods, n_models, score): the set of methods with most models that have all of it times methods, of every
    set that ``least`` models share; of equals the one of more methods, then the first by name. Empty without rows.

    Models are counted by the methods that they have, so that many equal ones are one row. Sets grow by one later method at
    a time, from those patterns that hold them; a set stays only while its models times the methods of its longest pattern
    could beat the best score yet, a bound that no larger set exceeds. Only the best score of a round reaches the driver.
    """
    known = have.where(F.col(model).isNotNull() & F.col(method).isNotNull()).select(F.col(model).alias("_m"), F.col(method).alias("_x")).distinct()
    patterns = known.groupBy("_m").agg(F.array_sort(F.collect_list("_x")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    patterns = written(patterns, "patterns")
    # a set's place in a pattern is that of its last method: later ones may follow
    open_ = patterns.select("pattern", "n", F.posexplode("pattern").alias("last", "x")).select("pattern", "n", "last", F.array("x").alias("methods"))
    found, best, size = [], 0, 1
    while True:
        sums = open_.groupBy("methods").agg(F.sum("n").alias("n_models"), F.max(F.size("pattern")).alias("longest")).where(F.col("n_models") >= least)
        sums = written(sums, "method-sets")
        top = sums.agg(F.max("n_models")).first()[0]
        if top is None:
            break
        best = max(best, top * size)
        found.append(sums.select("methods", F.lit(size).cast("long").alias("n_methods"), "n_models", (F.col("n_models") * size).alias("score")).where(F.col("score") >= best))
        kept = sums.where((F.col("n_models") * F.col("longest") >= best) & (F.col("longest") > size)).select("methods")
        held = open_.join(kept, "methods").select("pattern", "n", "methods", "last")
        more = F.slice("pattern", F.col("last") + 2, F.size("pattern"))
        grown = held.select("*", F.posexplode(more).alias("step", "x"))
        open_ = written(grown.select("pattern", "n", (F.col("last") + 1 + F.col("step")).alias("last"), F.concat("methods", F.array("x")).alias("methods")), "grown")
        size += 1
    if not found:
        return patterns.limit(0).select(F.col("pattern").alias("methods"), F.lit(0).cast("long").alias("n_methods"), F.col("n").alias("n_models"), F.col("n").alias("score"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.orderBy(F.desc("score"), F.desc("n_methods"), "methods").limit(1)


def rollup_with_phases(units: DataFrame, keys: list[str], name: str, phase: str, groupable: str, capacity: str) -> DataFrame:
    """Units of equal keys (null is a key of its own) as one row where their name is groupable, others as they are; a
    phase is part of the name."""
    named = units.withColumn(name, F.concat_ws(" ", F.col(name), F.nullif(F.trim(phase), F.lit(""))))
    fits = F.coalesce(F.col(name).rlike(groupable), F.lit(False))
    grouped = named.where(fits).groupBy(*keys).agg(F.sum(capacity).alias("capacity"), F.count(F.lit(1)).alias("n_units"), F.min(name).alias("name"))
    return grouped.unionByName(named.where(~fits).select(*keys, F.col(capacity).alias("capacity"), F.lit(1).cast("long").alias("n_units"), F.col(name).alias("name")))


def geometric_cost_ratio(a: Column, b: Column) -> Column:
    return F.exp(F.avg(F.log(a / b)))


def population_sd(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
