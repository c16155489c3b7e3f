"""Orders, samples, set operations and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.ordered import Ordered

TOLERANCE = 1e-3
#: Parts of a stratum that are ranked apart.
SPREAD = 64


def stratified_sample(rows: DataFrame, stratum: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum in the order of a seeded hash. Each of SPREAD parts of a stratum names its first ``n``,
    and these are ranked, so that no task ranks a whole stratum."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(SPREAD)))
    first = lambda df, *by: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("_h", ident))).where(F.col("_rn") <= n).drop("_rn")
    return first(first(hashed, stratum, "_part"), stratum).drop("_h", "_part")


def balanced(rows: DataFrame, cell: list[str], ident: str, seed: int = 0) -> DataFrame:
    """Every cell (of two rows or more) drawn down, by hash, to the size of the smallest."""
    least = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").agg(F.min("_c").alias("_least"))
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string"))))
    w = Window.partitionBy(*cell)
    ranked = hashed.withColumn("_rn", F.row_number().over(w.orderBy("_h", ident))).withColumn("_c", F.count(F.lit(1)).over(w)).where("_c > 1")
    return ranked.join(F.broadcast(least)).where("_rn <= _least").drop("_h", "_rn", "_c", "_least")


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string"))), ident).limit(n)


def top_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The most frequent values; equal counts in the order of a hash, so that no alphabet is favoured."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.md5(F.col(key).cast("string"))).limit(n)


def best_of_each(rows: DataFrame, group: str, score: str, ident: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), ident))).where("_rn = 1").drop("_rn")


def adjacent_deltas(rows: DataFrame, agent: str, rung: str, value: str) -> DataFrame:
    """Differences of neighbouring rungs (numbered without gaps) of an agent; a missing rung leaves its pairs out."""
    w = Window.partitionBy(agent).orderBy(rung)
    following = rows.withColumn("_next", F.lead(rung).over(w)).withColumn("_value", F.lead(value).over(w))
    return following.where(F.col("_next") == F.col(rung) + 1).select(agent, rung, (F.col("_value") - F.col(value)).alias("delta"))


def in_every(rows: DataFrame, ident: str, group: str) -> DataFrame:
    """Idents that occur in each group."""
    n = rows.select(F.count_distinct(group).alias("_all"))
    return rows.groupBy(ident).agg(F.count_distinct(group).alias("_n")).join(F.broadcast(n)).where("_n = _all").select(ident)


def parity(left: DataFrame, right: DataFrame, key: list[str], values: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(column, n_differ): rows on one side only, and values that differ by more than ``tolerance``."""
    pre = lambda df, p: df.select(*key, *[F.col(v).alias(f"{p}{v}") for v in values], F.lit(1).alias(f"{p}_in"))
    both = pre(left, "l").join(pre(right, "r"), key, "full")
    differs = lambda v: F.when(F.col("l_in").isNotNull() & F.col("r_in").isNotNull(), ~(F.col(f"l{v}").eqNullSafe(F.col(f"r{v}")) | F.coalesce(F.abs(F.col(f"l{v}") - F.col(f"r{v}")) <= tolerance, F.lit(False))))
    sums = both.agg(F.count_if(F.col("r_in").isNull()).alias("left_only"), F.count_if(F.col("l_in").isNull()).alias("right_only"), *[F.count_if(differs(v)).alias(v) for v in values])
    return sums.unpivot([], ["left_only", "right_only", *values], "column", "n_differ")


def pivoted(rows: DataFrame, index: str, column: str, names: list, value) -> DataFrame:
    return rows.groupBy(index).pivot(column, names).agg(value)


def growth(steps: DataFrame, order: str, entity: str) -> DataFrame:
    """How many distinct entities each prefix of the steps knows: entities count from their first step on."""
    first = steps.groupBy(entity).agg(F.min(order).alias(order)).groupBy(order).agg(F.count(F.lit(1)).alias("n_new"))
    return Ordered(first, [], [order]).sum_before("n_new", "_b").done().withColumn("n_known", F.col("_b") + F.col("n_new")).drop("_b")


def common(left: DataFrame, right: DataFrame, ident: str) -> DataFrame:
    """Idents of both tables, in order."""
    return left.select(ident).intersect(right.select(ident)).orderBy(ident)


def only_left(left: DataFrame, right: DataFrame, ident: str) -> DataFrame:
    """Idents of the first table that the second lacks; a null ident is one like any other."""
    return left.select(ident).subtract(right.select(ident))
