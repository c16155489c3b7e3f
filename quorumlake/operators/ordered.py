"""Scans over ordered rows of groups of any size: ranges of rows are folded, and what is before a range is carried to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.sources.tables import written


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys``, null being equal to null; the columns of ``right`` but its keys are added."""
    own = right.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys), F.lit(True))
    return left.join(own, on, how).drop(*[f"_own_{k}" for k in keys])


class Ordered:
    """Rows in the order of ``order`` inside each group of ``keys``.

    They are dealt by ranges of (keys, order) and written, so that a group is spread over as many parts as its rows need
    and parts stay what they are. A window reaches over a part's rows of one group; what earlier (or later) parts of the
    group hold comes from one row for each part and group. Rows that are equal in keys and order lie in one part: give
    counts of equal ones, or an order without ties.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        self.rows = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")

    def _carried(self, out: str, total: Column, before: bool, local: Column, join: Column) -> Ordered:
        """Adds ``out``: ``join`` of the scan inside the part (``local``) and of ``_carry``, the parts' ``total`` on that side."""
        parts = self.rows.groupBy("_part", *self.keys).agg(total.alias("_t"))
        side = Window.partitionBy(*self.keys).orderBy("_part")
        side = side.rowsBetween(Window.unboundedPreceding, -1) if before else side.rowsBetween(1, Window.unboundedFollowing)
        carry = parts.withColumn("_carry", (F.sum if before else F.min)("_t").over(side)).drop("_t")
        new = object.__new__(Ordered)
        new.keys, new.order = self.keys, self.order
        new.rows = null_safe(self.rows.withColumn("_local", local), carry, ["_part", *self.keys]).withColumn(out, join).drop("_local", "_carry")
        return new

    def _window(self):
        return Window.partitionBy("_part", *self.keys).orderBy(*self.order)

    def sum_before(self, value: str, out: str) -> Ordered:
        """Adds the sum of ``value`` over earlier rows of the group, 0 for the first."""
        local = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1))
        return self._carried(out, F.sum(value), True, local, F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0)))

    def place(self, out: str) -> Ordered:
        """Adds the row's place in its group, from 1."""
        return self._carried(out, F.count(F.lit(1)), True, F.row_number().over(self._window()).cast("long"), F.col("_local") + F.coalesce("_carry", F.lit(0)))

    def size(self, out: str) -> Ordered:
        """Adds the number of rows of the group."""
        new = object.__new__(Ordered)
        new.keys, new.order = self.keys, self.order
        new.rows = null_safe(self.rows, self.rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(out)), self.keys)
        return new

    def least_from(self, value: str, out: str) -> Ordered:
        """Adds the least ``value`` of this and all later rows of the group."""
        # from the last row on: a frame that runs to the end is summed up anew for each row
        back = Window.partitionBy("_part", *self.keys).orderBy(*[F.desc(c) for c in self.order])
        local = F.min(value).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._carried(out, F.min(value), False, local, F.least("_local", "_carry"))

    def with_column(self, out: str, value: Column) -> Ordered:
        new = object.__new__(Ordered)
        new.keys, new.order, new.rows = self.keys, self.order, self.rows.withColumn(out, value)
        return new

    def done(self) -> DataFrame:
        return self.rows.drop("_part")


def medians(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, a median for each name): exact, null where a group has no value. Values are counted, the counts are summed up
    in order, and the one or two values are taken that hold the middle places: no group's values are gathered."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_any")).drop("_any")
    for name, value in values.items():
        counts = rows.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        placed = Ordered(counts, keys, ["_v"]).sum_before("_c", "_before").done()
        sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        held = null_safe(placed, sizes, keys)
        low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
        v = F.col("_v").cast("double")
        middle = held.where(holds(low) | holds(high)).groupBy(*keys).agg(((F.min(v) + F.max(v)) / 2).alias(name))
        out = null_safe(out, middle, keys, "left")
    return out
