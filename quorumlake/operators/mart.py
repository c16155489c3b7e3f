"""A mart of run, probe and score records as one tagged union, and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1"


def tagged(kind: str, rows: DataFrame, key: str, measures: dict) -> DataFrame:
    """(record_kind, schema_version, record_key, name, value): a record's measures as rows of one shape."""
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in measures.items()]))
    return rows.select(F.lit(kind).alias("record_kind"), F.lit(VERSION).alias("schema_version"), F.col(key).cast("string").alias("record_key"), long.alias("m")).select("record_kind", "schema_version", "record_key", "m.*")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def view(mart: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """One kind's records, a column a measure."""
    return mart.where(F.col("record_kind") == kind).groupBy("record_key").pivot("name", names).agg(F.first("value"))


def coverage_view(runs: DataFrame, coverage: DataFrame, key: list[str], n_reference: int) -> DataFrame:
    """Runs with the number of reference entities that their coverage stands for."""
    return runs.join(coverage, key, "left").withColumn("n_matched", F.round(F.col("coverage") * n_reference).cast("long"))


def annotated(value, n, reason: str = "no_rows"):
    """A value, or null and why there is none."""
    return F.struct(F.when(n > 0, value).cast("double").alias("value"), F.when(~F.coalesce(n > 0, F.lit(False)), F.lit(reason)).alias("annotation"))
