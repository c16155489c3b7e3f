"""Runs declared with a number of rows against their reports: what is read, what is wrong, and the rows to blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import canonical_header
from quorumlake.operators.inventory import best_block, candidates, canonical_rows, parsed
from quorumlake.sources.tables import written

# What may be wrong with a declared run, in the order in which it is found out.
KINDS = ("invalid_parity_row", "unknown_arm", "run_not_found", "ambiguous_run", "missing_markdown", "invalid_encoding", "no_table", "parse_failed")
REQUIRED = ("arm", "model", "run", "inventory_rows")


def report_counts(reports: DataFrame, file: str, content: str) -> DataFrame:
    """(file, n_rows, error) of Markdown reports (bytes): rows with a name in the best of a report's pipe tables, or
    invalid_encoding for bytes that are no UTF-8, no_table, or parse_failed for a table without rows or without a column of
    names. A null or empty report has no table. Files are told apart by name: one row for each."""
    raw = F.coalesce(F.col(content), F.lit(b"")).cast("string")
    texts = written(reports.select(file, F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "\r\n?", "\n")).alias("_text")), "report-texts")
    best = written(best_block(candidates(texts.where("_text is not null"), file, "_text").where("kind = 'pipe'"), file), "report-tables")
    shape = best.select(file, parsed(F.col("block")).alias("_cells")).select(file, F.lit(True).alias("_table"), (F.size("_cells") >= 2).alias("_rows"), F.when(F.size("_cells") > 0, F.element_at("_cells", 1)).alias("_head"))
    counts = canonical_rows(best, file).groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    told = texts.join(shape, file, "left").join(counts, file, "left")
    known = F.coalesce(F.array_contains(F.transform("_head", canonical_header), "name"), F.lit(False))
    error = F.when(F.col("_text").isNull(), "invalid_encoding").when(F.col("_table").isNull(), "no_table").when(~F.col("_rows") | ~known, "parse_failed")
    return told.select(file, F.when(error.isNull(), F.coalesce("_n", F.lit(0))).cast("long").alias("n_rows"), error.alias("error"))


def _integer(text: Column) -> Column:
    """A text as a whole number, as people write one (blanks around it, a sign, single underscores); null else."""
    return F.when(text.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$"), F.regexp_replace(text, r"[\s_]", "").try_cast("bigint"))


def run_parity(declared: DataFrame, runs: DataFrame, counts: DataFrame, arms: list[str]) -> DataFrame:
    """Declared runs (arm, model, run, inventory_rows as texts) with (run_no, expected_rows, observed_rows, matches, error,
    detail), one row for each of them, repeated ones too.

    ``runs`` are the run files there are (arm, model, run_no, file), ``counts`` those of their reports (``report_counts``:
    file, n_rows, error). ``error`` is the first of KINDS that holds, ``detail`` names what is to blame: the fields that are
    missing or are no whole number, the arm, the files in question. Rows with an error match nothing and have no
    observed rows; ``quarantined`` keeps them.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.array_sort(F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in REQUIRED])))
    run_no, expected = _integer(F.col("run")), _integer(F.col("inventory_rows"))
    odd = F.array_compact(F.array(F.when(run_no.isNull(), F.concat(F.lit("run "), "run")), F.when(expected.isNull(), F.concat(F.lit("inventory_rows "), "inventory_rows"))))
    invalid = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(F.size(odd) > 0, F.element_at(odd, 1))
    asked = declared.withColumns({"run_no": run_no, "expected_rows": expected, "_invalid": invalid})
    # a run of very many files is counted, and named by its first and last
    files = runs.join(counts, "file", "left").groupBy("arm", "model", "run_no").agg(
        F.count(F.lit(1)).alias("_n"), F.min("file").alias("_first"), F.max("file").alias("_last"), F.first("n_rows").alias("_rows"), F.first("error").alias("_error"), F.count(F.coalesce("n_rows", F.when(F.col("error").isNotNull(), 0))).alias("_reports")
    )
    found = asked.join(files, ["arm", "model", "run_no"], "left")
    error = (
        F.when(F.col("_invalid").isNotNull(), "invalid_parity_row")
        .when(~F.col("arm").isin(*arms), "unknown_arm")
        .when(F.col("_n").isNull(), "run_not_found")
        .when(F.col("_n") > 1, "ambiguous_run")
        .when(F.col("_reports") == 0, "missing_markdown")
        .otherwise(F.col("_error"))
    )
    detail = (
        F.when(error == "invalid_parity_row", F.col("_invalid"))
        .when(error == "unknown_arm", F.concat(F.lit("arm "), "arm"))
        .when(error == "run_not_found", F.concat_ws(" ", F.lit("no run"), "arm", "model", F.col("run_no").cast("string")))
        .when(error == "ambiguous_run", F.concat_ws(" ", F.col("_n").cast("string"), F.lit("files:"), "_first", F.lit("to"), "_last"))
        .when(error.isNotNull(), F.col("_first"))
    )
    told = found.withColumns({"error": error, "detail": detail}).withColumn("observed_rows", F.when(F.col("error").isNull(), F.col("_rows")))
    return told.select(*declared.columns, "run_no", "expected_rows", "observed_rows", F.coalesce(F.col("observed_rows") == F.col("expected_rows"), F.lit(False)).alias("matches"), "error", "detail")


def quarantined(parity: DataFrame) -> DataFrame:
    """Declared rows that could not be checked, with what is wrong and what is to blame."""
    return parity.where("error is not null")
