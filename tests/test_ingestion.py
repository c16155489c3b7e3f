"""Declared runs against their reports: every kind of error, and the rows to blame."""

from quorumlake.operators import ingestion

TABLE = "text\n\n| Name | Fuel |\n|---|---|\n| A | coal |\n| B | gas |\n|  | gas |\n"


def test_run_parity(spark):
    reports = [("ok.md", TABLE.encode()), ("latin.md", TABLE.encode() + b"\xe9"), ("plain.md", b"no table"), ("null.md", None), ("other.md", b"| Qty | Rank |\n|---|---|\n| 1 | 2 |\n"), ("two.md", TABLE.replace("\n", "\r\n").encode())]
    counts = ingestion.report_counts(spark.createDataFrame(reports, "file string, content binary").repartition(3), "file", "content")
    assert {r["file"]: (r["n_rows"], r["error"]) for r in counts.collect()} == {
        "ok.md": (2, None), "latin.md": (None, "invalid_encoding"), "plain.md": (None, "no_table"), "null.md": (None, "no_table"), "other.md": (None, "parse_failed"), "two.md": (2, None),
    }
    files = ["ok.md", "latin.md", "plain.md", "gone.md", "other.md"]
    runs = spark.createDataFrame([("a", "m", k, f) for k, f in enumerate(files)] + [("a", "m", 9, "ok.md"), ("a", "m", 9, "two.md"), (None, None, None, "x.md")], "arm string, model string, run_no long, file string")
    rows = [("a", "m", "0", "2"), ("a", "m", " +0 ", "3"), ("a", "m", "1", "2"), ("a", "m", "2", "2"), ("a", "m", "3", "2"), ("a", "m", "4", "2"), ("a", "m", "9", "2"), ("a", "m", "7", "2")]
    rows += [("z", "m", "0", "2"), ("a", None, "", "2"), ("a", "m", "one", "2"), ("a", "m", "0", "2.5"), ("a", "m", "0", "1__0"), ("a", "m", "0", "2")]
    parity = ingestion.run_parity(spark.createDataFrame(rows, "arm string, model string, run string, inventory_rows string"), runs, counts, ["a", "b"])
    got = sorted((str(r["run"]), str(r["inventory_rows"]), r["observed_rows"], r["matches"], r["error"], r["detail"]) for r in parity.collect() if r["arm"] == "a")
    assert got == sorted([
        ("0", "2", 2, True, None, None), ("0", "2", 2, True, None, None), (" +0 ", "3", 2, False, None, None),
        ("1", "2", None, False, "invalid_encoding", "latin.md"), ("2", "2", None, False, "no_table", "plain.md"), ("3", "2", None, False, "missing_markdown", "gone.md"),
        ("4", "2", None, False, "parse_failed", "other.md"), ("9", "2", None, False, "ambiguous_run", "2 files: ok.md to two.md"), ("7", "2", None, False, "run_not_found", "no run a m 7"),
        ("", "2", None, False, "invalid_parity_row", "missing model, run"), ("one", "2", None, False, "invalid_parity_row", "run one"),
        ("0", "2.5", None, False, "invalid_parity_row", "inventory_rows 2.5"), ("0", "1__0", None, False, "invalid_parity_row", "inventory_rows 1__0"),
    ])
    bad = ingestion.quarantined(parity)
    assert bad.count() == 11 and {r["error"] for r in bad.collect()} == set(ingestion.KINDS)
    assert ingestion.run_parity(spark.createDataFrame(rows[:0], "arm string, model string, run string, inventory_rows string"), runs.limit(0), counts, ["a"]).count() == 0
