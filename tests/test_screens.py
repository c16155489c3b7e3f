"""Bibliographies of three forms, the sweep of the gate and conditions with their test, on hand-made rows."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from quorumlake import plans
from quorumlake.operators import extract, provenance, quality, selection, stats

PRIMARY, SECONDARY = r"(?i)\bministry\b|\bpower\s+plan\b", r"(?i)\breuters\b"


def counted(text):
    """The same counts, line by line."""
    lines = [x.strip() for x in (text or "").split("\n")]
    at = next((i for i, x in enumerate(lines) if re.match(r"#{1,4}\s+.*(?:bibliography|references)", x, re.I)), None)
    if at is None:
        return None, 0, 0
    part = [lines[at]]
    for x in lines[at + 1 :]:
        if x.startswith("#") and len(x.split()[0]) <= len(lines[at].split()[0]):
            break
        part.append(x)
    table = [x for x in part if x.startswith("|") and x.endswith("|") and not re.fullmatch(r"[\s|:\-]+", x)]
    code = lambda x: next((c.strip() for c in x.split("|") if c.strip()), "")
    found = {"table": sum(bool(re.fullmatch(r"\[?[A-Z]\d{1,3}\]?", code(x))) for x in table)}
    found["numbered"] = sum(bool(re.match(r"\d+\.\s+\*\*", x)) for x in part)
    found["bold"] = sum(bool(re.match(r"\*\*\[?[A-Z]\d{1,3}\]?", x)) for x in part)
    form = next((f for f, n in found.items() if n), None)
    primary, entry = sum(bool(re.search(PRIMARY, x)) for x in table), None
    if not primary:
        entries = []
        for x in part:
            if re.match(r"\d+\.\s+\*\*|\*\*\[?[A-Z]\d{1,3}\]?", x):
                entries.append([x])
            elif entries and x:
                entries[-1].append(x)
        primary = sum(bool(re.search(PRIMARY, " ".join(e))) for e in entries)
    return form, found.get(form, 0), primary


def test_bibliography_counts(spark):
    table = "## References\n| Code | Citation |\n|---|---|\n| [S01] | Ministry of x |\n| B2 | y |\n|  | A3 | z |\n| none | Ministry |"
    several = "x\n# Annotated bibliography\n1. **One**\nby the power\n\nplan\n2. **Two**\n## Part\n3. **Three** ministry\n# End\n4. **Four**"
    bold = "### my references\n**[S01] A** Reuters\n**B02** power\nplan of 2020\n**note** ministry"
    texts = [None, "", "no section", table, several, bold, "#### References", "##### References\n1. **x**", "# References\n##tag\n1. **a**\n#\n2. **b**", "# References\r\n1. **a** ministry\r\n"]
    rng = random.Random(5)
    pieces = ["# Bibliography", "## References", "# End", "### Sub", "#tag", "1. **a**", "22. **b** ministry", "**[S01]** c", "**B2** d", "| S1 | ministry |", "| x | y |", "|---|", "power", "plan", "", "  12.  **e**  ", "|  | [C3] |"]
    texts += ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {r["id"]: (r["form"], r["n_entries"], r["n_primary"]) for r in extract.bibliography_counts(docs, "id", "t", PRIMARY, SECONDARY).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_gate_sweep(spark):
    rows = [("a", 0.5, 0.9, 0.8), ("a", 0.4, 0.05, 0.7), ("a", None, 0.9, 0.6), ("b", 0.0, 0.9, 0.5), ("b", 0.2, 0.9, 0.4), ("c", 0.9, 0.9, None), (None, 0.9, None, 0.1)]
    runs = spark.createDataFrame(rows, "m string, x double, y double, f1 double")
    models = quality.gate_models(runs, "m", "f1", {"all": ["x", "y"], "only": ["y"]}, [0.0, 0.1])
    got = {(r["indicator_set"], r["tau"], r["m"]): (r["n_runs"], r["n_good"], r["accuracy"] and round(r["accuracy"], 6), r["disqualified"], r["floor"]) for r in models.collect()}
    assert got[("all", 0.0, "a")] == (3, 3, 0.7, False, False) and got[("all", 0.1, "a")] == (3, 2, 0.7, False, False)
    assert got[("all", 0.1, "b")] == (2, 1, 0.4, True, True) and got[("only", 0.0, "b")] == (2, 2, 0.45, False, True)
    assert got[("all", 0.0, "c")] == (1, 1, None, True, True) and got[("all", 0.0, None)] == (1, 1, 0.1, True, True)
    sweep = {(r["indicator_set"], r["tau"]): (r["n_dims"], r["n_disqualified"], r["equals_floor"]) for r in quality.gate_sweep(models).collect()}
    assert sweep[("all", 0.0)] == (2, 3, True) and sweep[("only", 0.0)] == (1, 2, False) and ("discriminating", 0.1) in sweep
    assert quality.gate_sweep(quality.gate_models(runs.limit(0), "m", "f1", {"all": ["x", "y"]}, [0.0])).count() == 0


def test_constant_ranks_have_no_correlation(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0), ("h", 1.0, 3.0), ("h", 2.0, 5.0)], "g string, x double, y double")
    assert {r["g"]: r["rho"] for r in stats.spearman(rows, "x", "y", ["g"]).collect()} == {"g": None, "h": 1.0}


def test_tested_comparison(spark):
    rows = [("m", "base", k, v) for k, v in enumerate([0.1, 0.2, 0.3, 0.2])] + [("m", "rag", k, v) for k, v in enumerate([0.5, 0.7, 0.6, 0.9])]
    rows += [("n", "base", 0, 0.5), ("n", "rag", 0, 0.4), ("n", "rag", 1, None), ("o", "base", 0, 0.5), ("p", "base", 1, 0.5), ("p", "rag", 1, 0.5), ("p", "rag", 1, 0.5), (None, "rag", 1, 0.5), ("m", "other", 9, 9.0)]
    rows += [("q", "base", 1, 1.0), ("q", "base", 2, 2.0), ("q", "rag", 1, 2.0), ("q", "rag", 2, 1.0)]
    frame = spark.createDataFrame(rows, "m string, c string, run long, f1 double").repartition(4)
    unstable = spark.createDataFrame([("m", "z"), ("y", "q")], "a string, b string")
    got = {r["m"]: r for r in selection.tested_comparison(frame, "m", "c", "f1", "run", "base", "rag", unstable).collect()}
    assert set(got) == {"m", "n", "p", "q"} and [round(got["m"][c], 6) for c in ("before", "after", "delta")] == [0.2, 0.65, 0.45]
    # of 16 sign patterns only all and none are as far from 0
    assert (got["m"]["p"], got["m"]["p_adjusted"]) == (0.125, 0.25) and got["q"]["p"] == 1.0 and got["n"]["p"] is None and got["p"]["p"] is None
    assert {m: r["unstable"] for m, r in got.items()} == {"m": True, "n": False, "p": False, "q": True}
    assert selection.tested_comparison(frame.limit(0), "m", "c", "f1", "run", "base", "rag").count() == 0
    assert frame.where(F.col("m").isNull()).count() == 1


def test_source_cell_quality(spark):
    rows = [(1, "[S01]", "S2"), (1, "S9", "—"), (1, "[S01](https://a.org/x)", "URL not verified"), (1, "Ministry", None), (2, "Ministry, p. 3", "Reuters"), (2, "S1", "no source found"), (3, "[S01]", "N/A"), (4, None, "")]
    cells = spark.createDataFrame(rows, "id long, s1 string, s2 string").repartition(3)
    bib = spark.createDataFrame([(1, "## References\n[S01] Ministry\nS2 Reuters\nagain S2 ministry"), (2, "S1 Ministry"), (4, "")], "id long, b string")
    got = {(r["id"], r["cell"]): tuple(r)[2:] for r in provenance.source_cell_quality(cells, "id", ["s1", "s2"], bib, "b", PRIMARY, SECONDARY).collect()}
    assert got[(1, "s1")] == ("key_ref", 0, 0, 4, 2, 2) and got[(1, "s2")] == ("key_ref", 2, 1, 1, 1, 0)
    assert got[(2, "s1")] == ("inline", 0, 0, 2, None, 1) and got[(2, "s2")] == ("inline", 0, 1, 1, None, 0)
    assert got[(3, "s1")] == ("key_ref", 0, 0, 1, 0, 0) and got[(4, "s1")] == ("inline", 1, 0, 0, None, 0)


def test_bibliography_lines_as_they_are(spark, tmp_path):
    """Pipes, blanks at the ends of lines and control characters in documents, against the SQL."""
    texts = ["table le|cle", "a le ", "le", "sale\x01x", "the|\nle\nle \n", "", None, "|", " le", "x\n\n le \nTHE"]
    rows = [(k * 3 + f, t) for k, t in enumerate(texts) for f in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()["bibliography_counts"]).fetchall()
    got = plans.queries()["bibliography_counts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
