"""Provenance, selection and comparison operators on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from quorumlake.operators import mart, provenance, selection


def test_levels_of_names(spark):
    rows = spark.createDataFrame([("Vinh Tan 1 & 2", "unit"), ("Vinh Tan", "plant"), ("Vinh Tan 2", "unit"), ("Vinh Tan Unit 2", "unit"), ("Vinh Tan 2", "plant"), ("", "unit"), ("A 1", "unknown"), ("Site", "complex")], "n string, l string")
    got = [r[0] for r in rows.select(provenance.level_consistent(F.col("n"), F.col("l"))).collect()]
    assert got == [False, False, False, True, True, None, None, True]


def test_wiki_names(spark):
    text = "x\n{| class=w\n! Name !! MW\n|-\n| [[Pha Lai|Phả Lại]] || 440\n|- style=x\n| align=left | ''Uong Bi'' || 300\n|}\n{|\n|-\n| other\n|}"
    got = provenance.wiki_names(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, t string"), "id", "t")
    assert [r["name"] for r in got.orderBy("row_no").collect()] == ["Phả Lại", "Uong Bi"]


def test_links_and_keys(spark):
    cells = spark.createDataFrame([(1, "see [2] and [1]", "1"), (1, "nothing", "7"), (2, "[1]", "1")], "id long, cell string, code string")
    entries = spark.createDataFrame([(1, 1, "A https://a.org/x"), (1, 2, "B https://b.org")], "id long, number int, entry string")
    got = provenance.linked_cells(cells, "id", "cell", entries)
    assert {(r["id"], r["cell"]): r["links"] for r in got.collect()} == {(1, "see [2] and [1]"): ["https://a.org/x", "https://b.org"], (1, "nothing"): [], (2, "[1]"): []}
    keys = provenance.resolved_keys(cells, "id", "code", entries.withColumn("code", F.col("number").cast("string")), "code")
    assert {(r["id"], r["code"]): r["resolved"] for r in keys.collect()} == {(1, "1"): True, (1, "7"): False, (2, "1"): False}


def test_citations(spark):
    citations = spark.createDataFrame([("PDP 8 annex (2023) p. 12",), ("Something else",)], "c string")
    files = spark.createDataFrame([("annex_pdp_8.md",), ("evn_report.md",)], "f string")
    assert [(r["c"], r["f"]) for r in provenance.citation_files(citations, files, "c", "f").collect()] == [("PDP 8 annex (2023) p. 12", "annex_pdp_8.md")]


def test_json_and_notes(spark):
    replies = spark.createDataFrame([('```json\n[{"k": 1}]\n```',), ('Here: [{"k": 2}, {"k": 3}] done',), ("no",)], "t string")
    assert [None if r[0] is None else [x["k"] for x in r[0]] for r in replies.select(provenance.json_array(F.col("t"), "struct<k: bigint>")).collect()] == [[1], [2, 3], None]
    notes = spark.createDataFrame([("Capacity uncertain",), ("fine",), (None,)], "n string")
    assert [r[0] for r in notes.select(provenance.honest(F.col("n"))).collect()] == [True, False, False]


def test_balanced_subset(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, method string")
    have = [(m, x) for m in "abc" for x in ("p", "q")] + [("d", "p"), ("e", "r"), (None, "q"), ("a", None), ("a", "p")]
    assert [tuple(r) for r in selection.balanced_subset(make(have), "model", "method").collect()] == [(["p", "q"], 2, 3, 6)]
    rng = random.Random(2)
    for _ in range(2):
        rows = [(f"m{k}", f"x{j:02}") for k in range(30) for j in range(9) if rng.random() < rng.choice([0.3, 0.8])]
        of = {m: {x for y, x in rows if y == m} for m, _ in rows}
        names, best = sorted({x for _, x in rows}), []
        for size in range(1, 10):
            for chosen in itertools.combinations(names, size):
                n = sum(s >= set(chosen) for s in of.values())
                best.append((-n * size, -size, list(chosen), n))
        s, size, chosen, n = min(best)
        assert [tuple(r) for r in selection.balanced_subset(make(rows), "model", "method").collect()] == [(chosen, -size, n, -s)]
    wide = make([(f"m{k}", f"y{j:02}") for k in range(3) for j in range(20) if j < 2 or j % 3 == k])  # more than 16 methods
    assert [tuple(r) for r in selection.balanced_subset(wide, "model", "method").collect()] == [([f"y{j:02}" for j in range(20) if j < 2 or j % 3 == 2], 8, 1, 8)]
    assert selection.balanced_subset(make([]), "model", "method").count() == 0



def test_selection(spark):
    models = spark.createDataFrame([("f1", "frontier", "us", 0.9, 5.0), ("f2", "frontier", "us", 0.8, 1.0), ("f3", "frontier", "cn", 0.7, 2.0), ("f4", "frontier", "cn", 0.2, 0.1), ("l1", "local", "fr", 0.5, 0.0)], "name string, kind string, country string, score double, cost double")
    got = {(r["name"], r["tier"]) for r in selection.frontier_and_local(models, "kind", "country", "score", "cost", "name", 3).collect()}
    assert got == {("f1", "best_of_country"), ("f3", "best_of_country"), ("l1", "local"), ("f2", "cheap_frontier")}
    units = spark.createDataFrame([("p", None, "a", "1", 5), ("p", None, "a", "2", 6), ("p", "x", "a", "1", 7), ("p", "x", "zz", "", 8)], "k string, t string, n string, ph string, c long")
    rolled = selection.rollup_with_phases(units, ["k", "t"], "n", "ph", "^a", "c")
    assert {(r["t"], r["capacity"], r["n_units"]) for r in rolled.collect()} == {(None, 11, 2), ("x", 7, 1), ("x", 8, 1)}


def test_normal_scores(spark):
    rows = spark.createDataFrame([(0.975,), (0.5,), (0.025,)], "p double")
    z = [r[0] for r in rows.select(selection.normal_quantile(F.col("p"))).collect()]
    assert abs(z[0] - 1.95996) < 1e-3 and abs(z[1]) < 1e-3 and abs(z[0] + z[2]) < 1e-9


def test_mart(spark):
    runs = spark.createDataFrame([(1, 0.5), (2, None)], "id long, v double")
    records = mart.union(mart.tagged("run", runs, "id", {"v": F.col("v")}), mart.tagged("probe", runs, "id", {"w": F.col("v") * 2, "one": F.lit(1)}))
    assert sorted((r["record_key"], r["w"], r["one"]) for r in mart.view(records, "probe", ["w", "one"]).collect()) == [("1", 1.0, 1.0), ("2", None, 1.0)]
    assert runs.select(mart.annotated(F.col("v"), F.lit(0)).alias("a")).first()["a"]["annotation"] == "no_rows"
