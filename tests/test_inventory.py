"""Extraction from text to canonical rows."""

from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators import extract, inventory

PIPES = "Coal\n| Plant name | Fuel | Status | Capacity (MW) |\n|---|---|---|---|\n| A | coal | operating | ~1,200 |\n| B | coal | planned | 300 |\n\nGas\n| Plant | Fuel | Stage | MW |\n|--|--|--|--|\n| C | gas | operating | 750 |\n| á | gas | operating | n/a |\n\n| x | y | z | w |\n| 1 | 2 | 3 | 4 |\n"
TEXTS = [
    (1, PIPES),
    (2, "```csv\nsep=;\nname;fuel;capacity_mwe\nA;coal;1.200\n;gas;5\nB;gas;x\n```\nno | table | here"),
    (3, "Some prose, of it, here\nname,fuel,province\nA,coal,North\nB,gas,South\n\n\nafter, the, table"),
    (4, "nothing at all"),
    (5, None),
    (6, "  "),
    (7, "| a | b | c |\n| 1 | 2 | 3 |"),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, t string").repartition(3)


def test_ingest(spark):
    rows, told = inventory.ingested(docs(spark), "id", "t")
    got = {}
    for r in rows.orderBy("id", "row_no").collect():
        got.setdefault(r["id"], []).append((r["name"], r["fuel"], r["status"], r["capacity_mwe"]))
    assert rows.columns == ["id", "row_no", *tx.CANONICAL]
    assert got == {
        1: [("A", "coal", "operating", "1200"), ("B", "coal", "planned", "300"), ("C", "gas", "operating", "750")],
        2: [("A", "coal", "", "1200"), ("B", "gas", "", "0")],
        3: [("A", "coal", "", "0"), ("B", "gas", "", "0")],
    }
    assert {r["id"]: (r["kind"], r["n_rows"], r["error"]) for r in told.collect()} == {1: ("fragments", 3, None), 2: ("fenced", 2, None), 3: ("inline", 2, None), 4: (None, 0, "no_table"), 5: (None, 0, "no_text"), 6: (None, 0, "no_text"), 7: ("pipe", 0, "no_name_column")}
    expected = spark.createDataFrame([(1, 3), (2, 5), (4, 1), (9, 1)], "id long, expected_rows long")
    parity = {r["id"]: (r["observed_rows"], r["matches"], r["error"]) for r in inventory.row_parity(expected, told, "id").collect()}
    assert parity == {1: (3, True, None), 2: (2, False, None), 4: (0, False, "no_table"), 9: (0, False, "run_not_found")}
    twice = told.where("id = 1").union(told.where("id = 1"))
    assert inventory.row_parity(expected.where("id = 1"), twice, "id").first()["error"] == "ambiguous_run"


def test_fragments(spark):
    rows = extract.pipe_table_rows(docs(spark), "id", "t")
    merged = inventory.merged_fragments(rows, "id").where("id = 1").orderBy("line_no").collect()
    # "á" folds to the name of the first row
    assert [r["cells"][0] for r in merged] == ["Plant name", "A", "B", "C"]
    fit = spark.createDataFrame([(["name", "fuel", None], ["fuel", None, "name"]), (["name", None], ["name", None])], "a array<string>, b array<string>")
    assert [r[0] for r in fit.select(inventory.headers_fit(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_inline_and_dialects(spark):
    texts = spark.createDataFrame([("a, b, c\nd, e, f\n\ng,h,i\n\n\nj,k,l",), ("text\nname;fuel;x\n1;2;3",), ("one, two",), (None,)], "t string")
    assert [r[0] for r in texts.select(inventory.inline_block(F.col("t"))).collect()] == ["a, b, c\nd, e, f\ng,h,i", "name;fuel;x\n1;2;3", None, None]
    blocks = spark.createDataFrame([("sep=;\na;b\n1,5;2",), ("a\tb\n1\t2\n\n",), ('"x, y",z\n1,2',), ("",)], "b string")
    assert [r[0] for r in blocks.select(inventory.parsed(F.col("b"))).collect()] == [[["a", "b"], ["1,5", "2"]], [["a", "b"], ["1", "2"]], [["x, y", "z"], ["1", "2"]], []]


def test_texts_are_cut_and_parsed_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cut = spark.createDataFrame(TEXTS, "id long, t string").select(inventory.inline_block(F.col("t")).alias("b"))
    assert plan(cut).count(", capacity)") == 1  # where the part starts isn't told again for each line
    rows, told = inventory.ingested(docs(spark), "id", "t")
    assert plan(rows).count("cells(") == plan(told).count("cells(") == 1
    found = plan(inventory.candidates(docs(spark), "id", "t"))
    assert found.count(", province)") == 6  # of the part that looks delimited once, and of five scores


def test_turns_and_arms(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "first"), (1, 1, "assistant", " "), (2, 0, "user", "q"), (3, 0, "user", "q")], "c long, t long, r string, x string")
    siblings = spark.createDataFrame([(2, "spare"), (4, "only"), (3, "")], "c long, s string")
    got = {r["c"]: (r["text"], r["origin"]) for r in inventory.text_of_turn(turns, "c", "t", "r", "x", siblings, "s").collect()}
    assert got == {1: ("first", "turn"), 2: ("spare", "sibling"), 3: (None, None), 4: ("only", "sibling")}
    records = spark.createDataFrame([("a", "hi", None), ("b", None, [("user", "q"), ("assistant", "x")]), ("c", "", None)], "arm string, response string, turns array<struct<role string, content string>>")
    flat = inventory.flattened(records, ["arm"]).orderBy("arm", "turn").collect()
    assert [tuple(r) for r in flat] == [("a", 0, "assistant", "hi", True), ("b", 0, "user", "q", False), ("b", 1, "assistant", "x", True)]


def test_pages_and_counters(spark):
    text = "lead\nPage 1\n# One\nab\n<!-- page 2 -->\ncd\n## Two\nef\n"
    got = inventory.paged_sections(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("section").collect()
    assert [(r["page"], r["title"], r["text"]) for r in got] == [(None, None, "lead"), (1, None, ""), (1, "One", "ab"), (2, None, "cd"), (2, "Two", "ef")]
    md = spark.createDataFrame([("# H\n| a | b |\n- x\n1. y [l](u)\nPhả Lại",)], "t string")
    counts = md.select(*[c.alias(n) for n, c in inventory.markdown_counters(F.col("t")).items()]).first()
    assert tuple(counts) == (1, 1, 2, 1, 4, 2)
    kept = spark.createDataFrame([("Phả Lại and Uong Bi",), ("none",)], "t string").select(inventory.diacritics_kept(F.col("t"), ("Phả Lại", "Uông Bí"))).collect()
    assert [r[0] for r in kept] == [0.5, None]


def test_cells_some_texts_at_a_time(spark, monkeypatch):
    """More texts than are parsed at once, nulls and empty ones among them, keep their order."""
    assert inventory.TEXTS < 100
    rows = [(k, None if k % 7 == 0 else "" if k % 7 == 1 else f"a,b\n{k},{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    for r in df.select("k", "t", inventory.parsed(df["t"]).alias("c")).collect():
        assert r["c"] == ([["a", "b"], [str(r["k"])] * 2] if r["t"] else [])
