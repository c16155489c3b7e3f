"""Run records, orders, sources and sinks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import fusion, records, selection
from quorumlake.functions import text as tx
from quorumlake.operators import extract, mart
from quorumlake.sources import tables


def test_measurements(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(
        '{"run_id":"r1","method":"rag","method_params":{"model":"m","prompt_version":"v1","extra":{"seed":"3","no_think":"true","finish_reason":"stop"}},"result_summary":{"tp":3,"fp":1,"fn":0,"f1":0.9},"resource_use":{"cost_usd":0.5},"citations":["a","b"]}\n'
        '{"run_id":"r2","method":"direct","method_params":{"model":"n"},"result_summary":{},"resource_use":{},"finish_reason":"length","result_file":"x/y.z.json"}\n'
    )
    raw = tables.read_records(spark, str(tmp_path / "r.jsonl"), records.SCHEMA)
    a, b = records.measurements(raw).orderBy("label").collect()
    assert (a["label"], a["coverage"], a["precision"], a["f1"], a["seed"], a["no_think"], a["finish_reason"], a["n_citations"], a["n_web_search_calls"]) == ("v1/r1", 1.0, 0.75, 0.9, "3", True, "stop", 2, None)
    assert (b["label"], b["coverage"], b["precision"], b["f1"], b["n_matched"], b["finish_reason"], b["cost_usd"]) == ("y.z", 0.0, 0.0, 0.0, 0, "length", None)
    assert records.measurements(raw, "rag").count() == 1


def test_paths_and_labels(spark):
    one = lambda c, *x: [r[0] for r in spark.createDataFrame([(v,) for v in x], "p string").select(c).collect()]
    p = F.col("p")
    assert one(records.renamed_paths(p, {"census": "direct", "rag_old": "rag"}), "a/census/x", "census", "censusx/y", "rag_old/1") == ["a/direct/x", "direct", "censusx/y", "rag/1"]
    assert one(records.renamed_values(p, {"census": "direct"}), "census", "rag", None) == ["direct", "rag", None]
    assert one(records.cohort(p, {"top/": "topup", "b": "batch"}), "top/1", "batch", "x") == ["topup", "batch", "base"]
    assert one(tx.without_provider(p), "a/b", "c") == ["b", "c"] and one(tx.without_run(p), "m-run12", "m-runx") == ["m", "m-runx"]
    assert one(records.polarity(p.cast("int")), "0", "1") == [1, 0]


def test_loading(spark):
    rows = spark.createDataFrame([("a/b/1",), ("a/bc/1",), ("a/b",), ("a/b/2_synthetic",)], "p string")
    assert sorted(r["p"] for r in records.under(rows, "p", "a/b", ("_synthetic",)).collect()) == ["a/b", "a/b/1"]
    with pytest.raises(ValueError, match="nothing is selected"):
        records.under(rows, "p", "z")
    joined = records.assembled(spark.createDataFrame([("b", 1), ("a", 2)], "k string, v int"), spark.createDataFrame([("a", "ok"), ("a", "ok")], "k string, s string"), "k").collect()
    assert [tuple(r) for r in joined] == [("a", 2, "ok"), ("b", 1, None)]


def test_corroboration(spark):
    arms = spark.createDataFrame([("doc", 1, None, None, 0, False), ("doc", 2, None, None, 0, True), ("free", 1, 0.5, 0.25, 8, None)], "arm string, run int, coverage double, rate double, n_rows int, parse_failed boolean")
    matched, quality = spark.createDataFrame([("doc", 1, 7)], "arm string, run int, n_matched long"), spark.createDataFrame([("doc", 1, 5), ("doc", 2, 1)], "arm string, run int, n_supported long")
    got = records.corroboration(arms, matched, quality, ["arm", "run"], 10, ["doc"], "arm")
    assert sorted(tuple(r) for r in got.collect()) == [("doc", 1, 7, 5), ("free", 1, 5, 2)]


def test_orders(spark):
    layers = spark.createDataFrame([("b", 1, 1), ("a", 1, 1), ("c", 0, 0)], "k string, x int, y int")
    assert [r["k"] for r in records.visibility(layers, ["x", "y"], "k").collect()] == ["a", "b", "c"]
    plants = spark.createDataFrame([("a", "planned", 5.0), ("b", "operational", None), ("c", "operational", 7.0), ("d", "odd", 9.0)], "n string, s string, c double")
    assert [r["n"] for r in records.entity_order(plants, "s", "c", "n", {"operational": 0, "planned": 1}).collect()] == ["c", "b", "a", "d"]


def test_sweep_without_confidence(spark):
    runs = spark.createDataFrame([(1, "m", 1.0), (2, "m", 2.0), (3, "n", 9.0)], "run int, model string, cost double")
    said = spark.createDataFrame([(1, "x", None), (2, "x", None), (2, "y", " ")], "run int, entity string, confidence string")
    chosen = fusion.model_pools(runs, "model", "run", "cost", [2, 3])
    assert sorted((r["size"], r["rule"], r["run"]) for r in chosen.collect()) == [(2, "cross_model_high", 1), (2, "cross_model_high", 3), (2, "cross_model_low", 1), (2, "cross_model_low", 3), (2, "cross_model_mixed", 1), (2, "cross_model_mixed", 3), (2, "intra_model", 1), (2, "intra_model", 2)]
    got = {(r["rule"], r["merge"]): r for r in fusion.aggregation_sweep(said, chosen, spark.createDataFrame([("x",), ("z",)], "entity string"), "run", "entity", "confidence", runs, "cost").collect()}
    assert len(got) == 16 and {m: r["n_pools"] for (rule, m), r in got.items() if rule == "intra_model"} == {"union": 1, "majority_2": 1, "majority_3": 1, "confidence_weighted": 0}
    best, none = got["intra_model", "majority_2"], got["intra_model", "confidence_weighted"]
    assert (best["recall"], best["precision"], best["n_entities"], best["cost"], none["recall"]) == (0.5, 1.0, 1.0, 3.0, None)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"one\r\ntwo")
    (tmp_path / "b.md").write_bytes(b"bad \xff end")
    texts = tables.read_texts(spark, str(tmp_path / "*.md"))
    assert {r["file"]: r["text"] for r in texts.collect()} == {"a.md": "one\ntwo", "b.md": "bad � end"}
    assert {r["file"]: r["text"] for r in tables.read_texts(spark, str(tmp_path / "*.md"), strict=True).collect()} == {"a.md": "one\ntwo", "b.md": None}
    assert tables.corpus(texts, "|").first()["text"] == "one\ntwo|bad � end"
    assert sorted(r["file"] for r in tables.without(texts, "file", ("a",), (".txt",)).collect()) == ["b.md"]
    with pytest.raises(Exception, match="not a path inside"):
        tables.artifact_paths(spark.createDataFrame([("../x",)], "p string"), "p").collect()
    assert tables.artifact_paths(spark.createDataFrame([("a/b..c",)], "p string"), "p").count() == 1
    (tmp_path / "reply.json").write_text('{"response": "hi", "finish_reason": "stop"}')
    assert tables.read_replies(spark, str(tmp_path / "*.json")).first()["response"] == "hi"


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    tables.write_csv(df, str(tmp_path / "out"), ["k"])
    tables.append_csv(df.limit(1), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    assert tables.has_column(spark, str(tmp_path / "out"), "v") and not tables.has_column(spark, str(tmp_path / "out"), "w")
    tables.write_mart(mart.tagged("run", df, "k", {"k2": F.col("k")}), str(tmp_path / "mart"))
    assert mart.view(spark.read.parquet(str(tmp_path / "mart")), "run", ["k2"]).count() == 2
    got = tables.named_rows(spark.createDataFrame([(" A ", "coal "), ("", "coal"), ("B", "solar")], "name string, fuel string"), "name", "fuel", ["coal"]).collect()
    assert [r["name"] for r in got] == ["A"]


def test_sheets_and_settings(spark, tmp_path):
    row = lambda *cells: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" for c in cells) + "</table:table-row>"
    body = row("title") + row("Name", "Cap", "Note") + row("A", "5", "") + '<table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row>' + row("B", "7", "x")
    xml = f'<o xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><table:table table:name="other">{row("z")}</table:table><table:table table:name="Plants">{body}</table:table></o>'
    with zipfile.ZipFile(tmp_path / "f.ods", "w") as z:
        z.writestr("content.xml", xml)
    got = tables.read_ods(spark, str(tmp_path / "f.ods"), "Plants", {"Name": "name", "Note": "note"}, 1).orderBy("row_no").collect()
    assert [(r["name"], r["note"]) for r in got] == [("A", None), ("B", "x")]
    with pytest.raises(Exception, match="not in the sheet: Nope"):
        tables.read_ods(spark, str(tmp_path / "f.ods"), "Plants", {"Nope": "x"}, 1).collect()
    far = '<table:table-cell table:number-columns-repeated="1500"/><table:table-cell><text:p>{}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="9000"/></table:table-row>'
    wide = row("Name")[: -len("</table:table-row>")] + far.format("Far") + '<table:table-row table:number-rows-repeated="70000"><table:table-cell/></table:table-row>' + row("C")[: -len("</table:table-row>")] + far.format("y")
    with zipfile.ZipFile(tmp_path / "g.ods", "w") as z:
        z.writestr("content.xml", xml.replace(body, wide + '<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'))
    got = tables.read_ods(spark, str(tmp_path / "g.ods"), "Plants", {"Name": "name", "Far": "far"}).collect()
    assert [(r["row_no"], r["name"], r["far"]) for r in got] == [(70001, "C", "y")]  # repeats of any number keep their places
    (tmp_path / "c.toml").write_text('[models.a]\nprice = 1.5\nname = "A"\n[models.b]\ntags = ["x"]\n')
    table = tables.config_table(spark, tables.read_config(str(tmp_path / "c.toml"))["models"], "slug").orderBy("slug").collect()
    assert [tuple(r) for r in table] == [("a", "A", "1.5", None), ("b", None, None, '["x"]')]


def test_small_remains(spark):
    flags = spark.createDataFrame([(0.8, 1.0), (0.95, 3.0), (0.95, 1.0)], "w double, l double").select(selection.assumptions(F.col("w"), F.col("l"))).collect()
    assert [r[0] for r in flags] == ["not_normal", "unequal_variance", "ok"]
    ratio = spark.createDataFrame([(2.0, 1.0), (8.0, 1.0)], "a double, b double").agg(selection.geometric_cost_ratio(F.col("a"), F.col("b"))).first()[0]
    assert abs(ratio - 4.0) < 1e-9 and selection.population_sd([1.0, 3.0]) == 1.0
    cells = spark.createDataFrame([(1, "https://a.org", ""), (1, "Not found", "x"), (1, None, "[3]")], "id int, s1 string, s2 string")
    got = {r["cell"]: tuple(r)[2:] for r in extract.source_cells(cells, "id", ["s1", "s2"]).collect()}
    assert got == {"s1": (1, 1, 1, 1), "s2": (1, 0, 2, 0)}
    codes = spark.createDataFrame([(1, "[3]"), (1, "S4"), (1, ""), (2, "free text"), (3, None)], "id int, c string")
    assert {r["id"]: r["style"] for r in extract.citation_style(codes, "id", "c").collect()} == {1: "key_ref", 2: "free", 3: "free"}


def test_repeatable_mart(spark, tmp_path):
    path, schema = str(tmp_path / "mart"), "k long, v double, record_kind string"
    batches = [[(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (3, 3.0, "b")], [(2, 5.0, "b"), (4, 4.0, "c")], [(4, 6.0, "b")], [(1, None, "a")]]
    held = {}
    for batch in batches:
        for _ in range(2):  # each batch comes twice
            tables.merge_mart(spark.createDataFrame(batch, schema), path, ["k"])
        held |= {r[0]: r for r in batch}
        assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "record_kind").collect())) == sorted(held.values())
    assert sorted(p.name for p in (tmp_path / "mart").glob("record_kind=*")) == ["record_kind=a", "record_kind=b"]
    with pytest.raises(ValueError, match="several records"):
        tables.merge_mart(spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "a")], schema), path, ["k"])
