"""Reconciliation end to end, audits and concordance on small lists."""

from pyspark.sql import functions as F

from quorumlake.operators import concordance, reconcile

ENTITY = "id long, name string, province string, fuel string, status string, capacity double, source_ref string"
REFERENCE = [(1, "Cà Mau 1", "Cà Mau", "gas", "operational", 750.0, "r1"), (2, "Cà Mau 2", "Cà Mau", "gas", "operational", 750.0, ""), (3, "Sơn Động 1", "Bắc Giang", "coal", "operational", 220.0, None), (4, "Long Phú", "Sóc Trăng", "coal", "planned", 1200.0, "r4"), (5, "Uông Bí", "Quảng Ninh", "coal", "operational", 330.0, None)]
SYSTEM = [
    ("a", 1, "ca mau 1 & 2", "ca mau", "gas", "planned", 1500.0, "s1"),
    ("a", 2, "Son Dong", "Bac Giang", "coal", "operational", 220.0, ""),
    ("a", 3, "Long Phu power", "Soc Trang", "gas", "planned", 1000.0, None),
    ("a", 4, "Atlantis", None, "oil", None, None, None),
    ("b", 1, "Uong Bi", "Quang Ninh", "coal", "operational", 330.0, None),
]


def tables(spark):
    return spark.createDataFrame(REFERENCE, ENTITY), spark.createDataFrame(SYSTEM, f"key string, {ENTITY}")


def test_reconcile(spark):
    entries = reconcile.reconcile(*tables(spark), "key")
    assert entries.columns == ["key", *reconcile.COLUMNS]
    got = {(r["key"], r["reference_name"], r["system_name"]): r for r in entries.collect()}
    assert set(got) == {
        ("a", "Cà Mau 1", "ca mau 1 & 2"), ("a", "Cà Mau 2", "ca mau 1 & 2"), ("a", "Sơn Động 1", "Son Dong"), ("a", "Long Phú", "Long Phu power"), ("a", "Uông Bí", None), ("a", None, "Atlantis"),
        ("b", "Uông Bí", "Uong Bi"), *(("b", n, None) for n in ("Cà Mau 1", "Cà Mau 2", "Sơn Động 1", "Long Phú")),
    }
    unit, alone, power = got["a", "Cà Mau 1", "ca mau 1 & 2"], got["a", None, "Atlantis"], got["a", "Long Phú", "Long Phu power"]
    assert (unit["match_type"], unit["status_match"], unit["fuel_match"], unit["capacity_diff_pct"], unit["similarity_score"], unit["reference_source_ref"], unit["system_source_ref"]) == ("exact", False, True, 100.0, 100.0, "r1", "s1")
    assert (alone["match_type"], alone["fuel_match"], alone["similarity_score"], alone["system_fuel"], alone["system_province"]) == ("sys_only", None, None, "oil", None)
    assert (power["match_type"], power["fuel_match"], power["province_match"], power["capacity_diff_pct"]) == ("fuzzy_diff", False, True, 16.7)
    wrong = {r["key"]: r for r in reconcile.errors(entries, "key").collect()}
    assert [wrong["a"][c] for c in ("hallucinated", "missed", "wrong_fuel", "wrong_status", "wrong_province", "capacity_mismatch")] == [1, 1, 1, 2, 0, 1]
    assert wrong["a"]["capacity_match_rate"] == 0.75
    told = {r["key"]: r for r in reconcile.accuracy(entries, "key").collect()}
    assert (told["a"]["tp"], told["a"]["fp"], told["a"]["fn"], told["a"]["province_accuracy"], told["b"]["coverage"]) == (4, 1, 1, 1.0, 0.2)


def test_forced_pairs_and_false_positives(spark):
    reference, system = tables(spark)
    matches, ref, own = reconcile.matched_names(reference, system, "key")
    forced = reconcile.forced_mismatches(matches, ref, own, "key").collect()
    assert [(r["ref_name"], r["sys_name"], r["verdict"]) for r in forced] == [("Uông Bí", "Atlantis", "clear")]
    fp = reconcile.false_positives(reconcile.reconcile(reference, system, "key"), reference, "key").collect()
    assert [(r["clean_name"], r["n_appearances"], r["verdict"]) for r in fp] == [("atlantis", 1, "statistical_borderline")]
    cases = [("x", 95.0, 95.0, 1), ("x", 80.0, 90.0, 1), ("a & b", 10.0, 10.0, 1), ("x", 70.0, 80.0, 2), ("x", 70.0, 70.0, 3), ("x", 70.0, 80.0, 5), ("sea x", 95.0, 95.0, 1)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, name string, now double, folded double, n int")
    got = [r["v"] for r in rows.orderBy("k").select(reconcile.false_positive_verdict(F.col("name"), F.col("now"), F.col("folded"), F.col("n"), ("sea",)).alias("v")).collect()]
    assert got == ["matcher_fail_lp_veto", "matcher_fail_normalization", "matcher_fail_combined_units", "statistical_borderline", "reference_hole", "statistical_borderline", "other"]


def test_worksheet(spark):
    reference, system = tables(spark)
    entries = reconcile.reconcile(reference, system, "key")
    layer = spark.createDataFrame([("bi uong",), ("other",)], "name string")
    narrative = spark.createDataFrame([("The plant at Long Phú is planned.",), (None,)], "t string")
    sheet = reconcile.miss_worksheet(entries, "key", "b", reference, layer, narrative, "t").collect()
    assert [(r["name"], r["n_runs_missed"], r["mentioned"]) for r in sheet] == [(n, 1, n == "Long Phú") for n in ("Cà Mau 1", "Cà Mau 2", "Long Phú", "Sơn Động 1")]
    best = reconcile.miss_worksheet(entries, "key", "a", reference, layer, narrative, "t").collect()
    assert [(r["name"], r["in_layer"], r["fuel"]) for r in best] == [("Uông Bí", True, "coal")]


def test_coverage_and_tail(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert spark.createDataFrame([("NĐ Phả Lại 2-CCGT",), (None,)], "n string").select(concordance.folded_name(F.col("n"))).collect() == [("pha lai 2",), ("",)]
    reference, source = names("Phả Lại", "Uông Bí", "Long Phú", "Cà Mau"), names("Pha Lai power", "Uong-Bi", "Nowhere")
    got = {r["name"]: (r["raw"], r["covered"]) for r in concordance.reviewed_coverage(reference, source, names("Long Phú"), "name").collect()}
    assert got == {"Phả Lại": (False, True), "Uông Bí": (False, True), "Long Phú": (True, True), "Cà Mau": (False, False)}
    assert [r["name"] for r in concordance.tail(source, reference, "name").collect()] == ["Nowhere"]
    rows = spark.createDataFrame([("op", True, False), ("op", True, True), ("pl", False, False)], "status string, gem boolean, wiki boolean")
    table = {r["status"]: tuple(r)[1:] for r in concordance.concordance(rows, spark.createDataFrame([("op",)], "status string"), "status", ["gem", "wiki"]).collect()}
    assert table == {"op": (2, 2, 0, 1, 1, 1), "pl": (1, 0, 1, 0, 1, 0), "All": (3, 2, 1, 1, 2, 1)}
    assert tuple(concordance.layer_counts(spark.createDataFrame([(1, 0), (1, 1)], "a int, b int"), ["a", "b"]).first()) == (2, 2, 1)


def test_lists_lines_and_titles(spark):
    known = spark.createDataFrame([("Pha Lai",)], "k string")
    got = {r["n"]: r["hit"] for r in concordance.in_list(spark.createDataFrame([("lai pha",), ("PHA LAI ",), ("other",), ("",), (None,)], "n string"), known, "n", "k", "hit").collect()}
    assert got == {"lai pha": True, "PHA LAI ": True, "other": False, "": False, None: False}
    pairs = spark.createDataFrame([("Duyên Hải", "x\nplant Duyen Hai, 1200 MW\n"), ("Duyen Hai", "about DUYEN HAI"), ("Zzzz", "none\nof it"), ("", "x"), ("a", None)], "n string, t string")
    assert {(r["n"], r["found"]) for r in concordance.name_in_text(pairs, "n", "t").collect()} == {("Duyên Hải", True), ("Duyen Hai", True), ("Zzzz", False), ("", False), ("a", False)}
    items = spark.createDataFrame([("the power plan", 1), ("plan of power", 2), ("cooking", 3)], "title string, id int")
    assert [r["id"] for r in concordance.titles_by_reference(items, spark.createDataFrame([("power plan",)], "t string"), "title", "t").collect()] == [2, 1]
