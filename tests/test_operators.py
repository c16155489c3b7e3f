"""Operators on small tables, kernels against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.operators import extract, fusion, matching, metrics, quality, ranking, resampling, stats
from quorumlake.sources import tables
from quorumlake.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("seed", range(30))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    n, m = sorted(map(int, rng.integers(1, 6, 2)))
    cost = rng.integers(0, 20, (n, m)).astype(float)
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
    got = matching.assign(cost)
    assert len(set(got)) == n and cost[np.arange(n), got].sum() == best


def sides(spark, ref, sys):
    return spark.createDataFrame([("k", "ref", i, n, c) for i, (n, c) in enumerate(ref)] + [("k", "sys", i, n, c) for i, (n, c) in enumerate(sys)], "key string, side string, id long, name string, capacity double")


def test_match_vetoes_units(spark):
    got = rows(matching.optimal_match(sides(spark, [("na duong 1", 100.0), ("na duong 2", 100.0)], [("na duong 1", 100.0), ("na duong 3", 100.0)]), "key"))
    assert {(a, b, s) for _, a, b, _, s in got} == {(0, 0, "exact"), (1, None, "ref_only"), (None, 1, "sys_only")}


def test_match_is_optimal_not_greedy(spark):
    got = {(a, b, s) for _, a, b, _, s in rows(matching.optimal_match(sides(spark, [("alpha", 5.0), ("alphabet", 5.0)], [("alphabet", 5.0), ("alpha", 9.0)]), "key"))}
    assert got == {(0, 1, "exact"), (1, 0, "exact")}


def test_mismatch_splits(spark):
    m = matching.optimal_match(sides(spark, [("aaaa", 5.0)], [("zzzz", 5.0)]), "key")
    assert {r["status"] for r in m.collect()} == {"mismatched"}
    assert {(r["ref_id"], r["sys_id"], r["status"]) for r in matching.split_mismatches(m).collect()} == {(0, None, "ref_only"), (None, 0, "sys_only")}


def test_phased_match(spark):
    got = {(a, b, s) for _, a, b, _, s in rows(matching.phased_match(sides(spark, [("a b", 1.0), ("a b", 1.0), ("vinh tan 2", 5.0), ("x", 1.0)], [("a b", 1.0), ("vinh tan power 2", 5.0), ("vinh tan 2", 6.0)]), "key"))}
    assert (0, 0, "exact") in got and (1, None, "ref_only") in got and (2, 2, "fuzzy_diff") in got and (3, None, "ref_only") in got


def test_unit_names(spark):
    names = spark.createDataFrame([("son dong 1",), ("mong duong 1",), ("x",)], "name string")
    reference = spark.createDataFrame([("son dong 1",), ("mong duong 1",), ("mong duong 2",)], "name string")
    assert sorted(r["name"] for r in matching.single_unit_names(names, reference, "name").collect()) == ["mong duong 1", "son dong", "x"]
    units = spark.createDataFrame([("nhon trach 3 & 4",), ("a 1 va 2",), ("b 3",)], "name string")
    assert sorted(r["name"] for r in matching.expand_units(units, "name").collect()) == ["a 1", "a 2", "b 3", "nhon trach 3", "nhon trach 4"]


def test_metrics_of_nothing(spark):
    m = spark.createDataFrame([("r", "sys_only", None, None, None)], "run string, status string, fuel_ok boolean, status_ok boolean, capacity_ok boolean")
    r = metrics.match_metrics(m, "run").first()
    assert (r["coverage"], r["precision"], r["f1"], r["fuel_accuracy"]) == (0.0, 0.0, 0.0, None)


TEXT = """Some words.| Plant name | Fuel | Capacity (MW) |
|---|---|---|
| A | coal | 600 |
| **Gas section** |
| B | gas | 300 | extra |
| C | gas | 300 |

| lonely | row | x |
text
| Name | Fuel | Status |
| D | oil | operating |
"""


def test_pipe_tables(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "a | b")], "id long, text string")
    got = extract.pipe_table_rows(docs, "id", "text")
    assert [(r["row_no"], r["cells"]) for r in got.orderBy("line_no").collect()] == [(0, ["Plant name", "Fuel", "Capacity (MW)"]), (1, ["A", "coal", "600"]), (2, ["C", "gas", "300"]), (0, ["Name", "Fuel", "Status"]), (1, ["D", "oil", "operating"])]
    cells = extract.canonical_cells(got, "id").orderBy("line_no").collect()
    assert [c["values"]["name"] for c in cells] == ["A", "C", "D"] and all(c["is_inventory"] for c in cells)
    assert cells[0]["values"]["capacity_mwe"] == "600"
    assert sorted(r["cells"] for r in extract.merged_tables(got, "id").collect()) == [["A", "coal", "600"], ["C", "gas", "300"]]


def test_blocks_and_delimiters(spark):
    df = spark.createDataFrame([("x\n```csv\nname,fuel\na,coal\n```\ny ```\nq;r\n1;2\n```",)], "t string")
    assert [len(b) for b in df.select(extract.fenced_blocks(F.col("t"))).first()] == [2]
    scores = spark.createDataFrame([("name,fuel\na,coal",), ("",), ("| a | b |",)], "b string").select(extract.block_score(F.col("b")), extract.delimiter(F.col("b"))).collect()
    assert scores[0][0] > 1.4 and [s[0] for s in scores[1:]] == [-1.0, -1.0] and [s[1] for s in scores] == [",", ",", "|"]


def test_turns_sections_bibliography(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", " "), (2, 0, "assistant", None)], "c long, t long, r string, x string")
    assert rows(extract.last_turn(turns, "c", "t", "r", "x")) == [(1, 1, "a")]
    assert rows(extract.joined_turns(turns, "c", "t", "r", "x"), "c") == [(1, 2, "a\n "), (2, 1, "")]
    docs = spark.createDataFrame([(1, "intro\n# One\nab\ncd\n## Two\nReferences\n[1] First title\n2. Second\n")], "id long, t string")
    assert [(r["section"], r["title"], r["n_lines"]) for r in extract.sections(docs, "id", "t").orderBy("section").collect()] == [(0, None, 1), (1, "One", 2), (2, "Two", 4)]
    assert rows(extract.bibliography(docs, "id", "t"), "number") == [(1, 1, "First title"), (1, 2, "Second")]


def test_containment(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("ab bc cd de ef fg gh hi".split()) for _ in range(n))
    texts = [(k, words(60)) for k in range(40)]
    texts += [(50, None), (51, "")]
    needles = [(k, texts[k][1][5:-9]) for k in range(0, 40, 3)] + [(100, words(12)), (101, "ab bc"), (102, words(30)), (103, None), (104, "c cd de e"), (105, "b ef f"), (106, texts[7][1][8:30])]
    got = {tuple(r) for r in extract.contained(spark.createDataFrame(needles, "n long, t string"), spark.createDataFrame(texts, "d long, t string"), "t", "t", "n", "d").collect()}
    assert got == {(n, d) for n, x in needles for d, t in texts if x is not None and t is not None and x in t}


def test_fusion(spark):
    facts = spark.createDataFrame([("e", "cod", "2010", 1, 2020, 1), ("e", "cod", "2012", 2, 2019, 2), ("e", "cod", None, 3, 2024, 3), ("e", "cod", "2013", 2, 2019, 4)], "entity string, field string, value string, tier int, year int, seq int")
    assert rows(fusion.highest_authority(facts, "entity", "field", "value", ["tier", "year", "seq"])) == [("e", "cod", "2013", 3)]
    assert {(r["seq"], r["change"]) for r in fusion.authority_changes(facts, "entity", "field", "value", "tier", "year", "seq").collect()} == {(1, "set"), (2, "replaced"), (4, "replaced")}
    votes = spark.createDataFrame([(1, "x", "c", 1), (2, "x", "d", 1), (1, "y", "c", 2), (3, "z", "q", 1)], "run int, entity string, fuel string, ord int")
    assert rows(fusion.majority(votes, "run", "entity", ["fuel"], 3)) == [("x", 2, "c")]
    assert rows(fusion.confidence_weighted(votes, "run", "entity", F.col("ord"), "ord", 2.0), "entity") == [("x", 2), ("y", 2)]


def em(assertions, entities, runs, rounds):
    """The same model, entity by entity."""
    model = dict(runs)
    said = {e: {r for r, x in assertions if x == e and r in model} for e, _, _ in entities}
    rate = {e: len(s) / len(runs) for e, s in said.items()}
    anchored = [e for e, a, _ in entities if a]
    c = min(max(np.mean([rate[e] for e in anchored]) / max(np.mean(list(rate.values())), 1e-6), 0.1), 0.95) if anchored else 0.5
    base = {e: 0.8 if rate[e] >= 0.5 else 0.3 for e, _, _ in entities}
    prior = {e: min(base[e] / max(c, 0.1), 0.99) if a else base[e] for e, a, _ in entities}
    sens, spec, q = {}, {}, {}
    for _ in range(rounds):
        for e, a, s in entities:
            odds = np.log(prior[e]) - np.log(1 - prior[e])
            for r, m in runs:
                x, y = sens.get((m, s, a), 0.7), spec.get((m, s, a), 0.7)
                odds += np.log(x) - np.log(1 - y) if r in said[e] else np.log(1 - x) - np.log(y)
            q[e] = 1 / (1 + np.exp(-odds))
        for m in set(model.values()):
            own = [r for r, x in runs if x == m]
            for s, a in {(s, a) for _, a, s in entities}:
                of = [e for e, b, t in entities if (b, t) == (a, s)]
                tp = sum(q[e] * sum(r in said[e] for r in own) for e in of)
                tn = sum((1 - q[e]) * sum(r not in said[e] for r in own) for e in of)
                sens[m, s, a] = min(max(tp / max(sum(q[e] for e in of) * len(own), 1e-9), 0.01), 0.99)
                spec[m, s, a] = min(max(tn / max(sum(1 - q[e] for e in of) * len(own), 1e-9), 0.01), 0.99)
    return q


def test_latent_truth(spark):
    rng = random.Random(4)
    entities = [(f"e{k}", k % 3 == 0, "coal" if k % 2 else "gas") for k in range(24)]
    runs = [(r, r % 3) for r in range(9)]
    assertions = [(r, e) for r, _ in runs for e, a, _ in entities if rng.random() < (0.8 if a else 0.3)]
    existence, reliability = fusion.latent_truth(spark.createDataFrame(assertions, "run int, entity string"), spark.createDataFrame(entities, "entity string, anchored boolean, stratum string"), spark.createDataFrame(runs, "run int, model int"), 6)
    want = em(assertions, entities, runs, 6)
    got = {r["entity"]: r["existence"] for r in existence.collect()}
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want) and reliability.count() == 6


def test_anova_and_permutation(spark):
    cells = [("a", "x", v) for v in (1.0, 2.0)] + [("a", "y", v) for v in (3.0, 5.0)] + [("b", "x", v) for v in (2.0, 2.5)] + [("b", "y", v) for v in (9.0, 8.0)]
    mean = sum(c[2] for c in cells) / len(cells)
    got = {r["effect"]: r for r in stats.two_way_anova(spark.createDataFrame(cells, "a string, b string, v double"), "a", "b", "v").collect()}
    assert abs(sum(r["ss"] for r in got.values()) - sum((c[2] - mean) ** 2 for c in cells)) < 1e-9
    assert got["residual"]["df"] == 4 and abs(got["a"]["ss"] - 2 * 4 * (2.75 - mean) ** 2) < 1e-9
    d = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.0)], "k string, d double")
    assert resampling.paired_test(d, "k", "d").first()["p"] == 0.25


def test_screens(spark):
    totals = spark.createDataFrame([(1, None, 100.0), (2, "x", 30.0), (3, "y", 0.0), (4, "z", 5.0)], "total_id long, dim string, declared double")
    data = spark.createDataFrame([("x", 30.0), ("y", 62.0)], "dim string, v double")
    assert [(r["total_id"], r["severity"]) for r in quality.control_totals(data, totals, ["dim"], "v").orderBy("total_id").collect()] == [(1, "warning"), (2, "ok"), (4, "error")]
    numbered = quality.numbered(spark.createDataFrame([(k * 7 % 31,) for k in range(31)], "k long").repartition(5), ["k"])
    assert all(r["row_no"] == r["k"] for r in numbered.collect())


def test_ranking(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k long, v double")
    right = spark.createDataFrame([(2, 2.0005), (3, None), (4, 1.0)], "k long, v double")
    assert dict(rows(ranking.parity(left, right, ["k"], ["v"]))) == {"left_only": 1, "right_only": 1, "v": 0}
    steps = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("a", 4, 9.0)], "g string, r int, v double")
    assert rows(ranking.adjacent_deltas(steps, "g", "r", "v")) == [("a", 1, 3.0)]


def test_inventory_files(spark, tmp_path):
    (tmp_path / "m-run2.csv").write_text('Name,Fuel,Status,Capacity MWe\nA,coal,6 operating,"1,200"\n,gas,planned,5\nB,peat,x,-3\nC,LNG,shelved,\n')
    raw = tables.read_inventory(spark, str(tmp_path / "*.csv"))
    got = tables.with_run(tables.entities(raw), F.col("_file")).orderBy("name").collect()
    assert [(r["name"], r["fuel"], r["status"], r["capacity_mwe"], r["model"], r["run"]) for r in got] == [("A", "coal", "operational", 1200.0, "m", 2), ("C", "imported lng", "cancelled", None, "m", 2)]
    tables.write_records(raw.select("name"), str(tmp_path / "out"), ["name"])
    assert tables.read_records(spark, str(tmp_path / "out"), "name string").count() == 4


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (2, 4, True), (2, 5, False), (2, 6, True)], "job long, at long, bad boolean").coalesce(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, at long, bad boolean").parquet(str(tmp_path / "in"))
    q = jobs.streaming_streaks(stream, "job", "bad").writeStream.outputMode("update").format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("streaks").collect()) == [(1, 3, True), (2, 1, False)]
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert rows(jobs.failure_streaks(batch, "job", ["at"], F.col("bad")), "job") == [(1, 3, True), (2, 1, False)]
