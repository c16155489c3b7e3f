"""Column builders and kernels."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import similarity as sim
from quorumlake.functions import text as tx
from quorumlake.functions.distributions import binomial_tail, f_tail, incomplete_beta


def one(spark, value, build, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(build(F.col("v"))).collect()]


def test_numbers(spark):
    given = ["1,200.5", "1.200,5", "1 200", "600", "1,200,000", "1,5", "x", "", None, "1.200"]
    assert one(spark, given, tx.number) == [1200.5, 1200.5, 1200.0, 600.0, 1200000.0, 1.5, None, None, None, 1.2]
    assert one(spark, ["1.200", "1.20", "1.200.300"], lambda c: tx.number(c, True)) == [1200.0, 1.2, 1200300.0]


def test_capacity_text(spark):
    assert one(spark, ["~1.200 MW", "660", "about", "≈ 1,320.5 MW"], tx.capacity_text) == ["1200", "660", "0", "1320.5"]


def test_fold_and_clean(spark):
    assert one(spark, ["Đồng Nai", "Vũng Áng", "é", None], lambda c: tx.fold(F.lower(c))) == ["dong nai", "vung ang", "e", None]
    assert one(spark, ["Đắk"], lambda c: tx.fold(c, stroke=False)) == ["Đak"]
    drops = (r"\bpower plant\b",)
    assert one(spark, ["Vĩnh Tân  Power Plant", "power plant"], lambda c: tx.clean_name(c, drops)) == ["vinh tan", "power plant"]
    assert one(spark, ["Oil / Gas"], tx.clean_fuel) == ["gas/oil"]
    assert one(spark, ["600 MW", "n/a", ".5"], tx.clean_capacity) == [600.0, None, 0.5]


def test_categories(spark):
    assert one(spark, ["6 operating", "Announced", "10 retired", "7", "", None], tx.status) == ["operational", "proposed", "retired", "unknown", "unknown", "unknown"]
    assert one(spark, ["LNG", " Natural gas", "peat", None], tx.fuel) == ["imported lng", "gas", "unknown", "unknown"]


def test_headers(spark):
    given = ["Plant Name (VN / EN)", "Capacity [MWe]", "Status / as of", "Installed Capacity (MW)", "Tỉnh", "Province"]
    assert one(spark, given, tx.canonical_header) == ["name", "capacity_mwe", "status_as_of", "capacity_mwe", None, "province"]


def test_sources(spark):
    given = ["https://notgov.vn/a", "https://en.wikipedia.org/x", "https://other.org", "Decision 500/QĐ", "none", "", "Title of a long enough citation text", "short"]
    assert one(spark, given, tx.source_by_text) == ["primary", "secondary", "unknown", "primary", "none", "none", "secondary", "none"]
    assert one(spark, [["primary", "primary"], ["primary"], ["secondary"], ["none"], ["hallucinated", "primary"], []], tx.evidence_score, "array<string>") == [4, 3, 2, 1, 0, 1]
    assert one(spark, ["a.example.com", "example.com", "notexample.com"], lambda c: tx.in_domains(c, ("example.com",))) == [True, True, False]


def test_refusals(spark):
    assert one(spark, ["I can’t do it", " **I will not", "Sure: I cannot", "Per your constraints"], tx.refusal) == [True, True, False, True]


def test_levels(spark):
    rows = spark.createDataFrame([("unit", 1400.0), ("Plant", 3000.0), ("block", 900.0), ("complex", 1.0), ("unknown", 5.0), ("unit", None)], "l string, c double")
    assert [r[0] for r in rows.select(tx.capacity_plausible(F.col("l"), F.col("c"))).collect()] == [False, True, False, True, None, None]
    address = spark.createDataFrame([("C", "P", "1"), ("C", "P", ""), ("C", None, None), (None, " ", "")], "c string, p string, u string")
    got = address.select(tx.level_of_address(*map(F.col, "cpu")), tx.name_of_address(*map(F.col, "cpu"))).collect()
    assert [tuple(r) for r in got] == [("unit", "P 1"), ("plant", "P"), ("complex", "C"), ("unknown", None)]


def test_gate_and_lifecycle(spark):
    rows = spark.createDataFrame([(0.5, 0.2), (None, 0.9), (None, None)], "a double, b double")
    assert [r[0] for r in rows.select(tx.passes_gate(0.3, F.col("a"), F.col("b"))).collect()] == [False, True, True]
    life = spark.createDataFrame([("planned", "operational", 2020), ("planned", "operational", 2030), ("cancelled", "planned", 2020), ("planned", "planned", 2030)], "a string, r string, v int")
    assert [r[0] for r in life.select(tx.lifecycle_compatible(F.col("a"), F.col("r"), F.col("v"), F.lit(2024))).collect()] == [True, False, False, True]


def test_similarity_by_hand():
    assert sim.ratio("abcd", "abxd") == 75.0
    assert sim.partial_ratio("na duong 1", "nhiet dien na duong 1") == 100.0
    assert (sim.partial_ratio("", ""), sim.partial_ratio("a", "")) == (100.0, 0.0)
    assert sim.token_sort_ratio("tan vinh", "vinh tan") == 100.0


@pytest.mark.parametrize("a,b", [("abcab", "bca"), ("kitten", "sitting"), ("aé ", "éa a"), ("aaaa", "bbbb")])
def test_lcs_against_subsets(a, b):
    subsequences = lambda s: {"".join(c) for n in range(len(s) + 1) for c in itertools.combinations(s, n)}
    assert sim._lcs(a, b) == max(map(len, subsequences(a) & subsequences(b)))


def test_distributions():
    assert math.isclose(f_tail(4.0, 2, 10), 1.8**-5, rel_tol=1e-10)
    assert math.isclose(incomplete_beta(2, 3, 0.4), 0.5248, rel_tol=1e-10)
    assert binomial_tail(0, 5) == 1.0 and binomial_tail(5, 5) == 1 / 32
