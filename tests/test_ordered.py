"""Ordered scans and medians against plain Python, with groups over several parts."""

import random
import statistics
from itertools import groupby

from pyspark.sql import functions as F

from quorumlake.operators.ordered import Ordered, medians


def test_scans(spark):
    rng = random.Random(2)
    rows = [(None if g == 3 else g, v, k, rng.randrange(-5, 9)) for k, (g, v) in enumerate((rng.choice([0, 0, 0, 0, 1, 3]), rng.choice([None, 1.5, 2.0, 7.0])) for _ in range(600))]
    df = spark.createDataFrame(rows, "g int, v double, k int, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    found = Ordered(df.repartition(5), ["g"], ["v", "k"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.rows.select("_part").distinct().count() > 1
    got = found.sum_before("x", "s").place("p").size("n").least_from("x", "m").done()
    assert got.columns == ["g", "v", "k", "x", "s", "p", "n", "m"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])
    want = set()
    for _, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        for k, r in enumerate(own):
            want.add((*r, sum(x[3] for x in own[:k]), k + 1, len(own), min(x[3] for x in own[k:])))
    assert set(map(tuple, got.collect())) == want
    whole = Ordered(df, [], ["v", "k"]).place("p").done().collect()
    assert sorted(r["p"] for r in whole) == list(range(1, 601)) and max(whole, key=lambda r: r["p"])["v"] == 7.0
    assert Ordered(df.limit(0), ["g"], ["v"]).place("p").done().count() == 0


def test_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None, "b", "a", "a"]), rng.choice([None, *range(9)]), rng.random()) for _ in range(300)] + [("z", None, 1.0)]
    got = medians(spark.createDataFrame(rows, "g string, a int, b double"), ["g"], {"ma": F.col("a"), "mb": F.when(F.col("b") > 0.2, F.col("b"))}).collect()
    middle = lambda x: statistics.median(x) if x else None
    own = lambda g: [r for r in rows if r[0] == g]
    assert {r["g"]: (r["ma"], r["mb"]) for r in got} == {g: (middle([r[1] for r in own(g) if r[1] is not None]), middle([r[2] for r in own(g) if r[2] > 0.2])) for g in ("a", None, "b", "z")}


def test_least_from_is_linear(spark):
    """The least of all later rows needs no frame that runs to the end, which costs the square of a part's rows."""
    rows = spark.range(300).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("o"), "id", ((F.col("id") * 37) % 101).alias("v"))
    got = Ordered(rows, ["k"], ["o", "id"]).least_from("v", "m").done()
    assert "FollowingFrame" not in got._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing", "FollowingFrame").split("_local")[0]
    told = sorted((r["k"], -1 if r["o"] is None else r["o"], r["id"], r["v"], r["m"]) for r in got.collect())
    for i, (k, _, _, _, m) in enumerate(told):
        assert m == min(x[3] for x in told[i:] if x[0] == k)


def test_unstable_pairs_over_blocks(spark, monkeypatch):
    """Dense means meet in many tiles, each pair once."""
    from quorumlake.operators import selection

    monkeypatch.setattr(selection, "BLOCK", 8)
    rng = random.Random(2)
    rows = [(k, m := rng.choice([rng.random() / 4, 0.1]), m - rng.random() / 20, m + rng.random() / 20) for k in range(120)] + [(200, None, None, None)]
    out = selection.unstable_pairs(spark.createDataFrame(rows, "k int, mean double, low double, high double"), "k")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    want = {(a[0], b[0]): abs(a[1] - b[1]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and abs(a[1] - b[1]) < selection.UNSTABLE and a[2] <= b[3] and b[2] <= a[3]}
    got = out.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["difference"] for r in got} == want


def test_majority_without_window(spark):
    """The attributes of the largest run come from an aggregate that holds a row for each entity."""
    from quorumlake.operators import fusion

    rows = spark.createDataFrame([(1, 10, "b", 2.0), (1, 11, "x", 1.0), (2, 10, "a", 1.0), (3, 10, "c", None), (3, 11, "c", 0.5), (1, 10, None, 7.0)], "run int, e int, p string, q double")
    out = fusion.majority(rows, "run", "e", ["p", "q"], 3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(10, 3, None, 7.0), (11, 2, "x", 1.0)]
