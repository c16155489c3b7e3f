"""Order-dependent fusion against sequential folds; rules that follow fixed words."""

import random
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from quorumlake.functions.similarity import KINDS
from quorumlake.operators import fusion, growing_master, provenance, records

SCHEMA = "entity string, field string, value string, tier int, year int, seq int"


def fold(facts):
    """Facts of one field in order: (seq, change), and the value that stands."""
    state, out = None, []
    for _, _, value, tier, year, seq in sorted(facts, key=lambda f: f[5]):
        if value is None:
            continue
        if state is None:
            out.append((seq, "set"))
            state = value, tier, year
        elif value == state[0]:
            out.append((seq, "confirmed"))
        elif (tier, year) >= state[1:]:
            out.append((seq, "replaced"))
            state = value, tier, year
        else:
            out.append((seq, "refused"))
    return out, state and state[0]


def drawn(rng, n):
    return [(rng.choice("xyz"), rng.choice("fg"), rng.choice(["a", "b", "c", None]), rng.randrange(3), rng.randrange(2019, 2022), k) for k in range(n)]


def test_authority(spark):
    kept = [("e", "f", "A", 1, 2020, 1), ("e", "f", "A", 3, 2021, 2), ("e", "f", "B", 2, 2019, 3)]  # an equal value lifts no rank
    df = spark.createDataFrame(kept, SCHEMA)
    args = ("entity", "field", "value", "tier", "year", "seq")
    assert [tuple(r) for r in fusion.authority(df, *args).collect()] == [("e", "f", "B", 2)]
    rows = drawn(random.Random(3), 160)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(e, f): fold([r for r in rows if r[:2] == (e, f)]) for e in "xyz" for f in "fg"}
    got = fusion.authority_changes(df.repartition(3), *args).collect()
    assert {(r["entity"], r["field"], r["seq"], r["change"]) for r in got} == {(e, f, *c) for (e, f), (cs, _) in want.items() for c in cs}
    assert {(r["entity"], r["field"]): r["value"] for r in fusion.authority(df, *args).collect()} == {k: v for k, (_, v) in want.items() if v}
    assert fusion.authority_changes(df.limit(0), *args).count() == 0


def test_prefix_scores(spark):
    rows = drawn(random.Random(5), 40)
    reference = [("x", "f", "a"), ("x", "g", "b"), ("y", "f", "c"), ("q", "f", "a")]
    changes = fusion.authority_changes(spark.createDataFrame(rows, SCHEMA), "entity", "field", "value", "tier", "year", "seq")
    got = fusion.prefix_scores(changes, spark.createDataFrame(reference, "entity string, field string, r string"), "entity", "field", "seq", "r").collect()
    steps = [r[5] for r in rows if r[2] is not None]
    assert sorted(r["seq"] for r in got) == steps
    known = {r[:2]: r[2] for r in reference}
    for r in got:
        stands = {(e, f): fold([x for x in rows if x[:2] == (e, f) and x[5] <= r["seq"]])[1] for e in "xyz" for f in "fg"}
        stands = {k: v for k, v in stands.items() if v is not None}
        entities = {e for e, _ in stands}
        found, right = len(entities & {"x", "y", "q"}), sum(known.get(k) == v for k, v in stands.items())
        assert (r["n_entities"], r["n_found"], r["n_facts"], r["n_right"]) == (len(entities), found, len(stands), right)
        assert abs(r["f1"] - 2 * found / (len(entities) + 3)) < 1e-9 and abs(r["coverage"] - found / 3) < 1e-9 and abs(r["precision"] - found / len(entities)) < 1e-9


def plain(name):
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().strip()


def in_turn(rows, fields):
    """One growing list, row by row: what each source does, and the list."""
    masters, done = [], {}
    for source, order, name, *rest in sorted(rows, key=lambda r: (r[0], r[1])):
        values, (tier, year) = rest[: len(fields)], rest[len(fields) :]
        if not (name or "").strip():
            continue
        told = done.setdefault(source, Counter())
        scores = KINDS["token_sort_ratio"]([plain(name)] * len(masters), [plain(m[0]) for m in masters]) if masters else []
        best = max(range(len(masters)), key=lambda k: (scores[k], -k), default=None)
        if best is None or scores[best] < 72:
            masters.append((name, [None if v is None else (v, tier, year) for v in values]))
            told["added"] += 1
            continue
        state, changed = masters[best][1], 0
        for k, v in enumerate(values):
            if v is not None and (state[k] is None or (v != state[k][0] and (tier, year) >= state[k][1:])):
                state[k] = v, tier, year
                changed += 1
        told["updates"] += changed
        told["unchanged"] += not changed
    return {s: (t["added"], t["updates"], t["unchanged"]) for s, t in done.items()}, sorted((n, *(v and v[0] for v in s)) for n, s in masters)


def test_growing_master(spark):
    rng = random.Random(8)
    stems = ["nhon trach", "phu my", "vinh tan", "vinh tan mo rong", "long phu", "song hau", "Sông Hậu", "ca mau", "o mon", "hiep phuoc"]
    rows = []
    for source in "abcdef":
        for k in range(rng.randrange(8, 16)):
            name = f"{rng.choice(stems)} {rng.randrange(1, 4)}" if rng.random() < 0.8 else rng.choice([None, " ", rng.choice(stems).upper()])
            rows.append((source, k, name, rng.choice(["coal", "gas", None]), rng.choice(["x", "y", None]), ord(source) % 3, 2020 + ord(source) % 2))
    df = spark.createDataFrame(rows, "source string, k int, name string, fuel string, status string, tier int, year int")
    steps, fused = growing_master.incremental_fusion(df.repartition(3), "source", "k", "name", ["fuel", "status"], "tier", "year")
    want, masters = in_turn(rows, ["fuel", "status"])
    assert {r["source"]: (r["added"], r["field_updates"], r["unchanged"]) for r in steps.collect()} == want
    assert sorted(((r["name"], r["fuel"], r["status"]) for r in fused.collect()), key=str) == sorted(masters, key=str)
    steps, fused = growing_master.incremental_fusion(df.limit(0), "source", "k", "name", ["fuel"], "tier", "year")
    assert steps.count() == fused.count() == 0


def test_names_meet_masters_block_by_block(spark, monkeypatch):
    """Several blocks give what one growing list gives, names of over 64 characters and later rows of a name included; links
    of names that are no masters are not told."""
    monkeypatch.setattr(growing_master, "FIRST", 3)
    rng = random.Random(12)
    stems = ["nhon trach", "trach nhon", "vinh tan", "vinh tan mo rong", "long phu", "ca mau", "hiep phuoc", "nha may nhiet dien than " * 3 + "quang ninh"]
    rows = [(s, k, f"{rng.choice(stems)} {rng.randrange(1, 5)}", rng.choice(["coal", "gas", None]), ord(s) % 3, 2020) for s in "abcd" for k in range(18)]
    df = spark.createDataFrame(rows, "source string, k int, name string, fuel string, tier int, year int")
    steps, fused = growing_master.incremental_fusion(df.repartition(3), "source", "k", "name", ["fuel"], "tier", "year")
    want, masters = in_turn(rows, ["fuel"])
    assert {r["source"]: (r["added"], r["field_updates"], r["unchanged"]) for r in steps.collect()} == want
    assert sorted(((r["name"], r["fuel"]) for r in fused.collect()), key=str) == sorted(masters, key=str)
    alike = spark.range(1, 301).select(F.format_string("nha may nhiet dien %03d", "id").alias("name"), "id", F.col("id").alias("first"), F.col("id").alias("last"))
    heads, links = growing_master.met_masters(alike, "token_sort_ratio", 72.0)
    assert [r[0] for r in heads.collect()] == [1] and links.count() <= 2 * 300


def test_honest_notes_and_hard_stops(spark):
    notes = spark.createDataFrame([("uncertain about COD",), ("all data confirmed",), ("conflicting sources on capacity",), ("Planned but stopped",), ("unverified",), (None,)], "n string")
    assert [r[0] for r in notes.select(provenance.honest(F.col("n"))).collect()] == [True, False, True, True, False, False]
    cases = [(500, "Daily limit reached", "HARD_STOP", "model"), (200, "insufficient credit", "HARD_STOP", "router"), (500, "see Billing", "HARD_STOP", "router"), (429, "billing", "HARD_STOP", "model"), (429, "payment", "SOFT_RETRY", "model"), (503, "billing", "SOFT_RETRY", "model"), (404, "billing", "PERMANENT_SKIP", "model"), (None, "slow down", "SOFT_RETRY", "model")]
    df = spark.createDataFrame(cases, "status int, message string, d string, s string")
    none = F.lit(None)
    got = df.select("d", "s", records.failure_class(F.lit("http"), F.col("status"), none.cast("int"), none.cast("string"), F.col("message")).alias("x")).collect()
    assert all((r["d"], r["s"]) == tuple(r["x"]) for r in got)


def test_facts_of_one_place_follow_the_file(spark, tmp_path):
    from quorumlake import plans

    lines = "l_partkey long, l_suppkey long, l_returnflag string, l_tax double, l_orderkey long, l_linenumber int, l_shipdate string"
    rows = [(1, 1, "A", 0.05, 7, 1, "2000-01-01"), (1, 2, "A", 0.01, 7, 1, "1998-01-01"), (1, 3, "R", 0.02, 6, 1, "1999-01-01")]
    spark.createDataFrame(rows, lines).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.queries()["authority_steps"](spark, str(tmp_path)).orderBy("seq", "change").collect()
    assert [tuple(r) for r in got] == [(1, 61, 0.02, "set"), (1, 71, 0.01, "refused"), (1, 71, 0.05, "replaced")]
    assert [tuple(r) for r in plans.queries()["authority_fold"](spark, str(tmp_path)).collect()] == [(1, "tax", 0.05, 2)]
