"""Rows without a doc_id, or with the same one, whose texts differ."""

import hashlib
import random

from pyspark.ml.functions import vector_to_array

from quorumlake.llm import jaccard_join, repeats, secrets


def near_text(words, k):
    return " ".join([*words[:k], f"x{k}", *words[k + 1 :]])


def test_near_copies_of_rows_without_id(spark):
    rng = random.Random(9)
    a, b, c = ([f"{p}{rng.randrange(10**6)}" for _ in range(90)] for p in "abc")
    text = " ".join(a)
    rows = [(None, text), (5, text), (7, near_text(a, 40))]  # the set of 5 is also that of a row without an id
    rows += [(None, " ".join(b)), (None, " ".join(b)), (None, near_text(b, 50)), (8, near_text(b, 30))]  # sets that only rows without an id have
    rows += [(9, " ".join(c)), (9, near_text(c, 20)), (9, "alone " * 30), (10, near_text(c, 20).upper())]  # one id, several texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted((i, str(c)) for i, c in [("None", 5), ("5", 5), ("7", 5), *[("None", 8)] * 3, ("8", 8), *[("9", 9)] * 3, ("10", 9)])
    assert sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(docs).collect()) == ["5", "8", "9", "9", *["None"] * 4]  # one 9 for c and its near copy, one for "alone"


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, inner = text(400), text(150)
    twice = text(30) + inner + text(20) + inner + text(200)  # its second half repeats the first
    clean, other = text(700), text(650)
    for i in (None, 4):
        rows = [(i, twice), (i, clean), (i, other), (i, other), (6, a), (7, text(50) + a), (8, text(120))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.without_repeats(docs).collect()}
        whole = lambda t: (0, 0, hashlib.sha256(t.encode()).hexdigest())
        assert got[i, 700] == whole(clean) and got[i, 650] == whole(other) and got[6, 400] == whole(a)
        assert got[i, 550][:2] == (150, 1) and got[7, 450][:2] == (400, 1) and got[8, 120][0] == 0
        assert repeats.without_repeats(docs).count() == len(rows)


def test_one_of_each_in_any_partitions(spark):
    rng = random.Random(4)
    a, b = ([f"{p}{rng.randrange(10**6)}" for _ in range(60)] for p in "ab")
    rows = [(1, " ".join(a), "s1"), (1, " ".join(b), "s2"), (1, " ".join(b), "s3"), (1, "other words " * 9, "s4"), (2, near_text(a, 9), "s5"), (2, near_text(b, 9), "s6"), (3, "", "s7"), (3, None, "s8"), (None, " ", "s9"), (None, " ".join(a), "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {n: sorted(map(str, jaccard_join.one_of_each(docs.repartition(n)).collect())) for n in (1, 2, 7)}
    assert kept[1] == kept[2] == kept[7]
    assert sorted((str(r["doc_id"]), r["text"]) for r in jaccard_join.one_of_each(docs).collect() if r["text"] and r["text"].strip()) == sorted([("1", " ".join(a)), ("1", " ".join(b)), ("1", "other words " * 9), ("None", " ".join(a))])


def test_secrets_of_rows_without_an_id(spark):
    forest = secrets.fit(secrets.labelled_findings(spark))
    key = lambda k: f"{k:06d}b58b8af68854f0e01b4ad40cdbb6ae7f578ae"[:40]
    rows = [(None, f"the password = {key(k)} of {k}, {key(k)}", k) for k in range(300)] + [(None, None, -1), (7, "", -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    clean = secrets.redact(docs, forest)
    assert clean.columns == docs.columns and "Exchange" not in clean._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["_text"], r["text"]) for r in clean.collect() if r["_text"] >= 0) == [(k, f"the password = [SECRET] of {k}, [SECRET]") for k in range(300)]
    scored = {(r["value"], r["start"]): r["score"] for r in secrets.scan(docs.limit(40), forest).collect()}
    score = secrets.forest_score(spark, forest)
    again = secrets.with_features(secrets.labelled_findings(spark, 200))
    both = forest.transform(again).select("probability", score(vector_to_array("features")).alias("s")).collect()
    assert scored and max(abs(r["probability"][1] - r["s"]) for r in both) < 1e-9
