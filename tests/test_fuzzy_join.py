"""Alike texts by the index of grams against all pairs."""

import itertools
import random

import pytest

from quorumlake.functions.similarity import KINDS
from quorumlake.operators import extract, fuzzy_join


def drawn(rng, n, most=25):
    return ["".join(rng.choice("abcdefghijklmnop eé") for _ in range(rng.randrange(1, most))) for _ in range(n)]


def edited(rng, text):
    chars = list(text)
    for _ in range(rng.randrange(0, 5)):
        k = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and chars:
            del chars[k - 1]
        else:
            chars.insert(k, rng.choice("abcxyz "))
    return "".join(chars)


def lists(seed):
    rng = random.Random(seed)
    base = drawn(rng, 60)
    left = [*base, "", None, "a", "ab", *(edited(rng, rng.choice(base)) for _ in range(40)), "b a", "a b", "a b"]
    right = [*(edited(rng, rng.choice(base)) for _ in range(60)), "", None, "b", "ab c", "a  b", *(f"{rng.choice(base)} {rng.choice(base)}" for _ in range(20))]
    return left, right


def scores(kind, pairs):
    return dict(zip(pairs, KINDS[kind]([p[0] for p in pairs], [p[1] for p in pairs]), strict=True))


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_alike(spark, kind):
    left, right = lists(4)
    of = lambda x: sorted({t for t in x if t is not None})
    known = scores(kind, list(itertools.product(of(left), of(right))))
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(y, 1) for y in right * 2], "y string, a int")
    for least in (60.0, 88.0, 100.0):
        got = {(r["x"], r["y"]): r["score"] for r in fuzzy_join.alike(a, b, "x", "y", kind, least).collect()}
        assert got == {p: s for p, s in known.items() if s >= least}
    inner = scores(kind, list(itertools.combinations(of(left), 2)))
    got = {(r["a"], r["b"]): r["score"] for r in fuzzy_join.alike_within(a.union(a), "x", kind, 70.0).collect()}
    assert got == {p: s for p, s in inner.items() if s >= 70}


def test_tiles(spark, monkeypatch):
    """Low thresholds, over several blocks, with texts that fit a tile and longer ones."""
    monkeypatch.setattr(fuzzy_join, "SIDE", (16, 32))
    left, right = lists(6)
    left, right = [*left, "x" * 64, "x" * 70, left[0] * 6], [*right, "x" * 65, "xy" * 40, right[1] * 5, left[0] * 5]
    of = lambda x: sorted({t for t in x if t is not None})
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(y,) for y in right], "y string")
    for kind, least in (("ratio", 35.0), ("token_sort_ratio", 72.0)):
        assert fuzzy_join.by_tiles(kind, least)
        known = scores(kind, list(itertools.product(of(left), of(right))))
        got = fuzzy_join.alike(a, b, "x", "y", kind, least).collect()
        assert {(r["x"], r["y"]): r["score"] for r in got} == {p: s for p, s in known.items() if s >= least} and len(got) == len({(r["x"], r["y"]) for r in got})
        inner = scores(kind, list(itertools.combinations(of(left), 2)))
        got = fuzzy_join.alike_within(a, "x", kind, least).collect()
        assert {(r["a"], r["b"]): r["score"] for r in got} == {p: s for p, s in inner.items() if s >= least} and len(got) == len({(r["a"], r["b"]) for r in got})


def test_nearest(spark):
    left, right = lists(5)
    left.append("~")  # has no character in common with any
    of = lambda x: sorted({t for t in x if t is not None})
    known = scores("partial_ratio", list(itertools.product(of(left), of(right))))
    best = {}
    for (x, y), s in known.items():
        best[x] = min(best.get(x, (1.0, "")), (-s, y))
    a, b = spark.createDataFrame([(x,) for x in left], "x string"), spark.createDataFrame([(y,) for y in right], "y string")
    assert {r["x"]: (-r["score"], r["y"]) for r in fuzzy_join.nearest(a, b, "x", "y").collect()} == best
    assert {r["x"]: (-r["score"], r["y"]) for r in fuzzy_join.nearest(a, b, "x", "y", least=75.0).collect()} == {x: m for x, m in best.items() if m[0] <= -75}
    assert fuzzy_join.nearest(a, b.limit(0), "x", "y").count() == 0
    with pytest.raises(ValueError, match="above 0"):
        fuzzy_join.alike(a, b, "x", "y", "ratio", 0)


def test_few_candidates(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("aaeeiioubdfgklmnprstvz ") for _ in range(rng.randrange(12, 26))) for _ in range(1500)]
    x = fuzzy_join.listed(spark.createDataFrame([(n,) for n in names], "text string"), "text", "ratio")
    pairs = fuzzy_join.candidates(x, x, "ratio", 88.0)
    assert 1500 <= pairs.count() < 0.1 * 1500 * 1500


def test_holders(spark):
    rng = random.Random(7)
    texts = drawn(rng, 40, 60) + [None, "", "ab"]
    needles = ["", None, "a", "ab", *(t[k : k + n] for t in texts[:40] for k, n in ((3, 2), (5, 9)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    asked = spark.createDataFrame([(n, 0) for n in needles], "needle string, t int")
    want = {(k, n) for k, t in enumerate(texts) if t for n in needles if n and n in t}
    assert {tuple(r) for r in fuzzy_join.holders(rows, asked, "d", "t", "needle").collect()} == want
    few = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "ab")], "n long, needle string")
    held = extract.contained(few, rows, "needle", "t", "n", "d").collect()
    assert {tuple(r) for r in held} == {(n, k) for n in (1, 4) for k, t in enumerate(texts) if t and "ab" in t}
