"""Matching against brute force: every veto branch, least total cost, phases."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import similarity as sim
from quorumlake.operators import matching


def common(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(table[j] + 1 if x == y else max(table[j + 1], row[j]))
        table = row
    return table[-1]


def ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = lambda s, x: max(ratio(s, x[max(0, k) : k + len(s)]) for k in range(1 - len(s), len(x)))
    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))


@pytest.mark.parametrize("kind,plain", [("ratio", ratio), ("partial_ratio", partial), ("token_sort_ratio", lambda a, b: ratio(*(" ".join(sorted(x.split())) for x in (a, b))))])
def test_kernels(spark, kind, plain):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé d") for _ in range(rng.choice((0, 1, 5, 12, 30, 64, 70))))
    pairs = [(word(), word()) for _ in range(250)] + [("", ""), ("x", "")]
    assert max(abs(s - plain(a, b)) for s, (a, b) in zip(sim.KINDS[kind](*zip(*pairs, strict=True)), pairs, strict=True)) < 1e-9
    assert (sim.ratio(None, None), sim.partial_ratio(None, "a"), sim.KINDS[kind]([], []).tolist()) == (100.0, 0.0, [])


def nums(name):
    return frozenset(w for w in name.split() if w.isdigit())


def bare(name):
    return " ".join(w for w in name.split() if not w.isdigit())


def blocked(a, b, names):
    """Numbers on both sides that differ, or the numbered side's base goes by several numbers."""
    if nums(a) and nums(b):
        return nums(a) != nums(b)
    if not (nums(a) or nums(b)):
        return False
    own = bare(a) if nums(a) else bare(b)
    return len({nums(x) for x in names if bare(x) == own and nums(x)}) > 1 and ratio(bare(a), bare(b)) >= 90


def frame(spark, ref, sys):
    return spark.createDataFrame([(k, s, i, n, c) for s, side in (("ref", ref), ("sys", sys)) for k, i, n, c in side], "key string, side string, id long, name string, capacity double")


def drawn(rng, k, n):
    base = ["ca na", "ca nas", "vung ang", "long son", "long son chemical", "an khe"]
    return [(k, i, rng.choice(base) + rng.choice(("", "", " 1", " 2", " 2 1", " 3")), rng.choice((None, 1.0, 5.0, 600.0, 660.0))) for i in range(n)]


def test_veto_branches(spark):
    names = ["ca na 2", "ca na 3", "quang ninh 1", "vung ang 1", "vung ang 2"]
    cases = [("vung ang 1", "vung ang 2"), ("ca na", "ca na 2"), ("ca na 2", "ca na"), ("quang ninh", "quang ninh 1"), ("long son", "long son chemical"), ("ca na", "vung ang 1"), ("ca na 2", "ca na 2"), ("an khanh", "ca na 2"), ("ca naa 2", "ca na")]
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, a string, b string")
    bases = matching.numbered_bases(spark.createDataFrame([(n,) for n in names], "n string"), [], "n")
    got = [r["veto"] for r in matching.with_veto(pairs, bases, [], "a", "b").orderBy("k").collect()]
    assert got == [True, True, True, False, False, False, False, False, False] == [blocked(a, b, names) for a, b in cases]


def cost(a, b, names):
    if blocked(a[2], b[2], names):
        return 20001.0
    if a[3] is None or b[3] is None:
        return 1000.0
    return (0 if a[2] == b[2] else 1 if partial(a[2], b[2]) >= 90 else 1000) + 0.001 * abs(a[3] - b[3])


def test_least_total_cost(spark):
    rng, sides = random.Random(3), {}
    for k in "abcdefghij":
        sides[k] = drawn(rng, k, rng.randrange(0, 5)), drawn(rng, k, rng.randrange(0, 6))
    df = frame(spark, [r for a, _ in sides.values() for r in a], [r for _, b in sides.values() for r in b])
    found = defaultdict(list)
    for r in matching.optimal_match(df.repartition(3), "key").collect():
        found[r["key"]].append(r)
    for k, (left, right) in sides.items():
        names = [r[2] for r in left + right]
        small, large = sorted((left, right), key=len)
        pair = lambda x, y: cost(x, y, names) if small is left else cost(y, x, names)  # noqa: B023, E731
        best = min((sum(min(pair(x, y), 20000) for x, y in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small))), default=0)
        total, seen = 0.0, ([], [])
        for r in found[k]:
            seen[0].extend([] if r["ref_id"] is None else [r["ref_id"]])
            seen[1].extend([] if r["sys_id"] is None else [r["sys_id"]])
            if r["ref_id"] is not None and r["sys_id"] is not None:
                x, y = left[r["ref_id"]], right[r["sys_id"]]
                total += cost(x, y, names)
                same = x[3] is not None and x[3] == y[3]
                assert r["status"] == ("exact" if x[2] == y[2] else "mismatched" if partial(x[2], y[2]) < 90 else "fuzzy" if same else "fuzzy_diff")
            else:
                assert r["status"] == ("sys_only" if r["ref_id"] is None else "ref_only")
        assert [sorted(s) for s in seen] == [list(range(len(left))), list(range(len(right)))]
        short = len(small) - sum(r["ref_id"] is not None and r["sys_id"] is not None for r in found[k])
        assert math.isclose(total + 20000 * short, best, abs_tol=1e-6)


def by_phases(left, right):
    names, out, free = [r[2] for r in left + right], [], list(right)
    rest = []
    for x in left:
        y = next((y for y in free if x[3] is not None and x[2:] == y[2:]), None)
        out += [(x[1], y[1], "exact")] if y else []
        rest += [] if y else [x]
        if y:
            free.remove(y)
    for x in rest:
        scored = [(partial(x[2], y[2]), -k) for k, y in enumerate(free) if not blocked(x[2], y[2], names)]
        s, k = max(scored, default=(0, 0))
        if s >= 90:
            y = free.pop(-k)
            out.append((x[1], y[1], "fuzzy_diff" if None not in (x[3], y[3]) and x[3] != y[3] else "fuzzy"))
        else:
            out.append((x[1], None, "ref_only"))
    return sorted(map(str, [*out, *((None, y[1], "sys_only") for y in free)]))


def test_phases(spark):
    rng, sides = random.Random(5), {}
    for k in "abcdefgh":
        sides[k] = drawn(rng, k, rng.randrange(0, 9)), drawn(rng, k, rng.randrange(0, 9))
    # siblings that pair off exactly still make their base ambiguous
    sides["x"] = [("x", 0, "ca na 2", 1.0), ("x", 1, "ca na 3", 1.0), ("x", 2, "ca na 4", 1.0)], [("x", 0, "ca na 2", 1.0), ("x", 1, "ca na 3", 1.0), ("x", 2, "ca na", 1.0)]
    df = frame(spark, [r for a, _ in sides.values() for r in a], [r for _, b in sides.values() for r in b])
    found = defaultdict(list)
    for r in matching.phased_match(df.repartition(3), "key").collect():
        found[r["key"]].append(str((r["ref_id"], r["sys_id"], r["status"])))
    assert {k: sorted(v) for k, v in found.items()} == {k: by_phases(a, b) for k, (a, b) in sides.items() if a or b}
    assert matching.phased_match(df.limit(0), "key").count() == matching.optimal_match(df.limit(0), "key").count() == 0


def test_close_pairs(spark):
    names = sorted({n for _, _, n, _ in drawn(random.Random(1), "k", 60)})
    got = {(r["a"], r["b"]): (round(r["score"], 6), r["veto"]) for r in matching.close_pairs(spark.createDataFrame([(n,) for n in names * 2], "n string"), "n", 80.0).collect()}
    assert got == {(a, b): (round(partial(a, b), 6), blocked(a, b, names)) for a, b in itertools.combinations(names, 2) if partial(a, b) >= 80}


def test_greedy_pairs(spark):
    rng = random.Random(2)
    scored = [(k, i, j, float(rng.randrange(1, 30) * 500)) for k in "ab" for i in range(6) for j in range(7)]
    got = defaultdict(set)
    for r in matching.greedy_match(spark.createDataFrame(scored, "key string, l long, r long, cost double"), "key", "l", "r", "cost").collect():
        got[r["key"]].add((r["l"], r["r"]))
    for k in "ab":
        a, b, want = set(), set(), set()
        for _, i, j, c in sorted((x for x in scored if x[0] == k), key=lambda x: (x[3], x[1], x[2])):
            if c < matching.UNMATCHED and i not in a and j not in b:
                want.add((i, j))
                a.add(i)
                b.add(j)
        assert got[k] == want


def test_attributes(spark):
    matches = spark.createDataFrame([(1, 2), (None, 3), (4, None)], "ref_id long, sys_id long")
    left, right = (spark.createDataFrame([(i, f"{p}{i}")], "id long, name string") for i, p in ((1, "r"), (2, "s")))
    got = sorted(map(str, matching.matched_attributes(matches, left, right).select("ref_id", "sys_id", "ref_name", "sys_name").collect()))
    assert got == sorted(map(str, [matching_row(spark, *x) for x in ((1, 2, "r1", "s2"), (None, 3, None, None), (4, None, None, None))]))


def matching_row(spark, *x):
    return spark.createDataFrame([x], "ref_id long, sys_id long, ref_name string, sys_name string").first()


def test_veto_is_null_safe(spark):
    pairs = spark.createDataFrame([("", "a 1"), ("a 1", "")], "a string, b string")
    bases = matching.numbered_bases(pairs, [], "a")
    assert [r["veto"] for r in matching.with_veto(pairs, bases, [], "a", "b").select(F.col("veto")).collect()] == [False, False]


def test_a_key_is_solved_without_a_matrix_of_its_entities():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng, n, names = np.random.default_rng(4), 300, [f"plant {c}" for c in "abcde"]
    table = pd.DataFrame({"key": "k", "side": ["ref"] * n + ["sys"] * n, "id": range(2 * n), "name": rng.choice(names, 2 * n), "capacity": rng.integers(1, 40, 2 * n).astype(float)})
    pairs = pd.DataFrame([("k", x, y, x == "plant a" and y == "plant b", 100.0 if x == y else 80.0) for x in names for y in names], columns=["key", "ref_name", "sys_name", "veto", "score"])
    tracemalloc.start()
    got = matching.solved(table, pairs, "key")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n, peak  # one matrix of doubles
    assert got["ref_id"].nunique() == got["sys_id"].nunique() == n
    costs = rng.choice([0.0, 1.0, 1000.0, 20001.0], (12, 15)) + rng.integers(0, 9, (12, 15)) / 1000
    alone = matching.assign(np.hstack([costs, np.full((12, 12), 20000.0)]))
    assert matching.assign(costs, 20000.0).tolist() == np.where(alone < 15, alone, -1).tolist()


def test_kinds_are_solved_not_entities(monkeypatch):
    """What is asked for goes with the kinds of entities, and the total is what single units give."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(6)
    for _ in range(20):
        n, m = rng.integers(2, 6, 2)
        costs, supply, room = rng.choice([0.0, 1.0, 1000.0, 20001.0], (n, m)) + rng.integers(0, 9, (n, m)) / 1000, rng.integers(1, 5, n), rng.integers(1, 5, m)
        i, j, units = matching.transported(costs, supply, room, 20000.0)
        assert (np.bincount(i, units, n) <= supply).all() and (np.bincount(j, units, m) <= room).all()
        each = np.repeat(np.repeat(costs, supply, axis=0), room, axis=1)
        to = matching.assign(each, 20000.0)
        want = sum(each[k, x] if x >= 0 else 20000.0 for k, x in enumerate(to))
        assert abs((costs[i, j] * units).sum() + 20000.0 * (supply.sum() - units.sum()) - want) < 1e-6
    asked, get = [], matching.Costs.__getitem__
    monkeypatch.setattr(matching.Costs, "__getitem__", lambda self, k: asked.append(np.size(k)) or get(self, k))
    n, names = 1500, [f"plant {c}" for c in "abc"]
    table = pd.DataFrame({"key": "k", "side": ["ref"] * n + ["sys"] * n, "id": range(2 * n), "name": rng.choice(names, 2 * n), "capacity": rng.integers(1, 8, 2 * n).astype(float)})
    pairs = pd.DataFrame([("k", x, y, False, 100.0 if x == y else 80.0) for x in names for y in names], columns=["key", "ref_name", "sys_name", "veto", "score"])
    got = matching.solved(table, pairs, "key")
    assert sum(asked) < n and sorted(got["ref_id"]) == list(range(n)) and sorted(got["sys_id"]) == list(range(n, 2 * n))
    side = lambda s: table[table["side"] == s].groupby(["name"]).size()
    assert (got["status"] == "exact").sum() == sum(min(side("ref")[x], side("sys")[x]) for x in names)
