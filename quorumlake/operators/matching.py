"""One-to-one matching of entities: optimal, phased, and what comes before and after."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.similarity import similarity
from quorumlake.operators.fuzzy_join import alike_within

# Costs and thresholds of the match.
FUZZY, MISMATCH, UNMATCHED, CAPACITY_STEP, NAME_FUZZY, AMBIGUOUS_RATIO = 1.0, 1000.0, 10000.0, 0.001, 90.0, 90.0
#: The price of two entities left over, in units of CAPACITY_STEP, and costs that are asked for at once.
STAY, BATCH = round(2 * UNMATCHED / CAPACITY_STEP), 1 << 14


def transported(cost: np.ndarray | Costs, supply: np.ndarray, room: np.ndarray, alone: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, units) of a least total cost that carry each row's supply to columns with room for it (successive
    shortest paths). With ``alone`` a unit may also stay where it is at that price; without, there is room for all. Only BATCH costs,
    or a row of them, are asked for at a time.

    A search goes out from a row with units left, by costs less the prices of both ends; a column that is full is left by any
    row that it has units of. Columns of one distance are left at once. As much goes along a path as its ends and the units on
    it allow, so that time goes with the distinct rows and columns and not with their units.
    """
    n, m = cost.shape
    u, v, left, free = np.zeros(n), np.zeros(m), supply.astype(np.int64), room.astype(np.int64)
    held: list[dict[int, int]] = [{} for _ in range(m)]
    for i in range(n):  # what is nearest and has room
        if m:
            row = cost[np.array([i])][0]
            u[i] = min(row.min(), np.inf if alone is None else alone)
            for j in np.flatnonzero((row == u[i]) & (free > 0)).tolist():
                if units := min(int(left[i]), int(free[j])):
                    held[j][i] = units
                    left[i] -= units
                    free[j] -= units
    step = max(1, BATCH // max(1, m))
    for i in np.flatnonzero(left).tolist():
        while left[i]:
            least, reached, way, closed = np.full(m, np.inf), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, bool)
            at, came, batch, far, lone, stays = {i: 0.0}, {}, [i], 0.0, np.inf, i
            while True:
                for b in range(0, len(batch), step):
                    part = np.array(batch[b : b + step])
                    slack = cost[part]
                    slack -= (u[part] - far)[:, None]
                    slack -= v
                    if len(part) == 1:
                        near, by = slack[0], part[0]
                    else:
                        best = slack.argmin(axis=0)
                        near, by = slack[best, np.arange(m)], part[best]
                    better = near < least
                    better &= ~closed
                    np.copyto(least, near, where=better)
                    np.copyto(way, by, where=better)
                    if alone is not None and far + alone - u[part].max() < lone:
                        stays = int(part[u[part].argmax()])
                        lone = far + alone - u[stays]
                far = least.min() if m else np.inf
                if lone <= far:
                    far, ends = lone, [-1]
                    break
                tied = np.flatnonzero(least == far)
                ends = tied[free[tied] > 0].tolist()
                if ends:
                    break
                reached[tied], closed[tied], least[tied] = far, True, np.inf
                batch = []
                for j in tied.tolist():
                    for r in held[j]:
                        if r not in at:
                            at[r], came[r] = far, j
                            batch.append(r)
            for r, d in at.items():
                u[r] += far - d
            v[closed] -= far - reached[closed]
            for end in ends:
                r, j, units, path = (stays, -1, left[i], []) if end < 0 else (int(way[end]), end, min(left[i], free[end]), [])
                while True:
                    path.append((r, j))
                    if r == i:
                        break
                    j = came[r]
                    units = min(units, held[j].get(r, 0))
                    path.append((r, ~j))
                    r = int(way[j])
                if units <= 0:
                    continue
                for k, (r, j) in enumerate(path):
                    if k == 0 and end < 0:
                        continue
                    if k % 2 == 0:
                        held[j][r] = held[j].get(r, 0) + int(units)
                    elif held[~j][r] == units:
                        del held[~j][r]
                    else:
                        held[~j][r] -= int(units)
                left[i] -= units
                if end >= 0:
                    free[end] -= units
    flows = sorted((i, j, x) for j, of in enumerate(held) for i, x in of.items())
    return tuple(np.array([f[k] for f in flows], np.int64) for k in range(3))


def assign(cost: np.ndarray | Costs, alone: float | None = None) -> np.ndarray:
    """Column of each row of costs with no more rows than columns, of least total cost. With ``alone`` a row may also stay
    without a column (-1) at that price."""
    i, j, _ = transported(cost, np.ones(cost.shape[0], np.int64), np.ones(cost.shape[1], np.int64), alone)
    out = np.full(cost.shape[0], -1, np.int64)
    out[i] = j
    return out


class Costs:
    """The costs of pairs of two sides' kinds of entities, in units of CAPACITY_STEP, by rows: a table over distinct names, and
    both sides' capacities. A vetoed pair costs more than to stay alone."""

    def __init__(self, names: np.ndarray, veto: np.ndarray, rows: np.ndarray, columns: np.ndarray, row_capacity: np.ndarray, column_capacity: np.ndarray):
        self.names, self.at, self.capacity, self.shape = np.where(veto, STAY + 1, np.round(names / CAPACITY_STEP)), (rows, columns), (row_capacity, column_capacity), (len(rows), len(columns))
        self.unknown = not (np.isfinite(row_capacity).all() and np.isfinite(column_capacity).all())

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        cost = np.abs(self.capacity[1] - self.capacity[0][i][:, None])
        price = self.names[self.at[0][i]][:, self.at[1]]
        if self.unknown:
            blank = np.isnan(cost)
            np.copyto(cost, round(MISMATCH / CAPACITY_STEP) - price, where=blank & (price <= STAY))
            np.copyto(cost, 0.0, where=blank & (price > STAY))
        cost += price
        return cost


def numbers(name: Column) -> Column:
    """A name's words of digits only: distinct, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w.rlike("^[0-9]+$"))))


def unnumbered(name: Column) -> Column:
    """A name without its words of digits only."""
    return F.array_join(F.filter(F.split(name, r"\s+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$")), " ")


def numbered_bases(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, base): what is left of names without their numbers, where it comes with two sets of numbers or more, so
    that the bare base names none of them."""
    told = names.select(*keys, unnumbered(F.col(name)).alias("base"), numbers(F.col(name)).alias("_n")).where(F.size("_n") > 0)
    return told.groupBy(*keys, "base").agg(F.count_distinct("_n").alias("_sets")).where("_sets > 1").drop("_sets")


def with_veto(pairs: DataFrame, bases: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Adds ``veto`` to pairs of names: numbers on both sides that differ; or on one side only, if the base of that side
    is among ``bases`` (keys, base) and the names without numbers are AMBIGUOUS_RATIO alike or more."""
    x, y = numbers(F.col(a)), numbers(F.col(b))
    one = (F.size(x) > 0) != (F.size(y) > 0)
    told = pairs.withColumn("base", F.when(one, F.when(F.size(x) > 0, unnumbered(F.col(a))).otherwise(unnumbered(F.col(b)))))
    told = told.join(bases.withColumn("_known", F.lit(True)), [*keys, "base"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    alike = similarity("ratio", F.when(F.col("_known"), unnumbered(F.col(a))), F.when(F.col("_known"), unnumbered(F.col(b)))) >= AMBIGUOUS_RATIO
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return told.withColumn("veto", F.when(both, x != y).otherwise(F.col("_known") & alike)).drop("base", "_known").select(*pairs.columns, "veto")


def named_pairs(rows: DataFrame, key: str, whole: DataFrame | None = None) -> DataFrame:
    """(key, ref_name, sys_name, score, veto): each distinct name of a key's reference side with each of its system side
    (what an assignment has to weigh), scored once; numbers are ambiguous over both sides of ``whole`` (``rows``)."""
    side = lambda s: rows.where(F.col("side") == s).select(key, F.col("name").alias(f"{s}_name")).distinct()
    pairs = with_veto(side("ref").join(side("sys"), key), numbered_bases(rows if whole is None else whole, [key], "name"), [key], "ref_name", "sys_name")
    return pairs.withColumn("score", similarity("partial_ratio", F.col("ref_name"), F.col("sys_name"))).toDF(key, "ref_name", "sys_name", "veto", "score")


MATCH = "ref_id long, sys_id long, score double, status string"


def _matched(k, left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray, score: np.ndarray, status: np.ndarray, key: str) -> pd.DataFrame:
    """Rows of the pairs (i, j), then of what neither side's pairs hold."""
    rest = [np.setdiff1d(np.arange(len(side)), of) for side, of in ((left, i), (right, j))]
    none = lambda of: pd.array([None] * len(of), "Int64")
    ids = lambda side, of: pd.array(side["id"].to_numpy()[of], "Int64")
    parts = [(ids(left, i), ids(right, j), score, status), (ids(left, rest[0]), none(rest[0]), np.nan, "ref_only"), (none(rest[1]), ids(right, rest[1]), np.nan, "sys_only")]
    return pd.concat([pd.DataFrame({key: [k] * len(a), "ref_id": a, "sys_id": b, "score": pd.array(np.broadcast_to(np.asarray(s, float), len(a)), "Float64"), "status": t}) for a, b, s, t in parts], ignore_index=True)


def _sides(table: pd.DataFrame, order: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    table = table.sort_values(order, kind="stable")
    return tuple(table[table["side"] == s].reset_index(drop=True) for s in ("ref", "sys"))


def _kinds(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A side's entities in order of their kinds (name, capacity) and ids; by kind, its first place there; and its entities."""
    kind = side.groupby(["name", "capacity"], dropna=False).ngroup().to_numpy()
    order = np.lexsort((side["id"].to_numpy(), kind))
    size = np.bincount(kind)
    return order, np.cumsum(size) - size, size


def _taken(kind: np.ndarray, other: np.ndarray, units: np.ndarray) -> np.ndarray:
    """How many units of its kind come before each flow's, in order of the other side's kinds."""
    order = np.lexsort((other, kind))
    before = np.cumsum(units[order]) - units[order]
    first = np.diff(kind[order], prepend=-1) != 0
    out = np.empty(len(units), np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(units))))
    return out


def solved(table: pd.DataFrame, pairs: pd.DataFrame, key: str) -> pd.DataFrame:
    """One key of ``optimal_match``: its entities and its pairs of names. What is solved are kinds of entities (name, capacity)
    and how many there are of each; entities of a kind are dealt in order of id."""
    left, right = _sides(table, ["name", "id"])
    k, n, m = table[key].iloc[0], len(left), len(right)
    if not n or not m:
        none = np.zeros(0, np.int64)
        return _matched(k, left, right, none, none, np.zeros(0), none.astype(str), key)
    names = [{x: p for p, x in enumerate(dict.fromkeys(s["name"]))} for s in (left, right)]
    score, veto = np.zeros((len(names[0]), len(names[1]))), np.zeros((len(names[0]), len(names[1])), bool)
    at = pairs["ref_name"].map(names[0]).to_numpy(), pairs["sys_name"].map(names[1]).to_numpy()
    score[at], veto[at] = pairs["score"], pairs["veto"]
    price = np.where(score >= NAME_FUZZY, FUZZY, MISMATCH)
    for x in names[0].keys() & names[1].keys():
        price[names[0][x], names[1][x]] = 0.0
    (by, start, size), (by_sys, start_sys, size_sys) = _kinds(left), _kinds(right)
    p, q = left["name"].map(names[0]).to_numpy()[by[start]], right["name"].map(names[1]).to_numpy()[by_sys[start_sys]]
    a, b = left["capacity"].to_numpy(float)[by[start]], right["capacity"].to_numpy(float)[by_sys[start_sys]]
    # the smaller side picks a partner, or none at the price of two entities left over
    if n <= m:
        i, j, units = transported(Costs(price, veto, p, q, a, b), size, size_sys, STAY)
    else:
        j, i, units = transported(Costs(price.T, veto.T, q, p, b, a), size_sys, size, STAY)
    x, y, found = left["name"].to_numpy()[by[start[i]]], right["name"].to_numpy()[by_sys[start_sys[j]]], score[p[i], q[j]]
    kind = np.where(x == y, "exact", np.where(found < NAME_FUZZY, "mismatched", np.where(np.abs(a[i] - b[j]) == 0, "fuzzy", "fuzzy_diff")))
    within = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    each = lambda first: np.repeat(first, units) + within
    return _matched(k, left, right, by[each(start[i] + _taken(i, j, units))], by_sys[each(start_sys[j] + _taken(j, i, units))], np.repeat(found, units), np.repeat(kind, units), key)


def optimal_match(rows: DataFrame, key: str) -> DataFrame:
    """(key, ref_id, sys_id, score, status) from (key, side 'ref' or 'sys', id, name, capacity): the one-to-one match of
    each key with least cost, every entity left over as a row of its own.

    A pair costs nothing for equal names, FUZZY for alike ones, MISMATCH for others, with CAPACITY_STEP a unit of
    capacity between them; MISMATCH where a capacity is null; a vetoed pair more than two entities left over, at
    UNMATCHED each. Names are scored and vetoed by one plan over all keys; what a task solves is a key (a run against its
    reference list), with a table over its distinct names in memory but no matrix over its entities, in a time that goes with
    its kinds of entities (name, capacity). Statuses: exact, fuzzy (same capacity), fuzzy_diff, mismatched, ref_only, sys_only.
    """

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).cogroup(named_pairs(rows, key).groupBy(key)).applyInPandas(lambda table, pairs: solved(table, pairs, key), f"{key} {kind}, {MATCH}")


def phased_match(rows: DataFrame, key: str) -> DataFrame:
    """(key, ref_id, sys_id, score, status) by phases: equal (name, capacity) pair off in order of id (a rank on both
    sides and an equi-join; a null capacity equals none); of the rest, reference by reference takes the free name that
    is most alike, from NAME_FUZZY on, unless numbers veto it (bases being ambiguous over both whole sides). Only pairs
    that may be taken reach the tasks that take them."""
    rank = F.row_number().over(Window.partitionBy(key, "side", "name", "capacity").orderBy("id"))
    ranked = rows.where("capacity is not null").withColumn("_rank", rank)
    side = lambda s, p: ranked.where(F.col("side") == s).select(key, F.col("id").alias(f"{p}_id"), "name", "capacity", "_rank")
    exact = side("ref", "ref").join(side("sys", "sys"), [key, "name", "capacity", "_rank"]).select(key, "ref_id", "sys_id", F.lit(100.0).alias("score"), F.lit("exact").alias("status"))
    used = exact.select(key, F.lit("ref").alias("side"), F.col("ref_id").alias("id")).union(exact.select(key, F.lit("sys"), F.col("sys_id")))
    rest = rows.join(used, [key, "side", "id"], "left_anti")

    def take(table: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(table, ["id"])
        near, free, out = {}, {}, []
        for x, y, s in zip(pairs["ref_name"], pairs["sys_name"], pairs["score"], strict=True):
            near.setdefault(x, []).append((y, s))
        for j in range(len(right) - 1, -1, -1):  # the first of a name is on top
            free.setdefault(right["name"].iloc[j], []).append(j)
        gap = lambda i, j: abs(left["capacity"].iloc[i] - right["capacity"].iloc[j])
        for i, x in enumerate(left["name"]):
            found = [(s, -free[y][-1], y) for y, s in near.get(x, []) if free.get(y)]
            if found:
                s, _, y = max(found)
                j = free[y].pop()
                out.append((i, j, float(s), "fuzzy_diff" if gap(i, j) > 0 else "fuzzy"))
        i, j, s, status = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
        return _matched(table[key].iloc[0], left, right, np.array(i, np.int64), np.array(j, np.int64), np.array(s, float), np.array(status, object), key)

    pairs = named_pairs(rest, key, rows).where(f"score >= {NAME_FUZZY} and not veto")
    kind = rows.schema[key].dataType.simpleString()
    return exact.union(rest.groupBy(key).cogroup(pairs.groupBy(key)).applyInPandas(take, f"{key} {kind}, {MATCH}"))


def greedy_match(scored: DataFrame, key: str, left: str, right: str, cost: str) -> DataFrame:
    """Pairs by ascending cost, each side once, up to UNMATCHED; ties by left and right id."""
    schema = scored.select(key, left, right, cost).schema

    def pick(table: pd.DataFrame) -> pd.DataFrame:
        a, b, keep = set(), set(), []
        for row in table.sort_values([cost, left, right], kind="stable").itertuples():
            x, y = getattr(row, left), getattr(row, right)
            keep.append(x not in a and y not in b)
            if keep[-1]:
                a.add(x)
                b.add(y)
        return table.sort_values([cost, left, right], kind="stable")[keep]

    return scored.where(F.col(cost) < UNMATCHED).select(key, left, right, cost).groupBy(key).applyInPandas(pick, schema)


def split_mismatches(matches: DataFrame) -> DataFrame:
    """A mismatched pair becomes a missed and an invented entity."""
    pair = F.array(F.struct("ref_id", F.lit(None).cast("long").alias("sys_id"), F.lit("ref_only").alias("status")), F.struct(F.lit(None).cast("long").alias("ref_id"), F.col("sys_id"), F.lit("sys_only").alias("status")))
    own = F.array(F.struct("ref_id", "sys_id", "status"))
    rest = [c for c in matches.columns if c not in ("ref_id", "sys_id", "status")]
    return matches.withColumn("_x", F.explode(F.when(F.col("status") == "mismatched", pair).otherwise(own))).select(*rest, "_x.*")


def single_unit_names(rows: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """Names that end in " 1" lose it where their base occurs once in the reference."""
    base = F.regexp_replace(name, r" \d+$", "")
    lone = reference.select(base.alias("_base")).groupBy("_base").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    out = rows.withColumn("_base", F.regexp_extract(name, r"^(.*) 1$", 1)).join(lone, "_base", "left")
    return out.withColumn(name, F.when((F.col("_base") != "") & F.col("_n").isNotNull(), F.col("_base")).otherwise(F.col(name))).drop("_base", "_n")


def unit_names(name: Column) -> Column:
    """The names that a name stands for: of two numbered units ("base 3 & 4", "base 3 va 4") both, else the name alone."""
    pattern = r"^(.*\S)\s*\b(\d+)\s*(?:&|va)\s*(\d+)\s*$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    both = F.array(F.concat_ws(" ", part(1), part(2)), F.concat_ws(" ", part(1), part(3)))
    return F.when(part(1) != "", both).otherwise(F.array(name))


def expand_units(rows: DataFrame, name: str) -> DataFrame:
    """A name of two numbered units becomes two rows; see ``unit_names``."""
    return rows.withColumn(name, F.explode(unit_names(F.col(name))))


def first_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_rn = 1").drop("_rn")


def matched_attributes(matches: DataFrame, reference: DataFrame, system: DataFrame) -> DataFrame:
    """Adds both sides' attributes (ref_*, sys_*) by id; null where a side has none."""
    pre = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return matches.join(pre(reference, "ref"), "ref_id", "left").join(pre(system, "sys"), "sys_id", "left")


def recognition_matrix(runs: DataFrame, reference: DataFrame, hits: DataFrame, run: str, entity: str) -> DataFrame:
    """Every run by every reference entity with whether it was hit: by definition a row for each pair of them."""
    grid = runs.select(run).distinct().crossJoin(reference.select(entity).distinct())
    return grid.join(hits.select(run, entity).distinct().withColumn("hit", F.lit(True)), [run, entity], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def close_pairs(names: DataFrame, name: str, least: float) -> DataFrame:
    """Distinct names a < b of partial ratio ``least`` or more, and whether their numbers veto the pair."""
    near = alike_within(names, name, "partial_ratio", least)
    return with_veto(near, numbered_bases(names.select(F.col(name).alias("a")).distinct(), [], "a"), [], "a", "b")


def resolve_by_key_or_only(runs: DataFrame, scores: DataFrame, exact: list[str], loose: str, value: str) -> DataFrame:
    """``value`` by the exact key, or by ``loose`` where that has one score row only."""
    only = scores.groupBy(loose).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_only")).where("_n = 1").drop("_n")
    by_key = scores.groupBy(*exact).agg(F.max(value).alias("_exact"))
    return runs.join(by_key, exact, "left").join(only, loose, "left").withColumn(value, F.coalesce("_exact", "_only")).drop("_exact", "_only")


def membership(reference: DataFrame, key: str, layers: dict[str, DataFrame]) -> DataFrame:
    """A 0/1 column for each layer that holds the key."""
    for name, layer in layers.items():
        flag = layer.select(key).distinct().withColumn(f"in_{name}", F.lit(1))
        reference = reference.join(flag, key, "left").na.fill(0, [f"in_{name}"])
    return reference
