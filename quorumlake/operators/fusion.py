"""Fusion of many runs into one estimate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidence weights; and the latent-truth model's prior, start and bounds.
CONFIDENCE = {"HIGH": 3.0, "MEDIUM": 2.0, "LOW": 1.0}
PRIOR_RATE, PRIOR_HIGH, PRIOR_LOW, START, LOW, HIGH, ROUNDS = 0.5, 0.8, 0.3, 0.7, 0.01, 0.99, 60


def union_of(assertions: DataFrame, entity: str) -> DataFrame:
    return assertions.select(entity).distinct()


def quorum(assertions: DataFrame, run: str, entity: str, least: int) -> DataFrame:
    """Entities that ``least`` runs (or models) assert."""
    return assertions.groupBy(entity).agg(F.count_distinct(run).alias("n_runs")).where(F.col("n_runs") >= least)


def confidence_weighted(assertions: DataFrame, run: str, entity: str, weight: Column, order: str, least: float) -> DataFrame:
    """Entities whose runs' confidence weights add up to ``least``; a run counts its last row of the entity."""
    per_run = assertions.groupBy(run, entity).agg(F.max_by(weight, F.col(order)).alias("_w"))
    return per_run.groupBy(entity).agg(F.sum("_w").alias("weight")).where(F.col("weight") >= least)


def majority(assertions: DataFrame, run: str, entity: str, attributes: list[str], n_runs: int) -> DataFrame:
    """Entities of most runs, with the attributes of the run that names most entities (the first of equals)."""
    sizes = assertions.groupBy(run).agg(F.count_distinct(entity).alias("_size"))
    votes = quorum(assertions, run, entity, n_runs // 2 + 1)
    # the least of (-size, run, attributes) is told as rows are read: no entity's rows are sorted or held
    order = F.struct((-F.col("_size")).alias("_size"), F.col(run).alias("_run"), *[F.col(a).alias(f"_{k}") for k, a in enumerate(attributes)])
    best = assertions.join(sizes, run).groupBy(entity).agg(F.min(order).alias("_b")).select(entity, *[F.col(f"_b._{k}").alias(a) for k, a in enumerate(attributes)])
    return votes.join(best, entity)


def highest_authority(facts: DataFrame, entity: str, field: str, value: str, order: list[str]) -> DataFrame:
    """The value of each entity's field that is last by ``order``, whatever came before; nulls never win."""
    return facts.where(F.col(value).isNotNull()).groupBy(entity, field).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count_distinct(value).alias("n_values"))


def authority_changes(facts: DataFrame, entity: str, field: str, value: str, tier: str, year: str, seq: str) -> DataFrame:
    """(entity, field, seq, value, change) of each fact that has a value, in order of ``seq`` (no two facts of a field share
    one): what an incremental fusion makes of it.

    The first value is set. A later one replaces the value that stands, and its tier and year, if it is another one of no
    lower tier, or of the same tier and no earlier year; else it is refused. An equal value is confirmed and changes
    nothing: the first one's tier and year stay. A fold over the facts of one field of an entity, of which each source
    has one, so that one row holds them.
    """
    types = {c: facts.schema[c].dataType.simpleString() for c in (value, tier, year, seq)}
    fact = F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"), F.col(tier).alias("tier"), F.col(year).alias("year"))
    told = f"array<struct<seq:{types[seq]},value:{types[value]},change:string>>"
    start = F.expr(f"named_struct('value', cast(null as {types[value]}), 'tier', cast(null as {types[tier]}), 'year', cast(null as {types[year]}), 'told', cast(array() as {told}))")

    def step(s: Column, x: Column) -> Column:
        ranks = (x["tier"] > s["tier"]) | ((x["tier"] == s["tier"]) & (x["year"] >= s["year"]))
        change = F.when(s["value"].isNull(), "set").when(x["value"] == s["value"], "confirmed").when(F.coalesce(ranks, F.lit(False)), "replaced").otherwise("refused")
        taken = change.isin("set", "replaced")
        stands = [F.when(taken, x[c]).otherwise(s[c]).alias(c) for c in ("value", "tier", "year")]
        return F.struct(*stands, F.concat(s["told"], F.array(F.struct(x["seq"].alias("seq"), x["value"].alias("value"), change.alias("change")))).alias("told"))

    known = facts.where(F.col(value).isNotNull()).groupBy(entity, field).agg(F.array_sort(F.collect_list(fact)).alias("_f"))
    out = known.select(entity, field, F.explode(F.aggregate("_f", start, step, lambda s: s["told"])).alias("_x"))
    return out.select(entity, field, F.col("_x.seq").alias(seq), F.col("_x.value").alias("value"), F.col("_x.change").alias("change"))


def authority(facts: DataFrame, entity: str, field: str, value: str, tier: str, year: str, seq: str) -> DataFrame:
    """(entity, field, value, n_changes): the value that stands after all facts, and how often one was set or replaced; see
    ``authority_changes``."""
    taken = authority_changes(facts, entity, field, value, tier, year, seq).where("change in ('set', 'replaced')")
    return taken.groupBy(entity, field).agg(F.max_by("value", seq).alias("value"), F.count(F.lit(1)).alias("n_changes"))


def prefix_scores(changes: DataFrame, reference: DataFrame, entity: str, field: str, seq: str, value: str) -> DataFrame:
    """(seq, n_entities, n_found, n_facts, n_right, precision, coverage, f1, field_accuracy) after each step of an
    incremental fusion, without fusing again: ``changes`` as ``authority_changes`` gives them, ``reference`` (entity, field,
    value).

    A value stands from the step that takes it to the step that takes the next one, so that each adds to the counts where
    it begins and takes away where it ends; an entity counts from its first value on. Sums of these differences over
    steps, of which there are as many rows as steps, are the counts of each prefix.
    """
    steps = changes.select(seq).distinct()
    taken = changes.where("change in ('set', 'replaced')").select(entity, field, seq, F.col("value").alias("_v"))
    until = F.lead(seq).over(Window.partitionBy(entity, field).orderBy(seq))
    known = reference.select(entity, field, F.col(value).alias("_r"))
    held = taken.withColumn("_until", until).join(known, [entity, field], "left").withColumn("_right", F.coalesce(F.col("_v") == F.col("_r"), F.lit(False)).cast("long"))
    began = held.select(F.col(seq).alias("_at"), F.lit(1).alias("facts"), F.col("_right").alias("right"))
    ended = held.where("_until is not null").select("_until", F.lit(-1), -F.col("_right"))
    first = taken.groupBy(entity).agg(F.min(seq).alias("_at")).join(reference.select(entity).distinct().withColumn("_in", F.lit(1)), entity, "left")
    sums = began.union(ended).groupBy("_at").agg(F.sum("facts").alias("facts"), F.sum("right").alias("right"))
    new = first.groupBy("_at").agg(F.count(F.lit(1)).alias("entities"), F.count("_in").alias("found"))
    deltas = steps.withColumn("_at", F.col(seq)).join(sums, "_at", "left").join(new, "_at", "left").na.fill(0, ["facts", "right", "entities", "found"])
    so_far = lambda c: F.sum(c).over(Window.orderBy(seq)).cast("long")
    out = deltas.select(seq, so_far("entities").alias("n_entities"), so_far("found").alias("n_found"), so_far("facts").alias("n_facts"), so_far("right").alias("n_right"))
    size = reference.select(entity).distinct().agg(F.count(F.lit(1)).alias("_size"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    found, size_ = F.col("n_found"), F.col("_size")
    out = out.crossJoin(F.broadcast(size))
    return out.select(
        seq, "n_entities", "n_found", "n_facts", "n_right",
        ratio(found, F.col("n_entities")).alias("precision"), ratio(found, size_).alias("coverage"), ratio(2 * found, F.col("n_entities") + size_).alias("f1"), ratio(F.col("n_right"), F.col("n_facts")).alias("field_accuracy"),
    )


def best_group(runs: DataFrame, group: str, value: str) -> DataFrame:
    """The group of the highest mean value, the first of equals."""
    means = runs.groupBy(group).agg(F.avg(value).alias("mean"))
    return means.orderBy(F.desc("mean"), group).limit(1)


MERGES = ("union", "majority_2", "majority_3", "confidence_weighted")


def pools(runs: DataFrame, model: str, run: str, cost: str, size: int) -> DataFrame:
    """(rule, run) of ``size`` runs each: the first ones, the cheapest, the dearest, and models in turn."""
    first = lambda order, rule: runs.orderBy(*order).limit(size).select(F.lit(rule).alias("rule"), run)
    turn = runs.withColumn("_k", F.row_number().over(Window.partitionBy(model).orderBy(run)))
    alternating = turn.orderBy("_k", model).limit(size).select(F.lit("alternating").alias("rule"), run)
    return first([run], "first").union(first([cost, run], "cheapest")).union(first([F.desc(cost), run], "dearest")).union(alternating)


def quorum_sweep(assertions: DataFrame, chosen: DataFrame, reference: DataFrame, run: str, entity: str, quorums: list[int]) -> DataFrame:
    """(rule, quorum, candidates, tp, recall, precision): each pool of runs merged by each quorum (1 is the union)."""
    votes = chosen.join(assertions, run).groupBy("rule", entity).agg(F.count_distinct(run).alias("_n"))
    grid = assertions.sparkSession.createDataFrame([(k,) for k in quorums], "quorum int")
    kept = votes.join(F.broadcast(grid), F.col("_n") >= F.col("quorum"))
    known = reference.select(entity).distinct().withColumn("_ref", F.lit(1))
    per = kept.join(known, entity, "left").groupBy("rule", "quorum").agg(F.count(F.lit(1)).alias("candidates"), F.count("_ref").alias("tp"))
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    return per.join(F.broadcast(total)).withColumn("recall", F.try_divide("tp", "_total")).withColumn("precision", F.col("tp") / F.col("candidates")).drop("_total")


def model_pools(runs: DataFrame, model: str, run: str, cost: str, sizes: list[int]) -> DataFrame:
    """(size, rule, pool, run): the pools of each size by four rules. intra_model: the first runs of each model that has
    enough of them, a pool a model; cross_model_low, _high and _mixed: the first run of the cheapest, the dearest, or
    in turn the cheapest and the dearest models by mean cost. A rule without enough models has no pool."""
    grid = runs.sparkSession.createDataFrame([(int(s),) for s in sizes], "size int")
    ranked = runs.withColumn("_k", F.row_number().over(Window.partitionBy(model).orderBy(run))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(model)))
    own = ranked.join(F.broadcast(grid), F.col("_k") <= F.col("size")).where("_n >= size").select("size", F.lit("intra_model").alias("rule"), F.col(model).cast("string").alias("pool"), run)
    means = runs.groupBy(model).agg(F.avg(cost).alias("_cost"), F.min(run).alias(run))
    low, high = Window.orderBy("_cost", model), Window.orderBy(F.desc("_cost"), model)
    places = means.withColumn("_low", F.row_number().over(low)).withColumn("_high", F.row_number().over(high))
    # in turn: the k-th cheapest is pick 2k - 1, the k-th dearest pick 2k; a model counts where it comes first
    places = places.withColumn("_turn", F.row_number().over(Window.orderBy(F.least(2 * F.col("_low") - 1, 2 * F.col("_high")))))
    cross = [places.join(F.broadcast(grid), F.col(c) <= F.col("size")).select("size", F.lit(f"cross_model_{rule}").alias("rule"), F.lit("all").alias("pool"), run) for rule, c in (("low", "_low"), ("high", "_high"), ("mixed", "_turn"))]
    out = own.union(cross[0]).union(cross[1]).union(cross[2])
    enough = out.groupBy("size", "rule", "pool").agg(F.count(F.lit(1)).alias("_n")).where("_n = size").drop("_n")
    return out.join(enough, ["size", "rule", "pool"])


def has_confidence(assertions: DataFrame, by: list[str], confidence: str) -> DataFrame:
    """(by, has_confidence): whether any row says how sure it is."""
    return assertions.groupBy(*by).agg(F.coalesce(F.bool_or(F.trim(F.col(confidence).cast("string")) != ""), F.lit(False)).alias("has_confidence"))


def aggregation_sweep(assertions: DataFrame, chosen: DataFrame, reference: DataFrame, run: str, entity: str, confidence: str, costs: DataFrame, cost: str) -> DataFrame:
    """(merge, size, rule, n_pools, recall, precision, f1, n_entities, cost): every pool of ``chosen`` (size, rule, pool,
    run) merged in each of MERGES against a reference, averaged over the pools of a rule. A weighted merge keeps
    entities whose weights of confidence (a run's last row of the entity: HIGH 3, MEDIUM 2, LOW 1) reach half the pool's
    size; a pool without any confidence has no such merge. Rules and merges without a pool are rows of nulls with
    n_pools 0."""
    pool = ["size", "rule", "pool"]
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.upper(F.trim(F.col(confidence).cast("string"))))
    rows = chosen.join(assertions.groupBy(run, entity).agg(F.max(weight).alias("_w")), run)
    votes = rows.groupBy(*pool, entity).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
    sure = rows.groupBy(*pool).agg(F.max(F.col("_w").isNotNull()).alias("_sure"))
    known = reference.select(entity).distinct().withColumn("_ref", F.lit(1))
    kept = F.array(F.lit("union"), F.when(F.col("_n") >= 2, "majority_2"), F.when(F.col("_n") >= 3, "majority_3"), F.when(F.col("_w") >= 0.5 * F.col("size"), "confidence_weighted"))
    told = votes.select(*pool, entity, F.explode(F.filter(kept, lambda x: x.isNotNull())).alias("merge")).join(known, entity, "left")
    per = told.groupBy("merge", *pool).agg(F.count(F.lit(1)).alias("n_entities"), F.count("_ref").alias("_tp"))
    merges = assertions.sparkSession.createDataFrame([(m,) for m in MERGES], "merge string")
    paid = chosen.join(costs.select(run, F.col(cost).alias("_cost")), run, "left").groupBy(*pool).agg(F.sum("_cost").alias("cost")).join(sure, pool, "left")
    each = paid.join(F.broadcast(merges)).where("merge <> 'confidence_weighted' or coalesce(_sure, false)").join(per, ["merge", *pool], "left").na.fill(0, ["n_entities", "_tp"])
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    each = each.join(F.broadcast(total)).withColumn("recall", F.coalesce(F.try_divide("_tp", "_total"), F.lit(0.0))).withColumn("precision", F.coalesce(F.try_divide("_tp", "n_entities"), F.lit(0.0)))
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("n_entities") + F.col("_total")), F.lit(0.0)))
    means = each.groupBy("merge", "size", "rule").agg(F.count(F.lit(1)).alias("n_pools"), *(F.avg(c).alias(c) for c in ("recall", "precision", "f1", "n_entities", "cost")))
    sizes = chosen.select("size").distinct()
    rules = assertions.sparkSession.createDataFrame([(r,) for r in ("intra_model", "cross_model_low", "cross_model_high", "cross_model_mixed")], "rule string")
    return sizes.join(F.broadcast(rules)).join(F.broadcast(merges)).join(means, ["merge", "size", "rule"], "left").na.fill(0, ["n_pools"])


#: Cells (models by strata) whose reliabilities the driver holds between rounds, at most.
TRUST_CELLS = 1_000_000


def _step(models: int, trust: dict[tuple, tuple[np.ndarray, np.ndarray]], n_runs: np.ndarray, told: bool):
    """One round over (stratum, anchored, prior, n, models, votes, pattern): each group's sums over its patterns, weighed
    by their number and existence; or, in the end (``told``), the existence of each pattern."""

    def existence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        votes = np.zeros((batch.num_rows, models))
        held = batch.column("votes")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
        flat = held.flatten()
        votes[rows, flat.field("at").to_numpy()] = flat.field("k").to_numpy()
        groups = list(zip(batch.column("stratum").to_pylist(), batch.column("anchored").to_pylist(), strict=True))
        prior = batch.column("prior").to_numpy()
        odds = np.log(prior) - np.log(1 - prior)
        for g in set(groups):
            sens, spec = trust[g]
            of = np.array([x == g for x in groups])
            for_, against = np.log(sens) - np.log(1 - spec), np.log(1 - sens) - np.log(spec)
            odds[of] += votes[of] @ for_ + (n_runs - votes[of]) @ against
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700))), votes, groups

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(existence(batch)[0])], ["pattern", "q"])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            q, votes, groups = existence(batch)
            n = batch.column("n").to_numpy()
            for g in set(groups):
                of = np.array([x == g for x in groups])
                yes, no = q[of] * n[of], (1 - q[of]) * n[of]
                total[g] = total.get(g, 0.0) + np.concatenate([yes @ votes[of], no @ votes[of], [yes.sum(), no.sum()]])
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in keys], pa.string()), pa.array([g[1] for g in keys], pa.bool_()), pa.array([total[g].tolist() for g in keys], pa.list_(pa.float64()))], ["stratum", "anchored", "total"])

    return tell if told else sums


def latent_truth(assertions: DataFrame, entities: DataFrame, runs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Existence of entities and reliability of models by EM.

    ``assertions`` (run, entity), ``entities`` (entity, anchored, stratum), ``runs`` (run, model). What matters of an
    entity is its stratum, whether it is anchored, and how many runs of each model assert it; entities alike in these
    are one pattern with a count, written once and kept by the executors. Sensitivity and specificity are numbers by
    (model, stratum, anchored): at most TRUST_CELLS, which the driver holds (a larger table is an error) and hands to
    each round; a round is one pass over the patterns that returns a row of sums for each group and task.
    """
    from quorumlake.sources.tables import written

    spark = assertions.sparkSession
    strata = entities.select(F.col("stratum").cast("string").alias("stratum"), "anchored").distinct().limit(TRUST_CELLS + 1).collect()
    per_model = runs.groupBy("model").agg(F.count_distinct("run").alias("n")).limit(TRUST_CELLS + 1).collect()
    if len(strata) * len(per_model) > TRUST_CELLS:
        raise ValueError(f"more than {TRUST_CELLS} cells of model, stratum and anchor")
    per_model.sort(key=lambda r: str(r["model"]))
    models, n_runs = len(per_model), np.array([r["n"] for r in per_model], float)
    numbered = spark.createDataFrame([(r["model"], k) for k, r in enumerate(per_model)], f"model {runs.schema['model'].dataType.simpleString()}, at int")
    total = runs.select(F.count_distinct("run")).first()[0] or 0
    told = assertions.distinct().join(runs.join(F.broadcast(numbered), "model"), "run").groupBy("entity", "at").agg(F.count(F.lit(1)).alias("k"))
    counts = told.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("votes"), F.sum("k").alias("asserted"))
    known = entities.withColumn("_stratum", F.col("stratum").cast("string")).join(counts, "entity", "left")
    known = known.withColumns({"asserted": F.coalesce("asserted", F.lit(0)), "votes": F.coalesce("votes", F.array().cast("array<struct<at:int,k:bigint>>"))})
    known = written(known.withColumn("pattern", F.xxhash64("_stratum", "anchored", "votes", "asserted")), "entities")
    first = {c: F.first(c).alias(c) for c in ("anchored", "votes", "asserted")}
    patterns = known.groupBy("pattern").agg(F.first("_stratum").alias("stratum"), *first.values(), F.count(F.lit(1)).alias("n"))
    patterns = patterns.withColumn("rate", F.col("asserted") / max(total, 1))
    means = patterns.agg(F.sum(F.when(F.col("anchored"), F.col("rate") * F.col("n"))) / F.sum(F.when(F.col("anchored"), F.col("n"))), F.sum(F.col("rate") * F.col("n")) / F.sum("n")).first()
    c = min(max(means[0] / max(means[1], 1e-6), 0.1), 0.95) if means[0] is not None else 0.5
    base = F.when(F.col("rate") >= PRIOR_RATE, PRIOR_HIGH).otherwise(PRIOR_LOW)
    prior = F.when(F.col("anchored"), F.least(base / max(c, 0.1), F.lit(0.99))).otherwise(base)
    patterns = written(patterns.select("pattern", "stratum", "anchored", "n", prior.alias("prior"), "votes"), "patterns").persist()
    start = lambda: (np.full(models, START), np.full(models, START))
    trust = {(r["stratum"], r["anchored"]): start() for r in strata}
    used = trust
    for _ in range(rounds):
        used, held = trust, dict.fromkeys(trust, 0.0)
        for r in patterns.mapInArrow(_step(models, trust, n_runs, False), "stratum string, anchored boolean, total array<double>").collect():
            held[r["stratum"], r["anchored"]] = held[r["stratum"], r["anchored"]] + np.array(r["total"])
        before, trust = trust, {}
        for g, x in held.items():
            yes, no = x[:models], x[models : 2 * models]
            clip = lambda a, b: np.clip(a / np.maximum(b, 1e-9), LOW, HIGH)
            trust[g] = clip(yes, x[-2] * n_runs), clip(x[-1] * n_runs - no, x[-1] * n_runs)
        if all(np.array_equal(trust[g][k], before[g][k]) for g in trust for k in (0, 1)):
            break  # further rounds would repeat this one
    existence = written(patterns.mapInArrow(_step(models, used, n_runs, True), "pattern long, q double"), "existence")
    patterns.unpersist()
    # a group without entities keeps the start
    full = [(r["model"], s, *(float(np.mean([trust.get((s, a), start())[k][m] for a in (True, False)])) for k in (0, 1))) for m, r in enumerate(per_model) for s in sorted({g[0] for g in trust}, key=str)]
    kind = runs.schema["model"].dataType.simpleString()
    reliability = spark.createDataFrame(full, f"model {kind}, stratum string, sensitivity double, specificity double")
    return known.join(existence, "pattern").select("entity", "anchored", "stratum", F.col("q").alias("existence")), reliability
