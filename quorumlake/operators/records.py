"""Run records: flat measurements, labels, costs, classes of failures, what is loaded and what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.operators.ordered import Ordered

#: What a run record holds (fields that a file lacks are null).
SCHEMA = (
    "run_id string, method string, result_file string, reference string, agent_family string, agent_mode string, synopsis_sha string, designed_prompt_sha string, web_search_calls array<string>, citations array<string>,"
    "parsed_table_path string, finish_reason string, retry_count bigint, error string, reasoning_summary string, tool_calls_cost_usd double,"
    "method_params struct<model string, prompt_version string, temperature double, max_tokens bigint, extra map<string, string>>,"
    "result_summary struct<tp bigint, fp bigint, fn bigint, f1 double, fuel_accuracy double, status_accuracy double, province_accuracy double>,"
    "resource_use struct<cost_usd double, wall_s double, tokens_in bigint, tokens_out bigint, thinking_tokens bigint>,"
    "justification struct<verification_mode string, mean_evidence_score double, verification_cost_usd double, faithfulness_score double>"
)
#: Fields that only some records have: null where a record lacks them.
OPTIONAL = ("seed", "num_ctx", "provider_order", "web_search", "system_instruction", "reasoning_effort")
# What of a folder's name tells the method, first rule first.
METHODS = (("multiturn", "direct+multiturn"), ("verification", "rag+verification"), ("web", "rag_livesearch"), ("rag", "rag"), ("decomposed", "rag"), ("sourced", "rag"))
# Parts of a message that end a sweep, or a model's part in it.
SPENT_WORDS = ("insufficient credit", "insufficient_credits", "out of credit", "credit balance", "billing", "payment required")
QUOTA_WORDS = ("quota_exceeded", "quota exceeded", "daily quota", "daily usage", "daily limit")


def measurements(records: DataFrame, method: str | None = None) -> DataFrame:
    """A flat row for each run record (SCHEMA), of one method if given: label, conditions, coverage and precision from the
    counts (0 without a denominator), accuracies, resources, numbers of searches and citations. Columns of the extra
    parameters and of a justification are null where a record has none."""
    r, n = F.col("result_summary"), lambda c: F.coalesce(c, F.lit(0))
    tp, fp, fn = n(r["tp"]), n(r["fp"]), n(r["fn"])
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    m, extra, used = F.col("method_params"), F.col("method_params.extra"), F.col("resource_use")
    stem = F.coalesce(F.regexp_extract(F.nullif("result_file", F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1), F.col("run_id"))
    out = {
        "label": F.concat_ws("/", F.nullif(m["prompt_version"], F.lit("")), stem), "model": m["model"], "method": F.col("method"), "prompt_version": m["prompt_version"], "temperature": m["temperature"], "no_think": F.coalesce(extra["no_think"] == "true", F.lit(False)),
        "coverage": share(tp, tp + fn), "precision": share(tp, tp + fp), "f1": F.coalesce(r["f1"], F.lit(0.0)), "n_reference": tp + fn, "n_system": tp + fp, "n_matched": tp, "n_missed": fn, "n_hallucinated": fp,
        **{f"{c}_accuracy": r[f"{c}_accuracy"] for c in ("fuel", "status", "province")},
        "cost_usd": used["cost_usd"], "wall_seconds": used["wall_s"], **{c: used[c] for c in ("tokens_in", "tokens_out", "thinking_tokens")}, "max_tokens": m["max_tokens"], **{c: extra[c] for c in OPTIONAL},
        **{c: F.col(c) for c in ("agent_family", "agent_mode", "synopsis_sha", "designed_prompt_sha", "parsed_table_path", "retry_count", "error", "reference", "reasoning_summary", "tool_calls_cost_usd")},
        "finish_reason": F.coalesce("finish_reason", extra["finish_reason"]), "n_web_search_calls": F.when(F.col("web_search_calls").isNotNull(), F.size("web_search_calls")), "n_citations": F.when(F.col("citations").isNotNull(), F.size("citations")),
        **{c: F.col(f"justification.{c}") for c in ("verification_mode", "mean_evidence_score", "verification_cost_usd", "faithfulness_score")},
    }
    rows = records if method is None else records.where(F.col("method") == method)
    return rows.select(*(c.alias(k) for k, c in out.items()))


def method_of_folder(folder: Column) -> Column:
    """The method that a folder's name tells; direct if nothing else does. "rag" doesn't count in a sourced one."""
    out = F.lit("direct")
    for word, method in reversed(METHODS):
        told = F.contains(folder, F.lit(word))
        out = F.when(told & ~F.contains(folder, F.lit("sourced")) if word == "rag" else told, method).otherwise(out)
    return out


def renamed_values(values: Column, names: dict[str, str]) -> Column:
    """Old names of a vocabulary as new ones; others stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]), values), values)


def renamed_paths(path: Column, folders: dict[str, str]) -> Column:
    """Paths with old folders as new ones; a folder counts as a whole, and the first rule that fits is the one."""
    out = path
    for old, new in reversed(sorted(folders.items())):
        out = F.when(path.rlike(rf"(?:^|/){old}(?:/|$)"), F.regexp_replace(path, rf"(^|/){old}(/|$)", rf"$1{new}$2")).otherwise(out)
    return out


def cohort(path: Column, prefixes: dict[str, str], other: str = "base") -> Column:
    """The label of the first prefix that a path begins with."""
    out = F.lit(other)
    for prefix, label in reversed(list(prefixes.items())):
        out = F.when(path.startswith(prefix), label).otherwise(out)
    return out


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Tokens times price a million; a missing price is 0."""
    none = F.lit(0)
    return (F.coalesce(tokens_in, none) * F.coalesce(price_in, none) + F.coalesce(tokens_out, none) * F.coalesce(price_out, none)) / 1e6


def with_registry(runs: DataFrame, registry: DataFrame, slug: str) -> DataFrame:
    """Runs with their model's metadata (null for an unknown one); a model that the registry lists twice counts once."""
    return runs.join(registry.dropDuplicates([slug]), slug, "left")


def polarity(veto: Column) -> Column:
    """A veto as a score: 1 is good."""
    return 1 - veto


def orphan_class(text: Column) -> Column:
    """What a reply without an inventory is: empty; a refusal, if it opens like one or holds no table; else an error."""
    table = (F.size(F.regexp_extract_all(text, F.lit(r"(?is)```(?:csv)?[ \t]*\n(.*?)```"), F.lit(1))) > 0) | text.rlike(r"(?m)^[^\n|]*\|[^\n|]*\|[^\n|]*\|[^\n]*\n(?:[^\n]*\|[^\n]*\|[^\n]*\|)")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(tx.refusal(text), "refusal").when(table, "error").otherwise("refusal")


def failure_class(kind: Column, status: Column, code: Column, type_: Column, message: Column, bodies: bool = True) -> Column:
    """(disposition, scope) of a provider's failure: HARD_STOP for spent credit (of the router, or of one model) and quotas,
    PERMANENT_SKIP for what a later try can't mend, SOFT_RETRY else.

    A message that tells of spent credit or of a quota is a hard stop whatever the status is, but for 403, 404 and 503;
    with 429 it stops the model alone. Without ``bodies`` messages are read with 429 only.
    """
    say = lambda d, s: F.struct(F.lit(d).alias("disposition"), F.lit(s).alias("scope"))
    low = F.lower(F.coalesce(message, F.lit("")))
    tells = lambda words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    out = (
        F.when(kind == "connection_refused", say("PERMANENT_SKIP", "model"))
        .when(kind == "timeout", say("SOFT_RETRY", "model"))
        .when(status == 402, say("HARD_STOP", "router"))
        .when(code == 402, say("HARD_STOP", "model"))
        .when(F.lower(type_) == "quota_exceeded", say("HARD_STOP", "model"))
        .when((status == 429) & tells(SPENT_WORDS + QUOTA_WORDS), say("HARD_STOP", "model"))
        .when(status.isin(429, 503), say("SOFT_RETRY", "model"))
        .when(status.isin(403, 404), say("PERMANENT_SKIP", "model"))
    )
    if bodies:
        out = out.when(tells(SPENT_WORDS), say("HARD_STOP", "router")).when(tells(QUOTA_WORDS), say("HARD_STOP", "model"))
    return out.otherwise(say("SOFT_RETRY", "model"))


def under(rows: DataFrame, path: str, folder: str, not_ending: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path is ``folder`` or inside it (a longer folder name is another one) and ends with none of
    ``not_ending``; none at all is an error."""
    kept = rows.where(F.col(path).rlike(rf"^{folder}(?:/|$)"))
    for end in not_ending:
        kept = kept.where(~F.col(path).endswith(end))
    if kept.isEmpty():
        raise ValueError(f"nothing is selected from {folder}")
    return kept


def assembled(records: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Records with what their validation says (null where there is none), in the order of ``key``."""
    return records.join(validation.dropDuplicates([key]), key, "left").orderBy(key)


def run_table(metadata: DataFrame, counts: DataFrame, key: str, costs: list[str]) -> DataFrame:
    """(key, cost, n_rows): a run's first known cost of the columns ``costs`` and the rows of its inventory (0)."""
    return metadata.join(counts, key, "left").select(key, F.coalesce(*costs).alias("cost"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def scaling(runs: DataFrame, registry: DataFrame, slug: str, by: list[str], value: str) -> DataFrame:
    """(by, values, n): the values of each model family, method and size, in order; runs of unknown models stay out."""
    return runs.join(registry.dropDuplicates([slug]), slug).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"), F.count(F.lit(1)).alias("n"))


def best_with_fallback(runs: DataFrame, slug: str, value: str, fallback: DataFrame) -> DataFrame:
    """(slug, best): each model's highest value; a model of ``fallback`` (slug, value) without runs keeps that one."""
    best = runs.groupBy(slug).agg(F.max(value).alias("best"))
    return best.join(fallback.select(slug, F.col(value).alias("_spare")), slug, "full").select(slug, F.coalesce("best", "_spare").alias("best"))


def corroboration(arms: DataFrame, matched: DataFrame, quality: DataFrame, keys: list[str], n_reference: int, documents: list[str], arm: str) -> DataFrame:
    """(keys, n_matched, n_supported): for arms with documents from their matches and bibliographies; for the others from
    coverage times the reference's size and rate times rows. Records that could not be parsed stay out."""
    parsed = arms.where("not coalesce(parse_failed, false)")
    with_docs = parsed.where(F.col(arm).isin(*documents)).join(quality, keys).join(matched, keys).select(*keys, "n_matched", "n_supported")
    rest = parsed.where(~F.col(arm).isin(*documents)).select(*keys, F.round(F.col("coverage") * n_reference).cast("long").alias("n_matched"), F.round(F.col("rate") * F.col("n_rows")).cast("long").alias("n_supported"))
    return with_docs.unionByName(rest)


def sidecar_issues(values: DataFrame, provenance: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """(key, issue): where a value and its provenance don't go together: one is null and the other isn't, or a key is on one
    side only."""
    both = values.select(key, F.col(value).alias("_v"), F.lit(True).alias("_l")).join(provenance.select(key, F.col(source).alias("_p"), F.lit(True).alias("_r")), key, "full")
    issue = F.when(F.col("_l").isNull(), "value_missing").when(F.col("_r").isNull(), "provenance_missing").when(F.col("_v").isNull() & F.col("_p").isNotNull(), "value_null").when(F.col("_v").isNotNull() & F.col("_p").isNull(), "provenance_null")
    return both.select(key, issue.alias("issue")).where("issue is not null")


def verifier_panel(rows: DataFrame, verdicts: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Adds n_verifiers, matched_verifiers, evidence_score and verified to ``rows`` (key, name): the whole part of the median
    of the verifiers (verdicts: key, name, verifier, score, matched) that found the name, or of all if none did; a
    verifier that says nothing of a name scores it 1 without finding it. Names meet in lower case."""
    low = lambda df: df.withColumn("_name", F.lower(F.trim(F.col(name))))
    panel = verdicts.select(*key, "verifier").distinct()
    said = low(verdicts).groupBy(*key, "_name", "verifier").agg(F.max_by("score", F.coalesce("matched", F.lit(False))).alias("score"), F.max(F.coalesce("matched", F.lit(False))).alias("matched"))
    each = low(rows).select(*key, "_name").distinct().join(panel, key).join(said, [*key, "_name", "verifier"], "left")
    score, hit = F.coalesce("score", F.lit(1)), F.coalesce("matched", F.lit(False))
    told = each.groupBy(*key, "_name").agg(F.count(F.lit(1)).alias("n_verifiers"), F.count_if(hit).alias("matched_verifiers"), F.median(F.when(hit, score)).alias("_found"), F.median(score).alias("_all"))
    told = told.select(*key, "_name", "n_verifiers", "matched_verifiers", F.floor(F.coalesce("_found", "_all")).cast("long").alias("evidence_score"))
    return low(rows).join(told, [*key, "_name"], "left").drop("_name").withColumn("verified", F.coalesce(F.col("evidence_score") >= 3, F.lit(False)))


def visibility(layers: DataFrame, flags: list[str], ident: str) -> DataFrame:
    """Rows by the number of layers that hold them, most first, then by ident."""
    return layers.withColumn("n_layers", sum((F.col(f).cast("int") for f in flags), F.lit(0))).orderBy(F.desc("n_layers"), ident)


def census_order(models: DataFrame, family: str, size: str, name: str) -> DataFrame:
    """Models by family, then size (unknown last), then name, with their place from 0."""
    placed = Ordered(models.withColumn("_unknown", F.col(size).isNull()), [], [family, "_unknown", size, name]).place("_k").done()
    return placed.withColumn("place", F.col("_k") - 1).drop("_k", "_unknown")


def entity_order(entities: DataFrame, status: str, capacity: str, name: str, ranks: dict[str, int]) -> DataFrame:
    """Entities by their status' rank (others last), the largest first, then name."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(ranks.items()) for x in pair]), F.col(status))
    return entities.orderBy(F.coalesce(rank, F.lit(len(ranks))), F.col(capacity).desc_nulls_last(), name)


def turnover(matches: DataFrame, key: str) -> DataFrame:
    """(key, n_false, rate): names without a partner among all that a run has."""
    own = matches.where("status <> 'ref_only'")
    return own.groupBy(key).agg(F.count_if(F.col("status") == "sys_only").alias("n_false"), F.avg((F.col("status") == "sys_only").cast("double")).alias("rate"))


def with_scores(runs: DataFrame, scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs with their score by arm, model and run (compared as texts; an empty score is null)."""
    text = lambda df: df.withColumns({f"_{k}": F.col(k).cast("string") for k in keys})
    known = text(scores).groupBy(*(f"_{k}" for k in keys)).agg(F.max(F.nullif(F.trim(F.col(value).cast("string")), F.lit("")).try_cast("double")).alias(value))
    return text(runs).join(known, [f"_{k}" for k in keys], "left").drop(*(f"_{k}" for k in keys))


def coverage_certainty(quality: DataFrame, matched: DataFrame, keys: list[str], arms: list[str], arm: str) -> DataFrame:
    """(keys, n_matched, n_supported) of the arms with documents: a bibliography of a run that has neither rows nor sources
    is a failure to parse and stays out, as does a run without a match count."""
    kept = quality.where(F.col(arm).isin(*arms) & ~((F.col("n_supported") == 0) & (F.coalesce("n_rows", F.lit(0)) == 0)))
    return kept.join(matched, keys).select(*keys, "n_matched", "n_supported")


def regimes(runs: DataFrame, model: str, method: str, value: str, models: list[str], methods: list[str], not_ending: tuple[str, ...] = ()) -> DataFrame:
    """(model, method, values): the values of chosen models and methods, in order; made-up runs stay out, nulls too."""
    kept = runs.where(F.col(model).isin(models) & F.col(method).isin(methods) & F.col(value).isNotNull())
    for end in not_ending:
        kept = kept.where(~F.col(model).endswith(end))
    return kept.groupBy(model, method).agg(F.array_sort(F.collect_list(value)).alias("values"))


def classified(rows: DataFrame, classes: DataFrame, fuel: str) -> DataFrame:
    """Rows with the code, label and carrier of their fuel; empty where it is in no class."""
    return rows.join(classes.dropDuplicates([fuel]), fuel, "left").na.fill("", ["code", "label", "carrier"])
