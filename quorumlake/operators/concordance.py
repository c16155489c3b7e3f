"""Lists of names against each other: what one covers of another, variants of spelling included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as tx
from quorumlake.functions.similarity import similarity
from quorumlake.operators.fuzzy_join import alike, holders

# Thresholds, the least length of a word that counts as a mention, and words that say what kind of plant.
VARIANT, LISTED, TITLE, LINE, MENTION = 88.0, 70.0, 60.0, 60.0, 6
PLANT_WORDS = ("nd", "tbkhh", "tbk", "nhiet dien", "ccgt", "gt")


def folded_name(name: Column) -> Column:
    """A name without diacritics and words for a kind of plant, other characters than letters and digits as spaces."""
    out = F.regexp_replace(F.lower(tx.fold(F.coalesce(name, F.lit("")))), r"\b(?:" + "|".join(PLANT_WORDS) + r")\b", "")
    return tx.squeezed(F.regexp_replace(out, "[^a-z0-9]+", " "))


def near(names: DataFrame, others: DataFrame, name: str, other: str, kind: str, least: float) -> DataFrame:
    """The distinct names that are ``least`` alike or more to one of ``others``."""
    return alike(names.select(name), others.select(F.col(other).alias("_other")), name, "_other", kind, least).select(name).distinct()


def in_list(names: DataFrame, known: DataFrame, name: str, other: str, out: str, least: float = LISTED) -> DataFrame:
    """Adds ``out``: whether a name equals one of ``known`` or is ``least`` alike on sorted words, both in lower case."""
    low = lambda df, c: df.withColumn("_low", F.lower(F.trim(c)))
    asked = low(names, name)
    found = near(asked.where("_low <> ''"), low(known, other).withColumnRenamed("_low", "_known"), "_low", "_known", "token_sort_ratio", least).withColumn(out, F.lit(True))
    return asked.join(found, "_low", "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_low")


def mentioned(names: DataFrame, texts: DataFrame, name: str, text: str, out: str) -> DataFrame:
    """Adds ``out``: whether a text holds the name, or one of its words of MENTION characters or more, in lower case.
    Texts are told apart by their own words; an empty name is in none."""
    asked = names.select(F.col(name).alias("_name")).distinct()
    parts = F.array_distinct(F.concat(F.array(F.lower("_name")), F.filter(F.split(F.lower("_name"), r"\s+"), lambda w: F.length(w) >= MENTION)))
    asked = asked.select("_name", F.explode(parts).alias("_part"))
    held = holders(texts.select(F.lower(text).alias("_text")).distinct().withColumn("_id", F.xxhash64("_text")), asked, "_id", "_text", "_part").select("_part").distinct()
    found = asked.join(held, "_part").select(F.col("_name").alias(name)).distinct().withColumn(out, F.lit(True))
    return names.join(found, name, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def name_in_text(pairs: DataFrame, name: str, text: str, least: float = LINE) -> DataFrame:
    """Adds ``found``: whether the text holds the name in lower case, or one of its lines is ``least`` alike. Lines are
    compared only where the name isn't held as it is; an empty name is never found."""
    rows = pairs.withColumn("_row", F.xxhash64(name, text)).withColumn("_low", F.lower(F.trim(F.coalesce(name, F.lit("")))))
    held = (F.col("_low") != "") & F.coalesce(F.contains(F.lower(text), F.col("_low")), F.lit(False))
    rows = rows.withColumn("_held", held)
    lines = rows.where("not _held and _low <> ''").select("_row", "_low", F.explode(F.split(F.lower(text), "\n")).alias("_line")).distinct()
    close = lines.where(similarity("partial_ratio", F.col("_low"), F.col("_line")) >= least).select("_row").distinct().withColumn("_close", F.lit(True))
    return rows.join(close, "_row", "left").withColumn("found", F.col("_held") | F.coalesce("_close", F.lit(False))).drop("_row", "_low", "_held", "_close")


def reviewed_coverage(reference: DataFrame, source: DataFrame, matched: DataFrame, name: str) -> DataFrame:
    """(name, raw, covered) of each reference name: whether the match found it in the source, and whether that or a variant
    of its spelling (VARIANT alike once folded) did."""
    names = reference.select(name).distinct().join(matched.select(name).distinct().withColumn("raw", F.lit(True)), name, "left").withColumn("raw", F.coalesce("raw", F.lit(False)))
    folded = names.withColumn("_fold", folded_name(F.col(name)))
    found = near(folded.where("not raw"), source.select(folded_name(F.col(name)).alias("_other_fold")), "_fold", "_other_fold", "partial_ratio", VARIANT).withColumn("_near", F.lit(True))
    out = folded.join(found, "_fold", "left").withColumn("covered", F.col("raw") | F.coalesce("_near", F.lit(False)))
    return out.select(name, "raw", "covered")


def tail(unmatched: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """Rows of ``unmatched`` whose folded name is below VARIANT to every reference name: what only the other list has."""
    folded = unmatched.withColumn("_fold", folded_name(F.col(name)))
    found = near(folded, reference.select(folded_name(F.col(name)).alias("_other_fold")), "_fold", "_other_fold", "partial_ratio", VARIANT)
    return folded.join(found, "_fold", "left_anti").drop("_fold")


def concordance(covered: DataFrame, only: DataFrame, status: str, flags: list[str], label: str = "All") -> DataFrame:
    """(status, n_reference, <flag>_matched, <flag>_reference_only, n_only) by status and for all: ``covered`` has a flag
    for each list, ``only`` the rows that no reference name stands for."""
    from quorumlake.operators.metrics import with_total

    counts = [F.count(F.lit(1)).alias("n_reference")]
    for f in flags:
        counts += [F.count_if(F.col(f)).alias(f"{f}_matched"), F.count_if(~F.col(f)).alias(f"{f}_reference_only")]
    others = with_total(only, status, [F.count(F.lit(1)).alias("n_only")], label)
    return with_total(covered, status, counts, label).join(others, status, "left").na.fill(0, ["n_only"])


def layer_counts(layers: DataFrame, flags: list[str]) -> DataFrame:
    """How many reference rows each layer (a 0/1 column) holds, and how many there are."""
    return layers.agg(F.count(F.lit(1)).alias("reference"), *(F.sum(f).cast("long").alias(f) for f in flags))


def titles_by_reference(items: DataFrame, titles: DataFrame, title: str, like: str, least: float = TITLE) -> DataFrame:
    """Items whose title is ``least`` alike or more to a reference title, with the score and the first such title, best
    first."""
    scored = alike(items.select(title), titles.select(F.col(like).alias("reference_title")), title, "reference_title", "token_sort_ratio", least)
    best = scored.groupBy(title).agg(F.min(F.struct((-F.col("score")).alias("s"), "reference_title")).alias("_b")).select(title, (-F.col("_b.s")).alias("score"), "_b.reference_title")
    return items.join(best, title).orderBy(F.desc("score"), title)
