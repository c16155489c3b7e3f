"""A training corpus from documents: language, near-duplicates, secrets, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import bpe, jaccard_join, language_id, mixing, secrets
from quorumlake.llm.common import documents, dropped, spare, written

#: Documents whose text no language's n-grams cover to this share are rejected, as are those without letters.
LEAST_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language, null and empty texts among them; a null lang becomes the predicted one. The
    filters are fitted on ``docs``; if none of them has a lang, nothing can be told and all documents with letters stay.
    Repeated rows are told apart from each other by nothing and stay or go together; other columns stay as they are."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    mark = spare(docs.columns, "_kept")
    own = {c: f"{mark}{c}" for c in docs.columns if c in ("lang_pred", "score")}
    told = language_id.predict(docs.withColumnsRenamed(own), model)
    told = told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id, of its texts the one with the
    least hash; see ``one_of_each``. Rows without a doc_id all stay, as do texts without words; columns stay as they are."""
    return jaccard_join.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[SECRET]`` and n_chars follows; every document stays, null and empty texts as they are. Each row is
    scanned by itself."""
    clean = secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule. Texts without words go; rows that are equal
    in id, text and source stand for each other; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens (none and 0 for a null or empty text); columns of these names give way."""
    tokens = bpe.multi_encoder(docs).ids(docs, "token_ids")
    return tokens.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mixing_stage),
    ("byte_bpe", token_stage),
]

#: Language filters, a trained forest and BPE have no SQL; the stages' operators are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
