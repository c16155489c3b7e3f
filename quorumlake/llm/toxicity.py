"""Toxicity by non-negative positive-unlabelled learning: linear classifiers over words, from toxic examples and plain text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm.common import CHUNK_BYTES, Powers, counted, documents, dropped, slices, text_chunks

#: The classifiers are fitted on about so many toxic documents and so many unlabelled ones, taken by hash. A bag, which gives
#: a classifier, has all of the toxic ones and about so many of the others.
POSITIVES, UNLABELLED, BAG = 2000, 16_000, 4000
#: A word's features are the word and its first 4 to 8 bytes. One of fewer documents of a bag is left out; the most
#: frequent ones stay, up to so many.
PREFIXES, LEAST_DOCUMENTS, FEATURES = range(4, 9), 8, 1 << 16
#: A feature's value in a text is its number over the number of words (FEW_WORDS at least) times this, 1 at most: about
#: once a paragraph counts in full.
DENSITY, FEW_WORDS = 60.0, 30
#: Steps of the descent over a whole bag, their length, and the weight of the squared norm.
STEPS, RATE, RIDGE = 200, 0.05, 1e-3
THRESHOLD = 0.3
_LETTER = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])


def folded(texts: Iterable[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def pieces(texts: list[bytes], limit: int = CHUNK_BYTES) -> tuple[list[bytes], np.ndarray]:
    """The texts, those of over ``limit`` bytes cut at spaces, and the number of the text that each piece is of."""
    out, of = [], []
    for i, text in enumerate(texts):
        a = 0
        while len(text) - a > limit and (b := text.find(b" ", a + limit)) >= 0:
            out.append(text[a:b])
            of.append(i)
            a = b
        out.append(text[a:])
        of.append(i)
    return out, np.array(of, np.int64)


def features(chunk: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of each word, a run of letters (non-ASCII bytes among them), and of its beginnings; words by text."""
    data = np.frombuffer(b" ".join(chunk) + b" ", np.uint8)
    letter = _LETTER[data]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edges = np.r_[0, edges] if letter[0] else edges
    start, stop = edges[::2], edges[1::2]
    text = np.searchsorted(np.cumsum([len(c) + 1 for c in chunk]), start, side="right")
    total = powers.sums(data)
    found = [(text, powers.hashes(total, start, stop) ^ np.uint64(1))]
    for k in PREFIXES:
        longer = stop - start > k
        found.append((text[longer], powers.hashes(total, start[longer], start[longer] + k)))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), np.bincount(text, minlength=len(chunk))


def counted_features(texts: list[bytes], powers: Powers, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, number) of ``texts``, and words by text; with ``known`` sorted features, only these, by their place."""
    cut, of = pieces(texts)
    words, found = np.zeros(len(texts)), [(np.zeros(0, np.int64), np.zeros(0, np.uint64 if known is None else np.int64), np.zeros(0, np.int64))]
    for a, b in text_chunks(cut):
        text, h, n = features(cut[a:b], powers)
        text = of[a:b][text]
        words += np.bincount(of[a:b], n, len(texts))
        if known is not None:
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            held = known[at] == h
            text, h = text[held], at[held]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
        found.append((text[first], h[first], np.diff(np.r_[first, len(h)])))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), words


def valued(texts: list[bytes], known: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``known``, value): what a model reads of ``texts``."""
    text, at, n, words = counted_features(texts, powers, known)
    pair, back = np.unique(text * len(known) + at, return_inverse=True)  # pieces of a long text meet
    n = np.bincount(back, n, len(pair))
    text = pair // len(known)
    return text, pair % len(known), np.minimum(1.0, DENSITY * n / np.maximum(words[text], FEW_WORDS))


@dataclass
class WordModel:
    """A logit: ``bias`` plus the weights of a text's features times their values. ``known`` are sorted hashes."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def merged(cls, models: list[WordModel]) -> WordModel:
        """The mean of the models' logits, a feature that one of them lacks weighing 0 there. Without models, never toxic."""
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(m.known for m in models)]))
        weights = np.zeros(len(known))
        for m in models:
            weights[np.searchsorted(known, m.known)] += m.weights / len(models)
        return cls(known, weights, float(np.mean([m.bias for m in models])) if models else -np.inf)

    def scores(self, texts: list[bytes], powers: Powers) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.known):
            text, at, value = valued(texts, self.known, powers)
            z += np.bincount(text, self.weights[at] * value, len(texts))
        return np.exp(-np.logaddexp(0, -z))


def nn_pu(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, positive: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative positive-unlabelled risk with the logistic loss; ``positive`` tells toxic rows
    from unlabelled ones, (rows, cols, values) are the entries of the matrix.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): what toxic rows add to the negative risk of the
    unlabelled is taken out of it. Where that difference falls below 0, which takes overfitting, the step goes up along
    it instead. Adam over the whole bag; the mean of the second half of its steps evens out those turns.
    """
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    w, first, second, mean = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(rows, w[cols] * values, len(positive)) + w[-1], -30, 30)
        up, loss = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        slope = np.where(positive, -prior * up / n_p, up / n_u)
        if loss[~positive].sum() / n_u < prior * loss[positive].sum() / n_p:
            slope = -slope
        else:
            slope = slope + np.where(positive, prior * (up - 1) / n_p, 0)
        g = np.r_[np.bincount(cols, slope[rows] * values, width) + RIDGE * w[:-1], slope.sum()]
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if 2 * step > STEPS:
            mean += w / (STEPS - STEPS // 2)
    return mean[:-1], float(mean[-1])


def train(texts: list[bytes], positive: np.ndarray, prior: float) -> WordModel:
    powers = Powers()
    text, h, n, _ = counted_features(texts, powers)
    known, at, times = np.unique(h, return_inverse=True, return_counts=True)  # pieces of a long text count apart
    least = max(LEAST_DOCUMENTS, np.sort(times)[-FEATURES]) if len(times) > FEATURES else LEAST_DOCUMENTS
    known = known[times >= least]
    del text, h, n, at
    if not len(known):
        return WordModel(known, np.zeros(0), float(np.log(prior / (1 - prior))))
    return WordModel(known, *nn_pu(*valued(texts, known, powers), positive, len(known), prior))


def drawn(rows: DataFrame, rows_before: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``rows_before`` rows, by the hash of doc_id."""
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, wanted / max(rows_before, 1)) * 1_000_003)


def fit(docs: DataFrame, labels: DataFrame) -> WordModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Toxic ones among ``labels`` are the confirmed examples; all of ``docs``, whatever their labels, are the unlabelled
    text; the share of toxic ones among ``labels`` is the class prior. Both samples are bounded (POSITIVES, UNLABELLED);
    an id counts once, with the least of its texts. A bag is trained in a task of its own, on whole texts. Without a
    toxic example there is nothing to learn, and no score is above 0.
    """
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told, n = counted(told, "toxic", toxic=F.count_if(F.col("toxic") == 1))
    if not n["toxic"]:
        dropped(told)
        return WordModel.merged([])
    prior = float(np.clip(n["toxic"] / n["rows"], 1e-3, 1 - 1e-3))
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    chosen, held = counted(drawn(told.where("toxic = 1"), n["toxic"], POSITIVES).select("doc_id"), "chosen")
    small = F.broadcast(chosen) if held["rows"] <= 2 * POSITIVES else chosen
    rows = docs.select("doc_id").count()
    bags = max(1, -(-min(rows, UNLABELLED) // BAG))
    once = lambda df: df.groupBy("doc_id").agg(F.min("text").alias("text"))
    positive = once(docs.join(small, "doc_id")).select(F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag"), F.lit(True).alias("positive"), "doc_id", "text")
    unlabelled = once(drawn(docs, rows, UNLABELLED)).select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(bags)).cast("int").alias("bag"), F.lit(False).alias("positive"), "doc_id", "text")

    def bag(table: pa.Table) -> pa.Table:
        table = table.sort_by([("positive", "ascending"), ("doc_id", "ascending")])
        m = train(folded(table["text"].to_pylist()), table["positive"].to_numpy(), prior)
        return pa.table({"known": [m.known.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias]})

    found = positive.union(unlabelled).groupBy("bag").applyInArrow(bag, "known binary, weights binary, bias double").collect()
    for table in (told, chosen):
        dropped(table)
    read = lambda x, kind: np.frombuffer(bytes(x), kind)
    return WordModel.merged([WordModel(read(r["known"], np.uint64), read(r["weights"], np.float64), r["bias"]) for r in found])


def score(docs: DataFrame, model: WordModel, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of toxicity, to (every column of) ``docs``, from ``text`` alone, whole. A null text is
    an empty one, which has the score of no evidence; a column of this name gives way; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in slices(batches):
            scores = shared.value.scores(folded(part.column(text).to_pylist()), powers)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores)], [*kept, "score"])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``documents``. Learned from rows that are not held out
    only, the unlabelled text among them; see ``fit`` and ``score``. A null doc_id is not held out and not learned from;
    repeated rows have equal scores; an empty table gives an empty result; other columns are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
