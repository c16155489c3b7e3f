"""Language ID with bit-sliced Bloom filters over byte n-grams: one probe gives all languages that hold an n-gram."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm.common import documents, dropped, mix64, text_chunks, written

#: Bytes of an n-gram; hashes of it; log2 of the filter's slots.
GRAM, HASHES, SLOT_BITS = 4, 3, 18
#: The classifier is fitted on about so many labelled documents of each language, taken by hash.
SAMPLE_PER_LANGUAGE = 2000
#: n-grams with at least this share of a language's n-grams are held by its filter, so at most 1 / MIN_SHARE of them.
MIN_SHARE = 5e-5
UNDETERMINED = "und"
#: ASCII bytes that aren't letters become spaces.
_SPACES = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def _folded(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8").translate(_SPACES) + b" "


def _has_letters(text: str | None, folded: bytes) -> bool:
    return bool(_ASCII_LETTER.search(folded)) or (not (text or "").isascii() and any(c.isalpha() for c in text))


def _grams(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text, as uint32, and each text's end among them; n-grams of mere space are left out."""
    data = np.frombuffer(b"".join(chunk), dtype=np.uint8)
    lengths = np.array([len(c) for c in chunk])
    g = data[: max(0, len(data) - GRAM + 1)].astype(np.uint32)
    for k in range(1, GRAM):
        g = (g << np.uint32(8)) | data[k : len(data) - GRAM + 1 + k]
    ends = np.cumsum(lengths)
    keep = (g & np.uint32(0xFFFF)) != 0x2020
    for k in range(1, GRAM):
        cross = ends - k
        keep[cross[(cross >= 0) & (cross < len(keep))]] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return g[keep], kept_before[np.minimum(ends, len(keep))]


def _slots(g: np.ndarray) -> list[np.ndarray]:
    h = mix64(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    """``slices[w][slot]`` has bit l of word w set if a hash of an n-gram of language 64 w + l fell there."""

    languages: list[str]
    slices: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray]) -> LanguageFilters:
        slices = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range((len(languages) + 63) // 64)]
        for i, g in enumerate(grams):
            for at in _slots(g.astype(np.uint32)):
                slices[i // 64][at] |= np.uint64(1 << (i % 64))
        fill = np.array([((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, slices, fill**HASHES)

    def counts(self, chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: n-grams that the filter holds, less the false positives to be expected; n-grams by text."""
        g, ends = _grams(chunk)
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        at = _slots(g)
        out = np.zeros((len(chunk), len(self.languages)))
        for w, s in enumerate(self.slices):
            held = s[at[0]] & s[at[1]] & s[at[2]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = np.concatenate([[0], np.cumsum((held >> np.uint64(i - 64 * w)) & np.uint64(1))])
                out[:, i] = hits[ends] - hits[starts]
        f = self.false_rate
        return np.clip((out - n[:, None] * f) / np.maximum(1 - f, 1e-9), 0, None), n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        folded = [_folded(t) for t in texts]
        langs, scores = [], np.zeros(len(texts))
        for a, b in text_chunks(folded):
            hits, n = self.counts(folded[a:b])
            for k in range(b - a):
                if not self.languages or not _has_letters(texts[a + k], folded[a + k]):
                    langs.append(UNDETERMINED)
                    continue
                best = int(np.argmax(hits[k]))
                langs.append(self.languages[best])
                scores[a + k] = min(1.0, hits[k][best] / max(n[k], 1))
        return langs, scores


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            folded = [_folded(t) for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in text_chunks(folded):
                g, n = np.unique(_grams(folded[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, min_share: float = MIN_SHARE) -> LanguageFilters:
    """Fit on (doc_id, text, lang): whole texts of about ``per_language`` documents of each language, by hash of doc_id.

    Rows without text or lang are left out. The driver gets a row for each language, then at most 1 / ``min_share``
    n-grams of each.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageFilters([], [], np.zeros(0))
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    counts = drawn.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for k, n in sorted(totals.items()) for x in (F.lit(k), F.lit(n * min_share))]) if totals else F.create_map(F.lit(""), F.lit(0.0))
    kept = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "gram").toPandas()
    dropped(counts)
    languages = sorted(sizes)
    return LanguageFilters.build(languages, [kept["gram"][kept["lang"] == x].to_numpy(dtype=np.uint32) for x in languages])


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to (every column of) ``docs``: the language with the most n-grams after correction and
    their share of the text's n-grams. A null text, or one without letters, is ``und`` with score 0. Columns of ``docs``
    of these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, scores = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``documents``; see ``fit`` and ``predict``. Texts are read
    whole. A null doc_id is not held out; rows without one share a hash, so that the fit reads all of them or none;
    repeated rows have equal predictions; a null or empty text, or one without letters, is ``und``. An empty table gives an
    empty result; a table without any lang predicts ``und`` for all. Other columns are not read."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
