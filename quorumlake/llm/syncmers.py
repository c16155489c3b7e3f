"""Document fingerprints from closed syncmers, and the likeness of fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import documents, mix64, partition_keys, shuffle_partitions, text_chunks

#: Bytes of a k-mer and of its inner substrings: a k-mer is chosen if a smallest inner substring is its first or last.
K, S = 20, 8
#: Bins of a fingerprint; each holds 16 bits of the smallest chosen k-mer hash that falls there, 0 if none does.
BINS = 128


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, byte position, 64-bit hash) of the closed syncmers of each text.

    Whether a k-mer is chosen depends on its own bytes only, so that a passage has the same anchors in any text. A text
    of fewer than K bytes is one anchor as a whole; an empty one has none.
    """
    data = np.frombuffer(b"".join(texts) + b"\0" * K, np.uint8).astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    two = (data[:-1] << np.uint64(8)) | data[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    h = mix64(eight)
    low, span = h, 1
    inner = K - S + 1
    while span * 2 <= inner:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if inner > span:
        low = np.minimum(low[: len(low) - (inner - span)], low[inner - span :])
    at = np.flatnonzero((h[: len(low)] == low) | (h[inner - 1 : inner - 1 + len(low)] == low))
    doc = np.searchsorted(ends, at, side="right")
    inside = doc < len(texts)
    at, doc = at[inside], doc[inside]
    inside = at + K <= ends[doc]
    at, doc = at[inside], doc[inside]
    value = mix64(eight[at] ^ mix64(eight[at + 8] ^ mix64(four[at + 16])))
    starts = ends - np.array([len(t) for t in texts], dtype=np.int64)
    short = [i for i, t in enumerate(texts) if 0 < len(t) < K]
    if short:
        own = np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in short], np.uint64)
        doc, at, value = np.concatenate([doc, short]), np.concatenate([at, starts[short]]), np.concatenate([value, own])
    return doc, at - starts[doc], value


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of BINS uint16 for each text; equal texts have equal rows. Texts of no bytes have zeros."""
    out = np.zeros((len(texts), BINS), np.uint16)
    for a, b in text_chunks(texts):
        doc, _, value = anchors(texts[a:b])
        cell = doc.astype(np.uint64) * np.uint64(BINS) + (value >> np.uint64(57))
        order = np.sort((cell << np.uint64(36)) | (value & np.uint64((1 << 36) - 1)))
        cells = (order >> np.uint64(36)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        out[a:b].reshape(-1)[cells[first]] = (((order[first] & np.uint64((1 << 36) - 1)) >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of bins that agree among those that either text fills; 1 if neither fills any."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1))


def with_next(docs: DataFrame) -> DataFrame:
    """(p, tail, doc_id, text), one task to a range p of doc_ids and sorted by doc_id within it; after each range comes
    a copy (tail 1) of the first document of the next one, the first of all after the last.

    Each text moves once; the driver gets a bound and a first doc_id for each range. Rows of equal doc_id are ordered by
    their texts' hashes; a null doc_id comes first.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order_id"), "doc_id", "text")
    n = shuffle_partitions(docs.sparkSession)
    bounds = np.unique(np.array(rows.approxQuantile("order_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], dtype=np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(order_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order_id.to_numpy(np.int64), side="right").astype(np.int32))

    placed = rows.withColumn("p", range_of("order_id"))
    firsts = sorted((r["p"], r["id"]) for r in placed.select("p", "order_id").groupBy("p").agg(F.min("order_id").alias("id")).collect())
    ids = np.array([i for _, i in firsts], np.int64)
    before = np.array([firsts[k - 1][0] for k in range(len(firsts))], np.int32)

    @F.pandas_udf("int")
    def also_in(order_id: pd.Series) -> pd.Series:
        x = order_id.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
        return pd.Series(np.where(ids[at] == x, before[at], -1).astype(np.int32)) if len(ids) else pd.Series(np.full(len(x), -1, np.int32))

    place = F.explode(F.filter(F.array(F.struct(F.col("p"), F.lit(0).alias("tail")), F.struct(also_in("order_id").alias("p"), F.lit(1).alias("tail"))), lambda x: x["p"] >= 0))
    spread = placed.withColumn("at", place).select("at.p", "at.tail", "order_id", "doc_id", "text")
    key = F.element_at(F.array(*map(F.lit, partition_keys(docs.sparkSession, n))).cast("array<bigint>"), F.col("p") + 1)
    return spread.withColumn("key", key).repartition(n, "key").sortWithinPartitions("p", "tail", "order_id", F.xxhash64("text")).drop("order_id", "key")


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple[int, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = texts[1:] + [following]
        half = [len(t) // 2 for t in texts]
        edited = [(t[: len(t) - h] + x[:h]).encode() for t, x, h in zip(texts, nexts, half, strict=True)]
        own = fingerprints([t.encode() for t in [*texts, following]])
        other = fingerprints(edited)
        columns = {
            "doc_id": pa.array([i for i, _ in rows], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            "fingerprint": pa.array([r.tobytes().hex() for r in own[:-1]]),
            "edited_fingerprint": pa.array([r.tobytes().hex() for r in other]),
            "near_edited": pa.array(likeness(own[:-1], other)),
            "near_next": pa.array(likeness(own[:-1], own[1:])),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    held: list[tuple[int, str]] = []
    size, at, ended = 0, None, False
    for batch in batches:
        for p, tail, i, text in zip(*(batch.column(c).to_pylist() for c in ("p", "tail", "doc_id", "text")), strict=True):
            text = text or ""
            if p != at:
                at, ended = p, False
            if tail:
                if not ended:  # further copies are rows of the same doc_id
                    yield made(held, text)
                    held, size, ended = [], 0, True
                continue
            if held and size > 1 << 20:
                yield made(held, text)
                held, size = [], 0
            held.append((i, text))
            size += len(text)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs``:
    its text (null: empty) against its edited text, whose last half is the start of the next document, and against the
    next document. A single document is its own next one.

    A null doc_id comes before all others. Of rows that share a doc_id the one with the lesser hash of its text comes first;
    repeated rows follow each other, and all are returned. An empty text has an empty fingerprint. An empty table gives an
    empty result; other columns are not read."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_told, schema)


def anchor_table(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash): the anchors of each text, for positional matching by a join on ``hash``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [(t or "").encode() for t in batch.column("text").to_pylist()], batch.column("doc_id")
            for a, b in text_chunks(texts):
                doc, at, value = anchors(texts[a:b])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + a)), pa.array(at.astype(np.int64)), pa.array(value.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, position long, hash long")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of whole texts, a row for
    each row; see ``fingerprint_pairs``."""
    return fingerprint_pairs(documents(spark, sf_dir))
