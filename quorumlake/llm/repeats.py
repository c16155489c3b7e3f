"""Exact removal of long repeated byte strings, by sorted suffixes of sampled positions.

A suffix array's induction needs the order of few suffixes only (those at local minima); the others follow. Here a
string of LENGTH bytes is named by its anchor, the smallest hash among its substrings of GRAM bytes: equal strings have
their anchors at equal places. So instead of every position, anchors are sorted (externally, by Spark's spilling
sort-merge), with the context that their strings span, and induce the rest in rounds:

1. Suffix tuples (gram, context, document, place) of all anchors are sorted. Of equal contexts the first one stays, the
   others repeat it throughout. An anchor whose gram has one context only repeats nothing.
2. Anchors whose gram has several contexts induce blocks of up to BLOCK neighbouring strings, named by what the strings
   of a block share and sorted with the context of the block, in the same way.
3. Blocks that stay open induce their strings; of equal strings the first one stays.
4. Each document gets its repeated strings, and drops the bytes that they cover.

Compared with an induced sort of all suffixes, carried by disk-backed priority queues, the tuples are about a
thirty-fifth of the bytes, and a task streams its sorted share with one tuple in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import NO_ID, Powers, documents, dropped, mix64, release, shuffle_partitions, text_chunks, written

LENGTH, GRAM = 100, 32
_first, _second = Powers(), Powers(0xD1342543DE82EF95)
#: Strings of a block.
BLOCK = 8
#: A place packs the start of a run of strings, the first one's distance to its anchor, and the number of further
#: strings; the two last have BITS each.
BITS = 7
LOW = (1 << BITS) - 1
#: a: what strings share; b, c: hashes of the context, of 64 and 32 bits, on bases of their own (0 where known).
TUPLES = "a long, b long, c int, doc_id long, sub long, place long, known boolean"


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, distance, further, gram hash, two context hashes) of each run of strings with the same anchor, in
    order."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 3))
    total = _first.sums(data)
    at = np.arange(n - gram + 1)
    bits = np.uint64(max(20, int(n).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    low = (_first.hashes(total, at, at + gram) & ~mask) | at.astype(np.uint64)
    grams, span = length - gram + 1, 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if grams > span:
        low = np.minimum(low[: len(low) - (grams - span)], low[grams - span :])
    anchor = (low & mask).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    some = sizes >= length
    np.add.at(inside, (ends - sizes)[some], 1)
    np.add.at(inside, (ends - length + 1)[some], -1)
    start = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 3))
    anchor = anchor[start]
    opens = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    p0 = start[opens]
    p1 = start[np.concatenate([opens[1:], [len(start)]]) - 1]
    anchor = anchor[opens]
    text = np.searchsorted(ends, p0, side="right")
    g = _first.hashes(total, anchor, anchor + gram)
    shape = mix64((anchor - p0).astype(np.uint64) * np.uint64(1 << 20) + (p1 - p0).astype(np.uint64))
    contexts = (mix64(powers.hashes(sums, p0, p1 + length) ^ shape) for powers, sums in ((_first, total), (_second, _second.sums(data))))
    return text, p0 - (ends - sizes)[text], anchor - p0, p1 - p0, g, *contexts


def packed(start: np.ndarray, distance: np.ndarray, further: np.ndarray) -> np.ndarray:
    return (((start << BITS) | distance) << BITS) | further


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 2 * BITS, (place >> BITS) & LOW, place & LOW


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first`` on: the range of each number, and the number."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - (np.cumsum(count) - count)[of] + first[of]


def blocks(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(what its strings share, two context hashes, place) of the blocks of runs. A block holds the strings of distances
    BLOCK j to BLOCK j + BLOCK - 1 to the anchor, as far as the run has them."""
    start, distance, further = unpacked(place)
    anchor, nearest = start + distance, distance - further
    of, j = _spread(nearest // BLOCK, distance // BLOCK - nearest // BLOCK + 1)
    anchor, far, near = anchor[of], np.minimum(distance[of], BLOCK * j + BLOCK - 1), np.maximum(nearest[of], BLOCK * j)
    total = _first.sums(data)
    core = mix64(_first.hashes(total, anchor - BLOCK * j, anchor - BLOCK * j - (BLOCK - 1) + LENGTH) ^ j.astype(np.uint64))
    shape = mix64((far * BLOCK * LENGTH + near).astype(np.uint64))
    contexts = (mix64(powers.hashes(sums, anchor - far, anchor - near + LENGTH) ^ shape) for powers, sums in ((_first, total), (_second, _second.sums(data))))
    return core, *contexts, packed(anchor - far, far, far - near)


def strings(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, second hash, 0, place) of each string of runs."""
    start, _, further = unpacked(place)
    _, p = _spread(start, further + 1)
    return _first.hashes(_first.sums(data), p, p + LENGTH), _second.hashes(_second.sums(data), p, p + LENGTH), np.zeros(len(p), np.uint64), packed(p, 0 * p, 0 * p)


def _tuples(a: np.ndarray, b: np.ndarray, c: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A batch of tuples; of those with equal (a, b, c) all but the first are known to repeat, and are dealt by place."""
    c = c & np.uint64(0xFFFFFFFF)
    order = np.lexsort((place, sub, doc, c, b, a))
    a, b, c, doc, sub, place = (x[order] for x in (a, b, c, doc, sub, place))
    alike = lambda *columns: np.concatenate([np.zeros(min(1, len(a)), bool), np.logical_and.reduce([x[1:] == x[:-1] for x in columns])])
    known = alike(a, b, c)
    same = known & alike(doc, sub, place)
    a = np.where(known, mix64((doc ^ sub).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place.astype(np.uint64)), a)
    keep = ~same
    b, c = (np.where(known, np.uint64(0), x) for x in (b, c))
    columns = [x[keep] for x in (a.view(np.int64), b.view(np.int64), c.astype(np.uint32).view(np.int32), doc, sub, place, known)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "c", "doc_id", "sub", "place", "known"])


def _anchor_tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        ids, subs = batch.column("doc_id").to_numpy(), batch.column("sub").to_numpy()
        found = [[] for _ in range(6)]
        for i, j in text_chunks(texts):
            text, start, distance, further, g, context, other = anchor_runs(texts[i:j])
            for column, x in zip(found, (g, context, other, ids[text + i], subs[text + i], packed(start, distance, further)), strict=True):
                column.append(x)
        if found[0]:
            yield _tuples(*(np.concatenate(x) for x in found))


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From tuples sorted by (a, b, c, doc_id, sub, place): (doc_id, sub, place, open): those that repeat an earlier one (open
    false), and the first ones of contexts whose gram has others (open true). Held back is the last context's first
    tuple, while its gram has no other."""
    last = None  # a, b, c, doc_id, sub, place, told
    for batch in batches:
        a, b, c, doc, sub, place = (batch.column(name).to_numpy() for name in ("a", "b", "c", "doc_id", "sub", "place"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        out = [(doc[known], sub[known], place[known], np.zeros(int(known.sum()), bool))]
        a, b, c, doc, sub, place = (x[~known] for x in (a, b, c, doc, sub, place))
        if len(a):
            if last is not None:
                a, b, c, doc, sub, place = (np.concatenate([[x], y]) for x, y in zip(last[:6], (a, b, c, doc, sub, place), strict=True))
            same_a, same_b = a[1:] == a[:-1], (b[1:] == b[:-1]) & (c[1:] == c[:-1])
            new_b = np.concatenate([[True], ~(same_a & same_b)])
            # tuples that are held by the carried one twice (identical rows) count once
            twin = np.concatenate([[False], same_a & same_b & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (place[1:] == place[:-1])])
            carried = last is not None
            repeats = ~new_b & ~twin
            first = np.flatnonzero(new_b)
            of = np.cumsum(np.concatenate([[0], (a[first][1:] != a[first][:-1]).astype(np.int64)]))
            several = np.bincount(of)[of] > 1
            if carried and last[6]:
                several |= of == 0
            tell = several.copy()
            if carried and last[6]:
                tell[0] = False
            out.append((doc[repeats], sub[repeats], place[repeats], np.zeros(int(repeats.sum()), bool)))
            out.append((doc[first][tell], sub[first][tell], place[first][tell], np.ones(int(tell.sum()), bool)))
            k = first[-1]
            last = (a[k], b[k], c[k], doc[k], sub[k], place[k], bool(several[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc_id", "sub", "place", "open"])


def _sorted(tuples: DataFrame, label: str) -> DataFrame:
    rows = tuples.repartition(shuffle_partitions(tuples.sparkSession), "a").sortWithinPartitions("a", "b", "c", "doc_id", "sub", "place")
    return written(rows.mapInArrow(_judged, "doc_id long, sub long, place long, open boolean"), label)


def _induced(kind):
    """Tuples that the places of (doc_id, sub, text, places) induce, by ``blocks`` or ``strings``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs, texts, places = batch.column("doc_id").to_numpy(), batch.column("sub").to_numpy(), batch.column("text"), batch.column("places")
            found, held = [[] for _ in range(6)], 0
            for k in range(batch.num_rows):
                data = np.frombuffer((texts[k].as_py() or "").encode(), np.uint8)
                place = np.array(places[k].as_py(), np.int64)
                start, _, further = unpacked(place)
                a, b, c, at = kind(data, place[start + further + LENGTH <= len(data)])
                for column, x in zip(found, (a, b, c, np.full(len(a), ids[k]), np.full(len(a), subs[k]), at), strict=True):
                    column.append(x)
                held += len(a)
                if held > 1 << 19:
                    yield _tuples(*(np.concatenate(x) for x in found))
                    found, held = [[] for _ in range(6)], 0
            if held:
                yield _tuples(*(np.concatenate(x) for x in found))

    return run


def _removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, runs, sha = [], [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            data = (text.as_py() or "").encode()
            got = places.as_py()
            n.append(len(data))
            if not got:
                gone.append(0)
                runs.append(0)
                sha.append(hashlib.sha256(data).hexdigest())
                continue
            place = np.array(got, np.int64)
            start, _, further = unpacked(place)
            start, stop = np.minimum(start, len(data)), np.minimum(start + further + LENGTH, len(data))
            edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
            covered = np.cumsum(edge)[: len(data)] > 0
            gone.append(int(covered.sum()))
            runs.append(int(covered[:1].sum()) + int((covered[1:] & ~covered[:-1]).sum()))
            sha.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, text) of ``docs``, null ids as NO_ID: ``sub`` is 0 (no bytes once compressed) where the rows of a
    doc_id have one text, else the text's hash, as for all null ids."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    named = rows.where(F.col("doc_id") != NO_ID).select("doc_id", F.xxhash64("text").alias("h"))
    several = written(named.groupBy("doc_id").agg(F.min("h").alias("l"), F.max("h").alias("m")).where("l <> m").select("doc_id"), "several")
    differs = F.col("doc_id") == NO_ID
    if not several.isEmpty():
        rows = rows.join(several.withColumn("differs", F.lit(True)), "doc_id", "left")
        differs |= F.col("differs").isNotNull()
    return rows.select("doc_id", F.when(differs, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("sub"), "text")


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, places): for each document with strings of LENGTH bytes that start earlier too, where they start."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "sub", "text")
    anchors = _sorted(rows.mapInArrow(_anchor_tuples, TUPLES), "anchors")
    release(spark)
    gathered = lambda df: df.groupBy("doc_id", "sub").agg(F.collect_list("place").alias("places")).hint("shuffle_hash")
    told, at = [anchors], anchors
    for label, kind in (("blocks", blocks), ("strings", strings)):
        before, rows = rows, written(rows.join(gathered(at.where("open")), ["doc_id", "sub"]).select("doc_id", "sub", "text", "places"), "open")
        release(spark)
        if len(told) > 1:
            dropped(before)
        at = _sorted(rows.mapInArrow(_induced(kind), TUPLES), label)
        release(spark)
        told.append(at)
        rows = rows.select("doc_id", "sub", "text")
    dropped(rows)
    both = told[0].where("not open").union(told[1].where("not open")).union(told[2].where("not open"))
    places = written(gathered(both.select("doc_id", "sub", "place")), "places")
    release(spark)
    for table in told:
        dropped(table)
    return places


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text; null text: empty).

    Earlier means a smaller doc_id, or an earlier start in the same document. Identical rows count as one document and
    get its result; rows of one doc_id that differ in text are documents of their own, ordered by the text's hash. A
    null doc_id is the smallest.
    """
    rows = identified(docs)
    places = repeated_places(rows)
    out = rows.join(places.hint("shuffle_hash"), ["doc_id", "sub"], "left").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row; see ``without_repeats``. A text is hashed
    whole, at some 60 bytes of memory a byte; other columns are not read."""
    return without_repeats(documents(spark, sf_dir))


OP5_SQL = """
with b as (select doc_id, encode(coalesce(text, '')) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, x, unnest(range(1, greatest(n - 98, 1))) as p from b),
r as (select doc_id, p, row_number() over (partition by md5(array_slice(x, p, p + 99)) order by doc_id, p) as rn from w),
d as (select doc_id, p, (p > lag(p) over (partition by doc_id order by p) + 100)::int as opens from r where rn > 1),
g as (select doc_id, p, sum(coalesce(opens, 1)) over (partition by doc_id order by p) as k from d),
i as (select doc_id, k, min(p) as a, max(p) + 100 as e from g group by 1, 2),
s as (select doc_id, count(*) as n_spans, sum(e - a)::bigint as n_removed from i group by 1),
k as (select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 1) as f, a as t from i union all select doc_id, max(e), null from i group by 1),
h as (select doc_id, string_agg(case when coalesce(t, n + 1) > f then hex(array_slice(x, f, coalesce(t, n + 1) - 1)) else '' end, '' order by f, t nulls last) as kept from k join b using (doc_id) group by 1)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(case when h.kept is null then x else unhex(h.kept) end) as kept_sha256
from b left join s using (doc_id) left join h using (doc_id)
"""
