"""Exact n-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into the cells of a sketch; a cell holds the XOR of its shingles' hashes.
Each shingle of the symmetric difference of two sets changes one cell at most, so the cells that differ (a Hamming
distance) bound it from below. Two sets of a and b shingles with a Jaccard similarity of at least 0.8 differ by
D = (a + b) / 9 shingles at most; of D + 1 cells that one of them fills, one agrees. Each set therefore emits its first
D + 1 filled cells (in cell order, with the D of its largest possible partner), for the layout of its size band and,
near the band's lower edge, for the one below; sets that share no emitted cell cannot link. All others are verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import Powers, connected_components, counted, documents, dropped, files_for, mix64, shuffle_partitions, slices, spare, text_chunks, written

SHINGLE = 5
#: Similarity as a fraction; CELLS is the share of a band's largest size that its sketch has as cells (at least LEAST).
SIM_NUM, SIM_DEN = 80, 100
CELLS, LEAST_CELLS = 0.32, 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


_powers = Powers()


#: A word, as Java reads it.
WORD = r"[^\x20\x09-\x0D]"


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, ascending. Words are runs of other bytes than ASCII white space,
    with A-Z in lower case; fewer than five words make one shingle, no words none."""
    data = [(t or "").encode("utf-8").lower() for t in texts]
    for a, b in text_chunks(data):
        chunk = np.frombuffer(b" ".join(data[a:b]) + b" ", np.uint8)
        space = _SPACE[chunk]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        words = _powers.hashes(_powers.sums(chunk), starts, ends)
        five = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            five = (five ^ words[k : len(five) + k]) * _STEP[k]
            five ^= five >> np.uint64(29)
        five = mix64(five)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in data[a:b])]))
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i >= SHINGLE:
                yield np.unique(five[i : j - SHINGLE + 1])
            elif j > i:
                short = np.array([j - i], np.uint64)
                for k in range(i, j):
                    short = mix64((short ^ words[k]) * _STEP[k - i])
                yield short
            else:
                yield np.zeros(0, np.uint64)


#: Bits of a set's name; fewer (in tests) make different sets share one.
ID_BITS = 64


def set_names(s: np.ndarray, bits: int = ID_BITS) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set of shingles: its name and, for sets whose names agree, another one. Equal sets
    have equal names."""
    x, out = s if len(s) else np.zeros(1, np.uint64), []
    for k in (0, 2):
        spread = mix64((x + np.uint64(0x1234567887654321)) * _STEP[k])
        both = spread.sum(keepdims=True) * _STEP[k + 1] ^ (np.bitwise_xor.reduce(mix64(spread), keepdims=True) + np.uint64(len(s)))
        out.append(int(mix64(both).view(np.int64)[0]))
    return out[0] >> (64 - bits), out[1]


def _cells(s: np.ndarray, band: int, need: int, seed: int) -> np.ndarray | None:
    """Keys of the first ``need`` filled cells of a set's sketch in a band's layout; None if fewer are filled."""
    m = max(LEAST_CELLS, int(CELLS * (2 << band)))
    if seed:
        s = np.sort(mix64(s + np.uint64(seed) * _STEP[0]))
    cell = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    if len(at) < need:
        return None
    stop = at[need] if len(at) > need else len(s)
    parity = np.bitwise_xor.reduceat(mix64(s[:stop] ^ _STEP[1]), at[:need])
    filled = parity != 0
    if not filled.all():
        return None
    return mix64(parity + (cell[at[:need]] + np.uint64(band << 40) + np.uint64(1)) * _STEP[2])


def sketch_keys(s: np.ndarray, seed: int = 0) -> np.ndarray | None:
    """The cell keys that a set emits; None if a layout fills too few cells for the bound to hold (try another seed)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    band = n.bit_length() - 1
    out = [_cells(s, band, (n + n * SIM_DEN // SIM_NUM) // 9 + 1, seed)]
    edge = (1 << band) - 1
    if edge and n * SIM_NUM <= edge * SIM_DEN:
        out.append(_cells(s, band - 1, (n + edge) // 9 + 1, seed))
    return None if any(x is None for x in out) else np.concatenate(out)


def bit_sketch(s: np.ndarray) -> bytes:
    """A parity bit for each of 2^k >= 4 |s| cells (64 at least): each shingle flips the bit of its hash. So few cells
    get two of the differing shingles that pairs of a similarity below about 0.79 are told apart."""
    bits = max(64, 1 << max(0, 4 * len(s) - 1).bit_length())
    flips = np.bincount((mix64(s ^ _STEP[3]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch_: bytes, size: int) -> np.ndarray:
    """A sketch as ``size`` bytes: the XOR of its parts is the sketch of fewer bits. Rows of uint64."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch_, np.uint64).reshape(-1, size // 8), axis=0)


def may_link(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose sketches differ in ``distance`` bits can link."""
    return (9 * distance <= n + m) & (np.minimum(n, m) * SIM_DEN >= np.maximum(n, m) * SIM_NUM)


def _sketched(seed: int, id_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            n, names, others, keys, lengths, failed, bits = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                name, other = set_names(s, id_bits)
                k = np.zeros(0, np.uint64)
                if len(s) and (name, other) not in seen:  # equal sets of a task emit once
                    seen.add((name, other))
                    k = sketch_keys(s, seed)
                failed.append(k is None)
                k = np.zeros(0, np.uint64) if k is None else k
                n.append(len(s))
                bits.append(bit_sketch(s))
                names.append(name)
                others.append(other)
                keys.append(k)
                lengths.append(len(k))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(others, pa.int64()), pa.array(failed), lists, pa.array(bits, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_id", "other", "failed", "keys", "sketch"])

    return run


SKETCHES = "doc_id long, text_key long, n_shingles long, set_id long, other long, failed boolean, keys array<long>, sketch binary"


def sketch(docs: DataFrame, id_bits: int = ID_BITS) -> tuple[DataFrame, bool]:
    """(doc_id, text_key, n_shingles, set_id, other, failed, keys, sketch), written, and whether a doc_id is null; text_key
    is a hash of the text.

    A seed that leaves a set with too few filled cells is given up for the next one, so that the bound holds for all
    sets. Sets that differ and have one 64-bit name get new names from both their hashes.
    """
    seed, rows = 0, docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    while True:
        out, told = counted(rows.mapInArrow(_sketched(seed, id_bits), SKETCHES), "sketches", failed=F.count_if("failed"), nameless=F.count_if(F.col("doc_id").isNull()))
        if not told["failed"]:
            break
        dropped(out)
        seed += 1
    alike = out.where("n_shingles > 0").groupBy("set_id").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
    alike, several = counted(alike.select("set_id").coalesce(1), "alike")
    if several["rows"]:
        new = F.when(F.col("alike"), renamed("set_id", "other")).otherwise(F.col("set_id"))
        out = written(out.join(alike.withColumn("alike", F.lit(True)), "set_id", "left").withColumn("set_id", new).select(out.columns), "sketches")
    return out, told["nameless"] > 0


def renamed(name, other):
    """The name of a set whose own one another set has too."""
    return F.col(name).bitwiseXOR(F.col(other)) if isinstance(name, str) else name ^ other


def _shared_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, set_id): each bucket's rows with their bucket's first set, for buckets of two sets or
    more. A bucket may span batches; only its first set is carried."""
    last_key = last_id = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, name = batch.column("key").to_numpy(), batch.column("set_id").to_numpy()
        new_key = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[last_id is None or name[0] != last_id], name[1:] != name[:-1]])
        first = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
        hubs = np.where(first >= 0, name[np.maximum(first, 0)], 0 if hub is None else hub)
        follows = new & ~new_key
        out_key, out_hub, out_name = key[follows], hubs[follows], name[follows]
        yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_hub), pa.array(out_name)], ["key", "hub", "set_id"])
        last_key, last_id, hub = key[-1], name[-1], hubs[-1]


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """(key, hub, set_id): for each cell key that several sets emit, its smallest set and each other one."""
    rows = sketches.select(F.explode("keys").alias("key"), "set_id")
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", "set_id")
    return rows.mapInArrow(_shared_buckets, "key long, hub long, set_id long")


def _linked(id_bits: int):
    """From (hub, salt, role, set_id, text), a hub's own text first: the pairs whose sets link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = hub_set = None
        for batch in slices(batches):
            rows = zip(batch.column("hub").to_pylist(), batch.column("role").to_pylist(), batch.column("set_id").to_pylist(), shingle_sets(batch.column("text").to_pylist()), strict=True)
            left, right = [], []
            for h, role, name, s in rows:
                own = set_names(s, id_bits)
                if name not in (own[0], renamed(*own)):  # another text with the same text_key
                    continue
                if role == 0:
                    hub, hub_set = h, s
                elif h == hub and links(hub_set, s):
                    left.append(h)
                    right.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 |a and b| >= 80 |a or b|, for ascending distinct arrays, neither empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) * SIM_DEN < len(large) * SIM_NUM:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return SIM_DEN * both >= SIM_NUM * (len(a) + len(b) - both)


#: Members that are compared with one copy of a hub's text.
HUB_MEMBERS = 64


def verified(pairs: DataFrame, texts: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """The rows of ``pairs`` (hub, set_id) that link, as (u, v); ``texts`` has (set_id, text).

    Each member's text meets its hub's in a stream sorted by hub; a hub with many members is salted, so that no task
    gets them all.
    """
    spread = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("salts"))
    members = pairs.join(spread, "hub").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("salts")).cast("int"))
    members = members.select("set_id", "hub", "salt").join(texts, "set_id").select("hub", "salt", F.lit(1).alias("role"), "set_id", "text")
    hubs = spread.withColumnRenamed("hub", "set_id").join(texts, "set_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hubs = hubs.select(F.col("set_id").alias("hub"), "salt", F.lit(0).alias("role"), "set_id", "text")
    rows = hubs.union(members).repartition(shuffle_partitions(pairs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return rows.mapInArrow(_linked(id_bits), "u long, v long")


def _passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("n2").to_numpy()
        left, right = batch.column("sketch").to_pylist(), batch.column("sketch2").to_pylist()
        far = np.array([int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum()) for x, y in zip(left, right, strict=True) for k in (min(len(x), len(y)),)], np.int64)
        yield batch.select(["hub", "set_id"]).filter(pa.array(may_link(n, m, far)))


#: Sets of a bucket that meet at once, and smallest keys of a set that its rows carry.
BLOCK, LOWEST = 1024, 16


def _crossing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, bi, bj): pairs of sets of one block pair, of different components, that may link. A pair
    is left to another bucket if a smaller key is among both sets' lowest ones (then they meet there)."""
    seen: set[tuple[int, int]] = set()

    def met(rows: list[dict]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        size = min(len(r["sketch"]) for r in rows)
        bits = np.stack([folded(r["sketch"], size) for r in rows])
        n, comp, name = (np.array([r[c] for r in rows]) for c in ("n", "component", "set_id"))
        own = np.array([r["blk"] for r in rows])
        across, key = rows[0]["bi"] != rows[0]["bj"], rows[0]["key"]
        lower = [{k for k in r["low"] if k < key} for r in rows]
        out = []
        for i in range(len(rows) - 1):
            ok = comp[i + 1 :] != comp[i]
            if across:
                ok &= own[i + 1 :] != own[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                at = at[may_link(n[i], n[at], np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1).astype(np.int64))]
                out += [(min(a, b), max(a, b)) for a, b in ((int(name[i]), int(name[j])) for j in at if lower[i].isdisjoint(lower[j]))]
        return out

    held, at = [], None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if (key := (row["key"], row["bi"], row["bj"])) != at:
                found += met(held)
                held, at = [], key
            held.append(row)
        new = list(set(found) - seen)
        seen.update(new)
        if len(seen) > 1_000_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], ["hub", "set_id"])
    last = met(held)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64())], ["hub", "set_id"])


def _texts(docs: DataFrame, first: DataFrame, pairs: DataFrame, nameless: bool) -> DataFrame:
    """(set_id, text) of the sets in ``pairs``. A row is found by its doc_id and its text's hash, one without a doc_id (if
    there are any) by the hash alone (of equal texts one goes, so that copies neither multiply nor meet in a task)."""
    named = pairs.select("set_id").union(pairs.select("hub")).distinct()
    wanted = first.select("set_id", "doc_id", "text_key").join(named, "set_id", "left_semi")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    told = rows.join(wanted.where("doc_id is not null").hint("shuffle_hash"), ["doc_id", "text_key"]).select("set_id", "text")
    if not nameless:
        return told
    unnamed = rows.where("doc_id is null").groupBy("text_key").agg(F.min("text").alias("text"))
    return told.union(unnamed.join(wanted.where("doc_id is null").select("set_id", "text_key").hint("shuffle_hash"), "text_key").select("set_id", "text"))


def joined_components(near: DataFrame, links: DataFrame) -> DataFrame:
    """``near`` (node, component) with ``links`` (u, v) added: whole components are joined, not their nodes again."""
    of = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    both = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    tops = connected_components(both.select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")))
    inside = near.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return inside.union(tops.join(near.select("node"), "node", "left_anti").select("node", "component"))


def set_components(docs: DataFrame, sketches: DataFrame, nameless: bool, id_bits: int = ID_BITS) -> DataFrame:
    """(node, component) of the linked sets.

    First each bucket's sets meet its smallest one; then, in the buckets that still hold several components, sets of
    different components meet each other in blocks: a pair inside one component can't change it. Pairs whose bit
    sketches differ too much go; the others' texts are compared.
    """
    buckets, n = counted(shared_buckets(sketches), "buckets")
    pairs, n = counted(buckets.select("hub", "set_id").distinct().coalesce(files_for(n["rows"])), "pairs")
    small = files_for(n["rows"])
    named = pairs.select("set_id").union(pairs.select("hub")).distinct()
    per_set = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "n_shingles", "sketch")).alias("x"), F.max(F.slice(F.array_sort("keys"), 1, LOWEST)).alias("low")
    first = sketches.groupBy("set_id").agg(*per_set).select("set_id", "x.doc_id", "x.text_key", F.col("x.n_shingles").alias("n"), "x.sketch", "low").join(named, "set_id", "left_semi")
    first = written(first.coalesce(8 * small), "first")
    info = first.select("set_id", "n", "sketch")
    both = pairs.join(info, "set_id").join(info.select(F.col("set_id").alias("hub"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "hub")
    passing = written(both.mapInArrow(_passing, "hub long, set_id long").coalesce(16 * small), "passing")
    edges = written(verified(passing, _texts(docs, first, passing, nameless), id_bits), "links")
    dropped(passing)
    near = connected_components(edges)
    rows = buckets.select("key", "set_id").union(buckets.select("key", F.col("hub").alias("set_id"))).distinct()
    component = near.select(F.col("node").alias("set_id"), "component")
    rows = rows.join(component, "set_id", "left").select("key", "set_id", F.coalesce("component", "set_id").alias("component"))
    sizes = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("held"))
    sizes = sizes.where("a <> b and held > 2").select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("blk", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "set_id", "component")
    rows = rows.join(info.join(first.select("set_id", "low"), "set_id"), "set_id").repartition(shuffle_partitions(docs.sparkSession), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "set_id")
    cross = rows.mapInArrow(_crossing, "hub long, set_id long").distinct().join(pairs, ["hub", "set_id"], "left_anti")
    cross, n = counted(cross.coalesce(16 * small), "cross")
    dropped(buckets)
    if n["rows"]:
        near = joined_components(near, written(verified(cross, _texts(docs, first, cross, nameless), id_bits), "links"))
    for table in (pairs, first, cross):
        dropped(table)
    return near


def members(docs: DataFrame, id_bits: int = ID_BITS) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text_key, n_shingles, component) of rows with shingles; (doc_id, n_shingles) of the others; files for a table
    of all rows. Components are named by sets."""
    sketches, nameless = sketch(docs, id_bits)
    sets = set_components(docs, sketches, nameless, id_bits)
    rows = sketches.select("doc_id", "text_key", "n_shingles", "set_id")
    held = rows.where("n_shingles > 0").join(sets.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    return held.select("doc_id", "text_key", "n_shingles", "component"), rows.where("n_shingles = 0").select("doc_id", "n_shingles"), files_for(rows.count())


def near_duplicates(docs: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Rows whose sets link are in one component, named by its smallest doc_id; equal sets link. A null or empty text, or
    one of white space, has no shingles and is a component of its own, as is every row that links with nothing. An
    empty table gives an empty result; a row that occurs twice is returned twice.
    """
    held, alone, files = members(docs, id_bits)
    held = written(held.select("doc_id", "n_shingles", "component").coalesce(files), "components")
    # written, so that the join reads two exchanges and Spark can split the partition of a large component
    least = written(held.groupBy("component").agg(F.min("doc_id").alias("component_id")).coalesce(files), "least")
    out = held.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return out.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, and of its texts there (rows of one doc_id may have
    several) the one with the least hash. A component of other texts of that doc_id keeps a row of its own.

    Rows that are equal in doc_id and text are one document: the row with the least hash of all columns stays. Rows
    without a doc_id all stay, as do those without shingles (no text, or no word in it).
    """
    held, _, files = members(docs)
    texts = held.where("doc_id is not null").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    kept = texts.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("x")).select("x.*")
    kept, n = counted(kept.coalesce(files), "kept", several=F.count_if(F.col("n") > 1))
    key, ident, rank = (spare(docs.columns, "_one") + c for c in ("key", "id", "rank"))
    chosen = kept.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).hint("shuffle_hash")
    keyed = docs.withColumn(rank, F.xxhash64("text"))
    out = keyed.join(chosen, (F.col("doc_id") == F.col(ident)) & (F.col(rank) == F.col(key)), "left_semi")
    if n["several"]:
        out = out.groupBy("doc_id", rank).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(key)).select(f"{key}.*")
    return out.select(*docs.columns).union(docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row; see ``near_duplicates``. A text is hashed whole, at some 80
    bytes of memory a byte."""
    return near_duplicates(documents(spark, sf_dir))


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select u, v from e union all select v, u from e),
reach as (select doc_id as u, doc_id as v from documents union select r.u, b.v from reach r join both_ways b on r.v = b.u),
c as (select u, min(v) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from documents d left join n using (doc_id) join c on c.u = d.doc_id
"""
