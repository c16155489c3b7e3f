"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins binary pieces.

The fold (``encode_words``) is a Spark higher-order ``aggregate`` over an array of binary pieces with a literal rank map.
Words that make up at least FREQUENT_SHARE of the corpus' words (so at most 1 / FREQUENT_SHARE of them: a proven bound)
are folded once for the whole corpus and their ids are shared with all tasks; a rarer word gets the same merges in the
task that meets it, which keeps the texts where they are (moving every word occurrence to its ids and back would
shuffle several times the input).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlake.llm.common import documents, dropped, release, written

FREQUENT_SHARE = 2.0**-18
#: Longest word, in bytes, that is folded or kept in a task's cache, and words of that cache.
WORD_BYTES, CACHE_WORDS = 64, 400_000
#: Literal rank map: an array of small maps, found by crc32 of a piece (a Spark map literal is searched linearly).
RANK_BUCKETS = 1 << 14
#: Unicode White_Space, spelled out: engines disagree on \s.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pattern(pattern: str) -> str:
    """``pattern`` with \\s and \\S as explicit classes, alike for Java and Python's regex."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % RANK_BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """Adds ``ids`` array<int> to (word string): the word's own rank, or else merges of the lowest rank,
    leftmost first, folded until none is left.

    A null word has null ids, an empty one none. Every byte has to have a rank.
    """
    data = F.col(word).cast("binary")
    steps = lambda n: F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    size = F.octet_length(F.col(word)).cast("int")
    parts = F.transform(steps(size), lambda i: F.substring(data, i, F.lit(1)))

    def folded(table: Column) -> Column:
        rank = lambda piece: F.element_at(F.element_at(table, (F.crc32(piece) % RANK_BUCKETS + 1).cast("int")), F.hex(piece))

        def merged(acc: Column, _: Column) -> Column:
            found = F.transform(steps(F.size(acc) - 1), lambda i: rank(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))))
            low = F.array_min(found)
            at = F.array_position(found, low).cast("int")
            joined = F.concat(F.slice(acc, F.lit(1), at - 1), F.array(F.concat(F.element_at(acc, at), F.element_at(acc, at + 1))), F.slice(acc, at + 2, F.size(acc)))
            return F.when(low.isNull(), acc).otherwise(joined)

        return F.when(rank(data).isNotNull(), F.array(rank(data))).otherwise(F.transform(F.aggregate(steps(size - 1), parts, merged), rank))

    # bound once, so that plans hold (and Spark's listeners keep) one copy of the literal
    ids = F.transform(F.array(F.struct(rank_literal(ranks).alias("table"))), lambda x: folded(x["table"]))[0]
    return words.withColumn("ids", F.when(data.isNotNull(), ids))


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` binary: the ids' pieces, concatenated. Null ids give null, no ids empty bytes; an id without a
    piece is an error."""
    hexed = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        hexed[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(hexed, separators=(",", ":"))), T.ArrayType(T.StringType()))
    return rows.withColumn("decoded", F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")))


def frequent_words(docs: DataFrame, pattern: str, share: float = FREQUENT_SHARE, text: str = "text") -> DataFrame:
    """(word): each distinct match of ``pattern`` of at most WORD_BYTES bytes that makes up ``share`` of all matches."""
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(split_pattern(pattern)), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where(F.octet_length("word") <= WORD_BYTES).where("n > 1"), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= total * share).select("word")


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, as the fold makes them; a heap of ranked pairs over a linked list for long words."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= WORD_BYTES:
        none, get = len(ranks), ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            whole = parts[at] + parts[at + 1]
            parts[at : at + 2] = [whole]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(whole + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + whole, none)
        return [ranks[p] for p in parts]
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    pair = lambda i: ranks.get(word[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[i], end[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = 0
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[k], end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class _Cache(dict):
    """What a word of the text becomes, as ``make`` of its ids; words not shared with the task are merged on demand.

    A worker keeps its cache from task to task, until it holds CACHE_WORDS words of its own.
    """

    kept: dict[tuple, _Cache] = {}

    def __init__(self, shared: dict[str, list[int]], ranks: dict[bytes, int], make):
        super().__init__((w, make(ids)) for w, ids in shared.items())
        self.frequent, self.ranks, self.make = dict(self), ranks, make

    @classmethod
    def of(cls, name: tuple, shared: dict[str, list[int]], ranks: dict[bytes, int], make) -> _Cache:
        if name not in cls.kept:
            cls.kept.clear()
            cls.kept[name] = cls(shared, ranks, make)
        return cls.kept[name]

    def __missing__(self, word: str):
        data = word.encode("utf-8")
        got = self.make(merge(data, self.ranks))
        if len(data) <= WORD_BYTES:
            self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > len(self.frequent) + CACHE_WORDS:
            self.clear()
            self.update(self.frequent)


def _ranges(characters: set[str]) -> str:
    """A character class's inside."""
    points, out = sorted(map(ord, characters)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def unicode_classes() -> dict[str, str]:
    """tiktoken's letters (L) and numbers (N), and the characters (odd) that regex, of another Unicode version, puts
    elsewhere."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    own = {bytes([b]): b for b in range(256)}
    told = {k: set(bytes(tiktoken.Encoding(k, pat_str=rf"\p{{{k}}}", mergeable_ranks=own, special_tokens={}).encode_ordinary(every)).decode()) for k in "LN"}
    odd = set().union(*(told[k] ^ set(regex.findall(rf"\p{{{k}}}", every)) for k in "LN"))
    return {k: _ranges(v) for k, v in told.items()} | {"odd": _ranges(odd), "least": min(odd, default="")}


def _splitter(pattern: str, classes: dict[str, str]):
    """The matches of ``pattern`` in a text, in order; ASCII texts take the same pattern with ASCII classes, those with a
    character of ``classes['odd']`` take it with tiktoken's spelled out."""

    def spelled(letters: str, numbers: str) -> str:
        return re.sub(r"(?<=[\[\w])\\p\{L\}\\p\{N\}", lambda _: letters + numbers, pattern).replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")

    plain, full = re.compile(spelled("A-Za-z", "0-9")).findall, regex.compile(pattern).findall
    if not classes["odd"]:
        return lambda text: (plain if text.isascii() else full)(text)
    # one range first: few texts hold so high a character
    high, odd, own = re.compile(f"[{classes['least']}-\U0010ffff]").search, re.compile(f"[{classes['odd']}]").search, []

    def find(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        if not high(text) or not odd(text):
            return full(text)
        if not own:
            own.append(regex.compile(spelled(classes["L"], classes["N"])).findall)
        return own[0](text)

    return find


class Encoder:
    """Encodes whole texts in tasks; the ids of frequent words come from the fold."""

    def __init__(self, docs: DataFrame, path: str, pattern: str, text: str = "text"):
        self.ranks, self.pattern, self.text = load_ranks(path), split_pattern(pattern), text
        words = frequent_words(docs, pattern, text=text)
        folded = encode_words(words, self.ranks).toPandas()
        dropped(words)
        shared = dict(zip(folded["word"], map(list, folded["ids"]), strict=True))
        release(docs.sparkSession)  # the plan that held the literal
        self.classes = unicode_classes()
        self.shared = docs.sparkSession.sparkContext.broadcast((shared, self.ranks))
        self.name = uuid.uuid4().hex

    def ids(self, docs: DataFrame, column: str = "ids") -> DataFrame:
        """Adds ``column`` array<int>, the text's ids (null or empty text: none); a column of that name gives way."""
        shared, pattern, text, name, classes = self.shared, self.pattern, self.text, self.name, self.classes
        kept = [c for c in docs.columns if c != column]
        schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(column, T.ArrayType(T.IntegerType()))])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ranks = shared.value
            find = _splitter(pattern, classes)
            cache = _Cache.of(("ids", name), words, ranks, lambda ids: np.asarray(ids, np.int32).tobytes())
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    rows = [b"".join(map(cache.__getitem__, find(t.as_py() or ""))) for t in part.column(text)]
                    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], [*kept, column])
                    cache.trim()

        return docs.mapInArrow(run, schema)

    def digests(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the text's ids and of the bytes they decode to, a row for
        each row of ``docs``. A null or empty text has no ids: 0 and the digests of no bytes."""
        shared, pattern, text, name, classes = self.shared, self.pattern, self.text, self.name, self.classes

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ranks = shared.value
            pieces = {rank: piece for piece, rank in ranks.items()}
            find = _splitter(pattern, classes)
            # one entry a word: decimal ids, then what its ids decode to
            cache = _Cache.of(("digests", name), words, ranks, lambda ids: (",".join(map(str, ids)), b"".join(pieces[i] for i in ids)))
            for batch in batches:
                n, ids_sha, text_sha = [], [], []
                for t in batch.column(text):
                    if found := find(t.as_py() or ""):
                        decimals, decoded = zip(*map(cache.__getitem__, found), strict=True)
                        joined = ",".join(decimals).encode()
                    else:
                        joined, decoded = b"", ()
                    n.append(joined.count(b",") + bool(joined))
                    ids_sha.append(hashlib.sha256(joined).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                    cache.trim()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def multi_encoder(docs: DataFrame) -> Encoder:
    import public_tokenizers

    return Encoder(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row, repeated ones and those without a doc_id
    included. Texts are encoded whole (null: empty); a word of any length is merged with a heap, in time n log n. An
    empty table gives an empty result. Columns but doc_id and text are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return multi_encoder(docs).digests(docs)
