"""Token-ID files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.llm.common import documents, shuffle_partitions, table_path, written

END_ID = 1
STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
#: Cached words of a Python worker, and the longest word (bytes) that is cached.
CACHE_WORDS, CACHE_BYTES = 900_000, 64
#: What every special token holds.
SPECIAL = b"<|"
#: Texts that are encoded together.
ROWS = 500


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Words(dict):
    """ids of words, as little-endian uint32 bytes; a worker keeps them from task to task.

    The tokenizer drops white space and neither its normaliser nor its splitter looks across it, so that the ids of a
    text are the ids of its words in order. It composes letters (NFC) and then lower-cases; an ASCII word is lower-cased
    here, any other one and any that may hold a special token (``<|``: found before lower-casing) comes as it is. A word
    of Latin letters only is one piece, which the tokenizer's model takes as it is; a full stop or comma after a letter
    is a piece of its own. Any other word goes through the whole tokenizer.
    """

    kept: dict[str, _Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.piece, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    @classmethod
    def of(cls, path: str) -> _Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __missing__(self, word: bytes) -> bytes:
        if word.isascii() and SPECIAL not in word and (low := word.lower()) != word:
            got = self[low]
        elif word[-1] in b".," and word[-2:-1].isalpha():
            got = self[word[:-1]] + self[word[-1:]]
        elif word.isalpha():
            got = array("I", [t.id for t in self.piece(word.decode())]).tobytes()
        else:
            text = word.decode("utf-8")
            if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha():
                ids = [t.id for t in self.piece(low.encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            got = array("I", ids).tobytes()
        if len(word) <= CACHE_BYTES:
            self[word] = got
        return got


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, between ASCII white space. A-Z come in lower case, so that fewer words differ, wherever that
    changes no id: in texts that may hold no special token and are composed (NFC) either way."""
    text = text or ""
    data = text.encode()
    if SPECIAL in data:
        return data.split()
    low = data.lower()
    if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode()):
        return low.split()
    return data.split()


def encoder(path: str, end_id: int | None = END_ID):
    """A mapInArrow function: (doc_id, text) -> (doc_id, part, n_tokens, ids). ``part`` is the task's partition."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words.of(path)
        tail = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for at in range(0, batch.num_rows, ROWS):
                words = [words_of(t) for t in texts.slice(at, ROWS).to_pylist()]
                if len(known) > CACHE_WORDS:
                    known.clear()
                rows = [b"".join(map(known.__getitem__, w)) + tail for w in words]
                lengths = np.fromiter((len(r) // 4 for r in rows), dtype=np.int64, count=len(rows))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, ROWS), pa.array(np.full(len(rows), part, np.int32)), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "part", "n_tokens", "ids"]
                )

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID) -> None:
    """Encode whole texts (null: empty) and write ORC files in ascending doc_id order, a range of ids to a file.

    Stripes of STRIPE_BYTES are read in parallel; row indexes each INDEX_ROWS rows and a Bloom filter on doc_id let a
    reader skip stripes and row groups. Integer columns are run-length encoded. An empty table gives an empty folder of
    files with the schema; rows of equal doc_id stay side by side.
    """
    rows = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    encoded = rows.mapInArrow(encoder(tokenizer_path, end_id), "doc_id long, part int, n_tokens long, ids array<int>")
    encoded.write.option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, n_tokens, ids); filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, n_tokens long, ids array<int>").orc(path)


def token_starts(files: DataFrame) -> DataFrame:
    """Adds ``start``, the tokens of all rows before: totals of the parts first, then a running sum inside each part."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = files.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inner.join(totals, F.col("part") == F.col("p2")).withColumn("start", F.col("base") + F.col("inner")).drop("p2", "base", "inner")


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "n_tokens", "ids_crc32"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, from the files that hold the ids of all whole texts.

    A special token's string in a text is that token, as the library has it. A null or empty text, or one of white
    space, holds the end id alone. Repeated rows and rows of equal doc_id stay side by side, each with a start of its
    own (which one comes first of equal ids with different texts is not defined); a null doc_id comes first; an empty
    table gives an empty result. Other columns are not read. A text is encoded whole, at some 12 bytes of memory a byte.
    """
    import public_tokenizers

    path = table_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    read = read_token_files(spark, path).select("doc_id", "part", "ids").mapInArrow(_crc, "doc_id long, part int, n_tokens long, ids_crc32 long")
    return token_starts(written(read, "token-counts")).select("doc_id", "start", "n_tokens", "ids_crc32")
