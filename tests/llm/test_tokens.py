"""Byte BPE, token files: against the libraries, and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quorumlake.llm import bpe, token_files

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = P.path("word_bpe_49k.json")

TEXTS = [
    (0, None),
    (1, ""),
    (2, "The thing isn't 12 o'clock,  is it?\n\n\tÄöüß été 日本語 　x\x85\x1c"),
    (3, "x" * 3000 + "é" * 500 + " <|endoftext|>"),
    (4, "hello hello hello"),
    (4, "hello hello hello"),
    (5, " \n\t "),
    (6, "İstanbul ΣΑΣ ǅ é a.b,c. don't"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, -1, "z") for i, t in TEXTS], "doc_id long, text string, n_tokens int, ids string").repartition(3)


def test_digests(spark, docs):
    got = sorted(map(tuple, bpe.multi_encoder(docs).digests(docs).collect()))
    want = []
    for i, t in TEXTS:
        ids = REFERENCE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_decode_to_text(spark, docs):
    encoded = bpe.multi_encoder(docs).ids(docs)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    for row in bpe.decode_ids(encoded, RANKS).collect():
        assert list(row["ids"]) == REFERENCE.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


def test_fold_of_words(spark):
    words = [" hello", "", "thingering", "heititionß", "a" * 40, " 日本語", None]
    rows = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()
    for row in rows:
        want = None if row["word"] is None else REFERENCE._core_bpe.encode_single_piece(row["word"].encode()) if row["word"] else []
        assert row["ids"] == want


@settings(max_examples=200, deadline=None)
@given(st.text("etaoinsr heélß日'", min_size=1, max_size=120))
def test_merge(word):
    assert bpe.merge(word.encode(), RANKS) == REFERENCE._core_bpe.encode_single_piece(word.encode())


@settings(max_examples=200, deadline=None)
@given(st.text("ab ıİſ1'.,\n\t\x85\x1c é!\u0c5c\U000107bb\U00011de0\u0e01٣", max_size=40))
def test_split(text):
    find = bpe._splitter(bpe.split_pattern(P.PATTERN), bpe.unicode_classes())
    assert sum((bpe.merge(w.encode(), RANKS) for w in find(text)), []) == REFERENCE.encode_ordinary(text)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.multi_encoder(none).digests(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abcéÉßÄäİıſŁﬁΣσςé'sx0.,!<|>endoftextñ é\x85\n", max_size=60))
def test_word_ids(text):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    known = token_files._Words.of(WORDS)
    data = b"".join(known[w] for w in text.encode().lower().split())
    assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs):
    from quorumlake.llm.common import table_path

    path = table_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, WORDS)
    read = token_files.read_token_files(spark, path)
    tokenizer = Tokenizer.from_file(WORDS)
    start, want = 0, []
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in token_files.token_starts(read).collect())
    assert got == want
    assert read.where("doc_id = 2").count() == 1
    crc = {tuple(r) for r in read.select("doc_id", "part", "ids").mapInArrow(token_files._crc, "doc_id long, part int, n_tokens long, ids_crc32 long").select("doc_id", "ids_crc32").collect()}
    assert crc == {(i, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, _, _, ids in want}


def test_empty_token_files(spark):
    from quorumlake.llm.common import table_path

    path = table_path(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert token_files.read_token_files(spark, path).count() == 0
