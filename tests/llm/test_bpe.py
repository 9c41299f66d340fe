import hashlib
import random

import public_tokenizers
import pytest

from gridloom.llm import bpe

SCHEMA = "doc_id long, text string, lang string, ids string, uid string"
WORDS = ["the", "Été", "12", "don't", "we'll", "x", "\n", "  ", "\t", "…", "日本", "a" * 40, "'", "''s", "\x1c", " ", "é"]


def oracle():
    return bpe.encoding(bpe.default_vocabulary(), public_tokenizers.PATTERN)


def texts():
    r = random.Random(1)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "it's 'll", "x'", None, "<|endoftext|> x"]
    out += ["".join(r.choice(WORDS) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(150)]
    return out


def expected(text):
    ids = oracle().encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def check(spark, given):
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(given)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: expected(t) for i, t in enumerate(given)}


def test_short_texts(spark):
    check(spark, texts())


def test_chunks_stitch(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 0)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    monkeypatch.setattr(bpe, "OVERLAP_CHARS", 12)
    stitched = bpe._stitched(bpe._Digests, bpe.default_vocabulary(), public_tokenizers.PATTERN)
    import pyarrow as pa

    given = [t for t in texts() if t] + ["b" * 400, " " * 300, "1" * 130 + "'ll" * 90, "ab " * 120]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(given)), pa.int64()), pa.array(range(len(given)), pa.int64()), pa.array(given)], ["doc_id", "uid", "text"])
    out = list(stitched(bpe._pretokenised(public_tokenizers.PATTERN)(bpe._chunked([batch]))))
    got = {d["doc_id"]: (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) for b in out for d in b.to_pylist()}
    assert got == {i: expected(t) for i, t in enumerate(given)}


def test_long_texts_through_spark(spark):
    r = random.Random(2)
    check(spark, ["".join(r.choice(WORDS) + " " for _ in range(20_000)), "z" * 70_000, "short"])


def test_round_trip_and_repeats(spark):
    df = spark.createDataFrame([(1, "été 12"), (1, "été 12"), (None, "x"), (2, None)], "doc_id long, text string")
    tokens = bpe.encode(df)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in bpe.decode(tokens).collect()) == [(0, b"x"), (1, "été 12".encode()), (1, "été 12".encode()), (2, b"")]


def test_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
