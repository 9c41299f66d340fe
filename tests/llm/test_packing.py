import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing


def check(df, docs, capacity):
    """Every id once and in order, no gap, no overlap; returns the number of sequences."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = defaultdict(list)
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        ends = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            want[d].append((k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(n for v in want.values() for _, _, n, _ in v)


def test_pack(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["alpha", "été", "12", "x\n", "don't"]) for _ in range(r.randrange(0, 400)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 3000), (None, "a b"), (5, "again"), (1003, "<|endoftext|> tail")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, bin string, fill int").repartition(12)
    n, tokens = check(packing.pack(df), docs, 1024)
    assert n <= tokens / 1024 * 1.05 + 1
    n, tokens = check(packing.pack(df, capacity=64, fan_in=2), docs, 64)
    assert n <= tokens / 64 * 1.1 + 1


def test_unmergeable_bins_end(spark):
    docs = [(i, "a b c d") for i in range(50)]
    n, _ = check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), capacity=9, fan_in=2), docs, 9)
    assert n == 50


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_against_search():
    r = random.Random(4)
    for _ in range(200):
        sizes = sorted((r.randrange(1, 21) for _ in range(30)), reverse=True)
        fills, want = [], []
        for i, s in enumerate(sizes):
            room = [(20 - f, -b) for b, f in enumerate(fills) if 20 - f >= s]
            if room:
                b = -min(room)[1]
                fills[b] += s
            else:
                b = len(fills)
                fills.append(s)
            want.append(b)
        got = packing.best_fit(sizes, 20)
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(fills)


def test_added_tokens_as_the_tokenizer_has_them(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  ", "<|endoftext|", "a  <|endoftext|>\n b <|EndOfText|>", "plain words", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.op3_packing(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert got[k] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), text
