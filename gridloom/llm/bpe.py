"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two neighbouring chunks
are stitched at the first pre-token boundary that both of them found in their overlap; the pieces between
such cuts are encoded and their ids follow one another. Decoding concatenates the raw bytes of the ids.

Why a cut is exact: a match of the pattern looks only forward, so what follows a true boundary does not
depend on what precedes it. The boundaries of a text's first chunk are true (but for the last two, which
the chunk's end may have moved). A boundary of the next chunk that equals a true one is true, and so are
all after it. Where an overlap holds no common boundary, the open piece grows by the next chunk and is
pre-tokenised again from the last cut, so the result is exact for every text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: Texts of more code points than this are cut into chunks.
LONG_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 1_024
#: Entries of a worker's memo of encoded units; it is emptied when full, which changes no result.
MEMO_ENTRIES = 300_000
MEMO_UNIT_CHARS = 64

_INSIDE_SPACE = re.compile(r"\s ")
_UNIT = re.compile(r"(?<=\S)(?= )")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(vocabulary: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})


class Memo(dict):
    """Results by key, computed when first asked for; bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_UNIT_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class UnitEncoder:
    """Encodes texts unit by unit: a unit starts at a space that follows something other than white space.

    White space never joins what precedes it in one match of the pattern, so each such place is a
    pre-token boundary and the units encode independently. ``make(ids)`` turns the ids of a unit into
    what :meth:`units` yields for it.
    """

    def __init__(self, encode, make):
        self.first = Memo(lambda u: make(encode(u)))
        self.rest = Memo(lambda u: make(encode(" " + u)))

    def units(self, text: str) -> list:
        if not text:
            return []
        if _INSIDE_SPACE.search(text):
            return [self.first[u] for u in _UNIT.split(text) if u]
        head, *tail = text.split(" ")
        out = [self.first[head]] if head else []
        out += map(self.rest.__getitem__, tail)
        return out


def _digest_unit(vocab: dict[int, bytes]):
    return lambda ids: (len(ids), " ".join(map(str, ids)), b"".join(map(vocab.__getitem__, ids)))


class _Digests:
    """Running digests of a document's ids and of the bytes that they decode to."""

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def __init__(self):
        self.n, self.ids, self.raw = 0, hashlib.sha256(), hashlib.sha256()

    @staticmethod
    def encoder(vocabulary: str, pattern: str) -> UnitEncoder:
        enc = encoding(vocabulary, pattern)
        vocab = {i: b for b, i in load_ranks(vocabulary).items()}
        return UnitEncoder(enc.encode_ordinary, _digest_unit(vocab))

    def add(self, units: list) -> None:
        if units:
            counts, ids, raw = zip(*units)
            self.ids.update(((" " if self.n else "") + " ".join(ids)).encode())
            self.n += sum(counts)
            self.raw.update(b"".join(raw))

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


class _Ids:
    """The ids themselves."""

    schema = "ids array<int>"
    arrow = [("ids", pa.list_(pa.int32()))]

    def __init__(self):
        self.ids = array("i")

    @staticmethod
    def encoder(vocabulary: str, pattern: str) -> UnitEncoder:
        return UnitEncoder(encoding(vocabulary, pattern).encode_ordinary, lambda ids: array("i", ids))

    def add(self, units: list) -> None:
        for u in units:
            self.ids.extend(u)

    def row(self) -> tuple:
        return (self.ids,)


def compiled_pattern(pattern: str):
    """The pattern for the regex module, with the white space of Unicode, which leaves out U+001C to U+001F."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(pattern, text: str) -> list[int]:
    """Where the matches of the pattern end, but for those that end in white space.

    What ends elsewhere matches the same without the text behind it; a run of white space may not.
    """
    return [m.end() for m in pattern.finditer(text) if not text[m.end() - 1].isspace()]


def _pretokenised(pattern: str):
    """Chunks with the boundaries that they found in their overlaps, as offsets in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compiled_pattern(pattern)
        for batch in batches:
            heads, tails = [], []
            for start, last, text in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "chunk"))):
                found = boundaries(compiled, text)
                found = found if last else found[:-2]
                heads.append([start + x for x in found if x <= OVERLAP_CHARS] if start else [])
                tails.append([] if last else [start + x for x in found if x >= CHUNK_CHARS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "heads", "tails"])

    return run


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        ids = [batch.column(c) for c in names]
        for i, text in enumerate(batch.column("text").to_pylist()):
            starts = list(range(0, len(text), CHUNK_CHARS))
            if len(starts) > 1 and len(text) - starts[-1] <= OVERLAP_CHARS:
                starts.pop()
            for a in range(0, len(starts), 64):
                part = starts[a : a + 64]
                chunks = [text[s:] if s == starts[-1] else text[s : s + CHUNK_CHARS + OVERLAP_CHARS] for s in part]
                keys = [pa.array([c[i].as_py()] * len(part), c.type) for c in ids]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(part, pa.int64()), pa.array([s == starts[-1] for s in part], pa.bool_()), pa.array(chunks, pa.string())], [*names, "start", "last", "chunk"])


def _stitched(kind, vocabulary: str, pattern: str):
    """Rows sorted by uid and start: cuts, encodes and feeds one sink a document, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, enc = compiled_pattern(pattern), kind.encoder(vocabulary, pattern)
        uid, sink, open_text, open_at, tails = None, None, "", 0, []
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("uid", "doc_id", "start", "last", "chunk", "heads", "tails")]
            for u, doc_id, start, last, text, heads, own_tails in zip(*cols):
                if start == 0:
                    uid, sink, open_text, open_at, tails = u, kind(), text, 0, own_tails
                else:
                    assert u == uid
                    heads = set(heads)
                    cut = next((x for x in tails if x in heads), None)
                    if cut is None:
                        open_text += text[open_at + len(open_text) - start :]
                        found = boundaries(compiled, open_text)
                        tails = [] if last else [open_at + x for x in found[:-2] if open_at + x >= start + CHUNK_CHARS]
                    else:
                        sink.add(enc.units(open_text[: cut - open_at]))
                        open_text, open_at, tails = text[cut - start :], cut, own_tails
                if last:
                    sink.add(enc.units(open_text))
                    out.append((doc_id, *sink.row()))
                    uid, sink, open_text, tails = None, None, "", []
            if out:
                yield _batch(kind, out)

    return run


def _whole(kind, vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kind.encoder(vocabulary, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, out = batch.slice(a, 512), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    sink = kind()
                    sink.add(enc.units(text))
                    out.append((doc_id, *sink.row()))
                yield _batch(kind, out)

    return run


def _batch(kind, rows: list[tuple]) -> pa.RecordBatch:
    fields = [("doc_id", pa.int64()), *kind.arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _encode(docs: DataFrame, kind, vocabulary: str | None, pattern: str | None) -> DataFrame:
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id long, {kind.schema}"
    # octet_length is known without decoding; a text of few bytes has few code points
    long_text = F.octet_length("text") > LONG_CHARS
    short = rows.filter(~long_text).mapInArrow(_whole(kind, vocabulary, pattern), schema)
    chunks = (
        rows.filter(long_text)
        .withColumn("uid", F.monotonically_increasing_id())
        .mapInArrow(_chunked, "doc_id long, uid long, start long, last boolean, chunk string")
    )
    found = chunks.repartition("uid", "start").mapInArrow(
        _pretokenised(pattern), "doc_id long, uid long, start long, last boolean, chunk string, heads array<long>, tails array<long>"
    )
    stitched = found.repartition("uid").sortWithinPartitions("uid", "start").mapInArrow(_stitched(kind, vocabulary, pattern), schema)
    return short.unionByName(stitched)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and the ``ids`` of every whole text, without special tokens.

    A null or empty text has no ids. Repeated rows and null ids each keep their own row; other columns of
    ``docs`` are not read. Vocabulary and pattern are those of the rank file in use.
    """
    return _encode(docs, _Ids, vocabulary, pattern)


def encode_digests(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """As :func:`encode`, with the number of ids, the sha256 of the decimal ids joined by spaces and that of the decoded bytes."""
    return _encode(docs, _Digests, vocabulary, pattern)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the raw bytes of ``ids``, concatenated. Null ids give null; no ids give no bytes."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {i: b for b, i in load_ranks(path).items()}
        for batch in batches:
            raw = [None if ids is None else b"".join(map(vocab.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
