"""Packing of documents into sequences of a bounded number of tokens, by hierarchical residual packing.

Every partition packs its own pieces best-fit (largest first, each into the fullest bin that takes it) and
emits the nearly full bins. Underfull bins become items of the next round, which merges the partitions of
the last one by a fixed fan-in and packs again, until one partition is left or merging no longer lowers
their number. Only underfull bins move; the pieces stay where they were written.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import UnitEncoder, default_pattern, default_vocabulary, encoding
from gridloom.llm.common import materialise, small_or_shuffled, table

CAPACITY = 1024
END_ID = 2
#: A bin with at most this many free tokens is nearly full and is not packed further.
SLACK = 1
#: Partitions of one round that become one of the next.
FAN_IN = 8
#: A partition of a round takes about this many underfull bins; it bounds a task's memory.
ROUND_ITEMS = 100_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``, which are taken in the given order; each goes into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if not by_room[room]:
            rooms |= 1 << room
        by_room[room].append(b)
    return bins


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or pieces of the capacity behind a first one that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(a, capacity) for a in range(first, length, capacity)]


def default_added_tokens() -> dict[str, int]:
    """The added tokens of the tokenizer's file, which it finds in a text before it splits and merges."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for t in found:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token with options: {t}")
    return {t["content"]: t["id"] for t in found}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset int, fill int"
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _packed_pieces(vocabulary: str, pattern: str, capacity: int, end_id: int, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = UnitEncoder(encoding(vocabulary, pattern).encode_ordinary, lambda ids: struct.pack(f"<{len(ids)}I", *ids))
        end, pieces = struct.pack("<I", end_id), []
        own = {t: struct.pack("<I", i) for t, i in added.items()}
        split = re.compile("(" + "|".join(map(re.escape, own)) + ")").split if own else None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if own and any(t in text for t in own):  # the texts between added tokens are encoded each on its own
                    ids = b"".join([own[part] if k % 2 else b"".join(enc.units(part)) for k, part in enumerate(split(text))] + [end])
                else:
                    ids = b"".join([*enc.units(text), end])
                for k, (a, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    pieces.append((n, doc_id, k, a, zlib.crc32(ids[4 * a : 4 * (a + n)])))
        # the order within a partition of files is fixed, so a task that runs again gives the same bins
        pieces.sort(key=lambda p: -p[0])
        base, rows = TaskContext.get().partitionId() << 33, []
        for b, members in enumerate(best_fit([p[0] for p in pieces], capacity)):
            fill, at = sum(pieces[i][0] for i in members), 0
            for i in members:
                n, doc_id, k, a, crc = pieces[i]
                rows.append((doc_id, k, a, n, crc, base + b, at, fill))
                at += n
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for a in range(0, len(rows), 10_000):
            cols = zip(*rows[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_TYPES)], names)

    return run


_MEMBERS = pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int32())]))
_BINS = "bin long, fill int, members array<struct<bin: long, base: int>>"


def _merged(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(r["bin"], r["fill"], r["members"]) for b in batches for r in b.to_pylist()]
        items.sort(key=lambda x: (-x[1], x[0]))
        rows = []
        for group in best_fit([x[1] for x in items], capacity):
            at, members = 0, []
            for i in group:
                members += [{"bin": m["bin"], "base": m["base"] + at} for m in items[i][2]]
                at += items[i][1]
            rows.append((items[group[0]][0], at, members))
        for a in range(0, len(rows), 5_000):
            cols = zip(*rows[a : a + 5_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), _MEMBERS))], ["bin", "fill", "members"])

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    vocabulary: str | None = None,
    pattern: str | None = None,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Repeated rows and
    null ids are documents of their own. ``added`` has ids of tokens that are taken out of a text before it is
    encoded; without it such a token is text. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    partitions = max(1, rows.rdd.getNumPartitions())
    pieces = materialise(rows.mapInArrow(_packed_pieces(vocabulary or default_vocabulary(), pattern or default_pattern(), capacity, end_id, added or {}), _PIECES), "pieces")
    is_open = F.col("fill") < capacity - slack
    bins = pieces.filter(is_open & (F.col("bin_offset") == 0)).select(
        "bin", "fill", F.array(F.struct(F.col("bin"), F.lit(0).cast("int").alias("base"))).alias("members")
    )
    done, waiting = [], bins.count()
    while waiting and partitions > 1:
        merged = max(-(-partitions // fan_in), -(-waiting // ROUND_ITEMS))
        if merged >= partitions:
            break
        partitions = merged
        last = materialise(bins.repartition(partitions, "bin").mapInArrow(_merged(capacity), _BINS), "bins")
        done.append(last.filter(~is_open))
        bins = last.filter(is_open)
        waiting = bins.count()
    for d in done[1:]:
        done[0] = done[0].unionByName(d)
    placed = (done[0].unionByName(bins) if done else bins).select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    placed = materialise(placed.select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.base").alias("base")), "placed")
    joined = pieces.join(small_or_shuffled(placed), "bin", "left")
    return joined.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.coalesce("base", F.lit(0)) + F.col("bin_offset")).cast("long").alias("offset"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=default_added_tokens())
