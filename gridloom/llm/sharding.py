"""Shards of near equal bytes by a k-d tree over document metadata.

The tree splits a node at the weighted median (for an odd number of leaves: the weighted quantile) of its
widest metadata dimension until each leaf is one shard, which has its target of bytes. Dimensions are
language, source, size and id, each scaled to the whole table's range. All nodes of a level are split
together by exact distributed selection: a histogram of at most 1024 ranges a node tells in which range
the quantile lies, and the next histogram covers that range alone, until one item is left at the cut.

The items of the tree are groups of equal texts, which therefore stay in one shard; a group that would
fill more than a fixed part of a shard is split into parts that stay next to each other in every order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release, table

SHARDS = 40
#: Bytes that every row adds to those of its text.
ROW_BYTES = 16
#: Parts of a shard's target; a group of equal texts beyond one part is split into such parts.
PARTS_OF_TARGET = 16
#: Ranges of a histogram, and rows of a window that numbers slots.
RANGES = 1024
SLOT_ROWS = 50_000
DIMENSIONS = ("lang_at", "source_at", "size_at", "id_at")
_VALUE_BITS, _HASH_BITS, _PART_BITS = 20, 30, 12


@dataclass
class Node:
    first: int
    leaves: int
    dimension: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def number(self) -> Column:
        """The first shard of the leaf of a row, which also names the nodes that are not split yet."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col("keys")[self.dimension] <= F.lit(self.cut), self.left.number()).otherwise(self.right.number())

    def open(self) -> list[Node]:
        if self.left is not None:
            return self.left.open() + self.right.open()
        return [self] if self.leaves > 1 else []


def _scaled(column: str, low, high) -> Column:
    spread = float((high or 0) - (low or 0)) or 1.0
    return (F.coalesce(F.col(column), F.lit(low or 0)) - F.lit(low or 0)) / F.lit(spread)


def _selected(items: DataFrame, root: Node, dimension: dict[int, int], want: dict[int, float]) -> dict[int, int]:
    """The cut of each open node: the key up to which its items go left, whose weight is nearest to what is wanted."""
    spark = items.sparkSession
    numbered = items.withColumn("node", root.number())
    bounds = {n: (0, (1 << 62) - 1, 0.0) for n in dimension}  # lowest and highest key, weight below
    cuts: dict[int, int] = {}
    while bounds:
        rows = [(n, dimension[n], lo, hi, max(0, (hi - lo).bit_length() - RANGES.bit_length() + 1)) for n, (lo, hi, _) in sorted(bounds.items())]
        ranges = spark.createDataFrame(rows, "node int, dimension int, lo long, hi long, shift int")
        at = numbered.join(F.broadcast(ranges), "node").withColumn("key", F.col("keys")[F.col("dimension")])
        at = at.filter("key between lo and hi").withColumn("range", F.expr("shiftright(key - lo, shift)"))
        found: dict[int, list] = {}
        for r in at.groupBy("node", "range").agg(F.sum("w").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            found.setdefault(r.node, []).append((r.range, r.w, r.lo, r.hi))
        for n in list(bounds):
            lo, hi, below = bounds.pop(n)
            ordered = sorted(found.get(n, []))
            for k, (_, w, first, last) in enumerate(ordered):
                if below + w >= want[n] or k == len(ordered) - 1:
                    break
                below += w
            if first < last:
                bounds[n] = (first, last, below)
            else:
                cuts[n] = first if abs(below + w - want[n]) <= abs(below - want[n]) else first - 1
    return cuts


def build(items: DataFrame, shards: int) -> Node:
    """The tree over items of ``keys`` (an order per dimension), the dimensions and a weight ``w``."""
    root = Node(0, shards)
    while nodes := root.open():
        spans = [F.max(d) - F.min(d) for d in DIMENSIONS]
        seen = {}
        for r in items.withColumn("node", root.number()).groupBy("node").agg(F.sum("w").alias("w"), *(s.alias(d) for s, d in zip(spans, DIMENSIONS))).collect():
            seen[r.node] = (r.w, max(range(len(DIMENSIONS)), key=lambda i: (r[DIMENSIONS[i]] or 0.0, -i)))
        want = {n.first: seen[n.first][0] * (n.leaves // 2) / n.leaves for n in nodes if n.first in seen}
        cuts = _selected(items, root, {n: seen[n][1] for n in want}, want)
        for n in nodes:
            half = n.leaves // 2
            n.dimension, n.cut = (seen[n.first][1], cuts[n.first]) if n.first in seen else (0, -1)
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.leaves - half)
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The law is ``bytes``. A null text has no bytes, so its size is 16 and its checksum 0, as of an empty
    text. Null metadata stand at the low end of their dimension. Repeated rows are rows of their own, in
    their group. With fewer groups than shards some shards are empty; an empty table gives no rows. Slots
    follow the ids within buckets of rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1) / F.lit(float(1 << 63))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.when(F.col("lang").isNull(), 0.0).otherwise(place("lang")).alias("lang_at"),
            F.when(F.col("source").isNull(), 0.0).otherwise(place("source")).alias("source_at"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    whole = rows.agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("size").alias("small"), F.max("size").alias("large")).first()
    text_key = ["h", "text_crc32", "size"]
    part_bytes = max(1, (whole.w or 0) // (shards * PARTS_OF_TARGET))
    lowest = [F.min(c).alias(c) for c in ("doc_id", "lang_at", "source_at")]
    # the weights of all groups add up to the whole, so there are at most shards * PARTS_OF_TARGET of these
    large = rows.groupBy(*text_key).agg(F.count("*").alias("n"), *lowest).filter(F.col("n") * F.col("size") > part_bytes).filter("n > 1")
    large = large.select(*text_key, F.least(F.expr(f"cast(ceil(n * size / {part_bytes}) as long)"), F.col("n")).alias("parts"), *(F.col(c).alias(f"group_{c}") for c in ("doc_id", "lang_at", "source_at")))
    large = materialise(large, "large")
    parted = rows.join(F.broadcast(large), text_key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    item_key = [*text_key, "part"]
    items = parted.groupBy(*item_key).agg(F.sum("size").alias("w"), *(F.coalesce(F.min(f"group_{c}"), F.min(c)).alias(c) for c in ("doc_id", "lang_at", "source_at")))
    items = items.withColumns(
        {
            "id_at": _scaled("doc_id", whole.lo, whole.hi),
            "size_at": F.log2("size") / F.lit(40.0) if (whole.small or 1) == (whole.large or 1) else (F.log2("size") - F.log2(F.lit(whole.small))) / (F.log2(F.lit(whole.large)) - F.log2(F.lit(whole.small))),
        }
    )
    group_hash = F.shiftrightunsigned(F.xxhash64(*text_key), 64 - _HASH_BITS)
    tie = F.shiftleft(group_hash, _PART_BITS) + F.least(F.col("part"), F.lit((1 << _PART_BITS) - 1))
    top = float((1 << _VALUE_BITS) - 1)
    keys = F.array(*(F.shiftleft(F.floor(F.least(F.greatest(F.col(d), F.lit(0.0)), F.lit(1.0)) * top), _HASH_BITS + _PART_BITS) + tie for d in DIMENSIONS))
    items = materialise(items.withColumn("keys", keys).select(*item_key, "w", *DIMENSIONS, "keys"), "items")
    placed = items.select(*item_key, build(items, shards).number().alias("shard"))
    sharded = parted.join(placed, item_key).select("doc_id", "size", "text_crc32", "shard", "row")
    buckets = max(1, -(-whole.n // (shards * SLOT_ROWS)))
    sharded = materialise(sharded.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))), "sharded")
    release(rows, large, items)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("starts"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    numbered = sharded.withColumn("within", within).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("starts") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
