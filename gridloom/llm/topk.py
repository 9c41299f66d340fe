"""Exact top-k inner products over a bit-sliced index.

The index holds blocks of rows. In a block every attribute is stored as bit slices: bitmaps over the
block's rows, one per binary digit, in two's complement. A query's scores are the sum of its attributes'
slices, shifted and negated as the query's digits say, which carry-save adders form by bitmap arithmetic
alone. The top rows are then taken from the most significant slice of the sum downward: rows certain to be
in are kept, rows certain to be out are left, and the rows still tied after the last slice have equal
scores, so that the smaller ids among them win. A block answers a query with its own k best rows, and a
ranking over blocks gives the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gridloom.llm.common import table

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Values (rows times components) of a block, and queries of a chunk.
BLOCK_VALUES = 1 << 22
CHUNK_QUERIES = 256
#: Quantised values beyond this leave the slices and are scored in Python's unbounded integers.
MAX_VALUE = 1 << 24


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """A bitmap of 64-bit words from booleans."""
    words = -(-len(bits) // 64)
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def slices_of(values: np.ndarray) -> list[np.ndarray]:
    """Two's complement slices of a column of integers, the least significant first; the last is the sign."""
    width = max(int(values.max()).bit_length(), int(-values.min() - 1).bit_length() if values.min() < 0 else 0) + 1
    return [pack_bits((values >> b) & 1) for b in range(width)]


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form: the fewest signed powers of two that add up to ``q``."""
    out, shift = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((shift, sign))
            q -= sign
        q >>= 1
        shift += 1
    return out


class SlicedBlock:
    """The slices of a block of quantised rows, and top-k over them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.slices = [slices_of(self.values[:, d]) for d in range(values.shape[1])]
        self.negated = [[~s for s in column] for column in self.slices]
        self.present = pack_bits(np.ones(len(ids), np.uint8))

    def sum_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Two's complement slices of the scores, without a constant that is the same for all rows, and that constant.

        A term is a column shifted by one digit of the query, of which the sign slice is inverted so that it
        counts upward; what that adds, and the one that a negation adds, goes into the constant.
        """
        columns: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query.tolist()):
            for shift, sign in signed_digits(q):
                source = self.slices[d] if sign > 0 else self.negated[d]
                top = len(source) - 1
                while len(columns) <= shift + top:
                    columns.append([])
                for b in range(top):
                    columns[shift + b].append(source[b])
                columns[shift + top].append(self.negated[d][top] if sign > 0 else self.slices[d][top])
                constant += (1 << shift) * ((0 if sign > 0 else 1) - (1 << top))
        out = []
        b = 0
        while b < len(columns):
            column = columns[b]
            while len(column) > 1:
                x, y = column.pop(), column.pop()
                z = column.pop() if column else None
                if b + 1 == len(columns):
                    columns.append([])
                half = x ^ y
                if z is None:
                    columns[b + 1].append(x & y)
                    column.insert(0, half)
                else:
                    columns[b + 1].append((x & y) | (half & z))
                    column.insert(0, half ^ z)
            out.append(column[0] if column else np.zeros_like(self.present))
            b += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own; ties go to the smaller id."""
        candidates = self.present
        own = slice(*np.searchsorted(self.ids, [own_id, own_id + 1]).tolist())
        if own.start < own.stop:
            out = np.zeros(len(self.ids), np.uint8)
            out[own] = 1
            candidates = candidates & ~pack_bits(out)
        slices, _ = self.sum_slices(query)
        sure, tied, need = np.zeros_like(candidates), candidates, k
        if count(candidates) > k:
            for s in reversed(slices):
                high = tied & s
                n = count(high)
                if n > need:
                    tied = high
                else:
                    sure |= high
                    need -= n
                    tied = tied & ~s
                    if not need:
                        break
        else:
            sure, need = candidates, 0
        rows = positions(sure)
        if need:
            rows = np.concatenate([rows, positions(tied)[:need]])
        return self.ids[rows], self.values[rows] @ query


def _exact_top(ids: np.ndarray, values: list[list[int]], query: list[int], k: int, own_id: int) -> list[tuple[int, int]]:
    """As :meth:`SlicedBlock.top`, in unbounded integers."""
    scored = ((-max(min(sum(a * b for a, b in zip(v, query)), (1 << 63) - 1), -(1 << 63)), i) for i, v in zip(ids.tolist(), values) if i != own_id)
    return [(i, -s) for s, i in heapq.nsmallest(k, scored)]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``e``, the components as doubles (or floats, if they are), without rows that take no part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # false for NaN, which is largest
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(ok, F.lit(False)) & (F.size("embedding") > 0))
    narrow = rows.schema["embedding"].dataType.elementType == FloatType()
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if narrow else x).alias("e"))


def exact_floor(x: float, scale: int) -> int:
    """floor(scale * x) without rounding where the product leaves the doubles' whole range or a long's."""
    return math.floor(x * scale) if abs(x) < 1 << 50 else int(x) * scale


class Vectors:
    """Rows of one length: ids, and quantised values as an array, or as lists of integers where one doesn't fit the slices."""

    def __init__(self, ids: np.ndarray, e: np.ndarray, scale: int):
        self.ids, self.dim = ids, e.shape[1]
        # bounds of the slices, and of a sum that fits a long
        self.narrow = bool(np.abs(e).max() < MAX_VALUE / scale) and self.dim < 1 << 14
        self.values = np.floor(e * scale).astype(np.int64) if self.narrow else None
        self.e, self.scale, self._lists, self._block = e, scale, None, None

    @property
    def lists(self) -> list[list[int]]:
        if self._lists is None:
            self._lists = [[exact_floor(x, self.scale) for x in row] for row in self.e.tolist()]
        return self._lists

    @property
    def block(self) -> SlicedBlock:
        if self._block is None:
            self._block = SlicedBlock(self.ids, self.values)
        return self._block


def _by_length(ids: pa.Array, e: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of the vectors of each length."""
    values, ends = e.flatten().to_numpy().astype(np.float64), np.cumsum(pa.compute.list_value_length(e).to_numpy())
    dims, ids = np.diff(ends, prepend=0), ids.to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield ids[at], values[(ends[at] - dim)[:, None] + np.arange(dim)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each batch as chunks of one length."""
    for batch in batches:
        for ids, e in _by_length(batch.column("vec_id"), batch.column("e")):
            for a in range(0, len(ids), CHUNK_QUERIES):
                part = ids[a : a + CHUNK_QUERIES], np.ascontiguousarray(e[a : a + CHUNK_QUERIES])
                yield pa.RecordBatch.from_arrays([pa.array([e.shape[1]]), *(pa.array([x.tobytes()]) for x in part)], ["dim", "q_ids", "q_e"])


def _answers(k: int, scale: int):
    schema = ["query_id", "vec_id", "score"]

    def answered(rows: Vectors, asked: Vectors) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        for n, q in enumerate(asked.ids.tolist()):
            if rows.narrow and asked.narrow:
                best, scores = rows.block.top(asked.values[n], k, q)
                found += zip([q] * len(best), best.tolist(), scores.tolist())
            else:
                found += [(q, i, s) for i, s in _exact_top(rows.ids, rows.lists, asked.lists[n], k, q)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: first its rows, of which the slices are built once, then the chunks that it answers."""
        now, ids, vectors, held = None, [], [], {}
        for batch in batches:
            blocks, dims = batch.column("block").to_numpy(), batch.column("dim").fill_null(0).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(dims) != 0) | (dims[1:] > 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != now:
                    now, ids, vectors, held = blocks[a], [], [], {}
                part = batch.slice(a, b - a)
                if not dims[a]:
                    ids.append(part.column("vec_id"))
                    vectors.append(part.column("e"))
                    continue
                if ids:
                    held = {e.shape[1]: Vectors(i, e, scale) for i, e in _by_length(pa.concat_arrays(ids), pa.concat_arrays(vectors))}
                    ids, vectors = [], []
                dim = int(dims[a])
                if dim in held:
                    r = part.to_pylist()[0]
                    asked = Vectors(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_e"], np.float64).reshape(-1, dim), scale)
                    found = answered(held[dim], asked)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k largest inner products, from 1; ties to the smaller id.

    ``queries`` has the columns of ``vectors``. Rows with the query's own id are no candidates for it. Null ids, null or
    empty vectors and vectors that hold null or non-finite components take no part; vectors of another length than the
    query's are no candidates. Repeated rows are candidates of their own and may fill several ranks; queries that share
    an id are ranked together, as one. Finite components of any size take part; scores beyond a long count as the nearest
    long. An empty table gives no rows. Other columns are not read.

    Rows are dealt to blocks of a bounded number of values, and each block stays in its task; what is sent to every block
    are the queries, in chunks. Where there are fewer blocks than cores, each stands in several lanes, which share its
    chunks.
    """
    rows, asked = usable(vectors), usable(queries)
    n, widest = rows.agg(F.count("*"), F.max(F.size("e"))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n * (widest or 1) // block_values))
    lanes = -(-cores // n_blocks)
    # by a number of the row as well: a repeated id is no group in one block
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks))
    none, to = lambda t: F.lit(None).cast(t), lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    kind = rows.schema["e"].dataType
    index = rows.withColumn("block", block).select("block", to(lanes).alias("lane"), none("long").alias("dim"), "vec_id", "e", none("binary").alias("q_ids"), none("binary").alias("q_e"))
    chunks = asked.mapInArrow(_chunks, "dim long, q_ids binary, q_e binary").withColumn("lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)))
    chunks = chunks.select(to(n_blocks).alias("block"), "lane", "dim", none("long").alias("vec_id"), none(kind).alias("e"), "q_ids", "q_e")
    dealt = index.unionByName(chunks).select((F.col("block") * lanes + F.col("lane")).alias("block"), "dim", "vec_id", "e", "q_ids", "q_e")
    # a range for each of a few keys, so that no two share a task; many keys even out by their hashes
    dealt = dealt.repartitionByRange(n_blocks * lanes, "block") if lanes > 1 else dealt.repartition(n_blocks, "block")
    dealt = dealt.sortWithinPartitions("block", F.col("dim").asc_nulls_first())
    found = dealt.mapInArrow(_answers(k, scale), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`top_k` over all embeddings, asked by every twentieth; its docstring states the odd cases."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
