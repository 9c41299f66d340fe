"""Near-duplicate vectors of equal labels by an epsilon grid order join.

Vectors of unit length with a cosine of at least c lie within eps = sqrt(2 - 2c) of each other. They are
projected onto the leading principal dimensions, which never makes a distance longer, and sorted by the
cells of a grid of width eps there, lexicographically. The sorted sequence is cut into intervals. Two
intervals are joined only if cells of theirs touch and their boxes are within eps; a join halves the
intervals again and again, leaves out pairs of parts whose boxes are farther apart, and compares what is
left by the cosine of the full vectors.

Equal vectors of a label stand for one class with a multiplicity, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, release, small_or_shuffled, table
from gridloom.llm.components import components, spanning

COSINE = 0.93
#: Leading principal dimensions of the grid; they are fitted to this many vectors, of the smallest hashes,
#: and to this many leading coordinates at most. Results don't depend on the fit, only the work does.
GRID_DIMENSIONS = 4
PCA_SAMPLE = 20_000
PCA_COORDINATES = 256
#: Vectors of an interval, and of a part that is compared without halving it further.
INTERVAL = 1024
LEAF = 128
#: Room for rounding in the boxes' distances.
MARGIN = 1e-6


def principal(sample: np.ndarray) -> np.ndarray:
    """The leading principal directions, as columns."""
    centred = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, :GRID_DIMENSIONS]


def _celled(bases, eps: float):
    schema = [("cells", pa.list_(pa.int32())), ("projection", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, projections = [], []
            for v in batch.column("e").to_pylist():
                x = np.asarray(v)
                x = x / np.linalg.norm(x)
                basis = bases.get(len(x))
                p = x[: len(basis)] @ basis if basis is not None else x[:GRID_DIMENSIONS]
                projections.append(p.tolist())
                cells.append(np.floor(p / eps).astype(np.int32).tolist())
            arrays = [*batch.columns, pa.array(cells, schema[0][1]), pa.array(projections, schema[1][1])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "cells", "projection"])

    return run


_INTERVALS = "interval long, label long, dim int, low array<double>, high array<double>, corner array<string>, n int, width int, ids binary, copies binary, vectors binary, projections binary"


def _intervals(size: int):
    names = [c.split()[0] for c in _INTERVALS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial, now, rows = TaskContext.get().partitionId() << 33, 0, None, []

        def out() -> pa.RecordBatch:
            ids, copies, vectors, cells, projections = zip(*rows)
            p, v = np.array(projections), np.array(vectors)
            narrow = v.astype(np.float32)
            v = narrow if (narrow == v).all() else v
            corners = sorted({",".join(map(str, c[:2])) for c in cells})
            cols = [[base + serial], [now[0]], [now[1]], [p.min(0).tolist()], [p.max(0).tolist()], [corners], [len(ids)], [v.itemsize]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.int32(), pa.int32()]
            packed = [np.array(ids, np.int64), np.array(copies, np.int64), v, p]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), *(pa.array([x.tobytes()]) for x in packed)], names)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "rep", "copies", "e", "cells", "projection"))):
                if r[:2] != now or len(rows) >= size:
                    if rows:
                        yield out()
                        serial += 1
                    now, rows = r[:2], []
                rows.append(r[2:])
        if rows:
            yield out()

    return run


class Interval:
    def __init__(self, r: dict, side: str):
        n = r[f"{side}_n"]
        self.ids = np.frombuffer(r[f"{side}_ids"], np.int64)
        self.copies = np.frombuffer(r[f"{side}_copies"], np.int64)
        kind = np.float32 if r[f"{side}_width"] == 4 else np.float64
        self.vectors = np.frombuffer(r[f"{side}_vectors"], kind).reshape(n, -1).astype(np.float64)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.projections = np.frombuffer(r[f"{side}_projections"], np.float64).reshape(n, -1)


def join_intervals(a: Interval, b: Interval, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` of all linked pairs; within one interval each pair once."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + MARGIN
    left, right = [], []

    def apart(s: slice, t: slice) -> bool:
        p, q = a.projections[s], b.projections[t]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        return float(gap @ gap) > reach * reach

    def descend(s: slice, t: slice) -> None:
        if apart(s, t):
            return
        n, m = s.stop - s.start, t.stop - t.start
        if n <= LEAF and m <= LEAF:
            cos = a.vectors[s] @ b.vectors[t].T / (a.norms[s][:, None] * b.norms[t][None, :])
            i, j = np.nonzero(cos >= cosine)
            if same and s.start == t.start:
                i, j = i[i < j], j[i < j]
            left.append(i + s.start)
            right.append(j + t.start)
            return
        halves = lambda x: [slice(x.start, (x.start + x.stop) // 2), slice((x.start + x.stop) // 2, x.stop)]
        if same and s.start == t.start and s.stop == t.stop:
            first, second = halves(s)
            descend(first, first)
            descend(first, second)
            descend(second, second)
        else:
            for x in halves(s) if n > LEAF else [s]:
                for y in halves(t) if m > LEAF else [t]:
                    descend(x, y)

    descend(slice(0, len(a.ids)), slice(0, len(b.ids)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _linked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                a = Interval(r, "a")
                b = a if same else Interval(r, "b")
                i, j = join_intervals(a, b, same, cosine)
                if not len(i):
                    continue
                n = len(a.ids)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                copies = a.copies if same else np.concatenate([a.copies, b.copies])
                j = j if same else j + n
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                root = spanning(len(ids), i, j)
                at = np.flatnonzero(links)
                # a node with links, how many, and a node of its component here
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at].astype(np.int64))], ["u", "v", "n"])

    return run


def _prepared(vectors: DataFrame) -> DataFrame:
    e = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    finite = F.forall(e, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # false for NaN, which is largest
    nonzero = F.exists(e, lambda c: c != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & F.coalesce(finite & nonzero, F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"), usable.alias("usable"))


def deduplicate(vectors: DataFrame, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows whose label or vector is null, whose vector is empty, zero or holds a null or a component that is
    not finite, or whose id is null link with nothing: no links, their own id as component, kept. Vectors
    of different lengths don't link. Repeated rows are vectors of their own, and so are rows that share an id but not
    the label or the vector. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = _prepared(vectors)
    usable = rows.filter("usable").select("vec_id", "label", "e")
    classes = usable.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # nodes are numbers of classes, as several rows, and classes, may share an id
    classes = materialise(classes.select("*", F.size("e").alias("dim"), F.monotonically_increasing_id().alias("rep")), "classes")
    sample: dict[int, list] = {}
    for r in classes.select("dim", F.slice("e", 1, PCA_COORDINATES).alias("x")).orderBy(F.xxhash64("least"), "least").limit(PCA_SAMPLE).toLocalIterator():
        sample.setdefault(r.dim, []).append(np.array(r.x) / (np.linalg.norm(r.x) or 1.0))
    bases = {dim: principal(np.array(x)) for dim, x in sample.items()}
    celled = classes.drop("least").select("label", "e", "rep", "copies", "dim").mapInArrow(_celled(bases, eps), "label long, e array<double>, rep long, copies long, dim int, cells array<int>, projection array<double>")
    order = ["label", "dim", "cells", "rep"]
    n = classes.count()
    parts = max(1, min(-(-n // (4 * interval)), 20_000))
    ordered = celled.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    intervals = materialise(ordered.mapInArrow(_intervals(interval), _INTERVALS), "intervals")
    # two intervals can hold a link only if a cell of one is a cell of the other or touches it
    corner = F.split("c", ",")
    box = intervals.select("interval", "label", "dim", "low", "high", F.explode("corner").alias("c"))
    box = box.select("interval", "label", "dim", "low", "high", corner[0].cast("int").alias("x"), F.coalesce(F.get(corner, F.lit(1)).cast("int"), F.lit(0)).alias("y"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    reached = box.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    reached = reached.select(F.col("interval").alias("b"), "label", "dim", F.col("low").alias("b_low"), F.col("high").alias("b_high"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    gaps = F.zip_with(F.zip_with("low", "b_high", lambda p, q: p - q), F.zip_with("b_low", "high", lambda p, q: p - q), lambda s, t: F.greatest(s, t, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    pairs = box.join(reached, ["label", "dim", "x", "y"]).filter((F.col("interval") <= F.col("b")) & (apart <= (eps + MARGIN) ** 2))
    pairs = materialise(pairs.select(F.col("interval").alias("a"), "b").distinct(), "pairs")
    payload = ["n", "width", "ids", "copies", "vectors", "projections"]
    side = lambda s: intervals.select(F.col("interval").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in payload))
    loaded = pairs.join(side("a"), "a").join(side("b"), "b")
    found = materialise(loaded.mapInArrow(_linked(cosine), "u long, v long, n long"), "links")
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    linked = components(found.select("u", "v")).withColumnRenamed("node", "rep")
    known = classes.select("label", "e", "rep", "least", "copies").join(links, "rep", "left").join(linked, "rep", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "rep")), "known")
    smallest = materialise(known.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    known_too = materialise(known.join(small_or_shuffled(smallest), "component").select("label", "e", "links", "copies", "component_id"), "known")
    own = usable.join(small_or_shuffled(known_too), ["label", "e"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = materialise(own.unionByName(rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))), "vectors")
    release(intervals, pairs, found, classes, known, known_too, smallest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`deduplicate` of all embeddings; its docstring states the odd cases."""
    return deduplicate(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT n, label, e, sqrt(list_sum(list_transform(e, lambda c: c * c))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), p AS (
  SELECT a.n AS a, b.n AS b FROM u a JOIN u b ON a.label = b.label AND a.n < b.n AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda t: t[1] * t[2])) / (a.norm * b.norm) >= 0.93
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT n, n FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.b GROUP BY r.a),
k AS (SELECT a AS n, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (n) LEFT JOIN k USING (n)
"""
