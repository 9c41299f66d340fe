"""Joins by place: grid cells, tiles, nearest values, interpolation from surfaces and stripes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import grid, stats
from gridloom.sources.scratch import written


def blocks_with_mask(channel: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of a channel with those of the mask, one to one by their place."""
    return channel.join(mask, keys)


def from_surface(points: DataFrame, surface: DataFrame, x: str, y: str, name: str, first: tuple[float, float], step: tuple[float, float], nodes: tuple[int, int]) -> DataFrame:
    """Adds the bilinear value of a grid (gx, gy, z) at each point; outside it the nearest node along an edge.

    A cell's four corners are put in one row first, so that a point needs one equi-join on its cell.
    """
    cx, fx = grid.clamped_cell(grid.position(F.col(x), first[0], step[0]), nodes[0])
    cy, fy = grid.clamped_cell(grid.position(F.col(y), first[1], step[1]), nodes[1])
    step_right = F.array(F.lit(0), F.lit(1))
    corner = surface.select(F.explode(step_right).alias("_i"), "gx", "gy", "z").select("*", F.explode(step_right).alias("_j"))
    corner = corner.select((F.col("gx") - F.col("_i")).cast("int").alias("_cx"), (F.col("gy") - F.col("_j")).cast("int").alias("_cy"), (F.col("_i") + 2 * F.col("_j")).alias("_k"), "z")
    cells = corner.groupBy("_cx", "_cy").agg(*(F.max(F.when(F.col("_k") == k, F.col("z"))).alias(f"_z{k}") for k in range(4)))
    z = [F.coalesce(F.col(f"_z{k}"), F.col(f"_z{k & 2}"), F.col(f"_z{k & 1}"), F.col("_z0")) for k in range(4)]  # a grid of one row or column
    placed = points.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_fx", fx).withColumn("_fy", fy)
    value = grid.blend(z[0], z[1], z[2], z[3], F.col("_fx"), F.col("_fy"))
    return placed.join(cells, ["_cx", "_cy"], "left").withColumn(name, value).select(*points.columns, name)


def from_stripe(points: DataFrame, stripe: DataFrame, x: str, name: str, step: float = 1.0) -> DataFrame:
    """Adds the linear value of a stripe (x at multiples of ``step``, s) at each point, with lines going on beyond its ends.

    Consecutive nodes of the stripe are paired, and a point meets the pair of its cell by an equi-join;
    points before the first node and behind the last meet the end pairs.
    """
    w = Window.orderBy("x")  # a stripe has one row a pixel of the image's width
    pairs = stripe.select(F.col("x").cast("double").alias("_x0"), F.col("s").alias("_s0")).withColumnRenamed("_x0", "x")
    pairs = pairs.withColumn("_x1", F.lead("x").over(w)).withColumn("_s1", F.lead("_s0").over(w)).filter("_x1 is not null").withColumnRenamed("x", "_x0")
    ends = stripe.agg(F.struct(F.min("x").cast("double").alias("first"), F.max("x").cast("double").alias("last"))).scalar()
    cell = lambda v: F.floor(v / F.lit(float(step))).cast("long")
    cells = pairs.select("*", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1")) - 1)).alias("_c"))
    inside = F.least(F.greatest(F.col(x).cast("double"), ends["first"]), ends["last"] - F.lit(step))
    placed = points.withColumn("_c", cell(inside))
    value = grid.linear(F.col(x).cast("double"), F.col("_x0"), F.col("_s0"), F.col("_x1"), F.col("_s1"))
    return placed.join(cells, "_c", "left").withColumn(name, value).select(*points.columns, name)


def boxes_to_tiles(boxes: DataFrame, tile: tuple[int, int], tiles_across: int, left: str = "l", top: str = "t", width: str = "w", height: str = "h") -> DataFrame:
    """One row for each tile that a box touches, with the tile's number in row-major order from 0."""
    x1, x2 = grid.tile_range(F.col(left), F.col(width), tile[0])
    y1, y2 = grid.tile_range(F.col(top), F.col(height), tile[1])
    spread = boxes.select("*", F.explode(F.sequence(x1, x2)).alias("tx")).select("*", F.explode(F.sequence(y1, y2)).alias("ty"))
    return spread.withColumn("tile_id", F.col("ty") * F.lit(tiles_across) + F.col("tx"))


def _neighbours_in_order(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Nearest targets (_t, _b0) of points (_p, _a0) on a line, none of them missing, as (_p, _t, _d).

    Distinct values are sorted in ranges; a value's nearest targets are the last before it and the first behind it, in its
    own range or in those around it. So work grows with the rows, however crowded they lie.
    """
    values = targets.select(F.col("_b0").alias("v"), F.col("_t").alias("t")).unionByName(points.select(F.col("_a0").alias("v"), F.lit(None).cast(targets.schema["_t"].dataType).alias("t")))
    ranges = values.groupBy("v").agg(F.min("t").alias("t")).repartitionByRange("v").withColumn("_r", F.spark_partition_id())
    ranges = written(ranges.withColumn("s", F.when(F.col("t").isNotNull(), F.struct("v", "t"))).select("v", "s", "_r"), "ranges")
    up_to = lambda w, c, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    ends = ranges.groupBy("_r").agg(F.min("s").alias("first"), F.max("s").alias("last"))  # a row a range
    ends = ends.select("_r", up_to(Window.orderBy("_r"), "last", -1).alias("before"), up_to(Window.orderBy(F.desc("_r")), "first", -1).alias("behind"))
    own = Window.partitionBy("_r")
    around = ranges.select("v", "_r", up_to(own.orderBy("v"), "s", 0).alias("low"), up_to(own.orderBy(F.desc("v")), "s", 0).alias("high")).join(F.broadcast(ends), "_r")
    sides = [F.coalesce("low", "before"), F.coalesce("high", "behind")]
    best = F.least(*(F.when(s.isNotNull(), F.struct(F.abs(F.col("v") - s["v"]).alias("d"), s["t"].alias("t"))) for s in sides))
    best = written(around.select(F.col("v").alias("_a0"), best.alias("m")), "nearest")
    return points.join(best, "_a0").groupBy("_p").agg(F.min("m").alias("m")).select("_p", F.col("m.t").alias("_t"), F.col("m.d").alias("_d"))


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, coordinates: list[str], cell: float) -> DataFrame:
    """``point_id, target_id, distance`` of each point's nearest target; of equals the least id.

    On a line, neighbours in order are compared. Elsewhere points meet targets (one of each place) of the cells around their
    own by an equi-join. What is found within one cell's width is certain;
    the other points go on with wider cells, at once with such as reach the box of all targets, until a cell is as wide as
    all that is left of both. Each round is written, so that none is computed again. A point with a missing coordinate,
    and every point where there is no target, has nulls; targets with a missing coordinate are left out.
    """
    dims = range(len(coordinates))
    place = lambda df, key, name, side: df.select(F.col(key).alias(name), *(stats.missing_to_null(F.col(c)).alias(f"{side}{k}") for k, c in enumerate(coordinates)))
    known = lambda side: functools.reduce(Column.__and__, (F.col(f"{side}{k}").isNotNull() for k in dims))
    every, there = place(points, point_id, "_p", "_a"), place(targets, target_id, "_t", "_b").filter(known("_b"))
    left = every.filter(known("_a"))
    box = there.agg(F.count("*").alias("n"), *(f(f"_b{k}").alias(f"{n}{k}") for k in dims for n, f in (("low", F.min), ("high", F.max)))).first()
    none = every.filter(~known("_a") if box.n else F.lit(True)).select("_p", F.lit(None).cast(there.schema["_t"].dataType).alias("_t"), F.lit(None).cast("double").alias("_d"))
    if box.n and len(coordinates) == 1:
        found = none.unionByName(_neighbours_in_order(left, there))
        return found.select(F.col("_p").alias(point_id), F.col("_t").alias(target_id), F.col("_d").alias("distance"))
    if box.n:
        there = written(there.groupBy(*(f"_b{k}" for k in dims)).agg(F.min("_t").alias("_t")), "places")
    found, step, r = none, F.array(F.lit(-1), F.lit(0), F.lit(1)), 0
    gap = [F.greatest(F.lit(box[f"low{k}"]) - F.col(f"_a{k}"), F.col(f"_a{k}") - F.lit(box[f"high{k}"]), F.lit(0.0)) for k in dims] if box.n else []
    far = [F.greatest(F.abs(F.col(f"_a{k}") - F.lit(box[f"low{k}"])), F.abs(F.col(f"_a{k}") - F.lit(box[f"high{k}"]))) for k in dims] if box.n else []
    length = lambda parts: F.sqrt(sum((g * g for g in parts), F.lit(0.0)))
    while box.n:
        # of what is left: the least distance that any point can have to a target, and the most
        reach = left.agg(F.count("*").alias("n"), F.min(length(gap)).alias("least"), F.max(length(far)).alias("most")).first()
        if not reach.n:
            break
        while cell * 2.0**r < reach.least:
            r += 1
        last = cell * 2.0**r >= reach.most
        width = F.lit(float(cell * 2.0**r))
        near, own = there, left
        for k in dims:
            near = near.select("*", F.explode(step).alias("_s")).withColumn(f"_c{k}", F.floor(F.col(f"_b{k}") / width) + F.col("_s")).drop("_s")
            own = own.withColumn(f"_c{k}", F.floor(F.col(f"_a{k}") / width))
        apart = length([F.col(f"_a{k}") - F.col(f"_b{k}") for k in dims])
        best = own.join(near, [f"_c{k}" for k in dims]).groupBy("_p").agg(F.min(F.struct(apart.alias("d"), F.col("_t").alias("t"))).alias("m"))
        sure = written((best if last else best.filter(F.col("m.d") <= width)).select("_p", F.col("m.t").alias("_t"), F.col("m.d").alias("_d")), "nearest")
        found = found.unionByName(sure)
        if last:
            break
        left, r = written(left.join(sure.select("_p"), "_p", "left_anti"), "left"), r + 1
    return found.select(F.col("_p").alias(point_id), F.col("_t").alias(target_id), F.col("_d").alias("distance"))


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Adds an object's aggregates to its rows. Aggregated and written before the join: a large object is not held as one
    window, and where objects are few, their aggregates are sent to the rows, which else met in a task for each object."""
    return df.join(written(df.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items())), "aggregates"), keys)


def member_of(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(others, keys, "left_semi")


def not_member_of(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(others, keys, "left_anti")
