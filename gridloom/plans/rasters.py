"""Queries of the array operators: every embedding is a tile of 8 by 8 pixels, suppliers and orders are objects.

SQL expresses none of the array kernels; the tests hold these against brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import corrections, features, raster, surface
from gridloom.plans.experiment import Experiment
from gridloom.plans.registry import query
from gridloom.sources import table
from gridloom.sources.scratch import folder
from gridloom.streaming.features import last_states, windowed_features

SIDE = 8


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == SIDE * SIDE)
    place = {"bx": F.col("vec_id") % 64, "by": F.floor(F.col("vec_id") / 64)}
    size = {"x0": F.col("vec_id") % 64 * SIDE, "y0": F.floor(F.col("vec_id") / 64) * SIDE, "h": F.lit(SIDE), "w": F.lit(SIDE)}
    ints = [c.cast("int").alias(n) for n, c in (place | size).items()]
    return e.select(F.lit("embeddings").alias("image_id"), F.lit("DAPI").alias("channel"), *ints, F.transform("embedding", lambda v: v.cast("float")).alias("pixels"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.select("image_id", "channel", (F.col("by") * 64 + F.col("bx")).cast("long").alias("tile_id"), F.col("bx").alias("tx"), F.col("by").alias("ty"), "x0", "y0", "h", "w", "pixels")


def wide_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 4 by 4 embeddings."""
    return raster.to_blocks(tiles(spark, sf_dir).drop("channel"), 4, (SIDE, SIDE), "DAPI")


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = wide_blocks(spark, sf_dir)
    return b, raster.object_masks(b, raster.block_thresholds(b, corrected=True), raster.DistanceWatershed(2, 3, smoothing_size=1.0))


def _total(pixels: str = "pixels") -> Column:
    return F.round(F.aggregate(pixels, F.lit(0.0), lambda a, p: a + p), 4)


@query("""SELECT CAST(tx // 2 AS INTEGER) AS bx, CAST(ty // 2 AS INTEGER) AS by, CAST(max(8 * ty + 8) - min(ty // 2) * 16 AS INTEGER) AS h,
CAST(max(8 * tx + 8) - min(tx // 2) * 16 AS INTEGER) AS w, round(sum(s), 4) AS total
FROM (SELECT vec_id % 64 AS tx, vec_id // 64 AS ty, list_sum(list_transform(embedding, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))) AS s FROM embeddings WHERE len(embedding) = 64) GROUP BY tx // 2, ty // 2""")
def tile_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir).drop("channel")
    out = raster.to_blocks(t, 2, (SIDE, SIDE), "DAPI")
    return out.select("bx", "by", "h", "w", _total().alias("total"))


@query("""SELECT CAST(vec_id % 64 AS INTEGER) AS tx, CAST(8 * count(*) AS INTEGER) AS h, 8 AS w, CAST(64 * count(*) AS INTEGER) AS n,
round(sum(list_sum(list_transform(embedding, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)))), 4) AS total FROM embeddings WHERE len(embedding) = 64 GROUP BY vec_id % 64""")
def tile_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.strips(tiles(spark, sf_dir), "tx").select("tx", "h", "w", F.size("pixels").alias("n"), _total().alias("total"))


@query()
def block_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_thresholds(blocks(spark, sf_dir), corrected=True)


_WAVE = "2 * pi() * (u * (k // 8) + w * (k % 8)) / 8"


@query(f"""WITH e AS (SELECT vec_id, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE len(embedding) = 64),
f AS (SELECT unnest(range(8)) AS u), g AS (SELECT unnest(range(8)) AS w),
t AS (SELECT vec_id, u, w, sum(v * cos({_WAVE})) AS re, sum(v * sin({_WAVE})) AS im FROM e CROSS JOIN f CROSS JOIN g GROUP BY vec_id, u, w),
m AS (SELECT vec_id, sqrt(re * re + im * im) AS m FROM t), x AS (SELECT vec_id, max(m) AS mx FROM m GROUP BY vec_id)
SELECT 'embeddings' AS image_id, 'DAPI' AS channel, CAST(vec_id % 64 AS INTEGER) AS bx, CAST(vec_id // 64 AS INTEGER) AS by, sum(CASE WHEN m > mx / 1000 THEN 1 ELSE 0 END) / 8.0 AS sharpness
FROM m JOIN x USING (vec_id) GROUP BY vec_id""")
def sharpness_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_sharpness(blocks(spark, sf_dir))


@query()
def block_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return raster.levels(b, raster.block_thresholds(b, corrected=True))


@query()
def watershed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = _masks(spark, sf_dir)
    return m.select("bx", "by", F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p).cast("int").alias("pixels_in_objects"))


@query()
def object_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m = _masks(spark, sf_dir)
    return raster.object_pixels(b, m).groupBy("bx", "by", "label").agg(F.count("*").alias("area"), F.round(F.max("distance"), 6).alias("depth"))


@query()
def measured_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m = _masks(spark, sf_dir)
    return raster.measure_basic_props(b, m, (4 * SIDE, 4 * SIDE))


@query()
def measured_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.measure_intensity(*_masks(spark, sf_dir))


@query()
def shape_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m = _masks(spark, sf_dir)
    return raster.array_features(b, m, {"shape": {"vertices": 20, "descriptors": 6}})


@query()
def granularity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, m = _masks(spark, sf_dir)
    return raster.array_features(b, m, {"granularity": {"spectrum": 3, "element": 2}})


@query()
def experiment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = features.FeatureExtractor([features.BasicProps("DAPI"), features.Location(), features.Intensity("DAPI"), features.Ellipse(), features.RadialIntensity("DAPI", rings=1, width=1)])
    e = Experiment(wide_blocks(spark, sf_dir), ["DAPI"], "DAPI", raster.DistanceWatershed(2, 3, smoothing_size=1.0), groups)
    return e.create_object_mask(corrected=True).compute_features((4 * SIDE, 4 * SIDE), {"shape": {"vertices": 20, "descriptors": 6}})


@query()
def experiment_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features after all corrections from the image itself, texture among them."""
    groups = features.FeatureExtractor([features.BasicProps("DAPI"), features.Intensity("DAPI")])
    b = wide_blocks(spark, sf_dir)
    side = b.agg(F.max(F.col("x0") + F.col("w")), F.max(F.col("y0") + F.col("h"))).first()
    e = Experiment(b, ["DAPI"], "DAPI", raster.DistanceWatershed(2, 3, smoothing_size=1.0), groups).create_object_mask(corrected=True)
    return e.correct((4 * SIDE, 4 * SIDE), (float(side[0]), float(side[1]))).compute_features((4 * SIDE, 4 * SIDE), {"haralick": {"distances": (1,)}})


@query("""WITH p AS (SELECT (vec_id % 64) * 8 + (k - 1) % 8 AS px, (vec_id // 64) * 8 + (k - 1) // 8 AS py, CAST(v AS DOUBLE) AS v
FROM (SELECT vec_id, CAST(unnest(embedding) AS FLOAT) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE len(embedding) = 64)),
o AS (SELECT s_suppkey AS object_id, s_suppkey * 7 % 500 + 1 AS x, s_suppkey * 3 % 60 + 1 AS y FROM supplier), r AS (SELECT unnest(range(11)) AS i), c AS (SELECT unnest(range(11)) AS j),
a AS (SELECT object_id, 11 * i + j AS pos, x - 6 + j AS px, y - 6 + i AS py FROM o CROSS JOIN r CROSS JOIN c)
SELECT object_id, 'DAPI' AS channel, 11 AS h, 11 AS w, round(sum(v), 4) AS total, round(sum(v * pos), 3) AS moment FROM a JOIN p USING (px, py) GROUP BY object_id""")
def roi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), (F.col("s_suppkey") * 7 % 500 + 1).alias("x"), (F.col("s_suppkey") * 3 % 60 + 1).alias("y"))
    out = raster.extract_images(objects, tiles(spark, sf_dir), (SIDE, SIDE), 64, (11, 11))
    weighted = F.transform("pixels", lambda p, at: p.cast("double") * at)
    return out.select("object_id", "channel", "h", "w", _total().alias("total"), F.round(F.aggregate(weighted, F.lit(0.0), lambda a, p: a + p), 3).alias("moment"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects on a square of 10 by 10 with a value about 1 and, for one in five, about 2."""
    o = table(spark, sf_dir, "orders")
    x, y = F.pmod(F.xxhash64("o_orderkey"), F.lit(10_000)) / 1000, F.pmod(F.xxhash64("o_custkey", "o_orderkey"), F.lit(10_000)) / 1000
    noise = (F.pmod(F.xxhash64("o_totalprice"), F.lit(1000)) - 500) / 10_000
    return o.select(F.col("o_orderkey").alias("id"), x.alias("x"), y.alias("y"), ((F.when(F.col("o_orderkey") % 5 == 0, 2.0).otherwise(1.0) + noise) * (1 + x / 40)).alias("v"), F.lit(200.0).alias("area"))


@query()
def lowess_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surface.decimate_and_smooth(_objects(spark, sf_dir), "x", "y", "v", 1.0, 2.5)
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(s.x, s.y, s.z)], "x double, y double, z double")


@query()
def reference_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = np.linspace(0, 10, 11)
    _, objects = corrections.reference_corrections(_objects(spark, sf_dir), (10.0, 10.0), (nodes, nodes), area="area")
    return objects.select("id", F.round("corrected", 4).alias("corrected"), "first_band")


@query()
def channel_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = np.linspace(0, 10, 6)
    z, _ = corrections.channel_corrections(_objects(spark, sf_dir), (10.0, 10.0), (nodes, nodes))
    return spark.createDataFrame([(i, j, float(z[j, i])) for j in range(6) for i in range(6)], "gx int, gy int, z double")


@query()
def stripe_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir).withColumn("v", (1 + 0.1 * F.sin(2 * np.pi * F.col("x") / 0.5)))
    s = surface.fit_stripe(o, "x", "v", 0.02)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(s.x, s.s)], "x double, s double")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly features of the event stream, read to its present end. Each batch writes the windows that it changed, and the
    last state of each window counts, so that no window is held by the driver and late rows are left out."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    if table(spark, sf_dir, "events").inputFiles()[0].rstrip("/").split("/")[-1] != "events.parquet":  # a folder of parts
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    now = last_states(windowed_features(stream, "ts", ["event_type"], "value"), ["window", "event_type"], folder(spark, "windows"))
    return now.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
