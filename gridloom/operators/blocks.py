"""Aggregates per block and per strip: Otsu thresholds, background and foreground levels, stripes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.sources.scratch import written

LEVELS = 256


def otsu(df: DataFrame, keys: list[str], value: str, scale: str = "linear") -> DataFrame:
    """``threshold`` of each key by Otsu's method on a histogram of 256 levels.

    With the scale ``log`` the class means weigh the levels by their logarithm. The mean of equally good
    levels counts; a key of one value has the threshold 0. Everything after the histogram is over 256 rows
    a key, so only counts are shuffled.
    """
    if scale not in ("linear", "log"):
        raise ValueError(f"no such scale: {scale}")
    v = stats.missing_to_null(F.col(value))
    rows = df.select(*keys, v.alias("_v")).filter("_v is not null")
    spans = written(rows.groupBy(*keys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx")), "spans")
    joined = rows.join(spans, keys)
    level = F.round(F.lit(float(LEVELS - 1)) * F.try_divide(F.col("_v") - F.col("_mn"), F.col("_mx") - F.col("_mn"))) + 1
    counts = joined.groupBy(*keys, F.coalesce(level, F.lit(1.0)).alias("_k")).agg(F.count("*").alias("_c"), F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"))
    by = Window.partitionBy(*keys)
    up_to = by.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("_k") if scale == "linear" else F.log2("_k")
    p = F.col("_c") / F.sum("_c").over(by)
    shares = counts.withColumn("_p", p).withColumn("_w", F.sum("_p").over(up_to)).withColumn("_m", F.sum(F.col("_p") * weight).over(up_to)).withColumn("_t", F.sum(F.col("_p") * weight).over(by))
    inside = F.col("_w") * (1 - F.col("_w"))
    between = F.when(inside > 1e-12, (F.col("_t") * F.col("_w") - F.col("_m")) * (F.col("_t") * F.col("_w") - F.col("_m")) / F.nullif(inside, F.lit(0.0)))
    rated = shares.withColumn("_s", F.round(between, 9)).withColumn("_best", F.max("_s").over(by))
    # levels without pixels between two others are as good as the level before them
    following = F.lead("_k").over(by.orderBy("_k"))
    rated = rated.withColumn("_next", F.coalesce(following, F.col("_k") + 1))
    span = F.col("_next") - F.col("_k")
    best = rated.filter("_s = _best").groupBy(*keys).agg(
        (F.sum(span * (F.col("_k") + F.col("_next") - 1) / 2) / F.sum(span)).alias("_idx"), F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx")
    )
    found = best.select(*keys, ((F.col("_idx") - 1) / F.lit(float(LEVELS - 1)) * (F.col("_mx") - F.col("_mn")) + F.col("_mn")).alias("threshold"))
    return spans.select(*keys).join(found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))


def background(df: DataFrame, keys: list[str], value: str, threshold: Column) -> DataFrame:
    """Median of what lies below the threshold; 0 where nothing does."""
    v = stats.missing_to_null(F.col(value))
    return stats.medians(df, keys, value, "z", v < threshold).withColumn("z", F.coalesce("z", F.lit(0.0)))


def foreground(df: DataFrame, keys: list[str], value: str, threshold: Column) -> DataFrame:
    """Mean of what lies above the threshold; 0 where nothing does."""
    v = stats.missing_to_null(F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(v > threshold, v)), F.lit(0.0)).alias("z"))


def stripe(df: DataFrame, x: Column, corrected: Column, where: Column | None = None) -> DataFrame:
    """Median over y of a corrected value for every x."""
    rows = df.filter(where) if where is not None else df
    return stats.medians(rows.select(x.alias("x"), corrected.alias("_s")), ["x"], "_s", "s")


def median_3x3(surface: DataFrame, x: str = "gx", y: str = "gy", z: str = "z") -> DataFrame:
    """3 by 3 median of a grid from 0, mirrored at its edges."""
    size = surface.agg(F.struct(F.max(x).alias("r"), F.max(y).alias("b"))).scalar()
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = surface.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(step).alias("_dx")).select("*", F.explode(step).alias("_dy"))
    mirror = lambda c, d, top: F.when(c + d < 0, F.lit(0)).when(c + d > top, top).otherwise(c + d)
    placed = around.select("_x", "_y", mirror(F.col("_x"), F.col("_dx"), size["r"]).alias(x), mirror(F.col("_y"), F.col("_dy"), size["b"]).alias(y))
    return placed.join(surface.select(x, y, z), [x, y]).groupBy(F.col("_x").alias(x), F.col("_y").alias(y)).agg(F.median(z).alias(z))
