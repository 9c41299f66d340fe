"""Haralick texture by grey-level co-occurrence, as joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats

LEVELS = 8
#: Steps (down, right) of the four directions.
DIRECTIONS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))
#: The names of the thirteen features, in their order.
NAMES = (
    "Contrast", "Correlation", "DifferenceEntropy", "DifferenceVariance", "Energy", "Entropy", "InformationCorrelation1",
    "InformationCorrelation2", "InverseDifferenceMoment", "SumAverage", "SumEntropy", "SumOfSquaresVariance", "SumVariance",
)


def grey_levels(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``level`` 1 to 8 by each object's own range of values."""
    v = stats.missing_to_null(F.col(value))
    ranges = pixels.groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    level = F.least(F.floor(F.lit(float(LEVELS)) * (v - F.col("_mn")) / (F.col("_mx") + 1e-6 - F.col("_mn")) + 1), F.lit(LEVELS)).cast("int")
    return pixels.join(ranges, keys).withColumn("level", level).drop("_mn", "_mx")


def cooccurrence(pixels: DataFrame, keys: list[str], distance: int, x: str = "x", y: str = "y") -> DataFrame:
    """Shares ``p`` of level pairs (i, j) in each direction's symmetric matrix.

    A pixel meets its neighbour by an equi-join on object and place: the steps are exploded on one side, so
    that one join serves all directions.
    """
    one = pixels.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("level").alias("i"))
    steps = F.array(*(F.struct(F.lit(k).alias("direction"), F.lit(dy * distance).alias("dy"), F.lit(dx * distance).alias("dx")) for k, (dy, dx) in enumerate(DIRECTIONS)))
    ahead = one.select(*keys, "i", "_x", "_y", F.explode(steps).alias("s"))
    ahead = ahead.select(*keys, "i", F.col("s.direction").alias("direction"), (F.col("_x") + F.col("s.dx")).alias("_x"), (F.col("_y") + F.col("s.dy")).alias("_y"))
    pairs = ahead.join(one.withColumnRenamed("i", "j"), [*keys, "_x", "_y"]).groupBy(*keys, "direction", "i", "j").agg(F.count("*").alias("c"))
    both = pairs.select(*keys, "direction", "i", "j", "c").unionByName(pairs.select(*keys, "direction", F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    counts = both.groupBy(*keys, "direction", "i", "j").agg(F.sum("c").alias("c"))
    totals = counts.groupBy(*keys, "direction").agg(F.sum("c").alias("t"))
    return counts.join(totals, [*keys, "direction"]).select(*keys, "direction", "i", "j", (F.col("c") / F.col("t")).alias("p"))


def _entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def matrix_features(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The thirteen features of each matrix: ``keys`` and rows (i, j, p).

    The matrix of an object has at most 64 cells; marginals, sums and differences are grouped from it.
    """
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    margin = matrix.groupBy(*keys, "i").agg(F.sum("p").alias("px"))
    moments = margin.groupBy(*keys).agg(F.sum(F.col("i") * F.col("px")).alias("mu"), F.sum(F.col("i") * F.col("i") * F.col("px")).alias("m2"), _entropy(F.col("px")).alias("hx"))
    sums = matrix.groupBy(*keys, (F.col("i") + F.col("j")).alias("k")).agg(F.sum("p").alias("q"))
    sums = sums.groupBy(*keys).agg(F.sum(F.col("k") * F.col("q")).alias("SumAverage"), F.sum(F.col("k") * F.col("k") * F.col("q")).alias("k2"), _entropy(F.col("q")).alias("SumEntropy"))
    apart = matrix.groupBy(*keys, F.abs(F.col("i") - F.col("j")).alias("k")).agg(F.sum("p").alias("q"))
    apart = apart.groupBy(*keys).agg(F.sum(F.col("k") * F.col("q")).alias("d1"), F.sum(F.col("k") * F.col("k") * F.col("q")).alias("d2"), _entropy(F.col("q")).alias("DifferenceEntropy"))
    # in a symmetric matrix both marginals are equal: sum p log(px py) = 2 sum px log px, as is the second information sum
    cells = matrix.groupBy(*keys).agg(
        F.sum((i - j) * (i - j) * p).alias("Contrast"), F.sum(i * j * p).alias("ij"), F.sum(p * p).alias("Energy"), _entropy(p).alias("Entropy"), F.sum(p / (1 + (i - j) * (i - j))).alias("InverseDifferenceMoment")
    )
    rows = cells.join(moments, keys).join(sums, keys).join(apart, keys)
    variance = F.col("m2") - F.col("mu") * F.col("mu")
    hxy = 2 * F.col("hx")
    features = {
        "Correlation": F.try_divide(F.col("ij") - F.col("mu") * F.col("mu"), F.when(F.abs(variance) > 1e-12, variance)),
        "DifferenceVariance": F.col("d2") - F.col("d1") * F.col("d1"),
        "InformationCorrelation1": F.try_divide(F.col("Entropy") - hxy, F.when(F.col("hx") > 1e-12, F.col("hx"))),
        "InformationCorrelation2": F.sqrt(F.greatest(1 - F.exp(-2 * (hxy - F.col("Entropy"))), F.lit(0.0))),
        "SumOfSquaresVariance": variance,
        "SumVariance": F.col("k2") - F.col("SumAverage") * F.col("SumAverage"),
    }
    return rows.withColumns(features).select(*keys, *(F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in NAMES))


def haralick(pixels: DataFrame, keys: list[str], value: str, distances: tuple[int, ...] = (1,), x: str = "x", y: str = "y") -> DataFrame:
    """Features of each object and distance, averaged over the four directions."""
    levels = grey_levels(pixels, keys, value)
    out = None
    for d in distances:
        own = matrix_features(cooccurrence(levels, keys, d, x, y), [*keys, "direction"])
        mean = own.groupBy(*keys).agg(*((F.sum(n) / len(DIRECTIONS)).alias(f"HaralickTexture_{value}_{n}_{d}") for n in NAMES))
        out = mean if out is None else out.join(mean, keys, "full_outer")
    return out
