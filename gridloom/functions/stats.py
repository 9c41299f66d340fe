"""Aggregates: unbiased moments, ellipse axes, order statistics by the Hazen rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import written


#: Ranges of value in which the ranks of a whole table are formed.
RANGES = 1024
#: As many of each key's, where there are keys.
RANGES_OF_KEY = 64


def missing_to_null(v: Column) -> Column:
    """NaN marks what is missing; as null, aggregates leave it out."""
    return F.nullif(v.cast("double"), F.lit(float("nan")))


def logarithm(v: Column, log: Callable[[Column], Column] = F.log) -> Column:
    """Minus infinity of 0 and NaN of less, where Spark's own logarithms (``log``) are null."""
    return F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(log(v))


def skewness(v: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values or no spread."""
    n = F.count(v).cast("double")
    return F.when((n >= 3) & (F.var_pop(v) > 0), F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(v))


def kurtosis(v: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values or no spread."""
    n = F.count(v).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n >= 4) & (F.var_pop(v) > 0), scale * ((n + 1) * (F.kurtosis(v) + 3) - 3 * (n - 1)))


def std_or_zero(v: Column) -> Column:
    """Sample deviation; zero for a single value."""
    return F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0)))


def ellipse(x: Column, y: Column) -> dict[str, Column]:
    """Axes and eccentricity of the ellipse with the second moments of a set of unit pixels."""
    uxx, uyy, uxy = F.var_pop(x) + F.lit(1 / 12), F.var_pop(y) + F.lit(1 / 12), F.covar_pop(x, y)
    root = F.sqrt((uxx - uyy) * (uxx - uyy) + 4 * uxy * uxy)
    eight = F.lit(8.0)
    major, minor = F.sqrt(eight * (uxx + uyy + root)), F.sqrt(F.greatest(eight * (uxx + uyy - root), F.lit(0.0)))
    eccentricity = F.sqrt(F.greatest(major * major - minor * minor, F.lit(0.0))) / major
    return {"MajorAxisLength": major, "MinorAxisLength": minor, "Eccentricity": eccentricity}


def hazen(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], where: Column | None = None) -> DataFrame:
    """Percentiles of ``value`` by key: positions n * p + 0.5, linear between, clamped at the ends.

    Equal values are counted before anything is ranked, with partial counts on the map side; only distinct
    values are sorted, in ranges of the table's or the key's values, so that no task sorts all of a table or of
    a key that holds much of it. Nulls and NaN are left out.
    """
    v = missing_to_null(F.col(value))
    rows = df.filter(where) if where is not None else df
    counted = rows.select(*keys, v.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    span = [F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    ranges = RANGES_OF_KEY if keys else RANGES
    if keys:
        # written, so that the spans of few keys are sent to the values instead of all values of a key to one task
        spans = written(rows.select(*keys, v.alias("_v")).filter("_v is not null").groupBy(*keys).agg(*span), "spans")
        spanned, low, high = counted.join(spans, keys), F.col("_low"), F.col("_high")
    else:
        both = counted.agg(F.struct(*span)).scalar()
        spanned, low, high = counted, both["_low"], both["_high"]
    place = F.floor((F.col("_v") - low) / F.nullif(high - low, F.lit(0.0)) * ranges)
    parted = spanned.withColumn("_p", F.coalesce(F.least(place, F.lit(ranges - 1)), F.lit(0)).cast("int")).select(*keys, "_v", "_c", "_p")
    totals = parted.groupBy(*keys, "_p").agg(F.sum("_c").alias("_t"))  # a row a range
    by = Window.partitionBy(*keys)
    starts = totals.select(*keys, "_p", (F.sum("_t").over(by.orderBy("_p")) - F.col("_t")).alias("_s"), F.sum("_t").over(by).alias("_n"))
    up_to = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    ranked = parted.join(starts if keys else F.broadcast(starts), [*keys, "_p"]).withColumn("_hi", F.col("_s") + up_to)
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    return ranked.groupBy(*keys).agg(*(_weighted(p).alias(name) for name, p in shares.items()))


def _weighted(p: float) -> Column:
    """The sum over a value's ranks of its weight: only the two ranks next to the position have any."""
    n = F.col("_n").cast("double")
    at = F.least(F.greatest(n * F.lit(float(p)) + 0.5, F.lit(1.0)), n)
    total = F.lit(0.0)
    for rank in (F.floor(at), F.floor(at) + 1):
        held = (rank >= F.col("_lo")) & (rank <= F.col("_hi"))
        total = total + F.when(held, F.greatest(F.lit(0.0), 1 - F.abs(rank - at))).otherwise(0.0)
    return F.sum(F.col("_v") * total)


def median_of(df: DataFrame, value: str, where: Column | None = None) -> Column:
    """The median of a whole table's column, as a scalar subquery."""
    return hazen(df, [], value, {"m": 0.5}, where).scalar()


def medians(df: DataFrame, keys: list[str], value: str, name: str, where: Column | None = None) -> DataFrame:
    """``keys`` and the median of ``value`` of every key, null where it has no value (that ``where`` lets pass)."""
    return df.select(*keys).distinct().join(hazen(df, keys, value, {name: 0.5}, where), keys, "left")
