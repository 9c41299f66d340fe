"""Spatial decimation: points (x, y, z) into rectangular or hexagonal bins with pluggable reducers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import grid, stats
from gridloom.sources.scratch import written

#: Reducers that are plain aggregates of a bin's values.
SIMPLE: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": stats.std_or_zero,
    "density": lambda v: F.count(F.lit(1)),
}


def _binned(points: DataFrame, x: str, y: str, z: str, width: float | tuple[float, float], kind: str) -> DataFrame:
    a, b = width if isinstance(width, tuple) else (width, width)
    if kind == "hexagonal":
        gx, gy = grid.to_hex(F.col(x), F.col(y), a, b)
    elif kind == "rectangular":
        gx, gy = grid.rect_bin(F.col(x), a), grid.rect_bin(F.col(y), b)
    else:
        raise ValueError(f"no such kind of bins: {kind}")
    return points.select(gx.alias("gx"), gy.alias("gy"), stats.missing_to_null(F.col(z)).alias("z"))


def decimate(
    points: DataFrame,
    x: str,
    y: str,
    z: str,
    width: float | tuple[float, float] = 0.25,
    kind: str = "rectangular",
    reducer: str | Callable[[Column], Column] = "median",
    share: float = 0.5,
    step: float | None = None,
) -> DataFrame:
    """``gx, gy, z`` of every bin that holds a point.

    Reducers: min, max, mean, median, std, density, mode (of z in steps of ``step``, by default a fiftieth
    of the table's median absolute deviation; the least of equals), percentile (``share``, Hazen), mad
    (median absolute deviation), or a function from a column to an aggregate, a pandas UDF among them.
    """
    rows, keys = _binned(points, x, y, z, width, kind), ["gx", "gy"]
    if callable(reducer):
        return rows.groupBy(*keys).agg(reducer(F.col("z")).alias("z"))
    if reducer in SIMPLE:
        return rows.groupBy(*keys).agg(SIMPLE[reducer](F.col("z")).alias("z"))
    if reducer == "median":
        return stats.medians(rows, keys, "z", "z")
    if reducer == "percentile":
        return stats.hazen(rows, keys, "z", {"z": share})
    if reducer == "mode":
        q = F.lit(float(step if step is not None else median_deviation(points, z) / 50))
        counted = rows.filter("z is not null").groupBy(*keys, (F.round(F.col("z") / q) * q).alias("v")).agg(F.count("*").alias("n"))
        return counted.groupBy(*keys).agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("z"))
    if reducer == "mad":
        centre = stats.medians(rows, keys, "z", "m")
        return stats.medians(rows.join(centre, keys).select(*keys, F.abs(F.col("z") - F.col("m")).alias("z")), keys, "z", "z")
    raise ValueError(f"no such reducer: {reducer}")


def median_deviation(df: DataFrame, z: str) -> float:
    middle = stats.hazen(df, [], z, {"m": 0.5}).first().m
    if middle is None:
        return 0.0
    apart = df.select(F.abs(stats.missing_to_null(F.col(z)) - F.lit(middle)).alias("d"))
    return float(stats.hazen(apart, [], "d", {"m": 0.5}).first().m)


def centres(bins: DataFrame, width: float | tuple[float, float], kind: str) -> DataFrame:
    """Adds the centre of each bin as ``x, y``."""
    a, b = width if isinstance(width, tuple) else (width, width)
    if kind == "hexagonal":
        x, y = grid.from_hex(F.col("gx"), F.col("gy"), a, b)
    else:
        x, y = (F.col("gx") + 0.5) * F.lit(float(a)), (F.col("gy") + 0.5) * F.lit(float(b))
    return bins.withColumn("x", x).withColumn("y", y)


def trimmed(bins: DataFrame, points: DataFrame, x: str, y: str, width: float, reach: float = 1.5) -> DataFrame:
    """Bins (with centres) whose centre lies within ``reach`` widths of the points' bounding box."""
    box = points.agg(F.struct(F.min(x).alias("l"), F.max(x).alias("r"), F.min(y).alias("t"), F.max(y).alias("b"))).scalar()
    room = F.lit(float(width * reach))
    return bins.filter(F.col("x").between(box["l"] - room, box["r"] + room) & F.col("y").between(box["t"] - room, box["b"] + room))


def filled(bins: DataFrame, default: float, pad: int = 1) -> DataFrame:
    """The whole rectangle of bins and ``pad`` more at each border, with a default where none was.

    Border bins take the value of the nearest inner bin.
    """
    box = bins.agg(F.min("gx").alias("l"), F.max("gx").alias("r"), F.min("gy").alias("t"), F.max("gy").alias("b"))
    every = box.select("*", F.explode(F.sequence(F.col("l") - pad, F.col("r") + pad)).alias("gx"))
    every = every.select("*", F.explode(F.sequence(F.col("t") - pad, F.col("b") + pad)).alias("gy"))
    inner = every.withColumn("ix", F.least(F.greatest("gx", "l"), F.col("r"))).withColumn("iy", F.least(F.greatest("gy", "t"), F.col("b")))
    known = bins.select(F.col("gx").alias("ix"), F.col("gy").alias("iy"), "z")
    return inner.join(known, ["ix", "iy"], "left").select("gx", "gy", F.coalesce("z", F.lit(float(default))).alias("z"))


def cleaned(bins: DataFrame, default: float | None = None) -> DataFrame:
    """Bins but those that are missing, zero or at the default."""
    out = bins.filter(F.col("z").isNotNull() & (F.col("z") != 0))
    return out if default is None else out.filter(F.col("z") != F.lit(float(default)))


def histogram_peak(df: DataFrame, value: str, width: float = 0.05) -> DataFrame:
    """Centre of the fullest bin of a histogram; of equals the largest."""
    v = stats.missing_to_null(F.col(value))
    bins = df.filter(v.isNotNull()).groupBy(F.floor(v / F.lit(width)).alias("k")).agg(F.count("*").alias("n"))
    return bins.agg(F.max_by("k", F.struct("n", "k")).alias("k")).select(((F.col("k") + 0.5) * F.lit(width)).alias("peak"))


def band_mode(df: DataFrame, keys: list[str], value: str, peak: float, width: float = 0.05, fwhm: float = 1.0, least_height: float = 1.2, expected: int = 300) -> DataFrame:
    """The second band's mode in each cell: the best bin of a histogram that a Gaussian about the global peak
    weights, but for the lowest bin. Null where there is one bin only, or where the best weighs less than a
    flat histogram of the expected number of values would, by a factor. Of equals the lower bin counts."""
    v = stats.missing_to_null(F.col(value))
    counts = df.filter(v.isNotNull()).groupBy(*keys, F.floor(v / F.lit(width)).alias("k")).agg(F.count("*").alias("n"))
    centre = (F.col("k") + 0.5) * F.lit(width)
    sigma = fwhm / 2.355
    w = F.col("n") * F.exp(-(centre - F.lit(peak)) * (centre - F.lit(peak)) / F.lit(2 * sigma * sigma))
    lows = counts.groupBy(*keys).agg(F.min("k").alias("low"), (F.max("k") - F.min("k") + 1).alias("bins"))
    rated = counts.withColumn("w", F.round(w, 9)).join(lows, keys)
    above = F.when(F.col("k") > F.col("low"), F.col("k"))
    cell = rated.groupBy(*keys).agg(
        F.max_by("k", F.struct("w", -F.col("k"))).alias("best"),
        F.max_by(above, F.when(above.isNotNull(), F.struct(F.col("w"), -F.col("k")))).alias("second"),
        F.max(F.when(above.isNotNull(), F.col("w"))).alias("height"),
        F.max("low").alias("low"),
        F.max("bins").alias("bins"),
    )
    left = F.when(F.col("best") == F.col("low"), F.col("bins") - 1).otherwise(F.col("bins"))
    good = (F.col("bins") > 1) & (F.col("height") >= F.lit(least_height * expected) / F.nullif(left, F.lit(0)))
    return cell.select(*keys, F.when(good, (F.col("second") + 0.5) * F.lit(width)).alias("z"))


def low_band_mean(df: DataFrame, keys: list[str], value: str, shares: tuple[float, float] = (0.02, 0.04), least: float = 0.0) -> DataFrame:
    """Mean of each key's positive values between two percentiles; null for keys of fewer positive values than ``least``."""
    v = stats.missing_to_null(F.col(value))
    positive = df.filter(v > 0).withColumn("_v", v)
    limits = stats.hazen(positive, keys, "_v", {"_lo": shares[0], "_hi": shares[1]})
    if keys:
        # written, so that the limits of not too many keys are sent to the rows instead of all rows to their keys
        rows, low, high = positive.join(written(limits, "limits"), keys), F.col("_lo"), F.col("_hi")
    else:
        both = limits.select(F.struct("_lo", "_hi")).scalar()
        rows, low, high = positive, both["_lo"], both["_hi"]
    inside = F.when(F.col("_v").between(low, high), F.col("_v"))
    return rows.groupBy(*keys).agg(F.when(F.count("*") >= least, F.avg(inside)).alias("z"))


def running_median(df: DataFrame, keys: list[str], order: str, value: str, half: int = 15) -> Column:
    """Median of a centred window of 2 * half + 1 rows, shorter at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    values = F.array_sort(F.collect_list(value).over(w))
    n = F.size(values)
    return (F.element_at(values, ((n + 1) / 2).cast("int")) + F.element_at(values, (n / 2).cast("int") + 1)) / 2
