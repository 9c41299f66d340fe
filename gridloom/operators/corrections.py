"""Correction surfaces from object tables: of the reference channel (two bands at 1 and 2) and of others."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.operators import binning, surface
from gridloom.operators.surface import Stripe, Surface, decimate_and_smooth, fit_stripe
from gridloom.sources.scratch import written

#: Objects that a bin should hold, for intensity and for area surfaces.
PER_BIN, PER_AREA_BIN = 300, 800


def bin_width(n: int, area: float, per_bin: int = PER_BIN) -> float:
    """Width of hexagons that hold so many of n points on an area."""
    return math.sqrt(2 / math.sqrt(3) * per_bin * area / max(1, n))


@dataclass
class Grids:
    x: np.ndarray
    y: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    area: np.ndarray | None
    stripe: np.ndarray | None


def _flattened(stripe: Stripe, longest: float) -> Stripe:
    """The stripe without what is slower than its period."""
    return Stripe(stripe.x, kernels.highpass(stripe.s, longest, 1 / stripe.sampling) + 1, stripe.sampling)


def reference_corrections(objects: DataFrame, size: tuple[float, float], grid: tuple[np.ndarray, np.ndarray], stripe_width: float | None = None, x: str = "x", y: str = "y", value: str = "v", area: str | None = None, per_bin: int = PER_BIN) -> tuple[Grids, DataFrame]:
    """Factor and offset surfaces that move the bands of ``value`` to 1 and 2, and the objects with their
    corrected value and whether they lie in the first band.

    Steps: flatten by the mode, twice, the second time by the objects near 1 only; divide by the stripe, if
    there is one; flatten the first band by its median; fit the second band. Every step is one binning of
    the objects in Spark and a small fit; bins hold about ``per_bin`` objects, of which images with few objects need
    fewer; the objects are written after each, so that no step is computed again.
    """
    full = size[0] * size[1]
    now = objects.withColumn("_c", F.col(value).cast("double"))
    n = now.count()
    width = bin_width(n, full, per_bin)
    first = decimate_and_smooth(now, x, y, "_c", width, 5 * width, "mode", default=1.0)
    flat = now.withColumn("_d", F.try_divide("_c", first.evaluator()(F.col(x).cast("double"), F.col(y).cast("double"))))
    near = flat.filter((F.col("_d") > 0.5) & (F.col("_d") < 1.5))
    g1 = decimate_and_smooth(near, x, y, "_c", width, 2.5 * width, "mode", default=1.0)
    at = F.col(x).cast("double"), F.col(y).cast("double")
    now = written(now.withColumn("_c", F.try_divide("_c", g1.evaluator()(*at))), "flattened")
    per_length = n / max(1e-12, size[0])
    step = 0.005 * (10 if 200 / per_length > 0.005 else 1)
    stripe = fit_stripe(now, x, "_c", step, threshold=1e-2)
    line = None
    if stripe.sampling is not None:
        stripe = _flattened(stripe, 3 * stripe_width if stripe_width else 3.0)
        now = written(now.withColumn("_c", F.try_divide("_c", stripe.evaluator()(at[0]))), "unstriped")
        line = kernels.linear_beyond(stripe.x, stripe.s, grid[0])
    band = now.filter((F.col("_c") > 0.7) & (F.col("_c") < 1.3))
    again = decimate_and_smooth(band, x, y, "_c", width, 2.5 * width, "median", default=1.0)
    now = written(now.withColumn("_c", F.try_divide("_c", again.evaluator()(*at))), "flattened")
    second = now.filter((F.col("_c") > 1.8) & (F.col("_c") < 2.8))
    found = second.count()
    g2 = Surface(np.zeros(0), np.zeros(0), np.zeros(0))
    if found:
        wide = bin_width(found, full, per_bin)
        peak = binning.histogram_peak(second, "_c").first().peak

        def mode(points: DataFrame) -> DataFrame:
            cells = binning._binned(points, "_x", "_y", "_z", wide, "hexagonal")
            return binning.band_mode(cells, ["gx", "gy"], "z", peak, expected=per_bin)

        g2 = decimate_and_smooth(second, x, y, "_c", wide, 2.5 * wide, mode, of_table=True)
    twos = 2 * np.ones((len(grid[1]), len(grid[0]))) if not len(g2.z) else g2.on_grid(*grid)
    ones = g1.on_grid(*grid) * again.on_grid(*grid)
    twos = twos * ones
    level = g2.evaluator()(*at) if len(g2.z) else F.lit(2.0)
    # the first band stays at 1, the second comes to 2
    now = now.withColumn("_c", F.try_divide(F.col("_c") - 1, level - 1) + 1 if len(g2.z) else F.col("_c"))
    areas = None
    inside = (F.col("_c") > 0.7) & (F.col("_c") < 1.3)
    if area is not None:
        wide = bin_width(n, full, PER_AREA_BIN * per_bin // PER_BIN)
        areas = decimate_and_smooth(now.filter(inside), x, y, area, wide, 2.5 * wide, "median").on_grid(*grid)
    out = now.withColumn("corrected", F.col("_c")).withColumn("first_band", F.coalesce(inside, F.lit(False))).drop("_c")
    return Grids(*grid, twos - ones, 1 - ones / (twos - ones), areas, line), out


def channel_corrections(objects: DataFrame, size: tuple[float, float], grid: tuple[np.ndarray, np.ndarray], stripe_width: float | None = None, x: str = "x", y: str = "y", value: str = "v", per_bin: int = PER_BIN) -> tuple[np.ndarray, np.ndarray | None]:
    """The surface of a channel's low values (the mean between the 2nd and 4th percentile of each bin) and its stripe.

    The objects' places and values are written, so that they are computed once for all steps.
    """
    at = F.col(x).cast("double"), F.col(y).cast("double")
    now = written(objects.select(at[0].alias(x), at[1].alias(y), F.col(value).cast("double").alias("_c")), "objects")
    n = now.count()
    width = bin_width(n, size[0] * size[1], per_bin)
    flat = decimate_and_smooth(now, x, y, "_c", width, 2.5 * width, "median")
    divided = now.withColumn("_d", F.try_divide("_c", flat.evaluator()(*at)))
    stripe = fit_stripe(divided, x, "_d", 0.05, threshold=1e-2)
    line = None
    if stripe.sampling is not None:
        stripe = _flattened(stripe, 3 * stripe_width if stripe_width else 3.0)
        now = now.withColumn("_c", F.try_divide("_c", stripe.evaluator()(at[0])))
        line = kernels.linear_beyond(stripe.x, stripe.s, grid[0])

    def low(points: DataFrame) -> DataFrame:
        cells = binning._binned(points, "_x", "_y", "_z", width, "hexagonal")
        return binning.low_band_mean(cells, ["gx", "gy"], "z", least=0.5 * per_bin)

    fitted = decimate_and_smooth(now, x, y, "_c", width, 2.5 * width, low, of_table=True)
    return fitted.on_grid(*grid), line
