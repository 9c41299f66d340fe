"""Per-object features as grouped aggregates over rows of (object, x, y, value).

Every group only lists aggregate columns; :func:`extract` puts those of all groups and channels into one
groupBy, so that a scan and a shuffle serve them all.
"""

from __future__ import annotations

import json
from abc import ABC
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import stats


@dataclass
class FeatureGroup(ABC):
    """A plug-in: named aggregate columns over an object's pixels. ``channel`` is the column of its values."""

    channel: str = ""

    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        return {}

    @property
    def value(self) -> Column:
        return stats.missing_to_null(F.col(self.channel))

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, **asdict(self)})

    @staticmethod
    def from_json(text: str) -> FeatureGroup:
        options = json.loads(text)
        return KINDS[options.pop("kind")](**options)


@dataclass
class EmptyFeature(FeatureGroup):
    """No features."""


@dataclass
class BasicProps(FeatureGroup):
    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        out = {"BasicProps_Centroid_X": F.avg(x), "BasicProps_Centroid_Y": F.avg(y), "BasicProps_Area": F.count(F.lit(1))}
        return out | ({f"BasicProps_Intensity_{self.channel}_Integrated": F.sum(self.value)} if self.channel else {})


@dataclass
class Location(FeatureGroup):
    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        return {
            "Location_Centroid_X": F.avg(x),
            "Location_Centroid_Y": F.avg(y),
            "Location_BBox_L": F.min(x),
            "Location_BBox_T": F.min(y),
            "Location_BBox_W": F.max(x) - F.min(x) + 1,
            "Location_BBox_H": F.max(y) - F.min(y) + 1,
        }


@dataclass
class Intensity(FeatureGroup):
    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        v, name = self.value, f"Intensity_{self.channel}_"
        return {
            f"{name}Integrated": F.sum(v),
            f"{name}Mean": F.avg(v),
            f"{name}Std": F.stddev_samp(v),
            f"{name}Skewness": stats.skewness(v),
            f"{name}Kurtosis": stats.kurtosis(v),
        }


@dataclass
class Ellipse(FeatureGroup):
    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        return {"Shape_Area": F.count(F.lit(1))} | {f"Shape_{k}": c for k, c in stats.ellipse(x, y).items()}


@dataclass
class RadialIntensity(FeatureGroup):
    """Mean and deviation of rings by the distance to the background: ring k holds (k-1) * width < d <= k * width, the centre what is beyond."""

    distance: str = "distance"
    rings: int = 1
    width: float = 1.0

    def columns(self, x: Column, y: Column) -> dict[str, Column]:
        d, v = F.col(self.distance), self.value
        ring = F.least(F.ceil(d / F.lit(float(self.width))), F.lit(self.rings + 1))
        width = int(self.width) if self.width == int(self.width) else self.width
        out = {}
        for k in range(self.rings + 1, 0, -1):
            own = F.when(ring == k, v)
            name = "Center" if k > self.rings else f"R{k}"
            out[f"RadialIntensity_{self.channel}_Mean_W{width}_{name}"] = F.coalesce(F.avg(own), F.lit(0.0))
            out[f"RadialIntensity_{self.channel}_Std_W{width}_{name}"] = F.coalesce(F.stddev_samp(own), F.lit(0.0))
        return out


KINDS = {k.__name__: k for k in (EmptyFeature, BasicProps, Location, Intensity, Ellipse, RadialIntensity)}


@dataclass
class FeatureExtractor:
    """Groups over the channels that a table has; empty groups and those of unknown channels are left out."""

    groups: list[FeatureGroup] = field(default_factory=list)

    def add(self, group: FeatureGroup) -> FeatureExtractor:
        return FeatureExtractor([*self.groups, group])

    def usable(self, columns: list[str]) -> list[FeatureGroup]:
        return [g for g in self.groups if not isinstance(g, EmptyFeature) and (not g.channel or g.channel in columns)]

    def compute(self, pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y", offset: tuple[Column, Column] | None = None) -> DataFrame:
        """One row per object; ``offset`` moves positions from block to image coordinates."""
        xs, ys = F.col(x), F.col(y)
        if offset:
            xs, ys = xs + offset[0], ys + offset[1]
        aggregates: dict[str, Column] = {}
        for g in self.usable(pixels.columns):
            aggregates |= g.columns(xs, ys)
        if not aggregates:
            raise ValueError("no feature group has a channel of the table")
        return pixels.groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))


def extract(pixels: DataFrame, keys: list[str], groups: list[FeatureGroup], x: str = "x", y: str = "y") -> DataFrame:
    return FeatureExtractor(groups).compute(pixels, keys, x, y)


def larger_than(objects: DataFrame, area: str, least: int = 150) -> DataFrame:
    return objects.filter(F.col(area) >= least)


def without_border(pixels: DataFrame, keys: list[str], block: list[str], x: str, y: str, size: tuple[Column, Column]) -> DataFrame:
    """Pixels of objects that do not touch their block's border (places from 1 to the block's size).

    The touching objects are few and known from their own extremes; the pixels lose them by an anti-join.
    """
    ends = pixels.groupBy(*block, *keys).agg(F.min(x).alias("_l"), F.max(x).alias("_r"), F.min(y).alias("_t"), F.max(y).alias("_b"), F.first(size[0]).alias("_w"), F.first(size[1]).alias("_h"))
    touching = ends.filter((F.col("_l") <= 1) | (F.col("_t") <= 1) | (F.col("_r") >= F.col("_w")) | (F.col("_b") >= F.col("_h")))
    return pixels.join(touching.select(*block, *keys), [*block, *keys], "left_anti")


def offset_intensities(features: DataFrame, offset: Column, area: str, channel: str | None = None) -> DataFrame:
    """Adds an offset to integrated intensities, and its share of a pixel to means, of one channel or of all.

    Applies to the groups BasicProps and Intensity, and to the means of RadialIntensity.
    """
    per_pixel = offset / F.nullif(F.col(area).cast("double"), F.lit(0.0))
    changed = {}
    for c in features.columns:
        if channel is not None and not c.startswith((f"BasicProps_Intensity_{channel}_", f"Intensity_{channel}_", f"RadialIntensity_{channel}_")):
            continue
        if c.endswith("_Integrated") and c.startswith(("BasicProps_", "Intensity_")):
            changed[c] = F.col(c) + offset
        elif c.startswith("Intensity_") and c.endswith("_Mean") or c.startswith("RadialIntensity_") and "_Mean_" in c:
            changed[c] = F.col(c) + per_pixel
    return features.withColumns(changed)


def columns_named(df: DataFrame, exact: str | None = None, prefix: str | None = None, part: str | None = None) -> list[str]:
    """Feature columns by name, beginning or part of it."""
    return [c for c in df.columns if (exact is None or c == exact) and (prefix is None or c.startswith(prefix)) and (part is None or part in c)]


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: min, mean, max, deviation, mean absolute deviation, median, zeros and missing values.

    One aggregate serves all columns, a second one the deviations from the means; medians rank distinct
    values in ranges. No task holds a whole column.
    """
    values = df.select(*(stats.missing_to_null(F.col(c)).alias(c) for c in columns))
    one = [
        F.struct(F.min(c).alias("minX"), F.avg(c).alias("meanX"), F.max(c).alias("maxX"), F.stddev_samp(c).alias("stdX"), F.count_if(F.col(c) == 0).alias("is0"), F.count_if(F.col(c).isNull()).alias("isNan")).alias(c)
        for c in columns
    ]
    first = values.agg(*one)
    means = first.select(F.struct(*(F.col(f"{c}.meanX").alias(c) for c in columns))).scalar()
    second = values.agg(F.struct(*(F.avg(F.abs(F.col(c) - means[c])).alias(c) for c in columns))).scalar()
    rows = [F.struct(F.lit(c).alias("feature"), *(F.col(f"{c}.{n}").alias(n) for n in ("minX", "meanX", "maxX", "stdX", "is0", "isNan")), second[c].alias("madX"), stats.median_of(values, c).alias("medianX")) for c in columns]
    return first.select(F.explode(F.array(*rows)).alias("r")).select("r.*").select("feature", "minX", "meanX", "maxX", "stdX", "madX", "medianX", "is0", "isNan")
