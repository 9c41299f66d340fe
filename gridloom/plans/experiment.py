"""An experiment over the channels of one image: object mask, background corrections, object features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import match_option
from gridloom.operators import corrections, features, joins, raster
from gridloom.plans.expression import Correction
from gridloom.sources.scratch import written

OBJECT = ["image_id", "bx", "by", "label"]


@dataclass
class Experiment:
    """``blocks`` holds a row a block and channel; ``reference`` names the channel that objects are found in."""

    blocks: DataFrame
    channels: list[str]
    reference: str
    partitioner: raster.Partitioner = field(default_factory=raster.DistanceWatershed)
    extractor: features.FeatureExtractor = field(default_factory=features.FeatureExtractor)
    masks: DataFrame | None = None
    #: What corrects a channel's pixels, and offsets of objects' intensities: (nodes x, nodes y, z) by channel.
    correction: Correction = field(default_factory=lambda: Correction("(S - BG_o) / (FG_f * FG_s)"))
    offsets: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.reference not in self.channels:
            raise ValueError(f"{self.reference} is not a channel")
        if len(set(self.channels)) != len(self.channels):
            raise ValueError("channels repeat")

    def create_object_mask(self, corrected: bool = False) -> Experiment:
        """Thresholds of the smoothed reference blocks (linear for corrected images), and their masks divided into objects."""
        own = self.blocks.filter(F.col("channel") == self.reference)
        return self._with(masks=raster.object_masks(own, raster.block_thresholds(own, corrected), self.partitioner))

    def correct_backgrounds(self, grids: dict[str, dict[str, tuple]] | None = None) -> Experiment:
        """Blocks less their channel's background, which is the median of each block outside the objects, and divided by
        the surfaces of ``grids``, if there are any."""
        self._need_masks()
        levels = raster.outside_levels(self.blocks, self.masks)
        return self._with(blocks=written(raster.corrected_blocks(self.blocks, levels, self.correction.array, grids or {}), "corrected"))

    def correct(self, block: tuple[int, int], size: tuple[float, float], nodes: int = 11, per_bin: int = corrections.PER_BIN) -> Experiment:
        """All corrections from the image itself, in order: backgrounds outside the objects; the reference channel's factor
        and offset, which move the bands of the objects' integrated intensities to 1 and 2; the offsets of the other
        channels, from the low values of the objects in the first band.

        ``block`` is the width and height of blocks and ``size`` that of the image, in pixels. Surfaces are kept at
        ``nodes`` by ``nodes`` places and fitted to bins of about ``per_bin`` objects. Objects lie in the smoothed, corrected blocks and touch no border.
        """
        plain = self.correct_backgrounds()
        grid = np.linspace(1, size[0], nodes), np.linspace(1, size[1], nodes)
        smooth = raster.smoothed(plain.blocks)
        props = raster.measure_basic_props(smooth, self.masks, block)
        value = {"BasicProps_Centroid_X": "x", "BasicProps_Centroid_Y": "y", "BasicProps_Area": "area", "BasicProps_Intensity_v_Integrated": "v"}
        objects = written(props.withColumnsRenamed(value).select("channel", *OBJECT, "x", "y", "area", "v"), "objects")
        own = objects.filter(F.col("channel") == self.reference).filter("v > 0")
        grids, offsets = {}, {}
        if own.isEmpty():
            return plain
        found, banded = corrections.reference_corrections(own, size, grid, area="area", per_bin=per_bin)
        grids[self.reference] = {"FG_f": (*grid, found.factor)}
        if found.stripe is not None:
            grids[self.reference]["FG_s"] = (grid[0], grid[1][:1], found.stripe[None, :])
        offsets[self.reference] = (*grid, found.offset)
        first = written(banded.filter("first_band").select(*OBJECT), "first_band")
        for c in self.channels:
            theirs = objects.filter(F.col("channel") == c).join(first, OBJECT, "left_semi")
            if c != self.reference and not theirs.isEmpty():
                low, stripe = corrections.channel_corrections(theirs, size, grid, per_bin=per_bin)
                offsets[c] = (*grid, -low)
                if stripe is not None:
                    grids[c] = {"FG_s": (grid[0], grid[1][:1], stripe[None, :])}
        return self._with(blocks=self.correct_backgrounds(grids).blocks, offsets=offsets)

    def surface(self, name: str) -> DataFrame:
        """A surface of the reference channel by the beginning of its name, as rows (bx, by, z)."""
        own = self.blocks.filter(F.col("channel") == self.reference)
        made = {
            "threshold": lambda: raster.block_thresholds(own).withColumnRenamed("threshold", "z"),
            "sharpness": lambda: raster.block_sharpness(own).withColumnRenamed("sharpness", "z"),
            "background": lambda: raster.levels(own, raster.block_thresholds(own)).withColumnRenamed("background", "z"),
            "foreground": lambda: raster.levels(own, raster.block_thresholds(own)).withColumnRenamed("foreground", "z"),
        }
        return made[match_option(name, list(made))]().select("image_id", "bx", "by", "z")

    def pixels(self) -> DataFrame:
        self._need_masks()
        return raster.channels_side_by_side(raster.object_pixels(self.blocks, self.masks), self.channels)

    def compute_features(self, block: tuple[int, int], arrays: dict[str, dict] | None = None) -> DataFrame:
        """One row an object: all relational groups in one aggregate, array features pivoted beside them."""
        offset = (F.col("bx") * block[0], F.col("by") * block[1])
        out = self.extractor.compute(self.pixels(), OBJECT, offset=offset)
        if self.offsets:
            out = self._offset(out, offset)
        if arrays:
            long = raster.array_features(self.blocks, self.masks, arrays)
            # the names follow from the options, so that no job looks for them; shapes are the same for every channel
            wide = long.groupBy(*OBJECT).pivot("name", raster.array_names(self.channels, arrays)).agg(F.max("value"))
            out = out.join(wide, OBJECT, "left")
        return out

    def _offset(self, out: DataFrame, offset: tuple) -> DataFrame:
        """Adds the channels' offsets at the objects' centroids to their intensities."""
        place = features.FeatureExtractor([features.BasicProps("")]).compute(raster.object_pixels(self.blocks.filter(F.col("channel") == self.reference), self.masks), OBJECT, offset=offset)
        place = place.select(*OBJECT, F.col("BasicProps_Centroid_X").alias("_x"), F.col("BasicProps_Centroid_Y").alias("_y"), F.col("BasicProps_Area").alias("_n"))
        columns, out = out.columns, out.join(place, OBJECT)
        for c, (gx, gy, z) in self.offsets.items():
            rows = [(i, j, float(z[j, i])) for j in range(len(gy)) for i in range(len(gx))]
            surface = self.blocks.sparkSession.createDataFrame(rows, "gx int, gy int, z double")
            step = tuple(float(g[1] - g[0]) if len(g) > 1 else 1.0 for g in (gx, gy))
            out = joins.from_surface(out, F.broadcast(surface), "_x", "_y", "_o", (float(gx[0]), float(gy[0])), step, (len(gx), len(gy)))
            out = features.offset_intensities(out, F.col("_o"), "_n", c).drop("_o")
        return out.select(*columns)

    def _need_masks(self) -> None:
        if self.masks is None:
            raise ValueError("create the object mask first")

    def _with(self, **changes) -> Experiment:
        return Experiment(**{**{k: getattr(self, k) for k in ("blocks", "channels", "reference", "partitioner", "extractor", "masks", "correction", "offsets")}, **changes})


def save_features(features_: DataFrame, path: str, overwrite: bool = False) -> None:
    features_.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_features(spark, path: str, expected: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The table, and the expected columns that it lacks."""
    df = spark.read.parquet(path)
    return df, sorted(set(expected or []) - set(df.columns))
