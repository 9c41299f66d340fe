"""Blocks of images: assembly from tiles, smoothing, thresholds, partitioning into objects, array features.

A block is a row with its pixels as an array; whatever needs neighbours runs on whole blocks in Arrow
batches, and what is counted per object goes on as rows of (object, x, y, value).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import kernels
from gridloom.operators import features, joins

BLOCK = "image_id string, channel string, bx int, by int, x0 int, y0 int, h int, w int, pixels array<float>"
PIXEL = "image_id string, channel string, bx int, by int, label int, x int, y int, v double, distance double"


def image_of(r) -> np.ndarray:
    return np.asarray(r.pixels, float).reshape(r.h, r.w)


def to_blocks(tiles: DataFrame, tiles_a_side: int, tile: tuple[int, int], channel: str = "") -> DataFrame:
    """Blocks of so many tiles a side, trimmed at the image's right and lower edges. Places count from 0."""
    keyed = tiles.withColumn("bx", (F.col("tx") / tiles_a_side).cast("int")).withColumn("by", (F.col("ty") / tiles_a_side).cast("int"))
    bw, bh = tile[0] * tiles_a_side, tile[1] * tiles_a_side

    def assemble(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = key[1] * bw, key[2] * bh
        w, h = int((pdf.x0 + pdf.w).max() - x0), int((pdf.y0 + pdf.h).max() - y0)
        out = np.zeros((h, w), np.float32)
        for r in pdf.itertuples():
            out[r.y0 - y0 : r.y0 - y0 + r.h, r.x0 - x0 : r.x0 - x0 + r.w] = image_of(r)
        return pd.DataFrame([(key[0], channel, key[1], key[2], x0, y0, h, w, out.ravel())], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return keyed.groupBy("image_id", "bx", "by").applyInPandas(assemble, BLOCK)


def strips(tiles: DataFrame, axis: str) -> DataFrame:
    """Columns (``tx``) or rows (``ty``) of tiles over the whole image, one strip a row."""
    if axis not in ("tx", "ty"):
        raise ValueError(f"no such axis: {axis}")
    other, join = ("ty", np.vstack) if axis == "tx" else ("tx", np.hstack)

    def assemble(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf.sort_values(other)
        out = join([image_of(r) for r in parts.itertuples()])
        return pd.DataFrame([(key[0], int(key[1]), out.shape[0], out.shape[1], out.ravel())], columns=["image_id", axis, "h", "w", "pixels"])

    return tiles.groupBy("image_id", axis).applyInPandas(assemble, f"image_id string, {axis} int, h int, w int, pixels array<float>")


def map_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each block's pixels through an array function that keeps their shape."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(pixels=[kernel(image_of(r)).astype(np.float32).ravel() for r in pdf.itertuples()])

    return blocks.mapInPandas(run, blocks.schema)


def smoothed(blocks: DataFrame) -> DataFrame:
    return map_blocks(blocks, kernels.gaussian)


def block_values(blocks: DataFrame, kernel: Callable[[np.ndarray], float], name: str) -> DataFrame:
    """A number for each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["image_id", "channel", "bx", "by"]].assign(**{name: [float(kernel(image_of(r))) for r in pdf.itertuples()]})

    return blocks.mapInPandas(run, f"image_id string, channel string, bx int, by int, {name} double")


def otsu_level(a: np.ndarray, scale: str = "linear") -> float:
    """Otsu's threshold of one array, as the grouped operator has it."""
    low, high = float(np.min(a)), float(np.max(a))
    if not high > low:
        return 0.0
    counts = np.bincount(np.floor(255 * (np.ravel(a) - low) / (high - low) + 0.5).astype(int), minlength=256)
    p = counts / counts.sum()
    k = np.arange(1, 257)
    weight = k if scale == "linear" else np.log2(k)
    w, m = np.cumsum(p), np.cumsum(p * weight)
    inside = w * (1 - w)
    with np.errstate(all="ignore"):
        between = np.round(np.where(inside > 1e-12, (m[-1] * w - m) ** 2 / inside, np.nan), 9)
    best = k[between == np.nanmax(between)].mean()
    return float((best - 1) / 255 * (high - low) + low)


def block_thresholds(blocks: DataFrame, corrected: bool = False) -> DataFrame:
    """``threshold`` of each block after smoothing: on a logarithmic scale raised by a fifth, or a linear one for corrected images."""
    level = (lambda a: otsu_level(a, "linear")) if corrected else (lambda a: 1.2 * otsu_level(a, "log"))
    return block_values(blocks, lambda a: level(kernels.gaussian(a)), "threshold")


def block_sharpness(blocks: DataFrame) -> DataFrame:
    return block_values(blocks, kernels.sharpness, "sharpness")


def levels(blocks: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Median of each block's background and mean of its foreground, both eroded by a diamond; 0 where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                a = image_of(r)
                dark, bright = kernels.erode(a < r.threshold, kernels.diamond(2)), kernels.erode(a > r.threshold, kernels.diamond(2))
                rows.append((float(np.median(a[dark])) if dark.any() else 0.0, float(a[bright].mean()) if bright.any() else 0.0))
            yield pdf[["image_id", "channel", "bx", "by"]].assign(background=[x[0] for x in rows], foreground=[x[1] for x in rows])

    known = blocks.join(thresholds, ["image_id", "channel", "bx", "by"])
    return known.mapInPandas(run, "image_id string, channel string, bx int, by int, background double, foreground double")


def outside_levels(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    """Median of each block's smoothed pixels outside the objects (eroded by a diamond); 0 where there are none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for r in pdf.itertuples():
                outside = kernels.erode(np.asarray(r.mask).reshape(r.h, r.w) <= 0, kernels.diamond(2))
                found.append(float(np.median(kernels.gaussian(image_of(r))[outside])) if outside.any() else 0.0)
            yield pdf[["image_id", "channel", "bx", "by"]].assign(background=found)

    keys = ["image_id", "bx", "by"]
    known = joins.blocks_with_mask(blocks, masks.select(*keys, F.col("pixels").alias("mask")), keys)
    return known.mapInPandas(run, "image_id string, channel string, bx int, by int, background double")


def corrected_blocks(blocks: DataFrame, backgrounds: DataFrame, correction: Callable[[np.ndarray, dict], np.ndarray], grids: dict[str, dict[str, tuple]]) -> DataFrame:
    """Blocks through a correction of arrays, with their background as ``BG_o`` and their channel's surfaces.

    ``grids`` holds for each channel surfaces (nodes x, nodes y, z) by name; each is evaluated at the pixels' places in
    the image, from 1.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                y, x = np.mgrid[r.y0 + 1 : r.y0 + r.h + 1, r.x0 + 1 : r.x0 + r.w + 1]
                own = {name: kernels.bilinear(z, gx, gy, x.ravel().astype(float), y.ravel().astype(float)).reshape(r.h, r.w) for name, (gx, gy, z) in grids.get(r.channel, {}).items()}
                out.append(correction(image_of(r), own | {"BG_o": r.background}).astype(np.float32).ravel())
            yield pdf.drop(columns="background").assign(pixels=out)

    known = blocks.join(backgrounds, ["image_id", "channel", "bx", "by"]).select(*blocks.columns, "background")
    return known.mapInPandas(run, blocks.schema)


# ---- partitioners


@dataclass
class Partitioner(ABC):
    """A plug-in that divides the mask of a block into objects. Objects outside an acceptance contour of
    (intensity, area) are left undivided, if there is one."""

    minimum_object_size: int = 150
    minimum_hole_size: int = 10
    contour: list[tuple[float, float]] | None = None
    area_normaliser: Callable | None = None
    intensity_normaliser: Callable | None = None

    @abstractmethod
    def divide(self, mask: np.ndarray, image: np.ndarray) -> np.ndarray: ...

    def partition(self, mask: np.ndarray, image: np.ndarray, origin: tuple[int, int] = (0, 0)) -> np.ndarray:
        full = kernels.area_open(kernels.fill_holes(mask, self.minimum_hole_size), self.minimum_object_size)
        attempted = full & self._accepted(full, image, origin)
        divided = (self.divide(attempted, image) if attempted.any() else attempted) | (full & ~attempted)
        return kernels.area_open(self._finished(divided), self.minimum_object_size)

    def _finished(self, mask: np.ndarray) -> np.ndarray:
        return kernels.clear_border(mask)

    def _accepted(self, mask: np.ndarray, image: np.ndarray, origin: tuple[int, int]) -> np.ndarray:
        if self.contour is None:
            return mask
        found = kernels.label(mask)
        keep = np.zeros(found.max(initial=0) + 1, bool)
        y_at, x_at = np.nonzero(found)
        own = found[y_at, x_at]
        sums = [np.bincount(own, v, len(keep)) for v in (np.ones(len(own)), image[y_at, x_at], x_at, y_at)]
        for k in range(1, len(keep)):
            area, total, x, y = (float(v[k]) for v in sums)
            x, y = x / area + 1 + origin[0], y / area + 1 + origin[1]
            area = self.area_normaliser(area, x, y) if self.area_normaliser else area
            total = self.intensity_normaliser(total, x, y) if self.intensity_normaliser else total
            keep[k] = _inside(total, area, self.contour)
        return keep[found]


def _inside(x: float, y: float, vertices: list[tuple[float, float]]) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


class NoPartition(Partitioner):
    """The mask as it is."""

    def divide(self, mask: np.ndarray, image: np.ndarray) -> np.ndarray:
        return mask

    def partition(self, mask: np.ndarray, image: np.ndarray, origin: tuple[int, int] = (0, 0)) -> np.ndarray:
        return mask


@dataclass
class DistanceWatershed(Partitioner):
    """Divides each object along the ridges between basins of its opened distance transform."""

    smoothing_size: float = 4.0

    def divide(self, mask: np.ndarray, image: np.ndarray) -> np.ndarray:
        """Distances and minima of all objects at once: objects don't touch, so none changes those of another. Only objects
        of several minima are flooded."""
        found = kernels.label(mask)
        depth = kernels.opening(kernels.distance(np.pad(mask, 1)), kernels.disk(self.smoothing_size))
        minima = kernels.label(kernels.regional_minima(-depth[1:-1, 1:-1], mask))
        at = np.flatnonzero(minima)
        owner = np.zeros(minima.max(initial=0) + 1, int)
        owner[minima.ravel()[at]] = found.ravel()[at]
        several = np.bincount(owner[1:], minlength=found.max(initial=0) + 1) > 1
        out = mask & ~several[found]
        for k, own, y0, x0 in kernels.crops(found):
            if several[k]:
                h, w = own.shape
                padded = np.pad(own, 1)
                basins = kernels.watershed(np.where(padded, -depth[y0 : y0 + h + 2, x0 : x0 + w + 2], 0.0))
                out[y0 : y0 + h, x0 : x0 + w] |= own & (basins[1:-1, 1:-1] > 0)
        return out


class GeometricPartition(Partitioner):
    """A place for a partitioner by seed points, which other packages would have to bring."""

    def divide(self, mask: np.ndarray, image: np.ndarray) -> np.ndarray:
        raise NotImplementedError("partitioning by seed points needs a package that is not part of this library")


def object_masks(blocks: DataFrame, thresholds: DataFrame, partitioner: Partitioner) -> DataFrame:
    """Mask blocks (0 and 1): smoothed pixels above their block's threshold, divided into objects."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            masks = []
            for r in pdf.itertuples():
                a = kernels.gaussian(image_of(r))
                masks.append(partitioner.partition(a > r.threshold, a, (r.x0, r.y0)).astype(np.float32).ravel())
            yield pdf.drop(columns="threshold").assign(pixels=masks)

    return blocks.join(thresholds, ["image_id", "channel", "bx", "by"]).select(*blocks.columns, "threshold").mapInPandas(run, blocks.schema)


def object_pixels(blocks: DataFrame, masks: DataFrame, cleared: bool = False) -> DataFrame:
    """Rows of the labelled pixels of each channel's blocks, with places from 1 and distances to the background.

    ``cleared`` leaves out objects that touch their block's border.
    """
    keys = ["image_id", "bx", "by"]
    mask = masks.select(*keys, F.col("pixels").alias("mask"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                m = np.asarray(r.mask).reshape(r.h, r.w) > 0
                m = kernels.clear_border(m) if cleared else m
                found, a = kernels.label(m), image_of(r)
                y, x = np.nonzero(found)
                if len(y):
                    d = kernels.distance(np.pad(m, 1))[1:-1, 1:-1]
                    yield pd.DataFrame({"image_id": r.image_id, "channel": r.channel, "bx": r.bx, "by": r.by, "label": found[y, x], "x": x + 1, "y": y + 1, "v": a[y, x], "distance": d[y, x]})

    return joins.blocks_with_mask(blocks, mask, keys).mapInPandas(run, PIXEL)


def measure_basic_props(blocks: DataFrame, masks: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Centroid in the image, area and integrated intensity of the objects that touch no border of their block."""
    offset = (F.col("bx") * block[0], F.col("by") * block[1])
    keys = ["image_id", "channel", "bx", "by", "label"]
    return features.FeatureExtractor([features.BasicProps("v")]).compute(object_pixels(blocks, masks, cleared=True), keys, offset=offset)


def measure_intensity(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    """Integrated intensity alone, of the same objects."""
    return object_pixels(blocks, masks, cleared=True).groupBy("image_id", "channel", "bx", "by", "label").agg(F.sum("v").alias("total"))


def save_masks(masks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Mask blocks as Parquet by channel, their pixels as booleans."""
    out = masks.withColumn("pixels", F.transform("pixels", lambda p: p > 0))
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("channel").parquet(path)


def channels_side_by_side(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """One row a pixel with a column for each channel."""
    keys = ["image_id", "bx", "by", "label", "x", "y", "distance"]
    return pixels.groupBy(*keys).agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in channels))


def array_features(blocks: DataFrame, masks: DataFrame, kinds: dict[str, dict]) -> DataFrame:
    """Features that need whole objects or blocks, as (object, name, value) rows.

    Kinds: ``shape`` (solidity, form factor, Fourier descriptors; options vertices, descriptors), ``granularity``
    (options spectrum, element, sample, background_sample) and ``haralick`` (option distances).
    """
    if unknown := set(kinds) - {"shape", "granularity", "haralick"}:
        raise ValueError(f"no such features: {', '.join(sorted(unknown))}")
    keys = ["image_id", "bx", "by"]
    mask = masks.select(*keys, F.col("pixels").alias("mask"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                found = kernels.label(np.asarray(r.mask).reshape(r.h, r.w) > 0)
                rows: list[tuple[int, str, float]] = []
                if "shape" in kinds:
                    rows += shape_rows(found, **kinds["shape"])
                if "granularity" in kinds and found.any():
                    options = kinds["granularity"]
                    table = kernels.granularity(image_of(r), found, **options)
                    name = f"Granularity_{r.channel}_E{options.get('element', 10):g}"
                    rows += [(k + 1, f"{name}_{j + 1}", float(v)) for k, line in enumerate(table) for j, v in enumerate(line)]
                if "haralick" in kinds and found.any():
                    for d in kinds["haralick"].get("distances", (1,)):
                        for name, values in kernels.texture(kernels.cooccurrences(image_of(r), found, d)).items():
                            # directions without a pair of pixels count as 0, as undefined features do
                            rows += [(k + 1, f"HaralickTexture_{r.channel}_{name}_{d}", float(v)) for k, v in enumerate(values.mean(1))]
                if rows:
                    out = pd.DataFrame(rows, columns=["label", "name", "value"])
                    yield out.assign(image_id=r.image_id, channel=r.channel, bx=r.bx, by=r.by)[["image_id", "channel", "bx", "by", "label", "name", "value"]]

    return joins.blocks_with_mask(blocks, mask, keys).mapInPandas(run, "image_id string, channel string, bx int, by int, label int, name string, value double")


def array_names(channels: list[str], kinds: dict[str, dict]) -> list[str]:
    """The names that :func:`array_features` gives with these options, in order."""
    out = [name for _, name, _ in shape_rows(kernels.disk(3).astype(int), **kinds["shape"])] if "shape" in kinds else []
    for c in channels:
        if "granularity" in kinds:
            options = kinds["granularity"]
            out += [f"Granularity_{c}_E{options.get('element', 10):g}_{j + 1}" for j in range(options.get("spectrum", 10))]
        if "haralick" in kinds:
            features_ = kernels.texture(np.zeros((1, kernels.GREY_LEVELS, kernels.GREY_LEVELS)))
            out += [f"HaralickTexture_{c}_{n}_{d}" for d in kinds["haralick"].get("distances", (1,)) for n in features_]
    return out


def shape_rows(labels: np.ndarray, vertices: int = 100, descriptors: int = 10) -> list[tuple[int, str, float]]:
    out = []
    for k, own, _, _ in kernels.crops(labels):
        line, area = kernels.boundary(own), float(own.sum())
        hull, length = kernels.hull_area(line), kernels.perimeter(line)
        out.append((k, "Shape_Solidity", area / hull if hull else float("inf")))
        out.append((k, "Shape_FormFactor", area / (length**2 / (4 * np.pi)) if length else float("inf")))
        invariant, _ = kernels.fourier_descriptors(line.astype(float), vertices, descriptors)
        out += [(k, f"Shape_FourierDescriptor_{j + 2}", float(v)) for j, v in enumerate(invariant)]
    return out


def extract_images(objects: DataFrame, tiles: DataFrame, tile: tuple[int, int], tiles_across: int, patch: tuple[int, int], resize: tuple[int, int] | None = None) -> DataFrame:
    """Patches of (rows, columns) around objects (object_id, x, y from 1), out of tiles with a channel column.

    An object meets the tiles that its patch touches by an equi-join; what lies outside the image is 0.
    """
    rows, columns = patch
    left, top = F.round(F.col("x") - (columns - 1) / 2).cast("long"), F.round(F.col("y") - (rows - 1) / 2).cast("long")
    boxes = objects.select("object_id", left.alias("l"), top.alias("t"), F.lit(columns - 1).alias("w"), F.lit(rows - 1).alias("h"))
    needed = joins.boxes_to_tiles(boxes, tile, tiles_across).select("object_id", "l", "t", "tx", "ty")
    met = needed.join(tiles.select("channel", "tx", "ty", "x0", "y0", "h", "w", "pixels"), ["tx", "ty"])

    def crop(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((rows, columns), np.float32)
        for r in pdf.itertuples():
            a, y0, x0 = image_of(r), r.y0 - (r.t - 1), r.x0 - (r.l - 1)
            ys, xs = slice(max(0, y0), min(rows, y0 + r.h)), slice(max(0, x0), min(columns, x0 + r.w))
            if ys.start < ys.stop and xs.start < xs.stop:
                out[ys, xs] = a[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0]
        out = kernels.resize(out, resize).astype(np.float32) if resize else out
        return pd.DataFrame([(key[0], key[1], *out.shape, out.ravel())], columns=["object_id", "channel", "h", "w", "pixels"])

    kind = dict(objects.dtypes)["object_id"]
    return met.groupBy("object_id", "channel").applyInPandas(crop, f"object_id {kind}, channel string, h int, w int, pixels array<float>")
