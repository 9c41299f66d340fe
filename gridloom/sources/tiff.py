"""Tiled single-sample TIFF images: a parser of tags and tiles, a Spark data source of tiles, a writer.

Classic and big files of either byte order; tiles that are not compressed or deflated.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TILE_SCHEMA = "image_id string, tile_id long, tx int, ty int, x0 int, y0 int, h int, w int, pixels array<float>"
#: Numbers of TIFF tags and the sizes of its field types.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "description": 270, "samples": 277, "tile_width": 322, "tile_height": 323, "offsets": 324, "counts": 325, "format": 339}
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 11: "f", 12: "d", 16: "Q"}
UNCOMPRESSED, DEFLATED = (1,), (8, 32946)


class TiffError(ValueError):
    pass


class TiffImage:
    """Tags and tiles of an open file. Values are scaled to 0..1 (integers by their largest value)."""

    def __init__(self, file, name: str = ""):
        self.file, self.name = file, name
        head = file.read(16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None:
            raise TiffError(f"not a TIFF file: {name}")
        version = self._unpack("H", head[2:4])[0]
        if version not in (42, 43):
            raise TiffError(f"not a TIFF file: {name}")
        self.big = version == 43
        at = self._unpack("Q", head[8:16])[0] if self.big else self._unpack("I", head[4:8])[0]
        self.tags = self._directory(at)
        need = ("width", "height", "tile_width", "tile_height", "offsets", "counts")
        if absent := [n for n in need if TAGS[n] not in self.tags]:
            raise TiffError(f"{name} is not tiled: no {', '.join(absent)}")
        one = lambda n, d=None: int(self.tags.get(TAGS[n], (d,))[0])
        self.width, self.height, self.tile_w, self.tile_h = (one(n) for n in need[:4])
        self.bits, self.format, self.compression = one("bits", 1), one("format", 1), one("compression", 1)
        if one("samples", 1) != 1:
            raise TiffError(f"{name} has several samples a pixel")
        if self.compression not in UNCOMPRESSED + DEFLATED:
            raise TiffError(f"{name}: compression {self.compression} is not supported")
        if self.format not in (1, 2, 3) or self.bits not in (1, 8, 16, 32, 64):
            raise TiffError(f"{name}: samples of format {self.format} and {self.bits} bits are not supported")
        self.across, self.down = -(-self.width // self.tile_w), -(-self.height // self.tile_h)
        self.metadata = parse_description(self.description)

    @property
    def description(self) -> str:
        return self.tags.get(TAGS["description"], (b"",))[0].split(b"\0")[0].decode("latin-1")

    @property
    def max_sample(self) -> float:
        return 1.0 if self.format == 3 or self.bits == 1 else float(2 ** (self.bits - (self.format == 2)) - 1)

    def _unpack(self, kind: str, raw: bytes) -> tuple:
        return struct.unpack(self.order + kind, raw)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self, at: int) -> dict[int, tuple]:
        count_kind, entry, inline = ("Q", 20, 8) if self.big else ("H", 12, 4)
        size = struct.calcsize(self.order + count_kind)
        n = self._unpack(count_kind, self._read(at, size))[0]
        raw, out = self._read(at + size, n * entry), {}
        for k in range(n):
            e = raw[k * entry : (k + 1) * entry]
            tag, kind = self._unpack("HH", e[:4])
            count = self._unpack("Q" if self.big else "I", e[4 : entry - inline])[0]
            if kind not in SIZES:
                continue
            fmt = f"{count}s" if kind == 2 else SIZES[kind] * count if kind == 5 else f"{count}{SIZES[kind]}"
            length = struct.calcsize(self.order + fmt)
            value = e[entry - inline :][:length] if length <= inline else self._read(self._unpack("Q" if self.big else "I", e[entry - inline :])[0], length)
            out[tag] = self._unpack(fmt, value)
        return out

    def tile(self, number: int) -> np.ndarray:
        """A whole tile by its number (row-major from 0), padded with zeros where the file is short."""
        raw = self._read(self.tags[TAGS["offsets"]][number], self.tags[TAGS["counts"]][number])
        if self.compression in DEFLATED:
            raw = zlib.decompress(raw)
        n = self.tile_w * self.tile_h
        if self.bits == 1:
            flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(self.tile_h, -1), axis=1)[:, : self.tile_w].ravel()
            return flat.astype(np.float32).reshape(self.tile_h, self.tile_w)
        kind = {1: "u", 2: "i", 3: "f"}[self.format]
        flat = np.frombuffer(raw, f"{self.order}{kind}{self.bits // 8}")
        flat = np.concatenate([flat, np.zeros(max(0, n - len(flat)), flat.dtype)])[:n]
        work = np.float64 if self.bits > 16 and self.format != 3 else np.float32
        return (flat.astype(work) / self.max_sample).reshape(self.tile_h, self.tile_w)

    def trimmed_tile(self, number: int) -> tuple[np.ndarray, int, int]:
        """A tile without what lies outside the image, and its column and row in the tile grid."""
        tx, ty = number % self.across, number // self.across
        w, h = min(self.tile_w, self.width - tx * self.tile_w), min(self.tile_h, self.height - ty * self.tile_h)
        return self.tile(number)[:h, :w], tx, ty


def parse_description(text: str) -> dict[str, str]:
    """``key = value`` fields between vertical bars; other fields go under Extra."""
    out, extra = {}, []
    for part in filter(None, (p.strip() for p in text.split("|"))):
        if "=" in part:
            key, value = part.split("=", 1)
            out[key.strip().replace(" ", "_")] = value.strip()
        else:
            extra.append(part)
    return out | ({"Extra": "|".join(extra)} if extra else {})


def tile_batches(image: TiffImage, numbers: range, image_id: str) -> Iterator[pa.RecordBatch]:
    names = [c.strip().split()[0] for c in TILE_SCHEMA.split(",")]
    for k in numbers:
        pixels, tx, ty = image.trimmed_tile(k)
        h, w = pixels.shape
        ints = [pa.array([v], pa.int32()) for v in (tx, ty, tx * image.tile_w, ty * image.tile_h, h, w)]
        flat = pa.array([pixels.astype(np.float32).ravel()], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array([image_id]), pa.array([k], pa.int64()), *ints, flat], names)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.tiles = int(options.get("tilesPerPartition", "64"))

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                image = TiffImage(f, path)
                n = image.across * image.down
            out += [_Range(path, a, min(n, a + self.tiles)) for a in range(0, n, self.tiles)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from tile_batches(TiffImage(f, partition.path), range(partition.first, partition.last), partition.path)


class TiffTiles(DataSource):
    """``spark.read.format("tiff_tiles").load(path)``: a row a tile, for files on a mounted path. Several paths are joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "tiff_tiles"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TileReader(self.options)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of all images under a path that only Spark need reach. A file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                image = TiffImage(io.BytesIO(content), name)
                yield from tile_batches(image, range(image.across * image.down), name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, TILE_SCHEMA)


def write_tiff(file, tiles: Iterator[np.ndarray], width: int, height: int, tile: tuple[int, int], description: str = "", deflate: bool = True) -> None:
    """Writes a tiled image, tile by tile in row-major order: boolean tiles as one bit, floats as 32 bits, others as they are."""
    tw, th = tile
    offsets, counts, kind = [], [], None
    file.write(b"II*\0\0\0\0\0")
    for t in tiles:
        full = np.zeros((th, tw), t.dtype)
        full[: t.shape[0], : t.shape[1]] = t
        if full.dtype == bool:
            raw, kind = np.packbits(full, axis=1).tobytes(), (1, 1)
        else:
            full = full.astype("<f4") if full.dtype.kind == "f" else full.astype(full.dtype.newbyteorder("<"))
            raw, kind = full.tobytes(), (full.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[full.dtype.kind])
        raw = zlib.compress(raw) if deflate else raw
        offsets.append(file.tell())
        counts.append(len(raw))
        file.write(raw + b"\0" * (len(raw) % 2))
    text = description.encode("latin-1", "replace") + b"\0"
    fields = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [kind[0]]), (259, 3, [8 if deflate else 1]), (262, 3, [1]), (270, 2, text),
        (277, 3, [1]), (322, 4, [tw]), (323, 4, [th]), (324, 4, offsets), (325, 4, counts), (339, 3, [kind[1]]),
    ]
    at = file.tell()
    extra_at, entries, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, code, values in fields:
        raw = values if code == 2 else struct.pack(f"<{len(values)}{SIZES[code]}", *values)
        entries += struct.pack("<HHI", tag, code, len(values))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    file.write(struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra)
    file.seek(4)
    file.write(struct.pack("<I", at))
