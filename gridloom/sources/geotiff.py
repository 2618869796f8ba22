"""GeoTIFF images of elevation as a Spark data source: one partition per strip or tile.

    geotiff.pixels(spark, path)  ->  row, col, x, y, z

Only the header and the directory are read on the driver; a task reads the bytes of its strip or tile,
unpacks them and gives Arrow batches. Of several samples per pixel the first is the height. Paths are
local ones or URIs that pyarrow's file systems open.

Cases: nodata pixels and pixels that are not numbers have a null height; strips and tiles that reach
beyond the image are cut; those of no bytes are nodata; an image without a place on the map counts pixels
from its lower left corner; compressions, predictors and sample formats other than those below are errors.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tags of the format, sizes and codes of its field types, and its codes for compression.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
MODEL_TYPE, GEOGRAPHIC = 1024, 2


def opened(path: str) -> BinaryIO:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file:"), "rb")


@dataclass
class Part(InputPartition):
    """A strip or tile: where its bytes are, and which pixels they are."""

    offset: int
    size: int
    row: int
    col: int
    height: int  # as packed
    width: int


@dataclass
class Image:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default: Any = None) -> Any:
        found = self.tags.get(tag)
        return found[0] if found else default

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}.get(self.one(FORMAT, 1))
        bits = self.one(BITS, 1)
        if kind is None or bits % 8 or bits // 8 not in (1, 2, 4, 8) or (kind == "f" and bits < 32):
            raise ValueError(f"samples of format {self.one(FORMAT, 1)} with {bits} bits are not read")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def samples(self) -> int:
        """Samples of a pixel that lie side by side."""
        return 1 if self.one(PLANAR, 1) == 2 else self.one(SAMPLES, 1)

    @property
    def nodata(self) -> float | None:
        text = self.one(NODATA)
        return float(text.split(b"\0")[0]) if text else None

    @property
    def geographic(self) -> bool:
        """Whether places are degrees."""
        keys = self.tags.get(GEO_KEYS, ())
        return any(keys[k] == MODEL_TYPE and keys[k + 3] == GEOGRAPHIC for k in range(4, len(keys) - 3, 4))

    def affine(self) -> tuple[float, ...]:
        """a, b, c, d, e, f of x = a + b * column + c * row, y = d + e * column + f * row, of corners."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return m[3], m[0], m[1], m[7], m[4], m[5]
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[PIXEL_SCALE], self.tags[TIEPOINT]
            return x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy
        return 0.0, 1.0, 0.0, float(self.one(HEIGHT)), 0.0, -1.0

    def parts(self) -> list[Part]:
        width, height = self.one(WIDTH), self.one(HEIGHT)
        if TILES in self.tags:
            w, h, offsets, sizes = self.one(TILE_WIDTH), self.one(TILE_HEIGHT), self.tags[TILES], self.tags[TILE_BYTES]
        else:
            w, h, offsets, sizes = width, min(self.one(ROWS, height), height), self.tags[STRIPS], self.tags[STRIP_BYTES]
        across = -(-width // w)
        count = across * -(-height // h)  # of the first plane
        found = [Part(o, n, k // across * h, k % across * w, h, w) for k, (o, n) in enumerate(zip(offsets, sizes, strict=True)) if k < count]
        if TILES not in self.tags:
            for p in found:
                p.height = min(p.height, height - p.row)
        return found


def directory(f: BinaryIO) -> Image:
    """The first image of a file: classic or with 64-bit offsets."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else None
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    f.seek(at)
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))[0]
    step, inline = (20, 8) if big else (12, 4)
    rows, image = f.read(n * step), Image(order)
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", rows, k * step)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = count * struct.calcsize(f"{order}{code}")
        data = rows[k * step + step - inline : (k + 1) * step]
        if size > inline:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", data)[0])
            data = f.read(size)
        image.tags[tag] = struct.unpack_from(f"{order}{count}{code}", data)
    return image


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first, that get longer one code early; 256 begins a new
    table and 257 ends the data."""
    out: list[bytes] = []
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    start, width, before = len(table), 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[start:]
            width, before = 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and before:
            word = before + before[:1]
        else:
            raise ValueError("broken LZW data")
        if before:
            table.append(before + word[:1])
        out.append(word)
        before = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpacked(image: Image, part: Part, data: bytes) -> np.ndarray:
    """Heights (rows, columns) of a strip or tile, as packed: the first sample of each pixel."""
    how, kind, n = image.one(COMPRESSION, NONE), image.dtype, image.samples
    if how in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif how == LZW:
        data = lzw(data)
    elif how != NONE:
        raise ValueError(f"compression {how} is not read")
    shape = (part.height, part.width, n)
    predictor = image.one(PREDICTOR, 1)
    need = part.height * part.width * n * kind.itemsize
    if predictor == 3:  # bytes of a row by significance, each the difference from the one before
        rows = np.frombuffer(data, np.uint8, need).reshape(part.height, -1)
        size = part.width * n
        summed = rows.reshape(part.height, size * kind.itemsize // n, n).cumsum(1, dtype=np.uint8).reshape(part.height, kind.itemsize, size)
        return np.ascontiguousarray(summed.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(shape)[:, :, 0]
    pixels = np.frombuffer(data, kind, need // kind.itemsize).reshape(shape)
    if predictor == 2:
        whole = np.dtype(f"{image.order}u{kind.itemsize}")
        pixels = pixels.view(whole).cumsum(1, dtype=whole.newbyteorder("=")).astype(whole).view(kind)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not read")
    return pixels[:, :, 0]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        with opened(path) as f:
            self.image = directory(f)
        _ = self.image.dtype  # what can't be read is told at once

    def partitions(self) -> list[Part]:
        return self.image.parts()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        image, p = self.image, partition
        rows, cols = min(p.height, image.one(HEIGHT) - p.row), min(p.width, image.one(WIDTH) - p.col)
        z = np.full((rows, cols), np.nan)
        if p.size:
            with opened(self.path) as f:
                f.seek(p.offset)
                z = unpacked(image, p, f.read(p.size))[:rows, :cols].astype(np.float64)
        empty = np.isnan(z) if image.nodata is None else np.isnan(z) | (z == np.float64(image.dtype.type(image.nodata) if image.dtype.kind == "f" else image.nodata))
        a, b, c, d, e, f_ = image.affine()
        step = max(1, 65536 // max(cols, 1))
        for low in range(0, rows, step):
            high = min(rows, low + step)
            r, k = (v.ravel() for v in np.mgrid[p.row + low : p.row + high, p.col : p.col + cols])
            arrays = [pa.array(r, pa.int32()), pa.array(k, pa.int32()), pa.array(a + b * (k + 0.5) + c * (r + 0.5)), pa.array(d + e * (k + 0.5) + f_ * (r + 0.5)), pa.array(z[low:high].ravel(), mask=empty[low:high].ravel())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "col", "x", "y", "z"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, x double, y double, z double"

    def reader(self, schema: Any) -> DataSourceReader:
        return Reader(self.options["path"])


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from the upper left), x, y of the pixel's centre, and z."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").load(path)


def described(path: str) -> Image:
    """The directory of an image alone."""
    with opened(path) as f:
        return directory(f)


def from_bytes(data: bytes) -> Image:
    return directory(io.BytesIO(data))
