"""Images of elevation: every way of packing them, rescaling, and from a file to heights of cells."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.operators import elevation
from gridloom.plans import heights
from gridloom.sources import geotiff


def packed_lzw(data):
    """Codes as long as the table needs, a new table whenever it is full."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    put(256, 9)
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256, width)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        word = c
    if word:
        put(table[word], width)
        size += 1
    put(257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def image(z, *, order="<", compression=1, predictor=1, tile=None, rows=5, samples=1, big=False, more=()):
    """A file with heights z, as strips of some rows, or as tiles."""
    h, w = z.shape
    kind = z.dtype.newbyteorder(order)
    tall, wide = tile or (rows, w)
    parts = []
    for r in range(0, h, tall):
        for c in range(0, w, wide):
            block = z[r : r + tall, c : c + wide]
            if tile:
                block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1])))
            full = np.stack([block] + [block * 0 + 7] * (samples - 1), 2)
            if predictor == 2:
                full = np.concatenate([full[:, :1], full[:, 1:] - full[:, :-1]], 1)
            data = full.astype(kind).tobytes()
            if predictor == 3:
                b = np.frombuffer(full.astype(z.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(full.shape[0], -1, z.dtype.itemsize).transpose(0, 2, 1).reshape(full.shape[0], -1, samples)
                data = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1).tobytes()
            parts.append({1: lambda d: d, 5: packed_lzw, 8: zlib.compress}[compression](data))
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [z.dtype.itemsize * 8] * samples), (259, "H", [compression]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[z.dtype.kind]] * samples), *more]
    tags += [(322, "I", [wide]), (323, "I", [tall]), (324, "I", None), (325, "I", [len(p) for p in parts])] if tile else [(278, "I", [rows]), (273, "I", None), (279, "I", [len(p) for p in parts])]
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    tags.sort()
    head = 16 if big else 8
    entry, inline, word = (20, 8, "Q") if big else (12, 4, "I")
    at = head + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    extra = 0
    for _, code, v in tags:
        n = len(parts) if v is None else len(v)
        size = n * struct.calcsize("=" + code) if code != "s" else n
        extra += size if size > inline else 0
    offsets, place = [], at + extra
    for p in parts:
        offsets.append(place)
        place += len(p)
    out, tail = b"", b""
    for tag, code, v in tags:
        v = offsets if v is None else v
        data = bytes(v) if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        if len(data) > inline:
            here, tail = at + len(tail), tail + data
            data = struct.pack(f"{order}{word}", here)
        out += struct.pack(f"{order}HH{word}", tag, codes[code], len(v)) + data.ljust(inline, b"\0")
    first = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8))
    return first + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + out + struct.pack(f"{order}{word}", 0) + tail + b"".join(parts)


def hills(h, w, kind):
    r, c = np.mgrid[:h, :w]
    z = 300 + 40 * np.sin(r / 5) + 30 * np.cos(c / 7) + (r * 31 + c * 17) % 5
    return z.astype(kind)


WAYS = [
    ("float32", {}),
    ("float32", {"compression": 8, "predictor": 3, "order": ">"}),
    ("float64", {"compression": 5, "predictor": 3, "tile": (16, 16)}),
    ("int16", {"compression": 5, "predictor": 2, "samples": 2}),
    ("uint16", {"compression": 8, "predictor": 2, "tile": (16, 32), "order": ">"}),
    ("int32", {"big": True, "compression": 8}),
    ("uint8", {"rows": 64, "compression": 5}),
]


def test_unpacked():
    for kind, how in WAYS:
        z = hills(37, 45, kind)
        data = image(z, **how)
        own = geotiff.from_bytes(data)
        got = np.zeros(z.shape)
        for p in own.parts():
            block = geotiff.unpacked(own, p, data[p.offset : p.offset + p.size])
            got[p.row : p.row + p.height, p.col : p.col + p.width] = block[: 37 - p.row, : 45 - p.col]
        assert (got == z).all(), (kind, how)
    long = bytes(range(256)) * 90 + b"abc" * 9000
    assert geotiff.lzw(packed_lzw(long)) == long


def test_pixels(spark, tmp_path):
    z = hills(20, 33, "float32")
    z[3, 4], z[5, 6] = -9999, np.nan
    more = [(33550, "d", [2.0, 4.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0]), (42113, "s", b"-9999\0")]
    (tmp_path / "a.tif").write_bytes(image(z, compression=8, tile=(16, 16), more=more))
    df = geotiff.pixels(spark, str(tmp_path / "a.tif"))
    assert df.rdd.getNumPartitions() == 6
    got = {(r["row"], r["col"]): (r["x"], r["y"], r["z"]) for r in df.collect()}
    assert len(got) == z.size and got[3, 4][2] is got[5, 6][2] is None
    for (r, c), (x, y, h) in got.items():
        assert (x, y) == (1001.0 + 2 * c, 4998.0 - 4 * r) and (h is None or h == z[r, c])
    (tmp_path / "b.tif").write_bytes(b"not an image at all")
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff.described(str(tmp_path / "b.tif"))


def kernel(n, step):
    m = np.zeros((int(n / step), n))
    wide = max(step, 1.0)
    for t in range(len(m)):
        m[t] = np.maximum(0, 1 - np.abs(np.arange(n) + 0.5 - (t + 0.5) * step) / wide)
    return m


@pytest.mark.parametrize("step", [(2.6, 3.0), (0.7, 1.3)])
def test_rescaled(spark, step):
    z = hills(26, 30, "float64")
    rows = [(c, r, float(z[r, c])) for r in range(26) for c in range(30)]
    kx, ky = kernel(30, step[0]), kernel(26, step[1])
    want = (ky / ky.sum(1, keepdims=True)) @ z @ (kx / kx.sum(1, keepdims=True)).T
    got = {(r["x"], r["y"]): r["z"] for r in elevation.rescaled(spark.createDataFrame([*rows, (3, 3, None)], "x int, y int, z double"), *step).collect()}
    assert all(abs(got[c, r] - want[r, c]) < 1e-9 for r in range(want.shape[0]) for c in range(want.shape[1]))


def test_image_to_heights(spark, tmp_path):
    """A plane stays a plane, whatever the pixels' size; in degrees, too."""
    r, c = np.mgrid[:60, :50]
    x, y = 4000 + 4.0 * (c + 0.5), 9000 - 4.0 * (r + 0.5)
    more = [(33550, "d", [4.0, 4.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 4000.0, 9000.0, 0.0])]
    (tmp_path / "a.tif").write_bytes(image((x * 0.5 - y * 0.25).astype("float64"), compression=5, predictor=3, more=more))
    box = (4030.0, 8870.0, 4100.0, 8960.0)
    got = {(r["x"], r["y"]): r["z"] for r in heights.image_heights(spark, str(tmp_path / "a.tif"), box).collect()}
    assert set(got) == {(i, j) for i in range(9) for j in range(12)}
    assert all(abs(z - ((4034 + 8 * i) * 0.5 - (8874 + 8 * j) * 0.25)) < 1e-6 for (i, j), z in got.items())
    lon, lat = 9.0 + 0.0001 * (c + 0.5), 48.0 - 0.0001 * (r + 0.5)
    degrees = [(33550, "d", [0.0001, 0.0001, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 9.0, 48.0, 0.0]), (34735, "H", [1, 1, 0, 1, 1024, 0, 1, 2])]
    at = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon.ravel(), lat.ravel())], "x double, y double").select(g.to_utm(F.col("x"), F.col("y"), F.lit(32632)).alias("p")).select("p.x", "p.y").toPandas()
    z = (at["x"] * 0.5 - at["y"] * 0.25).to_numpy().reshape(lon.shape)
    (tmp_path / "b.tif").write_bytes(image(z, more=degrees))
    x0, y0 = math.floor(at["x"].min()) + 60.0, math.floor(at["y"].min()) + 100.0
    got = {(r["x"], r["y"]): r["z"] for r in heights.image_heights(spark, str(tmp_path / "b.tif"), (x0, y0, x0 + 100, y0 + 100)).collect()}
    assert all(abs(v - ((x0 + 4 + 8 * i) * 0.5 - (y0 + 4 + 8 * j) * 0.25)) < 1e-2 for (i, j), v in got.items()) and len(got) == 169


def test_projection_and_back(spark):
    """Under a millimetre, over all zones."""
    rows = [(float(lon), float(lat)) for lon in range(-179, 180, 7) for lat in range(-80, 85, 11)]
    own = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", g.utm_zone(F.col("lon"), F.col("lat")))
    got = own.withColumn("p", g.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))).withColumn("q", g.from_utm(F.col("p.x"), F.col("p.y"), F.col("zone"))).collect()
    assert max(max(abs(r["q"]["x"] - r["lon"]) * math.cos(math.radians(r["lat"])), abs(r["q"]["y"] - r["lat"])) * 111_320 for r in got) < 1e-3
