"""Heights between scattered points: linear within the triangles of their Delaunay triangulation.

Targets are dealt to square tiles of the plane. A task triangulates the points near the targets of one
tile, with the vertices of the hull of all points. Near are the nine buckets of the plane in and around a
target, which are so large that they hold some points; the others can't matter unless a circle says so, so
that work grows with the targets, however dense the points are. A triangle found so is one of the whole
triangulation where no point at all lies in its circle; what a circle reaches beyond what was given is
looked up by a join on buckets of the plane, and points found in it are given to the tile, which is
then triangulated again. Circles that find nothing new are certain, so rows don't depend on tiles.

Coordinates are rounded to QUANTUM and all tests are made with integers. Points get weights that are far
smaller than that, by a hash of their place, so that of several triangulations of points on one circle
(a regular grid has nothing else) always the same one is taken.

Cases: targets outside the hull and targets with null or non-finite places have a null height; points
with nulls or non-finite numbers are left out; of points at one place the least height counts; fewer than three points, or
points on one line, give nulls; targets may repeat; on the hull a height is that between the two points beside it there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import rounds

#: Map units that coordinates are rounded to.
QUANTUM = 1e-3
#: Beyond all points, as a multiple of a coordinate's largest size.
FAR = 1 << 60
LIFT = 1 << 24
#: Points that a bucket has if all are spread evenly, and that the nine around a target have at least.
LEAST = 16
Point = tuple[int, int]


def lifted(p: Point) -> int:
    """Height on the paraboloid, less a weight that is below QUANTUM squared by 1 / 16."""
    x, y = p
    mixed = (x * 0x9E3779B97F4A7C15 ^ (y * 0xC2B2AE3D27D4EB4F + (x >> 7))) & 0xFFFFFFFFFFFFFFFF
    mixed = (mixed ^ (mixed >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return (x * x + y * y) * LIFT - (mixed >> 44)


def left_of(a: Point, b: Point, c: Point) -> int:
    """Positive where c is left of the way from a to b."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


class Triangulation:
    """Delaunay triangles of points that are added one by one: those in whose circles a new point lies
    give way to triangles from it to their outline."""

    def __init__(self, size: int):
        far = FAR * max(size, 1)
        self.points: list[Point] = [(-3 * far, -2 * far), (3 * far, -2 * far), (0, 3 * far)]
        self.lift = [(x * x + y * y) * LIFT for x, y in self.points]
        self.triangles: dict[int, tuple[int, int, int]] = {0: (0, 1, 2)}  # counterclockwise
        self.beside: dict[tuple[int, int], int] = {(0, 1): 0, (1, 2): 0, (2, 0): 0}  # triangle left of a way
        self.last, self.made = 0, 1

    def locate(self, p: Point) -> int:
        """The triangle that a place lies in, walking from the last one."""
        t = self.last
        pts = self.points
        while True:
            a, b, c = self.triangles[t]
            for i, j in ((a, b), (b, c), (c, a)):
                if left_of(pts[i], pts[j], p) < 0:
                    t = self.beside[j, i]
                    break
            else:
                self.last = t
                return t

    def within(self, t: int, p: Point, h: int) -> bool:
        """Whether a point lies in the circle of a triangle."""
        rows = []
        for i in self.triangles[t]:
            x, y = self.points[i]
            rows.append((x - p[0], y - p[1], self.lift[i] - h))
        (ax, ay, al), (bx, by, bl), (cx, cy, cl) = rows
        # lifts are relative to the point's own tangent plane
        px, py = 2 * p[0] * LIFT, 2 * p[1] * LIFT
        al, bl, cl = al - px * ax - py * ay, bl - px * bx - py * by, cl - px * cx - py * cy
        return al * (bx * cy - by * cx) - bl * (ax * cy - ay * cx) + cl * (ax * by - ay * bx) > 0

    def add(self, p: Point) -> None:
        h = lifted(p)
        bad, todo = set(), [self.locate(p)]
        while todo:
            t = todo.pop()
            if t in bad or not self.within(t, p, h):
                continue
            bad.add(t)
            a, b, c = self.triangles[t]
            todo += [self.beside[w] for w in ((b, a), (c, b), (a, c)) if w in self.beside]
        if not bad:
            return
        k = len(self.points)
        self.points.append(p)
        self.lift.append(h)
        outline = []
        for t in bad:
            a, b, c = self.triangles[t]
            outline += [w for w in ((a, b), (b, c), (c, a)) if self.beside.get((w[1], w[0])) not in bad]
        for t in bad:
            a, b, c = self.triangles.pop(t)
            for w in ((a, b), (b, c), (c, a)):
                del self.beside[w]
        for a, b in outline:
            self.triangles[self.made] = (a, b, k)
            self.beside[a, b] = self.beside[b, k] = self.beside[k, a] = self.made
            self.last = self.made
            self.made += 1


def circle(a: Point, b: Point, c: Point) -> tuple[float, float, float]:
    """Centre and radius."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, math.hypot(ux, uy)


def hull(points: Iterable[Point]) -> list[Point]:
    """Vertices of the convex hull."""
    own = sorted(set(points))
    if len(own) < 3:
        return own
    out: list[Point] = []
    for way in (own, own[::-1]):
        side: list[Point] = []
        for p in way:
            while len(side) > 1 and left_of(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        out += side[:-1]
    return out


def heights(points: dict[Point, float], targets: list[Point], size: int) -> tuple[list[float | None], dict[tuple[Point, ...], Point]]:
    """The height of each target; the triangles and edges of the hull used, with a target in each."""
    net = Triangulation(size)
    band = max(1, math.isqrt(max(len(points), 1)))
    xs = sorted(p[0] for p in points)
    strip = max(1, (xs[-1] - xs[0]) // band + 1) if xs else 1

    def along(p: Point) -> tuple[int, int]:
        k = p[0] // strip
        return k, p[1] if k % 2 == 0 else -p[1]

    for p in sorted(points, key=along):
        net.add(p)
    found: dict[Point, float | None] = {}
    used: dict[tuple[Point, ...], Point] = {}
    for t in sorted(set(targets), key=along):
        corners = net.triangles[net.locate(t)]
        found[t] = None
        if min(corners) > 2:
            a, b, c = (net.points[i] for i in corners)
            used.setdefault((a, b, c), t)
            u, v, w = left_of(b, c, t), left_of(c, a, t), left_of(a, b, t)
            found[t] = (u * points[a] + v * points[b] + w * points[c]) / (u + v + w)
        else:  # on the hull, or beyond it
            real = [net.points[i] for i in corners if i > 2]
            if len(real) == 2 and left_of(*real, t) == 0:
                a, b = real
                used.setdefault((a, b), t)
                k = 0 if abs(a[0] - b[0]) >= abs(a[1] - b[1]) else 1
                found[t] = points[a] + (points[b] - points[a]) * (t[k] - a[k]) / (b[k] - a[k])
    return [found[t] for t in targets], used


# ---- tiles ----


def whole(c: str) -> Column:
    return F.round(F.col(c) / QUANTUM).cast("bigint")


def number(x: Column, y: Column, tile: int) -> Column:
    return F.floor(x / tile) * (1 << 32) + F.floor(y / tile)


def hull_of(points: DataFrame) -> list[Point]:
    """Hulls of parts, then of their vertices: what is collected are vertices of hulls of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Point] = []
        for b in batches:
            own = hull([*own, *zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in own], pa.int64()) for k in (0, 1)], ["x", "y"])

    parts = points.select("x", "y").mapInArrow(run, "x bigint, y bigint")
    return hull([(r["x"], r["y"]) for r in parts.coalesce(1).mapInArrow(run, "x bigint, y bigint").collect()])


def on_rim(points: DataFrame, corners: list[Point]) -> DataFrame:
    """Those of points that lie on edges of the hull with these vertices, counterclockwise."""
    edges = list(zip(corners, corners[1:] + corners[:1], strict=True)) if len(corners) > 2 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b[c].to_numpy().astype(float) for c in "xy")
            keep = np.zeros(len(x), bool)
            for p, q in edges:
                dx, dy = float(q[0] - p[0]), float(q[1] - p[1])
                off = dx * (y - p[1]) - dy * (x - p[0])
                near = np.flatnonzero(np.abs(off) <= 1e-9 * (dx * dx + dy * dy) + abs(dx) + abs(dy))
                for i, at in zip(near.tolist(), zip(b["x"].take(near).to_pylist(), b["y"].take(near).to_pylist(), strict=True), strict=True):
                    keep[i] |= left_of(p, q, at) == 0
            yield b.filter(pa.array(keep))

    return points.mapInArrow(run, points.schema)


def surroundings(places: DataFrame, points: DataFrame, box: Any, side: int, around: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """places (x, y, tile) with grain, the edge of the buckets around them; tile, x, y, z: the points in
    the nine buckets around each place, as far as around its tile. Buckets grow until they hold enough."""
    grain, extent = side, 0
    if box["lowx"] is not None:
        wide, high = (box[f"high{c}"] - box[f"low{c}"] + 1 for c in "xy")
        grain, extent = max(1, math.isqrt(wide * high * LEAST // box["n"])), max(wide, high)

    def at(c: str, grain: int, name: str) -> Column:
        return F.floor(F.col(c) / grain).alias(name)

    def nine(df: DataFrame, *keep: str) -> DataFrame:
        x = df.select(*keep, F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("bx"), "cy")
        return x.select(*keep, "bx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("by"))

    found: list[tuple[DataFrame, DataFrame]] = []
    left = places
    while True:
        inside = [F.floor(F.greatest(F.least(F.col(c), F.lit(box[f"high{c}"])), F.lit(box[f"low{c}"])) / grain).alias(f"c{c}") for c in "xy"]
        here = left.select("x", "y", "tile", *inside)
        n = len(found)
        if grain < extent:
            centres = here.select("cx", "cy").distinct()
            counted = points.groupBy(at("x", grain, "bx"), at("y", grain, "by")).agg(F.count("*").alias("n"))
            around_it = nine(centres.withColumns({"ox": F.col("cx"), "oy": F.col("cy")}), "ox", "oy").join(counted, ["bx", "by"])
            enough = around_it.groupBy(F.col("ox").alias("cx"), F.col("oy").alias("cy")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
            here = rounds.written(here.join(enough.drop("n").withColumn("enough", F.lit(True)), ["cx", "cy"], "left"), f"{folder}/near-{n}")
            left = here.where("enough is null").select(*left.columns)
            here = here.where("enough")
        own = nine(here.select("tile", at("x", side, "tx"), at("y", side, "ty"), "cx", "cy").distinct(), "tile", "tx", "ty").distinct()
        near = points.withColumns({"bx": at("x", grain, "bx"), "by": at("y", grain, "by")}).join(own, ["bx", "by"])
        for c in "xy":
            near = near.where((F.col(c) >= F.col(f"t{c}") * side - around) & (F.col(c) < (F.col(f"t{c}") + 1) * side + around))
        found.append((here.select("x", "y", "tile", F.lit(grain).cast("bigint").alias("grain")), near.select("tile", "x", "y", "z")))
        if grain >= extent or left.isEmpty():
            break
        grain *= 4
    both = [reduce(DataFrame.union, dfs) for dfs in zip(*found, strict=True)]
    return both[0], rounds.written(both[1], f"{folder}/near")


ROW = "tile bigint, place array<bigint>, z double, circles array<struct<x:double,y:double,r:double>>"
CIRCLES = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("r", pa.float64())]))


def interpolated(points: DataFrame, targets: DataFrame, tile: float, halo: float) -> DataFrame:
    """targets (x, y and others) with z, from points (x, y, z). tile: map units along the edge of what one
    task triangulates; halo: map units around it that it reads at first, at most. Rounds are written to the shared
    folder, which the result reads."""
    spark = points.sparkSession
    folder = rounds.new_folder(spark, "scattered")
    side, around = max(1, round(tile / QUANTUM)), max(0, round(halo / QUANTUM))

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)

    own = points.where(finite("x") & finite("y") & finite("z")).select(whole("x").alias("x"), whole("y").alias("y"), "z")
    own = rounds.written(own.groupBy("x", "y").agg(F.min("z").cast("double").alias("z")), f"{folder}/points")
    box = own.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).first()
    places = targets.where(finite("x") & finite("y")).select(whole("x").alias("x"), whole("y").alias("y")).distinct()
    places = rounds.written(places.withColumn("tile", number(F.col("x"), F.col("y"), side)), f"{folder}/targets")
    rim = spark.createDataFrame(hull_of(own), "x bigint, y bigint").join(own, ["x", "y"]).select("x", "y", "z")
    corners = {(r["x"], r["y"]): r["z"] for r in rim.collect()}  # vertices of the hull, for every tile
    rim_points = rounds.written(on_rim(own, hull(corners)), f"{folder}/rim")
    inner = own.join(rim.select("x", "y"), ["x", "y"], "left_anti")
    size = max((abs(box[f"{n}{c}"] or 0) for n in ("low", "high") for c in "xy"), default=1) + 1
    places, dealt = surroundings(places, own, box, side, around, folder)

    def run(want: pa.Table, given: pa.Table) -> pa.Table:
        here = corners | dict(zip(zip(given["x"].to_pylist(), given["y"].to_pylist(), strict=True), given["z"].to_pylist(), strict=True))
        at = list(zip(want["x"].to_pylist(), want["y"].to_pylist(), strict=True))
        z, used = heights(here, at, size)
        n = want["tile"][0].as_py() if at else 0
        x0, y0 = (at[0][0] // side * side, at[0][1] // side * side) if at else (0, 0)
        circles = []
        grains = dict(zip(at, want["grain"].to_pylist(), strict=True))
        for t, (tx, ty) in used.items():
            if len(t) == 2:  # an edge of the hull: other points between its ends
                (ax, ay), (bx, by) = t
                circles.append({"x": (ax + bx) / 2, "y": (ay + by) / 2, "r": -(math.hypot(bx - ax, by - ay) / 2 * (1 + 1e-9) + 1)})
                continue
            x, y, r = circle(*t)
            r = r * (1 + 1e-9) + 1
            grain = grains[tx, ty]
            low, high = [[max(k // grain * grain - grain, o - around) for k, o in ((tx, x0), (ty, y0))], [min(k // grain * grain + 2 * grain, o + side + around) for k, o in ((tx, x0), (ty, y0))]]
            if x - r < low[0] or x + r >= high[0] or y - r < low[1] or y + r >= high[1]:
                circles.append({"x": x, "y": y, "r": r})
        per = [circles if i == 0 else [] for i in range(len(at))]
        return pa.table({"tile": pa.array([n] * len(at), pa.int64()), "place": pa.array([list(a) for a in at], pa.list_(pa.int64())), "z": pa.array(z, pa.float64()), "circles": pa.array(per, CIRCLES)})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grain = places.agg(F.min("grain")).first()[0] or side
    todo, more, found, n = places, spark.createDataFrame([], "tile bigint, x bigint, y bigint, z double"), None, 0
    while True:
        tiles = todo.select("tile").distinct()
        given = dealt.union(more).join(tiles, "tile", "left_semi").select(F.expr("tile + 0").alias("tile"), "x", "y", "z")
        after = todo.repartition(parts, "tile").groupBy("tile").cogroup(given.repartition(parts, "tile").groupBy("tile")).applyInArrow(run, ROW)
        after = rounds.written(after.where("place is not null"), f"{folder}/round-{n}")
        new = rounds.written(missed(after, inner, rim_points, given, side, box, grain), f"{folder}/new-{n}")
        redo = new.select("tile").distinct()
        sure = after.join(redo, "tile", "left_anti").select(F.get("place", F.lit(0)).alias("__x"), F.get("place", F.lit(1)).alias("__y"), "z")
        found = sure if found is None else found.union(sure)
        n += 1
        if new.isEmpty():
            break
        todo = todo.join(redo, "tile", "left_semi")
        more = more.union(new)
    keyed = targets.withColumns({"__tx": F.when(finite("x"), whole("x")), "__ty": F.when(finite("y"), whole("y"))})
    return keyed.join(found, (F.col("__tx") == F.col("__x")) & (F.col("__ty") == F.col("__y")), "left").drop("__tx", "__ty", "__x", "__y")


def missed(after: DataFrame, points: DataFrame, rim: DataFrame, given: DataFrame, side: int, box: Any, grain: int) -> DataFrame:
    """tile, x, y, z: points in circles of a tile's triangles that the tile was not given, and points of the
    rim in circles over edges of the hull (r is negative). Small circles are looked up by small buckets
    (grain), the others by large ones (side)."""
    if box["lowx"] is None:
        return after.select("tile", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0.0).alias("z")).limit(0)
    circles = after.select("tile", F.inline("circles")).withColumnsRenamed({"x": "cx", "y": "cy"})
    parts = [(F.col("r").between(0, 4 * grain), points, grain), (F.col("r") > 4 * grain, points, side), (F.col("r") < 0, rim, side)]
    inside = reduce(DataFrame.union, [within(circles.where(of).withColumn("r", F.abs("r")), own, edge, box) for of, own, edge in parts]).distinct()
    return inside.join(given.select("tile", "x", "y"), ["tile", "x", "y"], "left_anti")


def within(circles: DataFrame, points: DataFrame, side: int, box: Any) -> DataFrame:
    """tile, x, y, z: points in circles (tile, cx, cy, r), by buckets."""

    def span(c: str) -> Column:
        least, most = F.greatest(F.col(f"c{c}") - F.col("r"), F.lit(float(box[f"low{c}"]))), F.least(F.col(f"c{c}") + F.col("r"), F.lit(float(box[f"high{c}"])))
        ends = F.floor(least / side), F.floor(most / side)
        return F.when(ends[0] <= ends[1], F.sequence(*ends)).otherwise(F.array().cast("array<bigint>"))

    reach = circles.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))
    near = [F.col(f"c{c}") - F.greatest(F.least(F.col(f"c{c}"), (F.col(f"b{c}") + 1) * side), F.col(f"b{c}") * side) for c in "xy"]
    reach = reach.where(near[0] * near[0] + near[1] * near[1] <= F.col("r") * F.col("r"))  # buckets that a circle touches
    own = points.select(F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"), "x", "y", "z")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return reach.join(own, ["bx", "by"]).where(dx * dx + dy * dy <= F.col("r") * F.col("r")).select("tile", "x", "y", "z")
