"""Buildings on their outlines: packed with tiles of a catalogue, one after the other in a given order.

Two kinds of fine cells, quarters and diamonds, lie over the map, and each outline is packed with those
of either kind that are free. Both are made of the same triangles, halves of a quarter cell, so cells
overlap exactly where they share a triangle, and what is taken is a table of triangles.

A building may depend on those before it, whose cells are then taken. Buildings are dealt by tiles of
the map and settled in rounds: within a tile in order, as long as none that comes before and reaches for
the same triangles is still open, be it of this tile or another. The first of all open buildings can
always be settled, and chains of neighbours within a tile need one round only, so the rounds are as many
as the borders of tiles that such a chain crosses; and each round has other borders and, as few are left, larger
tiles. The result is that of going through all of them in order.

Cases: outlines without an area, off the map, with a null ring or a corner that isn't finite, or on which nothing fits or nothing is
free get no rows; orders may repeat, then the smaller building comes first; buildings must be unique, and
place and priority must be set; an empty catalogue or no outlines give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions import labels, planning
from gridloom.operators import catalogues, grid, packing, rounds
from gridloom.plans.model import CELL, DIAMOND_AREA, QUARTER_AREA

#: A cell takes part if more than this share of it is covered.
SHARES = (0.0, 0.5)
#: Less than this share of a cell is rounding.
NOTHING = 1e-9
#: Corners of rings in candidate cells that are compared at once, and outlines.
POINTS, ROWS = 1 << 19, 1000
#: Quarter cells along the edge of a block of the map; by how much of a tile each round's tiles are shifted.
BLOCK, SHIFT = 16, 0.618
#: So few outlines may share one tile.
FEW = 10_000
PLACED = "array<struct<diagonal:boolean,rows:int,cols:int,qx:int,qy:int>>"
STATE = "building bigint, place bigint, priority int, tile bigint, ring array<struct<x:double,y:double>>, cells array<struct<diagonal:boolean,qx:int,qy:int,area:double>>"


class Sizes(NamedTuple):
    """Of one orientation: tiles (rows, cols), and the area of the largest."""

    tiles: tuple[tuple[int, int], ...]
    largest: float


def triangles(diagonal: Column, qx: Column, qy: Column) -> Column:
    """The triangles (ax, ay) of a fine cell: two of a quarter cell, four of a diamond. The first
    half of a quarter cell belongs to the diamond beside it, the second to the one above or below."""

    def at(x: Column, half: Column, y: Column) -> Column:
        return F.struct((x * 2 + half).cast("int").alias("ax"), y.cast("int").alias("ay"))

    half = F.when(F.pmod(qx, F.lit(4)) == 0, F.lit(1)).otherwise(F.lit(0))
    quarter = F.array(at(qx, F.lit(0), qy), at(qx, F.lit(1), qy))
    return F.when(diagonal, F.array(*[at(qx + a, half, qy + b) for a in (-1, 1) for b in (-1, 1)])).otherwise(quarter)


def triangles_of(diagonal: bool, qx: int, qy: int) -> list[tuple[int, int]]:
    """The same for one cell."""
    if not diagonal:
        return [(2 * qx, qy), (2 * qx + 1, qy)]
    half = int(qx % 4 == 0)
    return [(2 * (qx + a) + half, qy + b) for a in (-1, 1) for b in (-1, 1)]


def taken_squares(cells: DataFrame) -> DataFrame:
    """ax, ay, priority: triangles of whole cells (xidx, yidx, priority) that are taken."""
    x, y = F.col("xidx").cast("int") * 4, F.col("yidx").cast("int") * 4
    four = F.flatten(F.array(*[triangles(F.lit(False), x + a, y + b) for a, b in grid.QUARTERS]))
    return cells.select("priority", F.explode(four).alias("t")).select("t.ax", "t.ay", "priority")


def taken_by(placed: DataFrame) -> DataFrame:
    """ax, ay, priority: triangles that placements (diagonal, rows, cols, qx, qy, priority) take."""
    each = placed.select("priority", "diagonal", "qx", "qy", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "cols")
    each = each.select("priority", "diagonal", "qx", "qy", "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    r, c = F.col("r"), F.col("c")
    x = F.col("qx") + F.when(F.col("diagonal"), 2 * (r + c)).otherwise(2 * c)
    y = F.col("qy") + F.when(F.col("diagonal"), 2 * (r - c)).otherwise(2 * r)
    return each.select("priority", F.explode(triangles(F.col("diagonal"), x, y)).alias("t")).select("t.ax", "t.ay", "priority")


def parts(elements: DataFrame, rings: str, place: str) -> DataFrame:
    """elements with one row per outline of theirs: place, building (a number of its own) and ring. place
    is a whole number of each element. What has fewer than three corners is no outline."""
    own = elements.select("*", F.posexplode(rings).alias("__part", "ring")).where(F.size("ring") > 2)
    return own.withColumns({"place": F.col(place).cast("long"), "building": F.col(place).cast("long") * (1 << 20) + F.col("__part")}).drop("__part")


def clipped_areas(x: np.ndarray, y: np.ndarray, planes: list[tuple[float, float, np.ndarray]]) -> np.ndarray:
    """Areas of rings, one in each row of x and y, cut by half-planes a * x + b * y + c >= 0, with a c for
    each ring: the steps of geometry.clipped_area() in their order, so the same numbers."""
    sizes, one = np.full(len(x), x.shape[1]), np.arange(len(x))
    for a, b, c in planes:
        at = np.arange(x.shape[1])
        real, after = at < sizes[:, None], np.where(at + 1 < sizes[:, None], at + 1, 0)
        s = a * x + b * y + c[:, None]
        t = np.take_along_axis(s, after, 1)
        keeps, meets = real & (t >= 0), real & ((s >= 0) != (t >= 0))
        end = np.cumsum(keeps.astype(np.int64) + meets, axis=1)
        sizes = end[:, -1]
        cut = [np.zeros((len(x), max(int(sizes.max(initial=0)), 1))) for _ in range(2)]
        i, j = np.nonzero(meets)
        share = s[i, j] / (s[i, j] - t[i, j])
        k, m = np.nonzero(keeps)
        for p, out in zip((x, y), cut, strict=True):
            out[i, end[i, j] - 1 - keeps[i, j]] = p[i, j] + (p[i, after[i, j]] - p[i, j]) * share
            out[k, end[k, m] - 1] = p[k, after[k, m]]
        x, y = cut
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        n = np.where(j + 1 < sizes, j + 1, 0)
        total += np.where(j < sizes, x[:, j] * y[one, n] - x[one, n] * y[:, j], 0.0)
    return np.abs(total / 2)


def fine_areas(diagonal: bool, qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each ring its area within a fine cell; sides of upright boxes are multiplied, as by grid.fill_fine()."""
    cx, cy = (qx / 4 + 0.5) * CELL, (qy / 4 + 0.5) * CELL
    if diagonal:
        return clipped_areas(x, y, [(-a, -b, a * cx + b * cy + CELL / 2) for a in (1.0, -1.0) for b in (1.0, -1.0)])
    x0, y0, x1, y1 = cx - CELL / 4, cy - CELL / 4, cx + CELL / 4, cy + CELL / 4
    box = np.zeros(len(x), bool)
    if x.shape[1] == 4:
        for v, w in ((x, y), (y, x)):
            box |= (v[:, 0] == v[:, 1]) & (w[:, 1] == w[:, 2]) & (v[:, 2] == v[:, 3]) & (w[:, 3] == w[:, 0])
    wide = np.minimum(x.max(1), x1) - np.maximum(x.min(1), x0)
    high = np.minimum(y.max(1), y1) - np.maximum(y.min(1), y0)
    out, cut = np.maximum(wide, 0.0) * np.maximum(high, 0.0), ~box
    planes = [(1.0, 0.0, -x0[cut]), (-1.0, 0.0, x1[cut]), (0.0, 1.0, -y0[cut]), (0.0, -1.0, y1[cut])]
    out[cut] = clipped_areas(x[cut], y[cut], planes)
    return out


def fine_cells(x: np.ndarray, y: np.ndarray, size: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rings with equally many corners, one in each row: ring, diagonal, qx, qy, area of all fine cells of
    an nx by ny map that they cover in part, from POINTS corners of rings in candidate cells at a time."""
    for diagonal, offsets, margin in ((False, grid.QUARTERS, 3), (True, [o for o in grid.DIAMONDS if min(o) >= 0], 2)):
        pad = CELL if diagonal else 0.0
        low, wide = [], []
        for v, n in ((x, size[0]), (y, size[1])):
            # no farther off the map than a fine cell may lie
            ends = [np.clip(np.floor(e / CELL), -2, n + 1).astype(np.int64) for e in (v.min(1) - pad, v.max(1) + pad)]
            low.append(ends[0])
            wide.append(ends[1] - ends[0] + 1)
        stop = np.cumsum(wide[0] * wide[1] * len(offsets))
        every, step = int(stop[-1]) if len(stop) else 0, max(1, POINTS // x.shape[1])
        a, b = (np.array([o[k] for o in offsets]) for k in range(2))
        for begin in range(0, every, step):
            at = np.arange(begin, min(begin + step, every))
            ring = np.searchsorted(stop, at, "right")
            at = at - (stop[ring] - wide[0][ring] * wide[1][ring] * len(offsets))
            cell, o = np.divmod(at, len(offsets))
            right, up = np.divmod(cell, wide[1][ring])
            qx, qy = (low[0][ring] + right) * 4 + a[o], (low[1][ring] + up) * 4 + b[o]
            inside = (qx >= -2) & (qx <= 4 * size[0] - margin) & (qy >= -2) & (qy <= 4 * size[1] - margin)
            ring, qx, qy = ring[inside], qx[inside], qy[inside]
            area = fine_areas(diagonal, qx, qy, x[ring], y[ring])
            some = area > NOTHING * (DIAMOND_AREA if diagonal else QUARTER_AREA)
            yield ring[some], np.full(int(some.sum()), diagonal), qx[some], qy[some], area[some]


def reached(outlines: DataFrame, size: tuple[int, int]) -> DataFrame:
    """outlines (building, place, priority, ring) with cells, all fine cells of an nx by ny map that each
    covers in part, in order; those that cover none go. Dealt by building: much work on few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                b = whole.slice(begin, ROWS)
                rings = b.column("ring")
                count, flat = rings.value_lengths().to_numpy(), rings.flatten()
                x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                start, found = np.cumsum(count) - count, []
                for n in np.unique(count).tolist():
                    rows = np.flatnonzero(count == n)
                    corner = start[rows, None] + np.arange(n)
                    rows, corner = (v[(np.isfinite(x[corner]) & np.isfinite(y[corner])).all(1)] for v in (rows, corner))
                    found += [(rows[ring], *cells) for ring, *cells in fine_cells(x[corner], y[corner], size)]
                if not found:
                    continue
                row, diagonal, qx, qy, area = (np.concatenate(v) for v in zip(*found, strict=True))
                order = np.lexsort((qy, qx, diagonal, row))
                cells = pa.StructArray.from_arrays([pa.array(diagonal[order]), pa.array(qx[order], pa.int32()), pa.array(qy[order], pa.int32()), pa.array(area[order])], ["diagonal", "qx", "qy", "area"])
                own, sizes = np.unique(row, return_counts=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), cells)
                kept = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*b.schema.names, "cells"])

    parts = int(outlines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = outlines.select("building", "place", "priority", "ring").repartition(parts, "building")
    return own.mapInArrow(run, STATE.replace("tile bigint, ", ""))


def own_direction(ring: list[tuple[float, float]]) -> bool | None:
    """Whether the least rectangle around a ring lies diagonally; null if it has no area."""
    a, b, c, _ = planning.lower_left_first(planning.minimum_rectangle(ring))
    if math.dist(a, b) * math.dist(b, c) <= 1e-9:
        return None
    off = math.atan2(b[1] - a[1], b[0] - a[0]) % (math.pi / 2)
    return min(off, math.pi / 2 - off) >= math.pi / 8


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def best_packing(ring: list[tuple[float, float]], cells: list[tuple[bool, int, int, float]], sizes: dict[bool, Sizes], modular: bool) -> list[tuple[bool, int, int, int, int]]:
    """Placements (diagonal, rows, cols, qx, qy, of the lower left cell) of the packing in the outline's
    own direction, then that whose cells agree best with the outline; none if nothing fits. Of equals
    the first counts, cells in part before cells in half. Several tiles only where one
    is too small, and the catalogue has modular buildings."""
    own, area = own_direction(ring), ring_area(ring)
    best: tuple[tuple[bool, float], list[tuple[bool, int, int, int, int]]] | None = None
    if own is None or area == 0:
        return []
    for diagonal in (True, False):
        unit = DIAMOND_AREA if diagonal else QUARTER_AREA
        if diagonal not in sizes:
            continue
        tiles, largest = sizes[diagonal]
        for share in SHARES:
            # diamonds are turned by 45 degrees, so that rows and columns run along their sides
            use = {((x + y - 2) // 4, (x - y - 2) // 4) if diagonal else ((y + 1) // 2, (x + 1) // 2): a for d, x, y, a in cells if d == diagonal and a > share * unit}
            if not use:
                continue
            low, left = min(r for r, _ in use), min(c for _, c in use)
            matrix = np.zeros((max(r for r, _ in use) - low + 1, max(c for _, c in use) - left + 1), bool)
            for r, c in use:
                matrix[r - low, c - left] = True
            found = packing.packed_shape(matrix.shape, matrix.tobytes(), tiles, modular and area > largest).placed
            if not found:
                continue
            covered = [(r + low + i, c + left + j) for r, c, h, w in found for i in range(h) for j in range(w)]
            shared = sum(use[k] for k in covered)
            key = (diagonal != own, -shared / (len(covered) * unit + area - shared))
            if best is None or key < best[0]:
                corners = [(r + low, c + left, h, w) for r, c, h, w in found]
                best = key, [(diagonal, h, w, 2 * (r + c) + 2, 2 * (r - c)) if diagonal else (diagonal, h, w, 2 * c - 1, 2 * r - 1) for r, c, h, w in corners]
    return best[1] if best else []


def settle(rows: Iterator[dict[str, Any]], sizes: dict[bool, Sizes], modular: bool) -> Iterator[tuple[bool, list[tuple[bool, int, int, int, int]]]]:
    """Whether each row is settled, and its placements. Rows come by tile and in order; what is kept are
    the triangles that this tile's buildings have taken, and that its open ones may still take."""
    tile, taken, held = None, set(), set()
    for r in rows:
        if r["tile"] != tile:
            tile, taken, held = r["tile"], set(), set()
        cells = [(c["diagonal"], c["qx"], c["qy"], c["area"]) for c in r["cells"]]
        free = [c for c in cells if taken.isdisjoint(triangles_of(*c[:3]))]
        reach = {t for c in free for t in triangles_of(*c[:3])}
        if free and (r["waits"] or not held.isdisjoint(reach)):
            held |= reach
            yield False, []
            continue
        if not free:
            yield True, []
            continue
        found = best_packing([(p["x"], p["y"]) for p in r["ring"]], free, sizes, modular)
        for diagonal, h, w, qx, qy in found:
            for i in range(h):
                for j in range(w):
                    taken.update(triangles_of(diagonal, qx + 2 * (i + j if diagonal else j), qy + 2 * (i - j if diagonal else i)))
        yield True, found


def span(cells: str, q: str) -> tuple[Column, Column]:
    """The least and the greatest index along an axis of the fine cells in an array."""
    every = F.transform(cells, lambda c: c[q])
    return F.array_min(every), F.array_max(every)


def tiled(left: DataFrame, side: int, shift: int) -> DataFrame:
    """left with the tile that its first cells lie in: side by side map cells, shifted by quarter cells."""
    at = [F.floor((span("cells", q)[0] + shift) / (4 * side)).cast("long") for q in ("qx", "qy")]
    return left.withColumn("tile", at[0] * (1 << 32) + at[1])


def bordering(left: DataFrame) -> DataFrame:
    """Those whose bounds share a block of the map with any of another tile; no others reach for a triangle
    that another tile reaches for."""
    blocks = left.select("tile", "building", *[span("cells", q)[k].alias(f"{q}{k}") for q in ("qx", "qy") for k in (0, 1)])
    for q in ("qx", "qy"):  # the triangles of a cell lie within one index around it
        blocks = blocks.withColumn(q, F.explode(F.sequence(F.floor((F.col(f"{q}0") - 1) / BLOCK), F.floor((F.col(f"{q}1") + 1) / BLOCK))))
    shared = blocks.groupBy("qx", "qy").agg(F.min("tile").alias("a"), F.max("tile").alias("b")).where("a <> b")
    near = blocks.join(shared, ["qx", "qy"], "left_semi").select("building").distinct()
    return left.join(near, "building", "left_semi")


def one_round(left: DataFrame, sizes: dict[bool, Sizes], modular: bool) -> DataFrame:
    """left, with settled and placements."""
    each = bordering(left).select("tile", F.struct("priority", "place", "building").alias("turn"), F.explode("cells").alias("c"))
    claims = each.select("tile", "turn", F.explode(triangles(F.col("c.diagonal"), F.col("c.qx"), F.col("c.qy"))).alias("t")).select("tile", "turn", "t.ax", "t.ay")
    waiting = rounds.waiting(claims, "ax", "ay").select("turn.building").withColumn("waits", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def rows() -> Iterator[dict[str, Any]]:
            for b in batches:
                if b.num_rows:
                    kept.append(b)
                    yield from b.to_pylist()

        out: list[tuple[bool, list]] = []
        kind = pa.list_(pa.struct([("diagonal", pa.bool_()), *[(n, pa.int32()) for n in ("rows", "cols", "qx", "qy")]]))
        for one in settle(rows(), sizes, modular):
            out.append(one)
            if len(out) == kept[0].num_rows:
                b = kept.pop(0)
                placed = [[dict(zip(("diagonal", "rows", "cols", "qx", "qy"), p, strict=True)) for p in ps] for _, ps in out]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s for s, _ in out]), pa.array(placed, kind)], [*b.schema.names[:-1], "settled", "placed"])
                out = []

    flagged = left.join(waiting, "building", "left").select(*left.columns, F.coalesce("waits", F.lit(False)).alias("waits"))
    return rounds.spread(flagged, "priority", "place", "building").mapInArrow(run, f"{STATE}, settled boolean, placed {PLACED}")


def less_taken(left: DataFrame, taken: DataFrame) -> DataFrame:
    """left without the cells that have a triangle in taken (ax, ay, priority) of the same priority or
    one before."""
    each = left.select("building", F.col("priority").alias("own"), F.explode("cells").alias("c"))
    claims = each.select("building", "own", F.explode(triangles(F.col("c.diagonal"), F.col("c.qx"), F.col("c.qy"))).alias("t")).select("building", "own", "t", "t.ax", "t.ay")
    first = taken.groupBy("ax", "ay").agg(F.min("priority").alias("first"))
    lost = claims.join(first, ["ax", "ay"]).where("first <= own").groupBy("building").agg(F.collect_set("t").alias("lost"))
    both = left.join(lost, "building", "left")
    free = F.filter("cells", lambda c: ~F.arrays_overlap(triangles(c["diagonal"], c["qx"], c["qy"]), F.col("lost")))
    return both.withColumn("cells", F.when(F.col("lost").isNull(), F.col("cells")).otherwise(free)).select(*left.columns).where(F.size("cells") > 0)


def placed(outlines: DataFrame, catalogue: DataFrame, size: tuple[int, int], taken: DataFrame | None = None) -> DataFrame:
    """building, priority, diagonal, rows, cols, qx, qy: what is placed on the outlines (building, place,
    priority, ring) of an nx by ny map, in order of priority and place. catalogue: width, height,
    is_diagonal, is_modular, of some dozens of sizes. taken: ax, ay, priority, of what is there before.
    Every round is written to the shared folder, which the result reads."""
    spark = outlines.sparkSession
    folder = rounds.new_folder(spark, "outlines")
    found = catalogues.sizes(catalogue).collect()
    unit = {False: QUARTER_AREA, True: DIAMOND_AREA}
    sizes = {}
    for d in (False, True):
        own = tuple(sorted({(r["height"], r["width"]) for r in found if r["is_diagonal"] == d}))
        if own:
            sizes[d] = Sizes(own, max(h * w for h, w in own) * unit[d])
    modular = any(r["is_modular"] for r in found)

    own = outlines.select(F.col("building").cast("long").alias("building"), F.col("place").cast("long").alias("place"), F.col("priority").cast("int").alias("priority"), "ring").where(F.abs(g.signed_area(F.col("ring"))) > 0)
    left = reached(own, size)
    if taken is not None:
        left = less_taken(left, taken)
    left.write.parquet(f"{folder}/0")
    left = spark.read.parquet(f"{folder}/0")
    number, side, count = 0, rounds.TILE, left.count()
    done = left.limit(0).select("building", "priority", F.lit(None).cast(PLACED).alias("placed"))
    while True:
        number += 1
        # other borders each round, so that few outlines lie at one again
        whole = tiled(left, side, int(4 * side * (number * SHIFT % 1))).select("building", "place", "priority", "tile", "ring", "cells")
        one_round(whole, sizes, modular).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        done = done.union(after.where("settled").select("building", "priority", "placed"))
        rest = after.where("not settled").drop("tile", "settled", "placed")
        before, count = count, rest.count()
        if not count:
            return done.select("building", "priority", F.inline("placed"))
        new = after.where("settled").select("building", "priority", F.inline("placed"))
        if 4 * count <= before or count <= FEW:  # no more in a tile than before
            side *= 2
        left = rounds.written(less_taken(rest, taken_by(new)), f"{folder}/{number}-left")  # a round reads it often


def drawn(placements: DataFrame, catalogue: DataFrame, kind: str, per_row: int, salt: int = 0) -> DataFrame:
    """Assignments (xidx, yidx, building, priority, menu, cat1, cat2, direction): a building of the
    catalogue (BUILDINGS) for every placement of its size; where several are placed on an outline,
    modular ones, if there are any. Sizes without a building give no rows."""
    several = placements.join(placements.groupBy("building").agg((F.count("*") > 1).alias("several")), "building")
    any_modular = catalogue.agg(F.coalesce(F.bool_or("is_modular"), F.lit(False)).alias("any"))
    both = catalogue.join(F.broadcast(any_modular)).withColumn("several", F.explode(F.array(F.lit(True), F.lit(False))))  # one row
    options = both.where("not several or is_modular or not any")
    entry = F.struct("menu", "cat1", "direction", "row", "col")
    lists = options.select(F.col("height").alias("rows"), F.col("width").alias("cols"), "is_diagonal", "several", "stories", "weight", entry.alias("label"))
    picked = packing.chosen(several.withColumnRenamed("diagonal", "is_diagonal"), lists, "building", "qx", "qy", salt=salt, by=("rows", "cols", "is_diagonal", "several"))
    name = labels.numbered(kind, F.col("label.row"), F.col("label.col"), per_row)
    return picked.where("label is not null").select((F.col("qx") / 4 - 0.25).alias("xidx"), (F.col("qy") / 4 + 0.25).alias("yidx"), "building", "priority", "label.menu", "label.cat1", name.alias("cat2"), labels.direction_label(F.col("label.direction")).alias("direction"))
