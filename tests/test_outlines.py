"""Buildings on outlines, against a loop over them that compares polygons."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid, outlines, packing, rounds
from gridloom.plans import maps
from gridloom.plans.model import BUILDINGS
from gridloom.sources import readers

NX, NY = 12, 9
SIZES = {(1, 1, False), (1, 2, False), (2, 2, False), (2, 3, False), (1, 1, True), (2, 1, True)}


def clip(ring, other):
    """ring cut by a counter-clockwise convex ring."""
    for a, b in zip(other, other[1:] + other[:1]):
        out = []
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in ring]
        for i, p in enumerate(ring):
            j = (i + 1) % len(ring)
            if side[i] >= 0:
                out.append(p)
            if side[i] * side[j] < 0:
                t = side[i] / (side[i] - side[j])
                out.append((p[0] + (ring[j][0] - p[0]) * t, p[1] + (ring[j][1] - p[1]) * t))
        ring = out
    return ring


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if ring else 0.0


def fine_cells(diagonal):
    """Index in cells -> polygon, of a whole map."""
    steps = ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)) if diagonal else ((0.25, 0.25), (-0.25, 0.25), (0.25, -0.25), (-0.25, -0.25))
    out = {}
    for i in range(NX):
        for j in range(NY):
            for a, b in steps:
                x, y = (i + a + 0.5) * 8, (j + b + 0.5) * 8
                out[i + a, j + b] = [(x + 4, y), (x, y + 4), (x - 4, y), (x, y - 4)] if diagonal else [(x - 2, y - 2), (x + 2, y - 2), (x + 2, y + 2), (x - 2, y + 2)]
    return out


def loop(rings, angles, taken):
    """What the operator should place, outline by outline, in floating cell indexes."""
    cells = {d: fine_cells(d) for d in (True, False)}
    taken, out = list(taken), []
    for k, ring in enumerate(rings):
        own = min(angles[k] % 90, 90 - angles[k] % 90) >= 22.5
        found = []
        for d in (True, False):
            unit = 32 if d else 16
            fit = sorted({(h, w) for h, w, e in SIZES if e == d})
            free = {c: area(clip(ring, p)) for c, p in cells[d].items()}
            free = {c: a for c, a in free.items() if a > 1e-6 and all(area(clip(cells[d][c], o)) < 1e-6 for o in taken)}
            for share in (0, 0.5, 1):
                at = {(y + x, x - y) if d else (2 * y, 2 * x): c for (x, y), c in zip(free, free) if free[c] > share * unit}
                if not at:
                    continue
                low, left = min(r for r, _ in at), min(c for _, c in at)
                m = np.zeros((int(max(r for r, _ in at) - low) + 1, int(max(c for _, c in at) - left) + 1), bool)
                for r, c in at:
                    m[int(r - low), int(c - left)] = True
                largest = max(h * w for h, w in fit) * unit
                placed = packing.pack(m, fit, area(ring) > largest).placed
                if placed:
                    used = [[at[r + i + low, c + j + left] for i in range(h) for j in range(w)] for r, c, h, w in placed]
                    flat = [c for u in used for c in u]
                    shared = sum(free[c] for c in flat)
                    found.append((d != own, -shared / (len(flat) * unit + area(ring) - shared), d, [(h, w, u[0]) for (_, _, h, w), u in zip(placed, used)], flat))
        if found:
            best = min(found, key=lambda f: (f[0], round(f[1], 9)))
            taken += [cells[best[2]][c] for c in best[4]]
            out += [(k, best[2], h, w, *c) for h, w, c in best[3]]
    return out


def turned_box(x, y, w, h, degrees):
    t = math.radians(degrees)
    return [(x + a * math.cos(t) - b * math.sin(t), y + a * math.sin(t) + b * math.cos(t)) for a, b in ((0, 0), (w, 0), (w, h), (0, h))]


def catalogue(spark, modular=True):
    rows = [("p", "residential", "Menu", f"{h}x{w}", 0, i, 1, d, 0, 1.0, w, h, modular) for i, (h, w, d) in enumerate(sorted(SIZES))]
    return spark.createDataFrame(rows, BUILDINGS)


def table(spark, rings, priority=1):
    rows = [(k, len(rings) + k, priority, ring) for k, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "building long, place long, priority int, ring array<struct<x:double,y:double>>")


def indexed(df):
    return sorted((r["building"], r["diagonal"], r["rows"], r["cols"], r["qx"] / 4, r["qy"] / 4) for r in df.collect())


@pytest.mark.parametrize("tile", [64, 2])
def test_outlines_in_order(spark, monkeypatch, tile):
    """Crowded outlines, part of them off the map, in one tile or across many."""
    monkeypatch.setattr(rounds, "TILE", tile)
    r = random.Random(5)
    angles = [r.choice((0, 7, 45, 50, 90, 117)) for _ in range(30)]
    rings = [turned_box(r.uniform(-5, NX * 8), r.uniform(-5, NY * 8), r.uniform(3, 13), r.uniform(3, 9), a) for a in angles]
    squares = spark.createDataFrame([(2, 2, 1), (5, 4, 0), (7, 3, 9)], "xidx int, yidx int, priority int")
    before = [[(x * 8, y * 8), (x * 8 + 8, y * 8), (x * 8 + 8, y * 8 + 8), (x * 8, y * 8 + 8)] for x, y in ((2, 2), (5, 4))]
    got = indexed(outlines.placed(table(spark, rings), catalogue(spark), (NX, NY), outlines.taken_squares(squares)))
    want = sorted(loop(rings, angles, before))
    assert len({k for k, *_ in got}) > 10
    assert got == want


def test_triangles_of_cells(spark):
    """Cells share triangles just where they share an area."""
    cells = [(d, round(4 * x), round(4 * y), p) for d in (False, True) for (x, y), p in fine_cells(d).items() if 2 <= x <= 4 and 2 <= y <= 4]
    own = {(d, x, y): set(outlines.triangles_of(d, x, y)) for d, x, y, _ in cells}
    for d, x, y, p in cells:
        for e, u, v, q in cells:
            assert bool(own[d, x, y] & own[e, u, v]) == (area(clip(p, q)) > 1e-6)
    rows = spark.createDataFrame([c[:3] for c in cells], "d boolean, x int, y int")
    for r in rows.withColumn("t", outlines.triangles(F.col("d"), F.col("x"), F.col("y"))).collect():
        assert {(t["ax"], t["ay"]) for t in r["t"]} == own[r["d"], r["x"], r["y"]]


def test_cells_of_outlines(spark, monkeypatch):
    """Exactly the areas of grid.fill_fine(), few at a time; a table of one partition is dealt to several tasks."""
    monkeypatch.setattr(outlines, "POINTS", 50)
    r = random.Random(3)
    rings = [turned_box(r.uniform(-5, NX * 8), r.uniform(-5, NY * 8), r.uniform(3, 30), r.uniform(3, 9), r.choice((0, 7, 45, 90, 117))) for _ in range(20)]
    rings += [[(x + 8.0, y + 8.0) for x, y in ((0, 0), (20, 0), (20, 20), (14, 20), (14, 5), (6, 5), (6, 20), (0, 20))], [(1.0, 1.0), (30.0, 3.0), (9.0, 25.0)]]
    rings += [turned_box(-90, 8, 9, 9, 0), [(math.inf, 1.0), (2.0, 1.0), (2.0, 9.0)]]
    own = table(spark, rings).coalesce(1)
    got = outlines.reached(own, (NX, NY)).withColumn("task", F.spark_partition_id()).cache()
    assert got.select("task").distinct().count() > 1
    want = []
    for d, offsets, margin in ((False, grid.QUARTERS, 3), (True, grid.DIAMONDS, 2)):
        fine = grid.fill_fine(own.where(F.col("building") < len(rings) - 1), "ring", offsets, outlines.NOTHING)
        fine = fine.where(F.col("qx").between(-2, 4 * NX - margin) & F.col("qy").between(-2, 4 * NY - margin))
        want += [(r["building"], d, r["qx"], r["qy"], r["area"]) for r in fine.collect()]
    found = [tuple(r) for r in got.select("building", F.inline("cells")).collect()]
    assert sorted(found) == sorted(want) and len({b for b, *_ in found}) > 15
    assert all(r["cells"] == sorted(r["cells"]) for r in got.collect())


def test_a_chain_across_many_tiles_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(rounds, "TILE", 1)
    rings = [turned_box(3 + 7 * k, 9, 9, 7, 0) for k in range(30)]
    got = indexed(outlines.placed(table(spark, rings), catalogue(spark), (30, 4)))
    folder = rounds._folders[-1].removeprefix("file:")
    assert sum(n.isdigit() for n in os.listdir(folder)) <= 10
    monkeypatch.setattr(rounds, "TILE", 64)
    assert got == indexed(outlines.placed(table(spark, rings), catalogue(spark), (30, 4)))


def test_outlines_without_a_building(spark):
    """No area, off the map, a null ring, all taken; nothing at all."""
    flat = [(8.0, 8.0), (16.0, 8.0), (20.0, 8.0)]
    rings = [flat, turned_box(-50, -50, 9, 9, 0), None, turned_box(8, 8, 8, 8, 0)]
    whole = spark.createDataFrame([(x, y, 1) for x in range(4) for y in range(4)], "xidx int, yidx int, priority int")
    own = table(spark, rings)
    assert outlines.placed(own, catalogue(spark), (NX, NY), outlines.taken_squares(whole)).count() == 0
    assert outlines.placed(own.limit(0), catalogue(spark), (NX, NY)).count() == 0
    assert outlines.placed(own, catalogue(spark).limit(0), (NX, NY)).count() == 0
    assert indexed(outlines.placed(own, catalogue(spark), (NX, NY)))[0][0] == 3


def test_buildings_drawn(spark):
    """Modular buildings where several are placed; sizes without a building give none."""
    rows = [("p", "r", "M", "one", 2, 0, 0, False, 1, 1.0, 1, 1, False), ("p", "r", "M", "block", 0, 1, 2, False, 2, 1.0, 1, 1, True)]
    two = spark.createDataFrame(rows, BUILDINGS)
    placements = spark.createDataFrame([(1, 5, False, 1, 1, -1, -1), (1, 5, False, 1, 1, 1, -1), (2, 5, False, 1, 1, 9, 11), (3, 5, False, 2, 2, 1, 1)], "building long, priority int, diagonal boolean, rows int, cols int, qx int, qy int")
    single = outlines.drawn(placements.where("building > 1"), two.where("not is_modular"), "Barn", 3).collect()
    assert [tuple(r) for r in single] == [(2.0, 3.0, 2, 5, "M", "one", "Barn 1", "Direction 3")]
    got = outlines.drawn(placements, two, "Building", 4).collect()
    assert {r["cat2"] for r in got if r["building"] == 1} == {"Building 7"} and len(got) == 3


def test_buildings_of_a_map(spark):
    """Rules of one step follow each other, whatever the order of their features; a later step finds
    their cells taken; what isn't an outline gets its cells as before."""
    config = {
        "first": {"priority": 1, "tags": [["b", "1"]], "process": ["type_from_residential_building_outline"]},
        "second": {"priority": 1, "tags": [["b", "2"]], "process": ["type_from_residential_building_outline"]},
        "third": {"priority": 2, "tags": [["b", "3"]], "process": ["type_from_barn_outline"]},
        "grass": {"priority": 3, "tags": [["g", "1"]], "process": ["type_from_tag"], "cm_types": [{"menu": "Ground", "cat1": "Grass", "tags": [["g", "1"]]}]},
    }
    box = [(8.0, 8.0), (16.0, 8.0), (16.0, 16.0), (8.0, 16.0)]
    aside = [(24.0, 8.0), (32.0, 8.0), (32.0, 12.0), (24.0, 12.0)]
    features = [("1", {"b": "2"}, box), ("2", {"b": "1"}, box), ("3", {"b": "3"}, box), ("4", {"b": "3"}, aside), ("5", {"g": "1"}, box)]
    table_ = spark.createDataFrame(features, "id string, tags map<string,string>, ring array<struct<x:double,y:double>>")
    rows = [("p", "residential", "House", "Two", 0, 0, 1, False, 2, 1.0, 2, 2, False), ("p", "barn", "Independent", "Barn", 3, 1, 0, False, 0, 1.0, 2, 1, False)]
    own = maps.building_operators(spark.createDataFrame(rows, BUILDINGS), "p", (6, 4))
    got = maps.build(table_, readers.rule_table(spark, config), F.col("id").cast("long"), (6, 4), {"menu": "Ground"}, own).where("name <> 'default_ground'")
    found = sorted(tuple(r) for r in got.select("id", "xidx", "yidx", "menu", "cat2", "direction").collect())
    assert found == [("2", 0.5, 1.0, "House", "Building 2", "Direction 1"), ("4", 2.5, 1.0, "Independent", "Barn 4", "Direction 4"), ("5", 1.0, 1.0, "Ground", None, None)]


def test_buildings_keep_off_roads(spark):
    """Tiles of the same or an earlier priority take their cells; other rows of a cell don't."""
    rows = [("p", "church", "Church", "Old", 0, 0, 0, False, 1, 1.0, 2, 2, False)]
    boxes = [[(x, 8.0), (x + 8, 8.0), (x + 8, 16.0), (x, 16.0)] for x in (8.0, 24.0, 40.0)]
    own = spark.createDataFrame([(str(i), i, 0, "church", 2, b) for i, b in enumerate(boxes)], "id string, idx long, ord int, name string, priority int, ring array<struct<x:double,y:double>>")
    state = spark.createDataFrame([(1, 1, "Road Tile 4", 2), (3, 1, "Grass", 1), (5, 1, "Road Tile 1", 3)], "xidx int, yidx int, cat2 string, priority int")
    got = maps.building_operators(spark.createDataFrame(rows, BUILDINGS), "p", (8, 4))["churches"](own, state)
    assert {r["id"] for r in got.collect()} == {"1", "2"}


def test_parts(spark):
    own = spark.createDataFrame([(4, [turned_box(0, 0, 8, 8, 0), [(1.0, 1.0)], turned_box(20, 0, 8, 8, 0)]), (5, None)], "idx int, rings array<array<struct<x:double,y:double>>>")
    got = outlines.parts(own, "rings", "idx").collect()
    assert [(r["place"], r["ring"][0]["x"]) for r in got] == [(4, 0.0), (4, 20.0)] and len({r["building"] for r in got}) == 2
