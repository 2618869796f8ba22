"""Operators against small models in plain Python, and their invariants."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import draw
from gridloom.functions import geometry as g
from gridloom.functions import planning
from gridloom.operators import borders, elevation, grid, network, packing, paging, resolve, rules
from gridloom.plans import schedule
from gridloom.sources import readers, sinks
from gridloom.streaming import features


def model_resolve(rows, ranks):
    cells = {}
    for r in dict.fromkeys(rows):
        if r[4] is not None or r[5] is not None:
            cells.setdefault(r[:2], []).append(r)
    out = []
    for own in cells.values():
        if len(own) > 1:
            positive = [r[2] for r in own if r[2] > 0]
            low = min(positive) if positive else None
            own = [r for r in own if r[2] != -999 and not (low is not None and (r[2] > low or r[2] < 0))]
        groups = {}
        for r in own:
            groups.setdefault(r[2:4], []).append(r)
        for same in groups.values():
            ranked = sorted((ranks[r[3], r[4]], r[5] or 0, r) for r in same if (r[3], r[4]) in ranks)
            out += [r for r in same if (r[3], r[4]) not in ranks] + [x[2] for x in ranked[:1]]
    return sorted(out, key=repr)


def test_resolution(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(4), rng.choice([-999, -1, 0, 1, 2]), rng.choice("ab"), rng.choice(["m", "n", "o"]), float(i)) for i in range(120)]
    rows += [(9, 9, -999, "a", "m", 1.0), (8, 8, 1, "a", None, None)]
    ranks = {("a", "m"): 1, ("a", "n"): 0, ("b", "o"): 0}
    df = spark.createDataFrame(rows, "xidx int, yidx int, priority int, name string, menu string, z double").withColumn("cat1", F.col("menu"))
    dim = spark.createDataFrame([(a, b, b, r) for (a, b), r in ranks.items()] + [("a", "m", "m", 5)], "name string, menu string, cat1 string, ord int")
    got = sorted(((r["xidx"], r["yidx"], r["priority"], r["name"], r["menu"], r["z"]) for r in resolve.resolved(df, dim, ("z",)).collect()), key=repr)
    assert got == model_resolve(rows, ranks)


def test_rules_with_null_ids_and_tags(spark):
    f = spark.createDataFrame([(None, {"k": "v"}), ("1", {"k": "v", "x": "y"}), ("2", {"k": "v"}), ("3", None), ("4", {"q": "r"})], "id string, tags map<string,string>")
    config = {"a": {"priority": 1, "tags": [["k", "v"]], "exclude_tags": [["x", "y"]]}, "b": {"priority": 1, "tags": [["k", "v"]], "allowed_ids": ["1"]}}
    m = rules.match(f, readers.rule_table(spark, config))
    assert sorted((str(r["id"]), r["name"]) for r in m.select("id", "name").collect()) == [("1", "b"), ("2", "a"), ("None", "a")]
    assert [tuple(r) for r in rules.unprocessed_tags(f.where("id is not null"), m).collect()] == [("q", "r")]


def test_cell_areas_add_up(spark):
    rng = random.Random(2)
    rings = []
    for i in range(20):
        cx, cy, n = rng.uniform(30, 90), rng.uniform(30, 90), rng.randrange(3, 9)
        rings.append((i, [(cx + rng.uniform(5, 25) * math.cos(2 * math.pi * k / n), cy + rng.uniform(5, 25) * math.sin(2 * math.pi * k / n)) for k in range(n)]))
    df = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>")
    x, y = F.col("xidx") * 8.0, F.col("yidx") * 8.0
    part = grid.candidate_cells(df, "ring").withColumn("a", g.clipped_area(F.col("ring"), g.box_planes(x, y, x + 8, y + 8))).groupBy("id").agg(F.sum("a").alias("a"))
    for r in df.join(part, "id").select(g.signed_area(F.col("ring")).alias("s"), "a").collect():
        assert abs(r["s"] - r["a"]) < 1e-6


def test_draw_follows_weights(spark):
    df = spark.range(20_000).select(draw.pick(draw.number(F.col("id"), F.col("id") % 91), F.array(*[F.lit(w).cast("long") for w in (1, 0, 3)])).alias("i"))
    n = {r["i"]: r["count"] for r in df.groupBy("i").count().collect()}
    assert set(n) == {0, 2} and abs(n[0] / 20_000 - 0.25) < 0.02
    assert spark.range(1).select(draw.pick(F.lit(5), F.array().cast("array<bigint>")).alias("i")).first()["i"] is None


def test_cover_is_disjoint_and_complete():
    rng = np.random.default_rng(3)
    full = rng.random((24, 22)) < 0.9
    full[2:18, 3:19] = True
    seen = np.zeros_like(full, int)
    for size, x, y in paging.cover(full):
        h = size // 2
        seen[x - h : x + h + 1, y - h : y + h + 1] += 1
    assert (seen == full).all()


def test_pages_match_the_loop(spark):
    w, h = 61, 49
    cells = [(float(x), float(y)) for x in range(w) for y in range(h)]
    got = {(r["x"], r["y"]): (r["page_x"], r["page_y"]) for r in paging.paged(spark.createDataFrame(cells, "x double, y double")).collect()}
    nx, ny, rx, ry = w // 24, h // 22, w % 24 // 2 * 2, h % 22 // 2 * 2
    want, tw, th = {}, nx * 24 + rx, ny * 22 + ry
    for j in range(ny + 1):
        for i in range(nx + 1):
            x1, x0 = (tw - i * 24, tw - i * 24 - 24) if i < nx else (rx, 0)
            y0, y1 = (j * 22, j * 22 + 22) if j < ny else (th - ry, th)
            want |= {(x, y): (i, j) for x, y in cells if x0 <= x < x1 and y0 <= y < y1}
    assert got == want


def test_packing_is_optimal():
    def brute(grid_, tiles):
        best = [float(packing.unfilled_cost(grid_))]

        seen = {}

        def go(left, n):
            if seen.get(left.tobytes(), 99) <= n:
                return
            seen[left.tobytes()] = n
            best[0] = min(best[0], 0.5 * n + packing.unfilled_cost(left))
            for r in range(left.shape[0]):
                for c in range(left.shape[1]):
                    for h, w in tiles:
                        if left[r : r + h, c : c + w].shape == (h, w) and left[r : r + h, c : c + w].all():
                            rest = left.copy()
                            rest[r : r + h, c : c + w] = False
                            go(rest, n + 1)

        go(grid_, 0)
        return best[0]

    rng = np.random.default_rng(4)
    for _ in range(6):
        shape = rng.random((3, 3)) < 0.8
        assert packing.pack(shape, [(1, 1), (2, 1), (2, 2)], True)[0] == brute(shape, [(2, 2), (2, 1), (1, 1)])


def test_packing_has_no_limit():
    """Footprints on which the search is long: a corner of 5 by 4 and of 5 by 8 is missing."""
    for shape, cost in (((5, 4), 3.5), ((5, 8), 7.5), ((8, 5), 6.0)):
        cells = np.ones(shape, bool)
        cells[0, 0] = False
        got, placed, bound = packing.pack(cells, [(1, 1), (2, 1), (2, 2)], True)
        for r, c, h, w in placed:
            assert cells[r : r + h, c : c + w].all()
            cells[r : r + h, c : c + w] = False
        assert got == cost == bound == 0.5 * len(placed) + packing.unfilled_cost(cells)


def test_matrix_of_diamonds(spark):
    """Diamonds that share a side are neighbours in the matrix, along rows and columns."""
    from gridloom.operators import catalogues

    own = spark.createDataFrame([(2, 0), (4, 2), (4, -2), (6, 0)], "qx int, qy int")
    r, c = catalogues.row_col(F.col("qx"), F.col("qy"), F.lit(2), F.lit(0), True)
    assert [tuple(x) for x in own.select(r, c).collect()] == [(0, 0), (1, 0), (0, 1), (1, 1)]


def test_buildings_of_no_stories_are_drawn(spark):
    placed = spark.createDataFrame([(1, 2, 3, False)], "building long, rows int, cols int, is_diagonal boolean")
    barns = spark.createDataFrame([(2, 3, False, 0, 1.0, "Barn 1")], "rows int, cols int, is_diagonal boolean, stories int, weight double, label string")
    assert [r["label"] for r in packing.chosen(placed, barns, "building").collect()] == ["Barn 1"]


def test_schedule_order(spark):
    config = {"late": {"priority": 2, "tags": [], "process": ["type_from_tag"]}, "soon": {"priority": -1, "tags": [], "process": ["stream_tiles"]}, "off": {"priority": -5, "active": False, "tags": [], "process": ["type_from_tag"]}}
    steps = [(r["priority"], r["stage"], r["operator"]) for r in schedule.schedule(readers.rule_table(spark, config)).collect()]
    assert steps == [(-1, 0, "collect_lines"), (-1, 1, "node_lines"), (-1, 2, "search_paths"), (-1, 3, "stream_tiles"), (2, 0, "type_from_tag")]


def test_sources_and_sinks(spark, tmp_path):
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7, "tags": {"a": "b"}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"type": "Feature", "properties": {"c": "d"}, "geometry": {"type": "Point", "coordinates": [2, 3]}}]}
    (tmp_path / "f.json").write_text(json.dumps(geo))
    rows = readers.features(spark, str(tmp_path / "f.json")).collect()
    assert rows[0]["tags"] == {"a": "b"} and rows[0]["coords"][0][1]["x"] == 1.0
    assert rows[1]["tags"] == {"c": "d"} and rows[1]["coords"][0][0]["y"] == 3.0
    for name, sep in (("w", "  "), ("c", ",")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.xyz").write_text(f"1{sep}2{sep}3\n4{sep}5{sep}6\n")
        assert sorted(map(tuple, readers.elevation_points(spark, str(tmp_path / name)).collect())) == [(1, 2, 3), (4, 5, 6)]
    cells = spark.createDataFrame([(1.0, 2.0, 2.5, "m"), (9.0, 9.0, 3.5, None)], "xidx double, yidx double, z double, menu string")
    sinks.write(sinks.map_table(cells, (0, 0, 10, 10)), str(tmp_path / "out"))
    back = {(r["x"], r["y"]): (r["z"], r["menu"]) for r in readers.map_cells(spark, str(tmp_path / "out")).collect()}
    assert back == {(1.0, 2.0): (2.0, "m"), (9.0, 9.0): (4.0, None), (10.0, 10.0): (None, None)}


def test_rotation_keeps_the_centre(spark):
    raster = spark.createDataFrame([(x, y, float(x + y)) for x in range(11) for y in range(11)], "x int, y int, z double")
    got = {(r["x"], r["y"]): r["z"] for r in elevation.rotated(raster, 11, 11, 45.0).collect()}
    assert len(got) == 121 and abs(got[5, 5] - 10) < 1e-9 and got[0, 0] == -1.0


def test_utm_of_a_known_place(spark):
    # A position on zone 33's central meridian
    p = spark.range(1).select(g.to_utm(F.lit(15.0), F.lit(0.0), F.lit(32633)).alias("p"), g.utm_zone(F.lit(15.0), F.lit(0.0)).alias("z")).first()
    assert p["z"] == 32633 and abs(p["p"]["x"] - 500000) < 1e-3 and abs(p["p"]["y"]) < 1e-3


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "xidx int, yidx int, priority int, name string, menu string, z double")
    assert resolve.dominant(resolve.valid(rows)).count() == 0
    cells = spark.createDataFrame([], "x double, y double, z double")
    assert paging.paged(cells).count() == 0 and elevation.contours(cells, 5.0).count() == 0


def test_planning():
    from gridloom.functions import planning

    assert planning.parse_box([1, 2, 0, 5]) == (4326, [(0, 2), (1, 2), (1, 5), (0, 5)])
    code, box = planning.parse_box([25832, 0, 0, 2, 2, 1, 3, -1, 1])
    assert code == 25832 and abs(math.dist(box[0], box[1]) * math.dist(box[1], box[2]) - 4) < 1e-9
    assert planning.reference_points([(0, 0), (4, 0), (4, 2), (0, 2)], (3.9, 1.5)) == ((4, 2), (0, 2), (0, 0))
    assert planning.split_repeats([(0, 0), (1, 1), (2, 0), (1, 1), (0, 2)]) == [[(0, 0), (1, 1)], [(1, 1), (2, 0), (1, 1), (0, 2)]]


def test_catalogues(spark):
    from gridloom.operators import catalogues

    t = catalogues.tiles(spark, {(0, 0, 0): {"u": [1], "d": [1, 2], "l": None}, (1, 0, 0, 2): {"l": [1], "r": [1]}, (2, 0, 1): {"u": [2], "d": [2]}}, "road")
    assert [r["tile"] for r in catalogues.fitting(t, {"u": 1, "d": 2}).collect()] == [0]
    assert {r["n_connections"] for r in t.collect()} == {2}
    rows = [("p", "residential", 2, 1, False), ("p", "church", 3, 3, True)]
    b = spark.createDataFrame(rows, "profile string, building_type string, width int, height int, is_modular boolean").withColumn("is_diagonal", F.lit(False))
    assert [catalogues.buildings(b, "p", k).first()["width"] for k in ("church", "mill")] == [3, 2]
    assert catalogues.buildings(b, "q", "church").count() == 0
    layer = catalogues.default_layer(spark, "default_ground", 3, 2, {"menu": "Ground"})
    other = spark.createDataFrame([(0, 0, "Road", None, None, "road", 1)], layer.schema)
    assert resolve.dominant(layer.unionByName(other)).where("menu = 'Ground'").count() == 5


def test_streamed_features_match_as_in_batches(spark, tmp_path):
    config = {
        "wood": {"priority": 1, "tags": [["natural", "wood"], ["landuse", "forest"]], "exclude_tags": [["leaf", "none"]], "required_tags": [["kept", "yes"]], "exclude_ids": ["banned"], "cm_types": [{"menu": "w", "tags": [["kept", "yes"]]}]},
        "listed": {"priority": 2, "tags": [["natural", "wood"]], "allowed_ids": ["twice"], "cm_types": [{"menu": "l", "tags": [["natural", "wood"]]}]},
        "off": {"priority": 3, "active": False, "tags": [["natural", "wood"]], "cm_types": [{"menu": "o", "tags": [["natural", "wood"]]}]},
    }
    table = readers.rule_table(spark, config)
    wood = {"natural": "wood", "landuse": "forest", "kept": "yes"}
    each = [("twice", wood), ("banned", wood), ("bare", wood | {"leaf": "none"}), ("loose", {"natural": "wood"})]
    rows = [(i, tags, [(16.0 * k, 0.0), (16.0 * k + 8, 0.0), (16.0 * k + 8, 8.0), (16.0 * k, 8.0)]) for k, (i, tags) in enumerate(each)]
    schema = "id string, tags map<string,string>, ring array<struct<x:double,y:double>>"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = features.assignments(stream, table).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(60)
    got = sorted((r["xidx"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    place = {i: 2 * k for k, (i, _) in enumerate(each)}
    assert got == [(0, "listed"), (0, "wood")] == sorted((place[r["id"]], r["name"]) for r in rules.match(batch, table).collect())


def test_borders_of_cores(spark):
    """A border is taken off or added, with round corners."""
    cell = [(0, 0), (64, 0), (64, 64), (0, 64)]
    ell = [(0, 0), (64, 0), (64, 24), (24, 24), (24, 64), (0, 64)]
    rows = [(1, cell, None), (2, cell, 1.0), (3, cell, -1.0), (4, ell, 1.0), (5, ell, None), (6, cell[::-1], 1.0), (7, cell, 5.0)]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r], b) for i, r, b in rows], "id int, ring array<struct<x:double,y:double>>, border double")
    got = {}
    for r in grid.fill_core(df, "ring", "border").collect():
        got.setdefault(r["id"], set()).add((r["xidx"], r["yidx"]))
    square = {(x, y) for x in range(8) for y in range(8)}
    assert got[1] == square and got[2] == got[6] == {(x, y) for x, y in square if 0 < x < 7 and 0 < y < 7}
    assert got[3] == {(x, y) for x in range(-1, 9) for y in range(-1, 9)} - {(-1, -1), (-1, 8), (8, -1), (8, 8)} | ({(-1, -1), (-1, 8), (8, -1), (8, 8)} & got[3])
    corner = {(x, y) for x, y in square if x < 3 or y < 3}
    assert got[5] == corner and got[4] == {(x, y) for x, y in corner if 1 <= x < 7 and 1 <= y < 7 and (x < 2 or y < 2)}
    assert 7 not in got


def distances(ring, x, y):
    """Of points to a ring's border, and whether they lie inside: plain loops over sides."""
    far, inside = np.full(x.shape, np.inf), np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
        far = np.minimum(far, np.hypot(x - ax - t * dx, y - ay - t * dy))
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * dx / dy)
    return far, inside


def test_areas_within_borders(spark):
    """Exact areas against closed forms, and against points on a fine raster for shapes with turns."""

    def area(piece, sides, off, grow):
        return borders.cell_areas(np.array(piece, float).reshape(1, -1, 2), np.array(sides, float).reshape(1, -1, 4), np.array([off]), np.array([grow]), 8.0)[0]

    quarter = area([], [[-9, 0, 0, 0], [0, 0, 0, -9]], 5.0, True)
    assert abs(quarter - np.pi * 25 / 4) < 1e-9
    lens = area([[0, 0], [8, 0], [8, 8], [0, 8]], [[0, 4, 0, 4], [4, 4, 4, 4]], 3.0, False)
    both = 2 * 9 * np.arccos(4 / 6) - 2 * (36 - 16) ** 0.5
    assert abs(lens - (64 - (np.pi * 9 / 2 + np.pi * 9 - both))) < 1e-9
    ring = [(1.0, 2), (60, 5), (50, 30), (33, 12), (30, 41), (22, 14), (14, 50), (9, 50), (12, 20), (1, 30), (1, 2)]
    star = [(40 + (30 if k % 2 else 11) * np.cos(k * 0.4487), 40 + (30 if k % 2 else 11) * np.sin(k * 0.4487)) for k in range(14)]
    hook = [(0.0, 0), (56, 0), (56, 56), (40, 56), (40, 16), (16, 16), (16, 56), (0, 56)]
    rows = [(10 * a + b, [(float(x), float(y)) for x, y in (r[::-1] if b % 2 else r)], by) for a, r in enumerate((ring, star, hook)) for b, by in enumerate((0.2, 0.55, 0.9, -0.3, -1.0, -1.7, 0.0))]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, border double")
    got = {(r["id"], r["xidx"], r["yidx"]): r["area"] for r in grid.fill_core(df, "ring", "border", share=0.001).collect()}
    n = 40
    at = (np.arange(-4 * n, 16 * n) + 0.5) * 8 / n
    x, y = np.meshgrid(at, at)
    for i, r, by in rows:
        far, inside = distances(r, x, y)
        kept = inside | (far <= -by * 8) if by < 0 else inside & (far >= by * 8)
        points = kept.reshape(20, n, 20, n).sum(axis=(1, 3)) * (8 / n) ** 2
        for yi in range(-4, 16):
            for xi in range(-4, 16):
                assert abs(got.get((i, xi, yi), 0.0) - points[yi + 4, xi + 4]) < 0.8, (i, xi, yi)
    wide = {k: sum(v for (i, _, _), v in got.items() if i == k) for k in (23, 25)}
    # what a border of d adds: d times the length of the outline, sectors at corners, less what overlaps
    d = 0.3 * 8
    assert abs(wide[23] - (56 * 56 - 24 * 40 + 304 * d + 6 * np.pi * d * d / 4 - 2 * d * d)) < 0.5
    assert area([], [], 1.0, True) == 0


def test_numbers_of_rows(spark):
    from gridloom.functions.number import numbered

    rows = [(None, 1), (3, 2), (3, 1), (250, 0), (101, 5), (99, 9), (-7, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r["a"], r["b"]): r["idx"] for r in numbered(df, F.floor(F.col("a") / 100), "a", "b").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r: i for i, r in enumerate(order)}
    assert numbered(df.where("a > 999"), F.floor("a"), "a").count() == 0


def test_grid_files_and_mixed_delimiters(spark, tmp_path):
    every = grid.all_grids(grid.squares(spark, 3, 2))
    sinks.write_grids(every, str(tmp_path / "grids"))
    back = readers.grids(spark, str(tmp_path / "grids")).select(*every.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, every.collect()))
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "a.xyz").write_text("1 2 3\n4\t5   6.5\n\n")
    (tmp_path / "points" / "b.csv").write_text("7,8,9\n10 , 11, 12\nx,y,z\n13.5 14,15\n")
    got = {(r["x"], r["y"], r["z"]) for r in readers.elevation_points(spark, str(tmp_path / "points")).collect()}
    assert got >= {(1.0, 2.0, 3.0), (4.0, 5.0, 6.5), (7.0, 8.0, 9.0), (10.0, 11.0, 12.0)}


def test_crop_of_a_turned_raster():
    assert planning.crop_box(128, 128, 104.0, 56.0) == (12, 36, 116, 92)
    assert planning.crop_box(50, 40, 500.0, 20.0) == (0, 10, 48, 26)


def test_map_of_nothing(spark):
    from gridloom.plans import maps

    rules_ = readers.rule_table(spark, {"a": {"priority": 1, "tags": [["k", "v"]], "process": ["type_random_area", "type_from_linear"], "cm_types": [{"menu": "M", "cat1": "C"}], "modifiers": {"linear_name": "a", "stride_x": 2}}})
    none = spark.createDataFrame([], "id string, tags map<string,string>, ring array<struct<x:double,y:double>>")
    got = maps.build(none, rules_, F.col("id").cast("long"), (3, 2), {"menu": "G"}).collect()
    assert len(got) == 6 and {r["menu"] for r in got} == {"G"}
    ring = [(0.0, 0.0), (32.0, 0.0), (32.0, 16.0), (0.0, 16.0)]
    one = spark.createDataFrame([("1", {"k": "v"}, ring)], none.schema)
    got = {(r["xidx"], r["yidx"]): r["name"] for r in maps.build(one, rules_, F.col("id").cast("long"), (4, 2), {"menu": "G"}).collect()}
    assert {k for k, name in got.items() if name == "a"} == {(0, 0), (0, 1), (2, 0), (2, 1)} and len(got) == 8


def test_tile_paths_against_all_choices(spark):
    """The cheapest row of tiles whose ports agree, among all rows."""
    from itertools import product

    rng = random.Random(32)
    names = ("u", "d", "l", "r")
    tiles = [(i, rng.choice((1.0, 1.5, 2.25, 4.0)), t) for i, t in enumerate([{a: p, b: q} for i, a in enumerate(names) for b in names[i + 1 :] for p in (0, 1) for q in (0, 1) if rng.random() < 0.8] + [{a: p} for a in names for p in (0, 1)])]
    other = {"u": "d", "d": "u", "l": "r", "r": "l"}
    rows, want = [], {}
    for edge in range(25):
        steps = [rng.choice(names)]
        for _ in range(rng.randrange(4)):
            steps.append(rng.choice([n for n in names if n != other[steps[-1]]]))
        squares = [(to, back) for to, back in zip([*steps, None], [None, *[other[s] for s in steps]])]
        rows += [(edge, k, to, back) for k, (to, back) in enumerate(squares)]
        best = math.inf
        fitting = [[t for t in tiles if set(t[2]) == {x for x in sq if x}] for sq in squares]
        for row in product(*fitting):
            if all(a[2][steps[k]] == b[2][other[steps[k]]] for k, (a, b) in enumerate(zip(row, row[1:]))):
                best = min(best, sum(t[1] for t in row))
        want[edge] = best
    got = {}
    df = spark.createDataFrame(rows, "edge_id long, pos int, to string, back string")
    for r in network.tile_paths(df, tiles).collect():
        got.setdefault(r["edge_id"], {})[r["pos"]] = tiles[r["tile"]]
    for edge, best in want.items():
        if best == math.inf:
            assert edge not in got
            continue
        own = [(k, to, back) for e, k, to, back in rows if e == edge]
        assert abs(sum(got[edge][k][1] for k, _, _ in own) - best) < 1e-9
        assert all(set(got[edge][k][2]) == {x for x in (to, back) if x} for k, to, back in own)
        assert all(got[edge][k][2][to] == got[edge][k + 1][2][other[to]] for k, to, _ in own if to)


def test_tile_paths_go_through_many_edges_at_once(spark):
    """No call per edge; edges of one square have no tiles."""
    squares = spark.range(3000).selectExpr("id edge_id", "0 pos", "if(id % 100 = 0, 'r', null) to", "cast(null as string) back").union(spark.sql("select id * 100, 1, null, 'l' from range(30)"))
    found = network.tile_paths(squares, [(7, 1.0, {"l": 0}), (8, 1.0, {"r": 0})])
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted((r["edge_id"], r["pos"], r["tile"]) for r in found.collect()) == sorted((100 * i, k, 8 - k) for i in range(30) for k in (0, 1))



def test_strokes_set_each_cell_once(spark):
    rng = random.Random(33)
    rows = [(page, menu, x, y) for page in (0, 1) for menu in ("Ground 1", "Walls") for x in range(20) for y in range(18) if rng.random() < 0.8 or (x < 8 and y < 8)]
    df = spark.createDataFrame(rows, "page int, menu string, px int, py int")
    got = []
    for r in paging.brushes(df, ("page", "menu")).collect():
        half = r["brush"] // 2
        assert r["menu"] != "Walls" or r["brush"] == 1
        got += [(r["page"], r["menu"], x, y) for x in range(r["x"] - half, r["x"] + half + 1) for y in range(r["y"] - half, r["y"] + half + 1)]
    assert sorted(got) == sorted(rows)


def test_stream_of_actions_is_in_order(spark):
    """Against a loop over the pages of a small map, with strokes."""
    rng = random.Random(7)
    cells = [(float(x), float(y), float(rng.choice((18, 19, 22)))) for x in range(51) for y in range(25) if rng.random() < 0.8]
    own = spark.createDataFrame([*cells, (50.0, 24.0, None)], "x double, y double, z double").repartition(5)
    strokes = [(1, 0, "Ground", 3, 4, 4), (1, 0, "Ground", 1, 2, 2), (0, 0, "Brush", 1, 1, 1), (1, 1, "Brush", 1, 0, 0)]
    start = paging.start_size(own)
    assert start == (52, 26)
    got = sorted(tuple(r) for r in paging.stream(own, spark.createDataFrame(strokes, "page_x int, page_y int, menu string, brush int, x int, y int"), start).collect())
    assert [r[0] for r in got] == list(range(1, len(got) + 1))
    want, height, size = [], 20, list(start)
    # 51 x 25 cells: two pages of 24 and a rest of 2 across, one of 22 and a rest of 2 upward
    for py in (0, 1):
        for px in (0, 1, 2):
            shown = [26 + 24 * px if px < 2 else 2 * 26 - 2 + 2, 26 if py == 0 else 26 + 2]
            first = size == list(start)
            for k, name in ((0, "horizontal"), (1, "vertical")):
                n, less = abs(size[k] - shown[k]) // 2, shown[k] <= size[k]
                if n:
                    want.append((py, px, "button", f"{name}_{'minus' if less else 'plus'}", n))
                    if not first:
                        want.append((py, px, "button", f"{name}_{'plus2' if less else 'minus2'}", n))
            size = shown
            x1 = 50 - 24 * px
            on = [c for c in cells if max(x1 - 24, 0) <= c[0] < x1 and (c[1] < 22 if py == 0 else 22 <= c[1] < 24)]
            for z in sorted({c[2] for c in on}):
                if z != height:
                    want.append((py, px, "key", "+" if z > height else "-", int(abs(z - height))))
                height = z
                want += [(py, px, "height", None, 1)] * sum(c[2] == z for c in on)
            want += [(py, px, "brush", m, 1) for x, y, m, *_ in sorted(strokes, key=lambda s: (s[2], -s[3], s[4])) if (x, y) == (px, py)]
    assert [r[1:6] for r in got] == want


def test_rings_with_turns_share_areas(spark):
    """Concave rings, in either sense, against a fine raster of points; and closed forms."""
    rng = np.random.default_rng(8)

    def star(n, cx, cy):
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        r = rng.uniform(1, 6, n)
        return np.stack([cx + r * np.cos(t), cy + r * np.sin(t)], 1)

    def inside(p, ring):
        odd = np.zeros(len(p), bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
            odd ^= ((ay > p[:, 1]) != (by > p[:, 1])) & (p[:, 0] < (bx - ax) * (p[:, 1] - ay) / (by - ay) + ax)
        return odd

    pairs = [(star(9, 0, 0), star(8, rng.uniform(-3, 3), rng.uniform(-3, 3))[:: (-1) ** k]) for k in range(12)]
    comb = np.array([(0, 0), (6, 0), (6, 4), (5, 4), (5, 1), (3, 1), (3, 4), (2, 4), (2, 1), (0, 1)], float)
    pairs += [(comb, comb + [0, 2]), (comb, comb), (comb, comb + [20, 0])]
    point = "array<struct<x:double,y:double>>"
    rows = [(k, *[[(float(x), float(y)) for x, y in r] for r in p]) for k, p in enumerate(pairs)]
    got = {r["k"]: r["o"] for r in spark.createDataFrame(rows, f"k int, a {point}, b {point}").select("k", g.overlap(F.col("a"), F.col("b")).alias("o")).collect()}
    step = 0.02
    at = np.stack([v.ravel() for v in np.mgrid[-7:7:step, -7:7:step]], 1) + step / 2
    for k, (a, b) in enumerate(pairs[:12]):
        want = (inside(at, a) & inside(at, b)).sum() * step * step
        assert abs(got[k]["shared"] - want) < 0.15, (k, got[k], want)
    # teeth of one comb between x = 2 and 3, 5 and 6 meet the other's back and its own teeth
    assert abs(got[12]["shared"] - (2 * 1 * 2)) < 1e-9 and abs(got[13]["iou"] - 1) < 1e-9 and got[14]["shared"] == 0
