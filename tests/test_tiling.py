"""Tiles of networks, against going through all rows of tiles, route by route."""

import os
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from gridloom import queries as engine
from gridloom.functions.labels import STEPS
from gridloom.operators import catalogues, network, rounds, tiling
from gridloom.plans import maps
from gridloom.sources import readers

PATH = "component int, rank int, edge_id long, pos int, xidx int, yidx int"
BACK = {"u": "d", "d": "u", "l": "r", "r": "l"}


def catalogue(rng):
    sides = [c for n in (2, 3, 4) for c in combinations("udlr", n)]
    out = []
    for c in sides:
        for ports in rng.sample(list(product((1, 2), repeat=len(c))), 3 if len(c) > 2 else 2):
            out.append(tiling.Tile(len(out) + 1, rng.choice((1.0, 2.0, 5.0)), dict(zip(c, ports))))
    return out


def side(a, b):
    return STEPS[b[0] - a[0], b[1] - a[1]]


def every_row(squares, needs, tiles):
    """All rows of tiles along squares: (cost, numbers)."""
    found = [(0.0, [])]
    for k, need in enumerate(needs):
        new = []
        for cost, row in found:
            for t in tiles:
                if set(t.ports) == need and (not row or tiles[row[-1] - 1].ports[side(squares[k - 1], squares[k])] == t.ports[side(squares[k], squares[k - 1])]):
                    new.append((cost + t.cost, [*row, t.number]))
        found = new
    return found


def loop(walks, tiles):
    """walks: (component, rank, edge, squares) -> (component, edge, part) -> (pairs that may be, cost and ends)."""
    ports = {}
    for c, _, _, sq in walks:
        for a, b in zip(sq, sq[1:]):
            ports.setdefault((c, a), set()).add(side(a, b))
            ports.setdefault((c, b), set()).add(side(b, a))
    parts = []
    for c, rank, e, sq in walks:
        cuts = [0, *[k for k in range(1, len(sq) - 1) if len(ports[c, sq[k]]) > 2], len(sq) - 1]
        parts += [(rank, e, p, c, sq[a : b + 1]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    sides = {}
    for *_, c, sq in parts:
        sides.setdefault((c, sq[0]), set()).add(side(sq[0], sq[1]))
        sides.setdefault((c, sq[-1]), set()).add(side(sq[-1], sq[-2]))
    sides = {k: v | {BACK[next(iter(v))]} if len(v) == 1 else v for k, v in sides.items()}
    rows, allowed = {}, {}
    for rank, e, p, c, sq in parts:
        needs = [sides[c, sq[0]], *[{side(b, a), side(b, d)} for a, b, d in zip(sq, sq[1:], sq[2:])], sides[c, sq[-1]]]
        rows[rank, e, p, c] = own = [r for r in every_row(sq, needs, tiles) if sq[0] != sq[-1] or r[1][0] == r[1][-1]]
        for at, i in ((sq[0], 0), (sq[-1], -1)):
            ok = {r[1][i] for r in own}
            if ok:
                allowed[c, at] = allowed.get((c, at), ok) & ok
    out = {}
    for rank, e, p, c, sq in sorted(parts):
        a, b = (c, sq[0]), (c, sq[-1])
        for s, t in product(sorted(allowed.get(a, ())), sorted(allowed.get(b, ()))):
            fit = [r for r in rows[rank, e, p, c] if (r[1][0], r[1][-1]) == (s, t)]
            if fit:
                out[c, e, p] = (min(fit)[0], s, t)
                allowed[a], allowed[b] = {s}, {t}
                break
    return out


def table(spark, walks):
    return spark.createDataFrame([(c, rank, e, i, *xy) for c, rank, e, sq in walks for i, xy in enumerate(sq)], PATH)


@pytest.mark.parametrize("tile", [64, 2])
def test_tiles_of_networks(spark, monkeypatch, tile):
    monkeypatch.setattr(rounds, "TILE", tile)
    rng = random.Random(11)
    tiles, walks = catalogue(rng), []
    for e in range(24):
        sq = [(rng.randrange(6), rng.randrange(6))]
        for _ in range(rng.randrange(2, 7)):
            near = [(sq[-1][0] + dx, sq[-1][1] + dy) for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            near = [x for x in near if 0 <= x[0] < 6 and 0 <= x[1] < 6 and x not in sq]
            sq += [rng.choice(near)] if near else []
        if len(sq) > 1:
            walks.append((e % 3, rng.randrange(4), e, sq))
    walks.append((1, 9, 50, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]))
    walks.append((3, 0, 51, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]))
    found = tiling.tiled(table(spark, walks), tiles).collect()
    cost = {t.number: t.cost for t in tiles}
    got, nodes = {}, {}
    for r in sorted(found, key=lambda r: r["pos"]):
        got.setdefault((r["component"], r["edge_id"], r["part"]), []).append(r)
    want = loop(walks, tiles)
    assert len(want) > 15 and got.keys() == want.keys()
    assert {k: (sum(cost[r["tile"]] for r in v), v[0]["tile"], v[-1]["tile"]) for k, v in got.items()} == want
    for v in got.values():  # tiles agree at every border, and routes at every node
        for a, b in zip(v, v[1:]):
            name = side((a["xidx"], a["yidx"]), (b["xidx"], b["yidx"]))
            assert tiles[a["tile"] - 1].ports[name] == tiles[b["tile"] - 1].ports[BACK[name]]
        for r in (v[0], v[-1]):
            assert nodes.setdefault((r["component"], r["xidx"], r["yidx"]), r["tile"]) == r["tile"]


def test_folders_are_swept(spark):
    own = rounds.written(spark.range(3), f"{rounds.new_folder(spark, 'test')}/1")
    path = rounds._folders[-1]
    assert own.count() == 3 and os.path.isdir(path)
    rounds.sweep(spark)
    assert not os.path.exists(path) and not rounds._folders


def test_networks_without_tiles(spark):
    tiles = catalogue(random.Random(1))
    own = spark.createDataFrame([(1, 0, 1, None, None, None), (1, 0, 2, 0, 3, 3), (1, None, 3, 0, 1, 1), (1, None, 3, 1, 2, 1)], PATH)
    assert {r["edge_id"] for r in tiling.tiled(own, tiles).collect()} == {3}
    assert tiling.tiled(own, []).count() == 0
    assert tiling.tiled(own.limit(0), tiles).count() == 0
    apart = spark.createDataFrame([(1, 0, 1, 0, 0, 0), (1, 0, 1, 1, 5, 5)], PATH)
    assert tiling.tiled(apart, tiles).count() == 0


def test_lines_on_the_map(spark):
    """Lines that leave and come back, end off the map, run along its border, or miss it."""
    lines = {1: [(5, 5), (5, 30), (9, 30), (9, 5)], 2: [(-5, 10), (25, 10)], 3: [(30, 0), (30, 9)], 4: [(2, 2), (4, 4), (4, 4), (6, 2)], 5: [(-4, 4), (4, -4)], 6: [(0, 3), (0, 8)], 7: [(1, 1)]}
    own = spark.createDataFrame([(k, "n", [(float(x), float(y)) for x, y in v]) for k, v in lines.items()], "line int, name string, coords array<struct<x:double,y:double>>")
    got = {(r["line"], r["piece"]): [(p["x"], p["y"]) for p in r["coords"]] for r in network.collected(own, 20.0, 20.0).collect()}
    assert got == {(1, 1): [(5, 5), (5, 20)], (1, 2): [(9, 20), (9, 5)], (2, 1): [(0, 10), (20, 10)], (4, 1): [(2, 2), (4, 4), (4, 4), (6, 2)], (6, 1): [(0, 3), (0, 8)]}


def test_components_of_edges(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    own = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "edge_id int, src long, dst long")
    assert {r["edge_id"]: r["component"] for r in network.components(own).collect()} == {i: find(a) for i, (a, _) in enumerate(pairs)}
    assert network.components(own.limit(0)).count() == 0


@pytest.mark.parametrize("priority", [0, 1])
def test_roads_of_a_map(spark, priority):
    """Two roads that cross, and a fence over them that doesn't: tiles by what meets in each cell. Cells of
    roads are closed to the fence, unless the roads' priority is below 1."""
    config = {
        "road": {"priority": priority, "tags": [["r", "1"], ["r", "2"]], "process": ["road_tiles"], "cm_types": [{"menu": "Road", "cat1": "Paved", "tags": [["r", "1"]]}]},
        "fence": {"priority": 2, "tags": [["f", "1"]], "process": ["fence_tiles"], "cm_types": [{"menu": "Fence", "cat1": "Wood", "tags": [["f", "1"]]}]},
    }
    point = "struct<x:double,y:double>"
    features = [("1", {"r": "1"}, [[(4.0, 20.0), (44.0, 20.0)]]), ("2", {"r": "1"}, [[(20.0, 4.0), (20.0, 36.0)], [(1.0, 1.0)]]), ("3", {"r": "2"}, [[(4.0, 60.0), (36.0, 60.0)]]), ("4", {"f": "1"}, [[(-30.0, 28.0), (28.0, 28.0)]])]
    own = spark.createDataFrame([(i, t, None, ls) for i, t, ls in features], f"id string, tags map<string,string>, ring array<{point}>, lines array<array<{point}>>")
    sides = [c for n in (2, 3, 4) for c in combinations("udlr", n)]
    tiles = catalogues.tiles(spark, {(i % 4, i // 3, i % 3): {s: [1] for s in c} for i, c in enumerate(sides)}, "road")
    both = tiles.union(tiles.withColumns({"kind": F.lit("fence")}))
    got = maps.build(own, readers.rule_table(spark, config), F.col("id").cast("long"), (6, 8), {"menu": "Ground"}, maps.network_operators(both, (6, 8))).where("name <> 'default_ground'")
    name = {frozenset(c): (f"Direction {i % 4 + 1}", f"Road Tile {i + 1}") for i, c in enumerate(sides)}
    want = {}
    for x in range(6):
        want["road", x, 2] = name[frozenset("lr")]
    for y in (0, 1, 3, 4):
        want["road", 2, y] = name[frozenset("ud")]
    want["road", 2, 2] = name[frozenset("udlr")]
    found = {(r["name"], r["xidx"], r["yidx"]): (r["direction"], r["cat2"]) for r in got.collect()}
    fences = {k: found.pop(k) for k in list(found) if k[0] == "fence"}
    assert found == want
    straight = {("fence", x, 3): name[frozenset("lr")] for x in range(4)}
    turns = [(0, 3, "lr"), (1, 3, "lu"), (1, 4, "ud"), (1, 5, "dr"), (2, 5, "lr"), (3, 5, "ld"), (3, 4, "ud"), (3, 3, "ud")]
    assert fences == (straight if priority < 1 else {("fence", x, y): name[frozenset(c)] for x, y, c in turns})


def test_routes_of_one_square_go_no_further(spark):
    """They and edges without a route are left out before routes are cut and given tiles, with the same rows."""
    rows = [(1, 0, 3, 4), (2, 0, 3, 3), (2, 1, 3, 4), (2, 2, 4, 4), (3, None, None, None), (4, 0, 6, 3), (4, 1, 6, 4), (4, 2, 7, 4)]
    path = spark.createDataFrame(rows, "edge_id long, pos int, xidx int, yidx int")
    few = network.several(path)
    assert {r["edge_id"] for r in few.collect()} == {2, 4}

    def tiles(p):
        ranked = p.withColumns({"rank": F.lit(0).cast("long"), "component": F.lit(0).cast("long")})
        return sorted(map(tuple, tiling.tiled(ranked, engine.junction_tiles()).collect()))

    assert tiles(few) == tiles(path) != []


def test_tile_paths_get_no_routes_of_one_square(monkeypatch, spark):
    """The query leaves them out before squares are sorted, with the same rows."""
    rows = [(1, 0, 3, 4), (2, 0, 3, 3), (2, 1, 3, 4), (2, 2, 4, 4), (3, None, None, None)]
    path = spark.createDataFrame(rows, "edge_id long, pos int, xidx int, yidx int")
    seen, real = [], network.tile_paths
    monkeypatch.setattr(engine, "path_search", lambda *_: path)
    monkeypatch.setattr(network, "tile_paths", lambda squares, tiles: seen.append(squares) or real(squares, tiles))
    got = sorted(map(tuple, engine.tile_paths(spark, "").collect()))
    assert {r["edge_id"] for r in seen[0].collect()} == {2}
    assert got == sorted(map(tuple, real(network.with_directions(path), engine.tile_set()).collect())) != []
