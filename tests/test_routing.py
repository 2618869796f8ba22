"""Routes in rounds of map tiles, against one loop over all edges, and single routes against all walks."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridloom import queries as engine
from gridloom.functions.labels import STEPS
from gridloom.operators import network, routing

EDGES = "edge_id long, rank long, line array<struct<x:double,y:double>>"
# no tile has sides l, d and r, nor all of u, d and l
TILES = ["ud", "lr", "ul", "ur", "dl", "dr", "udr", "ulr"]


def lines(rng, n, size):
    out = []
    for _ in range(n):
        at = [(rng.uniform(0, size), rng.uniform(0, size))]
        for _ in range(rng.randrange(1, 4)):
            at.append(tuple(min(max(c + rng.uniform(-7, 7), 0.0), size - 0.01) for c in at[-1]))
        out.append(at)
    return out


def table(spark, edges):
    return spark.createDataFrame([(e, r, [{"x": x, "y": y} for x, y in line] if line is not None else None) for e, r, line in edges], EDGES).repartition(3)


def paths(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["edge_id"], []).extend([] if r["pos"] is None else [(r["pos"], r["xidx"], r["yidx"])])
    return {e: [c[1:] for c in sorted(p)] or None for e, p in got.items()}


def blocks_of(line):
    m, size, out = routing.MARGIN, routing.BLOCK, set()
    for a, b in zip(line, [*line[1:], line[-1]]):
        n = max(math.ceil(max(abs(a[0] - b[0]), abs(a[1] - b[1])) / size), 1)
        for k in range(n):
            xs, ys = zip(*[[a[i] + (b[i] - a[i]) * (k + d) / n for i in (0, 1)] for d in (0, 1)])
            out |= {(x, y) for x in range(math.floor((min(xs) - m) / size), math.floor((max(xs) + m) / size) + 1) for y in range(math.floor((min(ys) - m) / size), math.floor((max(ys) + m) / size) + 1)}
    return out


def loop(edges, box, known, closed=()):
    """Routes, and how many there were before mending."""
    r = routing.Router(routing.Lattice(closed), box, known)

    def rank(e):
        return e[1] is None, e[1] or 0

    def color(e):
        return int(e[2][0][0] // routing.SQUARE) % 2 * 2 + int(e[2][0][1] // routing.SQUARE) % 2 if e[2] else 0

    r.lines = {e: line for e, _, line in edges}
    blocks = {e: blocks_of(line) if line else set() for e, _, line in edges}
    for e in sorted(edges, key=lambda e: (rank(e), color(e), e[0])):
        r.lay(e[0])
    before = len(r.lattice.paths)
    for e, _, line in sorted(edges, key=lambda e: (color(e), rank(e), e[0])):
        if e not in r.lattice.paths and line:
            r.mend(e, {k for k in blocks if k != e and blocks[k] & blocks[e]})
    return r.lattice.paths, before


@pytest.mark.parametrize(("tile", "few"), [(14, 6), (28, 3), (4096, 0)])
def test_same_routes_as_a_loop(monkeypatch, spark, tile, few):
    monkeypatch.setattr(routing, "SQUARE", 14)
    rng = random.Random(12)
    size = 40
    edges = [(i, rng.choice([0, 1, None]), line) for i, line in enumerate(lines(rng, 45, size))]
    edges += [(200, 1, [(-5.0, 3.0), (4.0, 4.0)]), (201, 0, []), (202, None, None), (203, 1, [(3.2, 3.2), (3.4, 3.9)])]
    closed = [(rng.randrange(size), rng.randrange(size)) for _ in range(30)]
    known = routing.Catalogue("udlr", TILES)
    want, before = loop(edges, (size, size), known, closed)
    assert before < len(want) < len(edges) - 1  # some are mended, some stay without
    shut = spark.createDataFrame([*closed, closed[0]], "xidx int, yidx int")
    found = routing.routed(table(spark, edges), (size, size), "udlr", TILES, shut, tile, few)
    got = paths(found)
    assert got == {e: want.get(e) for e, _, _ in edges}
    # ports are used once, cells fit a tile, closed ones are not entered
    ports = [(c, b) for p in got.values() if p for c, s in routing.sides_of(p) for b in routing.bits(s)]
    assert len(ports) == len(set(ports))
    sides = {}
    for c, b in ports:
        sides[c] = sides.get(c, 0) | b
    assert all(known.fits[s] for s in sides.values()) and not set(sides) & set(closed)
    assert all(r["valid"] for r in network.valid_path(found).collect())
    assert routing.routed(table(spark, edges[:1]).limit(0), (9, 9)).collect() == []


def test_reach_covers_routes(spark):
    rng = random.Random(2)
    edges = [(i, 0, line) for i, line in enumerate(lines(rng, 40, 300))] + [(40, 0, [(10.0, 10.0), (290.0, 120.0)])]
    got = {r["edge_id"]: set(r["b"]) for r in table(spark, edges).select("edge_id", routing.reach(F.col("line")).alias("b")).collect()}
    for e, _, line in edges:
        assert got[e] == {x * (1 << 32) + y for x, y in blocks_of(line)}


def every_walk(start, goal, box, limit):
    """All walks that come to no cell twice."""
    todo = [[start]]
    while todo:
        p = todo.pop()
        if p[-1] == goal:
            yield p
        elif len(p) <= limit:
            todo += [[*p, (p[-1][0] + dx, p[-1][1] + dy)] for (dx, dy), n in STEPS.items() if n in "udlr" and 0 <= p[-1][0] + dx < box[0] and 0 <= p[-1][1] + dy < box[1] and (p[-1][0] + dx, p[-1][1] + dy) not in p]


def test_cheapest_route_where_tiles_fit():
    """Against all walks on a small lattice, with sides in use, for catalogues that leave some out."""
    rng = random.Random(9)
    box, met, without = (5, 4), 0, 0
    for _ in range(120):
        tiles = rng.sample(["".join(c) for n in (2, 3) for c in combinations("udlr", n)], 6)
        known = routing.Catalogue("udlr", tiles)
        lattice = routing.Lattice([(rng.randrange(5), rng.randrange(4))])
        for k in range(rng.randrange(3)):
            a = rng.randrange(4), rng.randrange(4)
            lattice.take(k, [a, (a[0] + 1, a[1])])
        line = [(rng.uniform(0, 5), rng.uniform(0, 4)), (rng.uniform(0, 5), rng.uniform(0, 4))]
        start, goal = routing.ends_of(line)
        if start == goal or {start, goal} & lattice.closed:
            continue
        limit, best = routing.LONGEST * math.dist(*line) + 2, math.inf

        def cost(p, line=line):
            return sum(routing.line_distance(x + 0.5, y + 0.5, line) + 1e-6 for x, y in p[1:])

        for p in every_walk(start, goal, box, limit):
            if len(p) - 1 > limit or set(p) & lattice.closed:
                continue
            sides = routing.sides_of(p)
            if all(not lattice.used(c) & s and known.fits[lattice.used(c) | s] for c, s in sides) and all(lattice.used(c).bit_count() < 2 for c in p[1:-1]):
                best = min(best, cost(p))
        found = routing.route(line, lattice.used, lattice.closed, box, known)
        if found is None:
            without += best == math.inf
        else:
            met += abs(cost(found) - best) < 1e-9
        assert (found is None) == (best == math.inf)
    assert met > 40 and without


def test_the_part_of_a_line_is_as_near():
    """The nearest point of the part of a line up to a point's projection is that of the whole line."""
    rng = random.Random(5)
    for _ in range(200):
        line = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randrange(2, 5))]
        x, y = rng.uniform(0, 9), rng.uniform(0, 9)
        near = []
        for k, (a, b) in enumerate(zip(line, line[1:])):
            n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
            t = max(0.0, min(1.0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / n))
            at = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
            near.append((math.dist((x, y), at), k, at))
        _, k, at = min(near)
        assert abs(routing.line_distance(x, y, [*line[: k + 1], at]) - routing.line_distance(x, y, line)) < 1e-9


def test_registered_routes_are_whole(spark):
    """Almost all edges have a route, from one end's cell to the other's or beside them."""
    sf = "/root/testdata/sf0.001"
    edges = {r["edge_id"]: r["line"] for r in engine.path_edges(spark, sf).collect()}
    got = paths(engine.path_search(spark, sf))
    assert set(got) == set(edges) and len(got) >= 10
    assert sum(p is None for p in got.values()) <= 0.02 * len(got)
    for e, p in got.items():
        for at, cell in ((edges[e][0], p[0]), (edges[e][-1], p[-1])) if p else ():
            assert max(abs(math.floor(at["x"]) - cell[0]), abs(math.floor(at["y"]) - cell[1])) <= 1


def test_cheapest_walks_with_few_steps():
    """Against all walks, on small lattices with random costs."""
    rng = random.Random(31)
    for _ in range(30):
        cost = {(x, y): rng.choice((0.1, 1.0, 3.0)) for x in range(4) for y in range(3)}

        def moves(at):
            return [(to, cost[to]) for to in ((at[0] + 1, at[1]), (at[0] - 1, at[1]), (at[0], at[1] + 1), (at[0], at[1] - 1)) if to in cost]

        best = {0: {(0, 0): 0.0}}  # by number of steps
        for n in range(12):
            best[n + 1] = {}
            for at, c in best[n].items():
                for to, step in moves(at):
                    best[n + 1][to] = min(best[n + 1].get(to, math.inf), c + step)
        for limit in (3, 5, 7, 12):
            want = min((b.get((3, 2), math.inf) for n, b in best.items() if n <= limit), default=math.inf)
            path = routing.cheapest((0, 0), lambda at: at == (3, 2), moves, limit, lambda at: 3 - at[0] + 2 - at[1])
            if want == math.inf:
                assert path is None
            else:
                assert len(path) - 1 <= limit and abs(sum(cost[p] for p in path[1:]) - want) < 1e-9
        assert abs(sum(cost[p] for p in routing.cheapest((0, 0), lambda at: at == (3, 2), moves)[1:]) - min(b.get((3, 2), math.inf) for b in best.values())) < 1e-9


def test_routes_that_take_turns_are_given_up(monkeypatch):
    """Two edges over one border, neither of which can go another way: no more turns once they repeat."""
    known = routing.Catalogue("udlr", None)
    router = routing.Router(routing.Lattice(), (9, 9), known)
    router.lines = {1: [(3.9, 3.5), (4.1, 3.5)], 2: [(3.95, 3.6), (4.05, 3.6)]}
    calls, real = [], router.route
    monkeypatch.setattr(router, "route", lambda e, used, ends=None: calls.append(ends) or real(e, used, ends))
    assert router.lay(1) and not router.lay(2)
    changed = router.mend(2, {1})
    assert router.lattice.paths[1] == [(3, 3), (4, 3)] and changed in (set(), {2})
    assert sum(ends is None for ends in calls) < 10


def test_edges_within_a_cell_take_no_turn(monkeypatch, spark):
    """They have their cell at once, unless it is closed or off the map."""
    seen, real = [], routing.flagged
    monkeypatch.setattr(routing, "flagged", lambda left, *more: seen.append({r["edge_id"] for r in left.select("edge_id").collect()}) or real(left, *more))
    edges = [(1, 0, [(2.1, 2.1), (2.9, 2.2)]), (2, 0, [(2.5, 2.5)]), (3, 1, [(5.1, 5.1), (5.2, 5.3)]), (4, None, [(-0.5, 1.0), (-0.4, 1.0)]), (5, 0, [(1.5, 2.5), (4.5, 2.5)]), (6, 0, []), (7, 0, None)]
    closed = spark.createDataFrame([(5, 5)], "xidx int, yidx int")
    got = paths(routing.routed(table(spark, edges), (9, 9), closed=closed))
    assert got[1] == got[2] == [(2, 2)] and got[5] == [(1, 2), (2, 2), (3, 2), (4, 2)] and got[6] is got[7] is None
    assert got.keys() == set(range(1, 8)) and seen[0] == {3, 4, 5, 6, 7}


def test_short_edges_that_are_alike(monkeypatch, spark):
    """Of those over one border only the first takes a turn, and what failed isn't tried again for others
    like it; the rows are those of a loop that tries all."""
    turns, real = [], routing.flagged
    monkeypatch.setattr(routing, "flagged", lambda left, *more: turns.append(left.count()) or real(left, *more))
    rng = random.Random(8)
    size, edges = 7, []
    for i in range(700):
        x, y, a, far = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(0, 7), rng.choice((0.3, 0.3, 0.6, 1.1))
        edges.append((i, rng.randrange(3), [(x, y), (min(max(x + far * math.cos(a), 0.0), size - 0.01), min(max(y + far * math.sin(a), 0.0), size - 0.01))]))
    known = routing.Catalogue("udlr", None)
    want, before = loop(edges, (size, size), known)
    moving = [e for e, _, line in edges if len(set(routing.ends_of(line))) > 1]
    lost = len(edges) - before
    assert len(want) > before and lost > 100
    found = paths(routing.routed(table(spark, edges), (size, size), "udlr", None, None, 4096, 0))
    assert found == {e: want.get(e) for e, _, _ in edges}
    assert turns[0] < len(moving) - 20

    # in mending, with what every edge is beside
    router = routing.Router(routing.Lattice(), (size, size), known)
    router.lines = {e: line for e, _, line in edges}
    order = sorted(edges, key=lambda e: (e[1], e[0]))
    for e, _, _ in order:
        router.lay(e)
    assert len(router.lattice.paths) == before
    tried, attempt = [], router.attempt
    monkeypatch.setattr(router, "attempt", lambda e, *more: tried.append(e) or attempt(e, *more))
    everyone = {e for e, _, _ in edges}
    for e, _, _ in order:
        if e not in router.lattice.paths:
            router.mend(e, everyone & router.lattice.paths.keys(), area="all")
    assert router.lattice.paths == want and len(tried) < lost
