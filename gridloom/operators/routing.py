"""Routes of a network over the cell lattice, in rounds of map tiles.

Edges choose their routes in order. A route runs near its line, so an edge waits only for earlier ones
whose lines come near its own; which ones may is told by blocks of cells that both can reach. In each
round a task per map tile routes what waits for nothing in another tile; a few that are left at last
are settled by one. Then edges that found their way taken are mended, in order: one transaction each
rips up routes beside it and lays them again, and holds only if all of them are laid. An edge that this
doesn't help may end at cells beside its ends. Mending reaches as far as the blocks of its neighbours,
and waits in rounds the same way. The rows are those of one loop over all edges, whatever the tiles
are; a tile's lines and the routes near them are all that a task holds, whatever the size of a
connected component.

Where lines are dense, many edges lie between the same two cells and can't be told apart. Of those that
can go straight over one border only, the first takes it or nobody does, so the others take no turn; in
a task, what had no way has none later either, as nothing laid is taken away before mending. An edge
that can't be mended isn't tried again for others like it until a cell that the attempt looked at changes.

The order is by rank, then by colour, then by edge_id; for mending, by colour first. Squares of SQUARE
cells have four colours, so that neighbours differ: all edges of a colour that don't reach across
a whole square are settled in one round, and rounds are some four times the number of ranks.

A step costs the distance of the entered cell's centre from the line; the part of the line up to
the centre's projection is as near as the whole line, so no more need be kept of it. A port that another
route has is closed; so is an inner cell with two connections; and so is a cell where no tile of the
catalogue has all the sides in use there, those of the route itself included. The search therefore goes
over cells with the side they were entered by. Closed cells are those of networks laid before.

Cases: an edge without a route gives one row of nulls; an edge within one cell that isn't closed gives
that cell; null ranks come last; edge_id must be unique; lines without points have no route; other
columns are ignored; no edges, no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.labels import STEPS
from gridloom.operators import rounds

# Costs above this are not walked, a route is no longer than this times its line.
DEAREST, LONGEST = 5.0, 2.0
#: Routes that a transaction lays at most before it is given up.
TURNS = 40
#: Cells along the edge of a block, by which edges tell whether they may meet.
BLOCK = 16
#: Cells along the edge of a square, whose colour is part of the order.
SQUARE = 128
#: Cells along the edge of a tile, which one task settles in a round.
TILE = SQUARE
#: So many edges or fewer, with what is near them, are settled by one task.
FEW = 1000
#: Steps up to which all cells that a walk between two ends can reach are within DEAREST of any line between them.
NEAR = 6
#: Cells beyond a line that its route can reach: DEAREST from a cell's centre.
MARGIN = DEAREST + 1
SIDES = {name: 1 << i for i, name in enumerate(STEPS.values())}
OPPOSITE = {"u": "d", "d": "u", "l": "r", "r": "l", "ur": "dl", "dl": "ur", "ul": "dr", "dr": "ul"}
EDGE = "edge_id bigint, rank bigint, color int, tile bigint, line array<struct<x:double,y:double>>, blocks array<bigint>"
#: What comes first when edges are laid, and when they are mended.
LAY, MEND = ("rank", "color"), ("color", "rank")
#: How far either end of a route may be moved, the least first.
ASIDE = [(m[:2], m[2:]) for m in sorted(product((0, 1, -1), repeat=4), key=lambda m: sum(map(abs, m))) if any(m)]
PATH = "path array<struct<x:int,y:int,sides:int>>"

Cell = tuple[int, int]
Line = list[tuple[float, float]]


def line_distance(x: float, y: float, line: Line) -> float:
    best = math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:] or line, strict=False):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / n))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def ends_of(line: Line) -> tuple[Cell, Cell]:
    start, goal = ((math.floor(p[0]), math.floor(p[1])) for p in (line[0], line[-1]))
    return start, goal


def most_steps(line: Line) -> float:
    return LONGEST * sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False)) + 2


def cheapest(start: Any, done: Callable[[Any], bool], moves: Callable[[Any], Iterable[tuple[Any, float]]], limit: float = math.inf, ahead: Callable[[Any], int] = lambda at: 0, apart: Callable[[Any], Any] | None = None) -> list[Any] | None:
    """Cheapest walk over states, of at most limit steps. With a limit a state has several labels, as a
    dearer way to it that takes fewer steps may be the one that can go on. ahead: steps from a state to
    the goal at least. apart: what a walk must not come to twice."""
    heap, labels, fewest, cost = [(0.0, 0, 0)], [(start, -1)], {}, {start: 0.0}

    def walk(k: int) -> Iterator[Any]:
        while k >= 0:
            at, k = labels[k]
            yield at

    while heap:
        c, hops, k = heapq.heappop(heap)
        at = labels[k][0]
        if at in fewest and (limit == math.inf or fewest[at] <= hops):
            continue
        fewest[at] = hops
        if done(at):
            return list(walk(k))[::-1]
        been = {apart(s) for s in walk(k)} if apart else ()
        for to, step in moves(at):
            if apart and apart(to) in been:
                continue
            if limit == math.inf:
                if to in fewest or cost.get(to, math.inf) <= c + step:
                    continue
                cost[to] = c + step
            elif hops + 1 + ahead(to) > limit or fewest.get(to, math.inf) <= hops + 1:
                continue
            labels.append((to, k))
            heapq.heappush(heap, (c + step, hops + 1, len(labels) - 1))
    return None


class Catalogue:
    """Which sides a cell may have: some tile has them all. Without tiles any sides go."""

    def __init__(self, steps: Iterable[str], tiles: Iterable[Iterable[str]] | None = None):
        self.steps = [(d, SIDES[n], SIDES[OPPOSITE[n]]) for d, n in STEPS.items() if n in set(steps)]
        masks = None if tiles is None else {sum(SIDES[s] for s in t) for t in tiles}
        self.fits = [masks is None or any(m & t == m for t in masks) for m in range(256)]
        self.diagonal = any(dx and dy for (dx, dy), _, _ in self.steps)
        ways = [b for _, b, _ in self.steps]
        #: Whether any two sides go wherever one does, so that the side entered by needn't be known.
        self.free = masks is None or all(self.fits[u | a | b] for u in [0, *ways] for a in ways for b in ways if len({u, a, b} - {0}) > 1)

    def apart(self, a: Cell, b: Cell) -> int:
        dx, dy = abs(a[0] - b[0]), abs(a[1] - b[1])
        return max(dx, dy) if self.diagonal else dx + dy


def route(line: Line, used: Callable[[Cell], int], closed: set[Cell] | frozenset[Cell], box: Cell, known: Catalogue, ends: tuple[Cell, Cell] | None = None, far: dict[Cell, float] | None = None) -> list[Cell] | None:
    """Cheapest walk over cells from a line's first to its last point, in cell units. used: the sides
    that routes have of a cell. far: distances of cells from the line so far. A walk that would come to a
    cell twice is searched for again without that."""
    start, goal = ends or ends_of(line)
    far = {} if far is None else far
    if any(c in closed or not (0 <= c[0] < box[0] and 0 <= c[1] < box[1]) for c in (start, goal)):
        return None
    if start == goal:
        return [start]
    limit = most_steps(line)
    fits, free = known.fits, known.free
    out, into = used(start), used(goal)
    if known.apart(start, goal) > limit or all(out & side or not fits[out | side] for _, side, _ in known.steps) or all(into & back or not fits[into | back] for _, _, back in known.steps):
        return None  # too far, or an end is full

    def moves(state: tuple[int, int, int]) -> Iterator[tuple[tuple[int, int, int], float]]:
        x, y, entered = state
        here = used((x, y))
        for (dx, dy), side, back in known.steps:
            to = (x + dx, y + dy)
            if here & side or side == entered or not (0 <= to[0] < box[0] and 0 <= to[1] < box[1]) or to in closed:
                continue
            there = used(to)
            if there & back or (to != goal and there.bit_count() > 1) or not fits[here | entered | side] or not fits[there | back]:
                continue
            if known.apart(start, to) + known.apart(to, goal) > limit:
                continue
            if to not in far:
                far[to] = line_distance(to[0] + 0.5, to[1] + 0.5, line)
            if far[to] <= DEAREST:
                yield (*to, 0 if free else back), far[to] + 1e-6

    def search(**more: Any) -> list[Any] | None:
        return cheapest((*start, 0), lambda s: s[:2] == goal, moves, **more)

    found = search()
    if found is None:
        return None
    if len(found) - 1 > limit:
        found = search(limit=limit, ahead=lambda s: known.apart(s[:2], goal))
    if found and len({s[:2] for s in found}) < len(found):
        found = search(limit=limit, ahead=lambda s: known.apart(s[:2], goal), apart=lambda s: s[:2])
    return [s[:2] for s in found] if found else None


def alike(line: Line, known: Catalogue) -> tuple[Any, ...] | None:
    """What a search can tell of a short line: the cells of its ends, its steps at most, and which of two
    ways round is cheaper. None where that isn't all."""
    a, b = sorted(ends_of(line))
    dx, dy, steps = abs(b[0] - a[0]), abs(b[1] - a[1]), int(most_steps(line))
    if not known.free or known.diagonal:
        return None
    if dx + dy == 1 and steps < 3:
        return a, b, steps
    if dx + dy == 1 and steps < 5:
        ways = [[(c[0] + d * dy, c[1] + d * dx) for c in (a, b)] for d in (1, -1)]
    elif dx == dy == 1 and steps < 4:
        ways = [[(a[0], b[1])], [(b[0], a[1])]]
    else:
        return None
    one, two = (sum(line_distance(x + 0.5, y + 0.5, line) for x, y in w) for w in ways)
    return (a, b, steps, one < two) if abs(one - two) > 1e-9 else None


def sides_of(path: list[Cell]) -> list[tuple[Cell, int]]:
    """Cells of a route and the sides that it has there."""
    out = [0] * len(path)
    for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
        name = STEPS[b[0] - a[0], b[1] - a[1]]
        out[i] |= SIDES[name]
        out[i + 1] |= SIDES[OPPOSITE[name]]
    return list(zip(path, out, strict=True))


class Lattice:
    """Sides of cells in use, and the edge that has each; cells that are closed."""

    def __init__(self, closed: Iterable[Cell] = ()) -> None:
        self.closed = set(closed)
        self.sides: dict[Cell, int] = {}
        self.holder: dict[tuple[Cell, int], int] = {}
        self.paths: dict[int, list[Cell]] = {}
        self.seen: set[Cell] = set()  # cells looked at, until it is emptied

    def used(self, cell: Cell) -> int:
        self.seen.add(cell)
        return self.sides.get(cell, 0)

    def hold(self, edge: int, cell: Cell, sides: int) -> None:
        self.sides[cell] = self.sides.get(cell, 0) | sides
        for b in bits(sides):
            self.holder[cell, b] = edge

    def take(self, edge: int, path: list[Cell]) -> None:
        self.paths[edge] = path
        for cell, sides in sides_of(path):
            self.hold(edge, cell, sides)

    def drop(self, edge: int) -> None:
        for cell, sides in sides_of(self.paths.pop(edge)):
            self.sides[cell] &= ~sides
            for b in bits(sides):
                del self.holder[cell, b]

    def holders(self, cell: Cell) -> set[int]:
        return {self.holder[cell, b] for b in bits(self.used(cell))}

    def used_but(self, loose: Callable[[int], bool]) -> Callable[[Cell], int]:
        """Sides in use by edges that are not loose."""
        return lambda cell: sum(b for b in bits(self.used(cell)) if not loose(self.holder[cell, b]))

    def in_the_way(self, path: list[Cell], known: Catalogue) -> list[int]:
        """Edges whose routes a path can't be laid beside."""
        found: set[int] = set()
        for k, (cell, sides) in enumerate(sides_of(path)):
            there = self.used(cell)
            found |= {self.holder[cell, b] for b in bits(there & sides)}
            if (0 < k < len(path) - 1 and there.bit_count() > 1) or not known.fits[there | sides]:
                found |= self.holders(cell)
        return sorted(found)


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low
        mask ^= low


class Router:
    """Edges of one tile, or of all: their lines, the lattice, and what both passes do with one edge."""

    def __init__(self, lattice: Lattice, box: Cell, known: Catalogue):
        self.lattice, self.box, self.known = lattice, box, known
        self.lines: dict[int, Line] = {}
        self.far: dict[int, dict[Cell, float]] = {}
        self.shut: dict[tuple[Cell, Cell], int] = {}  # steps that didn't suffice between two cells
        self.changed: dict[Cell, int] = {}  # how many had been mended when a cell changed last
        self.turn = 0
        self.hopeless: dict[Any, tuple[set[Cell], int, float, float]] = {}

    def route(self, edge: int, used: Callable[[Cell], int], ends: tuple[Cell, Cell] | None = None) -> list[Cell] | None:
        line = self.lines[edge]
        return route(line, used, self.lattice.closed, self.box, self.known, ends, self.far.setdefault(edge, {})) if line else None

    def lay(self, edge: int) -> bool:
        path = self.route(edge, self.lattice.used)
        if path:
            self.lattice.take(edge, path)
        return path is not None

    def forget(self, edge: int) -> None:
        """What is known of an edge without a route."""
        self.lines.pop(edge, None)
        self.far.pop(edge, None)

    def lay_first(self, edge: int) -> bool:
        """lay, before anything is mended."""
        line = self.lines[edge]
        if not line:
            return False
        a, b = sorted(ends_of(line))
        steps = int(most_steps(line))
        if steps <= NEAR and self.shut.get((a, b), 0) >= steps:
            return False
        if self.lay(edge):
            return True
        if steps <= NEAR:
            self.shut[a, b] = steps
        return False

    def mend(self, edge: int, *beside: set[int], area: Any = None) -> set[int]:
        """Edges whose routes have changed: this one and some of those beside it (in any of the sets), or
        none. area: the same for edges with the same sets. An attempt that failed isn't repeated
        for an edge like the one that failed while all cells that it looked at are as they were; numbers of
        edges count where several are ripped up at once."""
        same = alike(self.lines[edge], self.known) if area is not None and self.lines[edge] else None
        if same:
            seen, at, low, high = self.hopeless.get((same, area), (None, 0, 0, 0))
            if seen is not None and low < edge < high and all(self.changed.get(c, 0) <= at for c in seen):
                return set()
        self.lattice.seen = set()
        before: dict[int, list[Cell]] = {}  # of those that are ripped up
        span = [-math.inf, math.inf]  # numbers that the edge could have had as well
        new = self.attempt(edge, beside, before, span)
        if new:
            self.turn += 1
            for e in new:
                for c in (*before.get(e, ()), *self.lattice.paths[e]):
                    self.changed[c] = self.turn
        elif same:
            self.hopeless[same, area] = self.lattice.seen, self.turn, *span
        return new

    def attempt(self, edge: int, beside: Iterable[set[int]], before: dict[int, list[Cell]], span: list[float]) -> set[int]:
        if self.lay(edge):
            return {edge}

        def loose(e: int) -> bool:
            return e == edge or any(e in own for own in beside)

        fixed = self.lattice.used_but(loose)
        todo, laid, touched, seen = deque([edge]), set(), {edge}, set()
        for _ in range(TURNS):
            # routes that have taken each other's place go on like that for ever
            state = tuple(todo), frozenset((e, tuple(self.lattice.paths.get(e, ()))) for e in touched if self.lattice.paths.get(e) != before.get(e))
            if state in seen:
                break
            seen.add(state)
            e = todo.popleft()
            path = self.route(e, self.lattice.used)
            if not path:
                path = self.route(e, fixed)
                others = self.lattice.in_the_way(path, self.known) if path else []
                if not path or not all(map(loose, others)):
                    todo.appendleft(e)
                    break
                if edge in others:
                    span[0] = max([span[0], *(o for o in others if o < edge)])
                    span[1] = min([span[1], *(o for o in others if o > edge)])
                for other in others:
                    if other != edge:
                        before.setdefault(other, self.lattice.paths[other])
                    self.lattice.drop(other)
                    todo.append(other)
                    touched.add(other)
            self.lattice.take(e, path)
            laid.add(e)
            if not todo:
                return {e for e in laid if self.lattice.paths[e] != before.get(e)}
        for e in laid | {edge}:
            if e in self.lattice.paths:
                self.lattice.drop(e)
        for e, path in before.items():
            if e not in self.lattice.paths:
                self.lattice.take(e, path)
        path = self.aside(edge)
        if path:
            self.lattice.take(edge, path)
        return {edge} if path else set()

    def aside(self, edge: int) -> list[Cell] | None:
        """A route between cells next to a line's ends, the nearest first. Where an end's own cell has
        routes, the cell beside must be on one of them."""
        if not self.lines[edge]:
            return None

        def beside(old: Cell) -> dict[Cell, Cell]:
            own = self.lattice.holders(old)
            new = {m: (old[0] + m[0], old[1] + m[1]) for m in product((0, 1, -1), repeat=2)}
            return {m: c for m, c in new.items() if c == old or not own or own & self.lattice.holders(c)}

        def open_(cell: Cell, way: int) -> bool:
            there = self.lattice.used(cell)
            on_map = 0 <= cell[0] < self.box[0] and 0 <= cell[1] < self.box[1] and cell not in self.lattice.closed
            return on_map and any(not there & step[way] and self.known.fits[there | step[way]] for step in self.known.steps)

        # only ends that a route could leave or reach
        starts, goals = ({m: c for m, c in beside(end).items() if open_(c, way)} for way, end in enumerate(ends_of(self.lines[edge]), 1))
        if not starts or not goals:
            return None
        limit = most_steps(self.lines[edge])
        for m, n in ASIDE:
            if m in starts and n in goals and starts[m] != goals[n] and self.known.apart(starts[m], goals[n]) <= limit:
                path = self.route(edge, self.lattice.used, (starts[m], goals[n]))
                if path:
                    return path
        return None


# ---- in rounds ----


def reach(line: Column) -> Column:
    """Numbers of the blocks that the route of a line (array of points) can reach."""
    ends = F.transform(line, lambda p, i: F.struct(p.alias("a"), F.get(line, F.least(i + 1, F.size(line) - 1)).alias("b")))

    def pieces(s: Column) -> Column:
        n = F.greatest(F.ceil(F.greatest(F.abs(s["a"]["x"] - s["b"]["x"]), F.abs(s["a"]["y"] - s["b"]["y"])) / BLOCK), F.lit(1)).cast("int")

        def blocks(k: Column) -> Column:
            def span(c: str) -> Column:
                at = [s["a"][c] + (s["b"][c] - s["a"][c]) * (k + d) / n for d in (0, 1)]
                return F.sequence(F.floor((F.least(*at) - MARGIN) / BLOCK), F.floor((F.greatest(*at) + MARGIN) / BLOCK))

            return F.flatten(F.transform(span("x"), lambda x: F.transform(span("y"), lambda y: x * (1 << 32) + y)))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), blocks))

    return F.array_distinct(F.flatten(F.transform(ends, pieces)))


def straight(known: Catalogue) -> Column:
    """Whether a line (a and b, the cells of its ends) is so short that its only way is over one border."""
    if known.diagonal:
        return F.lit(False)
    length = F.aggregate(F.sequence(F.lit(1), F.size("line") - 1), F.lit(0.0), lambda n, i: n + F.hypot(F.get("line", i)["x"] - F.get("line", i - 1)["x"], F.get("line", i)["y"] - F.get("line", i - 1)["y"]))
    beside = F.abs(F.col("a.xidx") - F.col("b.xidx")) + F.abs(F.col("a.yidx") - F.col("b.yidx")) == 1
    # less than three steps, whatever the last digit
    return F.coalesce(F.when((F.size("line") > 1) & beside, LONGEST * length + 2 < 2.999), F.lit(False))


def block_of(x: Column, y: Column) -> Column:
    return (F.floor(x / BLOCK) * (1 << 32) + F.floor(y / BLOCK)).cast("bigint")


def near(places: DataFrame, paths: DataFrame, closed: DataFrame | None) -> DataFrame:
    """tile, edge_id, x, y, sides: what is laid or closed (sides null) in the blocks (at) of a tile."""
    cells = paths.where("path is not null").select("edge_id", F.inline("path")).withColumn("at", block_of(F.col("x"), F.col("y")))
    if closed is not None:
        x, y = F.col("xidx").cast("int").alias("x"), F.col("yidx").cast("int").alias("y")
        shut = closed.select(F.lit(None).cast("bigint").alias("edge_id"), x, y, F.lit(None).cast("int").alias("sides"))
        cells = cells.union(shut.withColumn("at", block_of(F.col("x"), F.col("y"))))
    return cells.join(places, "at").select(F.expr("tile + 0").alias("tile"), "edge_id", "x", "y", "sides")


def flagged(left: DataFrame, order: tuple[str, ...], few: int, areas: DataFrame | None = None) -> DataFrame:
    """left with waits: some open edge of another tile comes first at one of the blocks that it reaches, or at one
    of the wide ones that areas has for these. Edges of a tile that reach the same blocks are
    looked up once. The last few edges are of one tile."""
    if left.count() <= few:
        return left.withColumns({"tile": F.lit(0).cast("bigint"), "waits": F.lit(False)})
    turn = F.struct(*[F.coalesce(k, F.lit((1 << 63) - 1)).alias(k) for k in order], "edge_id")
    own = left.groupBy("tile", "blocks").agg(F.min(turn).alias("turn"))
    claims = own.withColumn("wide", F.col("blocks")) if areas is None else own.join(areas, "blocks")
    claims = claims.select("tile", "blocks", "turn", F.explode("wide").alias("at"))
    first = claims.groupBy("at", "tile").agg(F.min("turn").alias("turn"))
    two = first.groupBy("at").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "tile"))), 1, 2).alias("two")).where(F.size("two") > 1)
    other = F.when(F.get("two", 0)["tile"] != F.col("tile"), F.get("two", 0)["turn"]).otherwise(F.get("two", 1)["turn"])
    before = claims.join(two, "at").groupBy("tile", "blocks").agg(F.min(other).alias("before"))
    return left.join(before, ["tile", "blocks"], "left").withColumn("waits", F.coalesce(F.col("before") < turn, F.lit(False))).select(*left.columns, "waits")


class Lists:
    """The lists of a column, taken out one at a time."""

    def __init__(self, column: pa.ChunkedArray):
        own = column.combine_chunks()
        self.offsets = own.offsets.to_numpy().tolist()
        values = own.values
        self.values = [values.field(c).to_numpy() for c in "xy"] if pa.types.is_struct(values.type) else values.to_numpy()

    def line(self, i: int) -> Line:
        a, b = self.offsets[i], self.offsets[i + 1]
        return list(zip(*(v[a:b].tolist() for v in self.values), strict=True))

    def key(self, i: int) -> bytes:
        return self.values[self.offsets[i] : self.offsets[i + 1]].tobytes()


def numbers(key: bytes) -> frozenset[int]:
    return frozenset(np.frombuffer(key, np.int64).tolist())


def in_turn(own: pa.Table, order: tuple[str, ...]) -> list[int]:
    """Places of rows in order, nulls last."""
    return pc.sort_indices(own, [(k, "ascending") for k in (*order, "edge_id")], null_placement="at_end").to_pylist()


class Held:
    """Blocks of edges that wait for another round, and so have those that come after them wait."""

    def __init__(self, reach: Callable[[bytes], frozenset[int]]):
        self.reach, self.blocks, self.keys = reach, set(), set()

    def waits(self, key: bytes, already: bool) -> bool:
        if key in self.keys:
            return True
        own = self.reach(key)
        if already or not self.blocks.isdisjoint(own):
            self.blocks |= own
            self.keys.add(key)
            return True
        return False


def lattice_of(cells: pa.Table) -> Lattice:
    lattice = Lattice()
    for e, x, y, sides in zip(*(cells[c].to_pylist() for c in ("edge_id", "x", "y", "sides")), strict=True):
        if sides is None:
            lattice.closed.add((x, y))
        else:
            lattice.hold(e, (x, y), sides)
    return lattice


def shown(path: list[Cell] | None) -> list[dict[str, int]] | None:
    return [{"x": x, "y": y, "sides": s} for (x, y), s in sides_of(path)] if path else None


def by_tile(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Much work on few bytes: as many partitions as are set, which adaptive execution doesn't merge."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, "tile").groupBy("tile").cogroup(right.repartition(parts, "tile").groupBy("tile")).applyInArrow(run, schema)


SETTLED = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("sides", pa.int32())]))


def laid(edges: DataFrame, closed: DataFrame | None, box: Cell, known: Catalogue, folder: str, few: int) -> DataFrame:
    """edges (EDGE) with path, of those that find a way in their turn."""
    spark = edges.sparkSession
    left, n = edges, 0
    none = spark.createDataFrame([], f"edge_id bigint, {PATH}")

    def run(own: pa.Table, cells: pa.Table) -> pa.Table:
        router, held = Router(lattice_of(cells), box, known), Held(cache(numbers))
        ids, waits, lines, areas = own["edge_id"].to_pylist(), own["waits"].to_pylist(), Lists(own["line"]), Lists(own["blocks"])
        settled, paths = [False] * len(ids), [None] * len(ids)
        for i in in_turn(own, LAY):
            if held.waits(areas.key(i), waits[i]):
                continue
            settled[i], e = True, ids[i]
            router.lines[e] = lines.line(i)
            if router.lay_first(e):
                paths[i] = shown(router.lattice.paths[e])
            router.forget(e)
        return own.drop_columns(["waits"]).append_column("settled", pa.array(settled, pa.bool_())).append_column("path", pa.array(paths, SETTLED))

    while True:
        there = spark.read.parquet(folder).where("settled").select("edge_id", "path") if n else none
        turn = flagged(left, LAY, few)
        places = turn.where("not waits").select("tile", F.explode("blocks").alias("at")).distinct()
        after = by_tile(turn, near(places, there, closed), run, f"{EDGE}, settled boolean, {PATH}")
        after.write.parquet(f"{folder}/round={n}")
        left = spark.read.parquet(f"{folder}/round={n}").where("not settled").drop("settled", "path")
        n += 1
        if left.isEmpty():
            return spark.read.parquet(folder).where("settled").drop("settled", "round")


def mended(found: DataFrame, closed: DataFrame | None, box: Cell, known: Catalogue, folder: str, few: int) -> DataFrame:
    """edge_id and path of the edges whose routes change when those without one are mended."""
    spark = found.sparkSession
    lost = rounds.written(found.where("path is null and size(line) > 0").drop("path"), f"{folder}-lost")
    changed = spark.createDataFrame([], f"edge_id bigint, {PATH}, round int")
    if lost.isEmpty():
        return changed.drop("round")
    # blocks that neighbours of an edge in a block may reach; edges that reach the same blocks are alike in that
    by_block = rounds.written(found.select("blocks").distinct().withColumn("at", F.explode("blocks")), f"{folder}-blocks")
    own = lost.select("blocks").distinct().withColumn("at", F.explode("blocks"))
    further = by_block.join(own.select("at").distinct(), "at", "left_semi").select("at", F.explode("blocks").alias("to")).distinct()
    areas = rounds.written(own.join(further, "at").groupBy("blocks").agg(F.sort_array(F.collect_set("to")).alias("wide")), f"{folder}-areas")
    all_places = areas.select(F.explode("wide").alias("at")).distinct()
    around = found.join(by_block.join(all_places, "at", "left_semi").select("blocks").distinct(), "blocks", "left_semi")
    around = rounds.written(around.select("edge_id", "line", "blocks", "path"), f"{folder}-around")

    def run(own: pa.Table, cells: pa.Table) -> pa.Table:
        kind = own["kind"]
        wide, near_, rows = (own.filter(pc.equal(kind, k)) for k in (AREA, LINE, TURN))
        keys, to = Lists(wide["blocks"]), Lists(wide["wide"])
        reach_of = {keys.key(i): numbers(to.key(i)) for i in range(len(wide))}
        blocks = cache(numbers)
        router, held = Router(lattice_of(cells), box, known), Held(reach_of.__getitem__)
        laid_at: dict[int, set[int]] = defaultdict(set)  # edges with a route, by the blocks that they reach
        lines, areas = Lists(near_["line"]), Lists(near_["blocks"])
        area_of: dict[int, bytes] = {}
        for i, (e, path) in enumerate(zip(near_["edge_id"].to_pylist(), near_["path"].to_pylist(), strict=True)):
            router.lines[e], area_of[e] = lines.line(i), areas.key(i)
            router.lattice.paths[e] = [(p["x"], p["y"]) for p in path]
            for b in blocks(area_of[e]):
                laid_at[b].add(e)
        ids, waits, lines, areas = rows["edge_id"].to_pylist(), rows["waits"].to_pylist(), Lists(rows["line"]), Lists(rows["blocks"])
        changed: set[int] = set()
        late = [False] * len(ids)
        for i in in_turn(rows, MEND):
            e, area = ids[i], areas.key(i)
            if held.waits(area, waits[i]):
                late[i] = True
                continue
            router.lines[e] = lines.line(i)
            new = router.mend(e, *(laid_at[b] for b in blocks(area)), area=area)
            changed |= new
            if new:
                area_of[e] = area
                for b in blocks(area):
                    laid_at[b].add(e)
            else:
                router.forget(e)
        rest = rows.filter(pa.array(late, pa.bool_())).select(["edge_id", "rank", "color", "tile", "line", "blocks"])
        rest = rest.append_column("settled", pa.array([False] * len(rest), pa.bool_())).append_column("path", pa.nulls(len(rest), SETTLED))
        known_now = sorted(changed)
        new = {"edge_id": pa.array(known_now, pa.int64()), "path": pa.array([shown(router.lattice.paths[e]) for e in known_now], SETTLED)}
        return pa.concat_tables([rest.cast(MENDED), pa.table([new.get(f.name, pa.nulls(len(known_now), f.type)) for f in MENDED], MENDED)])

    n = 0
    columns = "edge_id", "rank", "color", "tile", "line", "blocks"
    left = lost
    while True:
        now = changed.groupBy("edge_id").agg(F.max_by("path", "round").alias("new"))
        there = around.join(now, "edge_id", "left").withColumn("path", F.coalesce("new", "path")).drop("new").where("path is not null")
        turn = rounds.written(flagged(left.select(*columns), MEND, few, areas), f"{folder}-turn/round={n}")
        go = turn.where("not waits").select("tile", "blocks").distinct()
        places = go.join(areas, "blocks").select("tile", F.explode("wide").alias("at")).distinct()
        beside = go.select("tile", F.explode("blocks").alias("at")).distinct().join(by_block, "at").select("tile", "blocks").distinct()
        lines = there.join(beside, "blocks").select(F.lit(LINE).alias("kind"), "edge_id", "tile", "line", "blocks", "path")
        wide = turn.select("tile", "blocks").distinct().join(areas, "blocks").select(F.lit(AREA).alias("kind"), "tile", "blocks", "wide")
        both = turn.select(F.lit(TURN).alias("kind"), *columns, "waits").unionByName(lines, True).unionByName(wide, True)
        after = by_tile(both, near(places, there, closed), run, f"{EDGE}, settled boolean, {PATH}")
        after.write.parquet(f"{folder}/round={n}")
        mine = spark.read.parquet(f"{folder}/round={n}")
        left = mine.where("settled = false").drop("settled", "path")
        changed = spark.read.parquet(folder).where("settled is null").select("edge_id", "path", "round")
        n += 1
        if left.isEmpty():
            return changed.groupBy("edge_id").agg(F.max_by("path", "round").alias("path"))


#: What a row given to a task of mending is.
AREA, LINE, TURN = range(3)
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
MENDED = pa.schema([("edge_id", pa.int64()), ("rank", pa.int64()), ("color", pa.int32()), ("tile", pa.int64()), ("line", POINTS), ("blocks", pa.list_(pa.int64())), ("settled", pa.bool_()), ("path", SETTLED)])


def routed(edges: DataFrame, box: Cell, steps: Iterable[str] = ("u", "d", "l", "r"), tiles: Iterable[Iterable[str]] | None = None, closed: DataFrame | None = None, tile: int = TILE, few: int = FEW) -> DataFrame:
    """edge_id, pos, xidx, yidx: routes of edges (rank, edge_id, line in cell units) of one network on a
    map of box cells, in order of rank, then edge. tiles: the sides of each tile of a catalogue; closed:
    cells (xidx, yidx) that no route may enter. An edge without a route gives one row of nulls. Every
    round is written to the shared folder, which the result reads."""
    folder = rounds.new_folder(edges.sparkSession, "routes")
    known = Catalogue(steps, tiles)
    line = F.coalesce(F.col("line"), F.array().cast("array<struct<x:double,y:double>>"))
    own = edges.select(F.col("edge_id").cast("bigint").alias("edge_id"), F.col("rank").cast("bigint").alias("rank"), line.cast("array<struct<x:double,y:double>>").alias("line"))

    def home(size: int) -> tuple[Column, Column]:
        x, y = (F.floor(F.coalesce(F.get("line", F.lit(0))[c], F.lit(0.0)) / size) for c in "xy")
        return x, y

    (x, y), (sx, sy) = home(tile), home(SQUARE)
    home_tile = (x * (1 << 32) + y).cast("bigint")
    own = own.select("edge_id", "rank", (F.pmod(sx, F.lit(2)) * 2 + F.pmod(sy, F.lit(2))).cast("int").alias("color"), home_tile.alias("tile"), "line")
    shut = rounds.written(closed.select("xidx", "yidx").distinct(), f"{folder}/closed") if closed is not None else None
    # edges within an open cell use no side of it, so that they neither wait nor are in the way
    ends = {i: F.struct(*[F.floor(at[c]).cast("int").alias(n) for c, n in (("x", "xidx"), ("y", "yidx"))]) for i, at in (("a", F.get("line", F.lit(0))), ("b", F.element_at("line", -1)))}
    inside = F.col("a.xidx").between(0, box[0] - 1) & F.col("a.yidx").between(0, box[1] - 1)
    own = own.withColumns({k: F.when(F.size("line") > 0, at) for k, at in ends.items()}).withColumn("still", F.coalesce((F.col("a") == F.col("b")) & inside, F.lit(False)))
    if shut is not None:
        barred = shut.select(F.struct(F.col("xidx").cast("int").alias("xidx"), F.col("yidx").cast("int").alias("yidx")).alias("a"), F.lit(True).alias("barred")).distinct()
        own = own.join(barred, "a", "left").withColumn("still", F.col("still") & F.col("barred").isNull())
    blocks = F.when(F.size("line") > 0, F.sort_array(reach(F.col("line")))).otherwise(F.array().cast("array<bigint>"))
    moving = {c: F.when(~F.col("still"), v) for c, v in (("line", F.col("line")), ("blocks", blocks), ("straight", straight(known)))}
    own = rounds.written(own.select("edge_id", "rank", "color", "tile", "a", "b", "still", *[v.alias(c) for c, v in moving.items()]), f"{folder}/edges")
    all_ = own.where("not still")
    # of edges that can go straight over one border only, all but the first find it taken, or closed
    border = F.when(F.col("straight"), F.array_sort(F.array("a", "b")))
    turn = F.struct(*[F.coalesce(k, F.lit((1 << 63) - 1)).alias(k) for k in LAY], "edge_id")
    first = all_.where("straight").groupBy(border.alias("border")).agg(F.min(turn).alias("turn")).select(F.col("turn.edge_id").alias("edge_id"))
    late = all_.where("straight").join(first, "edge_id", "left_anti")
    at_all = all_.where("not straight").unionByName(all_.where("straight").join(first, "edge_id", "left_semi"))
    columns = [c.split()[0] for c in EDGE.split(", ")]
    found = laid(at_all.select(*columns), shut, box, known, f"{folder}/laid", few)
    # the last few were laid as one tile's; with edges of many colours it would have all tiles wait for each other
    found = found.withColumn("tile", home_tile).select(*columns, "path").union(late.select(*columns, F.lit(None).cast(PATH[5:])))
    new = mended(found, shut, box, known, f"{folder}/mended", few).withColumnRenamed("path", "new")
    last = found.join(new, "edge_id", "left").select("edge_id", F.posexplode_outer(F.coalesce("new", "path")).alias("pos", "c"))
    moved = last.select("edge_id", "pos", F.col("c.x").alias("xidx"), F.col("c.y").alias("yidx"))
    return moved.union(own.where("still").select("edge_id", F.lit(0).alias("pos"), "a.xidx", "a.yidx"))
