"""Packing building footprints with catalogue tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import draw
from gridloom.functions import geometry as g

# How likely buildings of one, two and three stories are, in tenths. Others are as their
# weight says.
STORIES = {1: 3, 2: 6, 3: 1}
#: States of the first search beside each other, and of the second one altogether; cells of shapes that
#: are gone through set by set where need be.
NARROW, STATES, DEEP = 32, 150_000, 49


def footprint(buildings: DataFrame, ring: str) -> DataFrame:
    """buildings with a positive area, and whether their first edge runs diagonally."""
    a, b = F.get(F.col(ring), 0), F.get(F.col(ring), 1)
    return buildings.where(F.abs(g.signed_area(F.col(ring))) > 0).withColumn("is_diagonal", g.is_diagonal(b["x"] - a["x"], b["y"] - a["y"]))


def as_bits(grid: np.ndarray) -> tuple[int, int]:
    """The cells of a grid as bits of a number, row by row with an empty column after each row, and how many
    bits a row has."""
    wide = np.zeros((grid.shape[0], grid.shape[1] + 1), bool)
    wide[:, :-1] = grid
    return int.from_bytes(np.packbits(wide, bitorder="little").tobytes(), "little"), wide.shape[1]


def layers_cost(left: int, row: int) -> int:
    """unfilled_cost() of bits."""
    total, layer = 0, 1
    while left:
        core = left & left >> 1 & left << 1 & left >> row & left << row
        total += layer * (left.bit_count() - core.bit_count())
        left, layer = core, layer + 1
    return total


def unfilled_cost(grid: np.ndarray) -> int:
    """Each open cell costs the number of layers around it, counted from the border of the grid."""
    return layers_cost(*as_bits(grid))


class Packing(NamedTuple):
    cost: float
    placed: list[tuple[int, int, int, int]]  # row, col, rows, cols
    bound: float  # no packing costs less; equal to cost where it is known to be the cheapest


def singles(grid: np.ndarray, tiles: list[tuple[int, int]]) -> Packing:
    """The cheapest packing of one tile at most."""
    cells, row = as_bits(grid)
    best: tuple[float, list[tuple[int, int, int, int]]] = (float(layers_cost(cells, row)), [])
    for h, w in tiles:
        block = sum(((1 << w) - 1) << (k * row) for k in range(h))
        for r, c in np.argwhere(grid).tolist():
            own = block << (r * row + c)
            if cells & own == own:
                best = min(best, (0.5 + layers_cost(cells ^ own, row), [(r, c, h, w)]), key=lambda b: b[0])
    return Packing(*best, best[0])


class Frontier:
    """Ways to fill cells in order along the shorter side: each is the upper left of a tile or stays open.
    What is left tells states apart, and differs within the reach of a tile beyond the first cell left,
    only. A state is dropped where even its bound is no better than a packing that is known."""

    def __init__(self, grid: np.ndarray, tiles: list[tuple[int, int]]):
        self.turned = grid.shape[1] > grid.shape[0]
        cells = grid.T if self.turned else grid
        n, m = self.shape = cells.shape
        self.all = int.from_bytes(np.packbits(cells, bitorder="little").tobytes(), "little")
        self.blocks: dict[int, list[tuple[int, tuple[int, int, int, int]]]] = {}
        share = np.ones(cells.shape)
        for h, w in ((t[::-1] if self.turned else t) for t in tiles):
            bits = sum(((1 << w) - 1) << (k * m) for k in range(h))
            for r in range(n - h + 1):
                for c in range(m - w + 1):
                    at = r * m + c
                    if self.all >> at & bits == bits:
                        self.blocks.setdefault(at, []).append((bits << at, (r, c, h, w)))
                        own = share[r : r + h, c : c + w]
                        np.minimum(own, 0.5 / (h * w), out=own)
        #: What a cell costs at least, and all cells from one on.
        self.share = np.where(cells, share, 0.0).ravel()

    def bound(self, left: int) -> float:
        bits = np.unpackbits(np.frombuffer(left.to_bytes(-(-len(self.share) // 8), "little"), np.uint8), bitorder="little")[: len(self.share)]
        return math.ceil(2 * float(self.share[bits.astype(bool)].sum()) - 1e-9) / 2

    def search(self, width: int, below: float) -> tuple[float, list[tuple[int, int, int, int]], int, float]:
        """The cheapest packing found that costs less than below, where open cells cost one each; its
        cells that stay open; and the least that anything cut off could cost: of the states that share
        a first cell, width go on."""
        layers: dict[int, dict[int, tuple[float, float, int | None, tuple[int, int, int, int] | None, int]]] = {}
        first = (self.all & -self.all).bit_length() - 1
        layers[first] = {self.all: (0.0, float(self.share.sum()), None, None, 0)}
        cut, end = math.inf, len(self.share)
        share = self.share.tolist()
        known: dict[int, float] = {}  # shares of cells, by bits
        done: tuple[float, float, int | None, tuple[int, int, int, int] | None, int] | None = None
        for at in range(first, end):
            here = layers.get(at)
            if not here:
                continue
            go = here.items()
            if len(here) > width:
                ranked = sorted(go, key=lambda s: (s[1][0] + s[1][1], s[0]))
                cut = min(cut, math.ceil(2 * (ranked[width][1][0] + ranked[width][1][1]) - 1e-9) / 2)
                go = ranked[:width]
                layers[at] = dict(go)
            for left, (cost, ahead, _, _, _) in list(go):
                for bits, place in [*self.blocks.get(at, ()), (1 << at, None)]:
                    if left & bits != bits:
                        continue
                    rest = left ^ bits
                    spent = cost + (0.5 if place else 1.0)
                    if bits not in known:
                        known[bits] = share[at] * (place[2] * place[3]) if place and self.even else sum(share[k] for k in set_bits(bits))
                    after = ahead - known[bits]
                    if math.ceil(2 * (spent + after) - 1e-9) / 2 >= below:
                        continue
                    if not rest:
                        if done is None or spent < done[0]:
                            done, below = (spent, 0.0, left, place, at), min(below, spent)
                        continue
                    to = layers.setdefault((rest & -rest).bit_length() - 1, {})
                    if rest not in to or spent < to[rest][0]:
                        to[rest] = (spent, after, left, place, at)
        if done is None:
            return math.inf, [], 0, cut
        placed, open_, state = [], 0, done
        while state is not None and state[2] is not None:
            if state[3]:
                placed.append(state[3])
            else:
                open_ |= 1 << state[4]
            left = state[2]
            state = layers[state[4]][left]
        return done[0], [(c, r, w, h) if self.turned else (r, c, h, w) for r, c, h, w in placed[::-1]], open_, cut

    @cached_property
    def even(self) -> bool:
        """Whether all cells have one share."""
        own = self.share[self.share > 0]
        return bool(len(own)) and bool((own == own[0]).all())

    def cells(self, mask: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(mask.to_bytes(-(-len(self.share) // 8), "little"), np.uint8), bitorder="little")[: len(self.share)]
        own = bits.reshape(self.shape).astype(bool)
        return own.T if self.turned else own


def set_bits(x: int) -> Iterator[int]:
    while x:
        yield (x & -x).bit_length() - 1
        x &= x - 1


def pack(grid: np.ndarray, tiles: list[tuple[int, int]], modular: bool) -> Packing:
    """The cheapest packing: half a unit a tile, and the cost of what stays open. One tile at most, unless
    modular. A narrow search gives a packing to begin with, then one over all states that may be cheaper.
    That one is cut short beyond STATES states, and its result may then cost more than the bound; so
    it may where open cells that are deep inside cost more than one each, on shapes of over DEEP cells. Up
    to there all sets of open cells are gone through."""
    grid = grid.astype(bool)
    order = sorted(set(tiles), key=lambda t: (-t[0] * t[1], t))
    if not grid.any():
        return Packing(0.0, [], 0.0)
    if not modular:
        return singles(grid, order)
    f = Frontier(grid, order)
    best = Packing(float(unfilled_cost(grid)), [], f.bound(f.all))
    for width in (NARROW, max(NARROW, STATES // int(grid.sum()))):
        cost, placed, open_, cut = f.search(width, best.cost)
        if cost < math.inf:
            true = 0.5 * len(placed) + unfilled_cost(f.cells(open_))
            if true < best.cost:
                best = Packing(true, placed, best.bound)
        # cheaper ones by the count of open cells were all seen, but for what was cut off
        least = max(best.bound, min(best.cost, cut, cost))
        best = best._replace(bound=least)
        if best.bound >= best.cost:
            return best
    return deepened(grid, order, best) if grid.sum() <= DEEP else best


def deepened(grid: np.ndarray, tiles: list[tuple[int, int]], best: Packing) -> Packing:
    """The cheapest packing where open cells inside cost more than one: branch and bound over cells in
    order, from a packing that is known. For small shapes."""
    cover = least_cover(grid.shape, tiles)
    found = best

    def search(left: np.ndarray, open_: np.ndarray, placed: list[tuple[int, int, int, int]]) -> None:
        nonlocal found
        cost = 0.5 * len(placed) + unfilled_cost(left | open_)
        if cost < found.cost:
            found = Packing(cost, list(placed), best.bound)
        for r, c in np.argwhere(left).tolist():
            if 0.5 * len(placed) + unfilled_cost(open_) + cover(left) >= found.cost:
                return
            for h, w in tiles:
                block = left[r : r + h, c : c + w]
                if block.shape == (h, w) and block.all():
                    rest = left.copy()
                    rest[r : r + h, c : c + w] = False
                    search(rest, open_, [*placed, (r, c, h, w)])
            left, open_ = left.copy(), open_.copy()
            left[r, c], open_[r, c] = False, True

    search(grid, np.zeros(grid.shape, bool), [])
    return found._replace(bound=found.cost)


def least_cover(shape: tuple[int, int], tiles: list[tuple[int, int]]) -> Callable[[np.ndarray], float]:
    """A function of cells: the least cost of covering them with tiles, an open cell costing one. Cells
    are bits, in order along the shorter side, and sets of them that are left are settled once: how
    many there are grows with the shorter side."""
    turn = shape[1] > shape[0]
    n, m = shape[::-1] if turn else shape
    blocks = [(h, w, sum(1 << (r * m + c) for r in range(h) for c in range(w))) for h, w in ((t[::-1] if turn else t) for t in tiles) if h <= n and w <= m]
    known: dict[int, float] = {0: 0.0}

    def cover(left: int) -> float:
        if left not in known:
            first = (left & -left).bit_length() - 1
            best = 1.0 + cover(left & (left - 1))
            for h, w, bits in blocks:
                block = bits << first
                if first // m + h <= n and first % m + w <= m and left & block == block:
                    best = min(best, 0.5 + cover(left ^ block))
            known[left] = best
        return known[left]

    return lambda cells: cover(int.from_bytes(np.packbits(cells.T if turn else cells, bitorder="little").tobytes(), "little"))


@lru_cache(maxsize=10_000)
def packed_shape(shape: tuple[int, int], cells: bytes, tiles: tuple[tuple[int, int], ...], modular: bool) -> Packing:
    """Footprints of one shape are packed once per worker."""
    return pack(np.frombuffer(cells, bool).reshape(shape), list(tiles), modular)


def packed(cells: DataFrame, tiles: list[tuple[int, int]], modular: bool = True) -> DataFrame:
    """building, cost, bound, row, col, rows, cols: placements over the cells (building, row, col) of each
    building, which is a group of bounded size. No packing costs less than bound."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        r, c = rows["row"].to_numpy(), rows["col"].to_numpy()
        grid = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        grid[r - r.min(), c - c.min()] = True
        cost, found, bound = packed_shape(grid.shape, grid.tobytes(), tuple(tiles), modular)
        out = [(key[0].as_py(), cost, bound, a + int(r.min()), b + int(c.min()), h, w) for a, b, h, w in found]
        kinds = (("building", pa.int64()), ("cost", pa.float64()), ("bound", pa.float64()), ("row", pa.int32()), ("col", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()))
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(kinds)})

    return cells.groupBy("building").applyInArrow(run, "building bigint, cost double, bound double, row int, col int, rows int, cols int")


def chosen(placements: DataFrame, catalogue: DataFrame, *keys: str, salt: int = 0, by: tuple[str, ...] = ("rows", "cols", "is_diagonal")) -> DataFrame:
    """placements with a building of their size drawn from the catalogue (the columns in by, stories,
    weight, label), by weight times how likely its number of stories is. keys: integer columns that the
    draw depends on."""
    stories = F.create_map(*[F.lit(x) for kv in STORIES.items() for x in kv])
    own = catalogue.withColumn("w", (F.round(F.col("weight") * 1000) * F.coalesce(F.try_element_at(stories, F.col("stories")), F.lit(10))).cast("long"))
    lists = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("label", "w"))).alias("options"))
    met = placements.join(lists, list(by))
    at = draw.pick(draw.number(*[F.col(k) for k in keys], salt=salt), F.transform("options", lambda o: o["w"]))
    return met.withColumn("label", F.get("options", at)["label"]).drop("options")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per building the candidate whose orientation matches, then the one with the largest overlap."""
    own = Window.partitionBy("building").orderBy(F.desc("matches"), F.desc("iou"), "candidate")
    return candidates.withColumn("r", F.row_number().over(own)).where("r = 1").drop("r")
