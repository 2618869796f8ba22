"""What of a cell a ring covers after a border was taken off it or added to it, round corners included.

Along an upright line both the ring and what is near its sides are intervals. Between the places where
curves (sides, sides moved by the border, circles about corners, the cell's edges) meet or end, the length
of the result is a smooth function; it is integrated by Gauss' rule after a substitution that takes the
roots at the ends of circles away, which is exact to rounding. Only sides within the border of a cell
travel to Python, and only cells that the border's edge may cross.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridloom.functions import geometry as g

GAUSS, WEIGHT = np.polynomial.legendre.leggauss(14)
#: Events on upright lines that are held at once.
EVENTS = 1 << 20


def _cuts(lines: np.ndarray, centres: np.ndarray, off: np.ndarray, cell: float) -> np.ndarray:
    """Of each cell the x at which curves start, end or meet, in order, the last one repeated; lines
    are x0, y0, x1, y1."""
    n, o = len(lines), off[:, None, None]
    p, d = lines[..., :2], lines[..., 2:] - lines[..., :2]
    at = [np.zeros((n, 1)), np.full((n, 1), cell), lines[..., 0], lines[..., 2], centres[..., 0] - off[:, None], centres[..., 0] + off[:, None]]

    def along(t: np.ndarray) -> np.ndarray:
        return np.where((t >= 0) & (t <= 1), p[:, :, None, 0] + t * d[:, :, None, 0], cell).reshape(n, -1)

    with np.errstate(divide="ignore", invalid="ignore"):
        turn = d[:, :, None, 0] * d[:, None, :, 1] - d[:, :, None, 1] * d[:, None, :, 0]
        to = p[:, None] - p[:, :, None]
        at.append(along((to[..., 0] * d[:, None, :, 1] - to[..., 1] * d[:, None, :, 0]) / turn))
        to = p[:, :, None] - centres[:, None]
        a, b, c = (d * d).sum(2)[:, :, None], (to * d[:, :, None]).sum(3), (to * to).sum(3) - o * o
        root = np.sqrt(b * b - a * c)
        at += [along((-b - root) / a), along((-b + root) / a)]
        to = centres[:, None] - centres[:, :, None]
        side = np.sqrt(o * o / (to * to).sum(3) - 0.25)
        met = centres[:, :, None, 0] + to[..., 0] / 2
        at += [np.where(np.isfinite(side), met + sign * side * to[..., 1], cell).reshape(n, -1) for sign in (-1.0, 1.0)]
    x = np.sort(np.clip(np.concatenate(at, axis=1), 0, cell), axis=1)
    x[:, 1:][np.diff(x, axis=1) == 0] = cell
    x = np.sort(x, axis=1)
    return x[:, : int((x < cell).sum(axis=1).max(initial=0)) + 1]


def _heights(lines: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y of each line at each x (cell, x, line); nan where it doesn't reach."""
    x0, y0, x1, y1 = (lines[:, None, :, k] for k in range(4))
    x = x[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((x >= np.minimum(x0, x1)) & (x < np.maximum(x0, x1)), y0 + (x - x0) / (x1 - x0) * (y1 - y0), np.nan)


def cell_areas(piece: np.ndarray, sides: np.ndarray, off: np.ndarray, grow: np.ndarray, cell: float) -> np.ndarray:
    """Of many cells at the origin, alike in numbers of corners and sides: piece, the corners of the ring within
    the cell; sides, x0, y0, x1, y1 of those near it. The area of the piece that is off away from all
    sides, or, where grow, of the cell that is in the piece or nearer."""
    n, m, k = len(piece), piece.shape[1], sides.shape[1]
    outline = np.concatenate([piece, np.roll(piece, -1, axis=1)], axis=2)
    d = sides[..., 2:] - sides[..., :2]
    size = np.hypot(d[..., 0], d[..., 1])[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        aside = np.where(size > 0, np.stack([-d[..., 1], d[..., 0]], axis=2) / size * off[:, None, None], 0.0)
    aside = np.concatenate([aside, aside], axis=2)
    edges = np.broadcast_to(np.array([[0.0, 0.0, cell, 0.0], [0.0, cell, cell, cell]]), (n, 2, 4))
    cuts = _cuts(np.concatenate([outline, sides + aside, sides - aside, edges], axis=1), np.concatenate([sides[..., :2], sides[..., 2:]], axis=1), off, cell)
    half, middle = np.diff(cuts, axis=1)[..., None] / 2, ((cuts[:, 1:] + cuts[:, :-1]) / 2)[..., None]
    turn = np.pi / 2 * GAUSS
    at = (middle + half * np.sin(turn)).reshape(n, -1)
    weight = (half * np.cos(turn) * WEIGHT * np.pi / 2).reshape(n, -1)
    # what begins or ends at an event, from below: a side's nearness, and the ring itself
    kinds = np.concatenate([np.zeros(m), np.ones(k), -np.ones(k), [0, 0]]).astype(np.int32)
    turns = np.concatenate([np.ones(m), np.zeros(2 * k + 2)]).astype(np.int32)
    total = np.zeros(n)
    step = max(1, EVENTS // (n * len(kinds)))
    for i in range(0, at.shape[1], step):
        x = at[:, i : i + step]
        curves = [_heights(sides + aside, x), _heights(sides - aside, x)]
        for end in (sides[:, None, :, :2], sides[:, None, :, 2:]):
            with np.errstate(invalid="ignore"):
                arc = np.sqrt(off[:, None, None] ** 2 - (x[..., None] - end[..., 0]) ** 2)
            curves += [end[..., 1] - arc, end[..., 1] + arc]
        zero = np.zeros((*x.shape, 1))
        y = np.concatenate([_heights(outline, x), np.fmin.reduce(curves), np.fmax.reduce(curves), zero, zero + cell], axis=2)
        y = np.clip(np.nan_to_num(y, nan=cell), 0, cell)
        order = np.argsort(y, axis=2, kind="stable")
        y = np.take_along_axis(y, order, axis=2)
        near, within = np.cumsum(kinds[order], axis=2)[..., :-1] > 0, np.cumsum(turns[order], axis=2)[..., :-1] % 2 == 1
        kept = np.where(grow[:, None, None], near | within, within & ~near)
        total += (weight[:, i : i + step] * (np.diff(y, axis=2) * kept).sum(axis=2)).sum(axis=1)
    return total


def _areas(cell: float):
    @pandas_udf("double")
    def areas(px: pd.Series, py: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, by: pd.Series) -> pd.Series:
        found = np.full(len(px), np.nan)
        alike: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(px.notna()):
            alike.setdefault((len(px[i]), len(x0[i])), []).append(i)
        for (m, k), rows in alike.items():
            most = max(1, EVENTS // (128 * (m + 2 * k + 2) ** 2))
            for own in (np.array(rows[i : i + most]) for i in range(0, len(rows), most)):
                piece, sides = (np.stack([np.stack(c[own].to_list()) for c in of], axis=2).astype(np.float64) for of in ((px, py), (x0, y0, x1, y1)))
                width = by[own].to_numpy()
                found[own] = cell_areas(piece, sides, np.abs(width), width < 0, cell)
        return pd.Series(found)

    # so that a filter on the area is not merged with what computes it
    return areas.asNondeterministic()


def with_bordered_area(cells: DataFrame, ring: str, by: str, x: Column, y: Column, cell: float) -> DataFrame:
    """cells (a ring and a cell at x, y each) with the area that the ring covers after a border of by is taken
    off, or added where by is negative."""
    own, width = F.col(ring), F.col(by)
    off, reach = F.abs(width), F.lit(cell * 2**0.5 / 2)

    def near() -> Column:
        def side(p: Column, i: Column) -> Column:
            n = F.get(own, (i + 1) % F.size(own))
            return F.struct(*[(v[c] - o).alias(f"{c}{k}") for k, v in ((0, p), (1, n)) for c, o in (("x", x), ("y", y))])

        def touches(s: Column) -> Column:
            low, high = ([f(s[f"{c}0"], s[f"{c}1"]) for c in "xy"] for f in (F.least, F.greatest))
            return (low[0] <= off + cell) & (low[1] <= off + cell) & (high[0] >= -off) & (high[1] >= -off)

        return F.filter(F.transform(own, side), touches)

    def part(of: Column, c: str, less: Column | float = 0.0) -> Column:
        return F.transform(of, lambda v: v[c] - less)

    far = cells.withColumn("__far", g.border_distance(own, x + cell / 2, y + cell / 2))
    crossed = (F.col("__far") < off + reach) & (F.col("__far") > off - reach)
    clipped = g.clipped(own, g.box_planes(x, y, x + cell, y + cell))
    cut = far.withColumns({"__piece": F.when(crossed | (F.col("__far") > off), clipped), "__sides": F.when(crossed, near())})
    pieces = F.when(crossed, F.col("__piece"))
    exact = cut.withColumn("__exact", _areas(cell)(part(pieces, "x", x), part(pieces, "y", y), *[part(F.col("__sides"), c) for c in ("x0", "y0", "x1", "y1")], width))
    clear = F.when(F.col("__far") > off, F.abs(g.signed_area(F.col("__piece")))).when(width < 0, cell * cell).otherwise(0.0)
    return exact.withColumn("area", F.when(crossed, F.col("__exact")).otherwise(clear)).drop("__far", "__piece", "__sides", "__exact")
