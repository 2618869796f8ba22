"""What is settled on the driver before a plan is built: boxes, zones, reference points. A handful of
numbers each; nothing here sees a table."""

from __future__ import annotations

import math

Point = tuple[float, float]


def parse_box(numbers: list[float]) -> tuple[int, list[Point]]:
    """EPSG code and corners from 4, 5, 8 or 9 numbers; an odd count begins with the code, else it is
    4326. Two corners make an upright box, four a rotated one."""
    if len(numbers) not in (4, 5, 8, 9):
        raise ValueError("a box has 4 or 8 numbers, with a code before them or not")
    code = int(numbers[0]) if len(numbers) % 2 else 4326
    flat = numbers[len(numbers) % 2 :]
    points = list(zip(flat[::2], flat[1::2], strict=True))
    if len(points) == 2:
        (x0, x1), (y0, y1) = (sorted(c) for c in zip(*points, strict=True))
        return code, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return code, minimum_rectangle(points)


def hull(points: list[Point]) -> list[Point]:
    """Convex hull, counter-clockwise."""
    own = sorted(set(points))
    if len(own) < 3:
        return own

    def chain(ps: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(own) + chain(own[::-1])


def minimum_rectangle(points: list[Point]) -> list[Point]:
    """Corners, counter-clockwise, of the rectangle of least area around points. One of its sides lies
    on a side of the hull."""
    ring = hull(points)
    best: tuple[float, list[Point]] | None = None
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        n = math.dist(a, b)
        if n == 0:
            continue
        ux, uy = (b[0] - a[0]) / n, (b[1] - a[1]) / n
        s = [p[0] * ux + p[1] * uy for p in ring]
        t = [p[1] * ux - p[0] * uy for p in ring]
        area = (max(s) - min(s)) * (max(t) - min(t))
        if best is None or area < best[0] - 1e-12:
            best = area, [(p * ux - q * uy, p * uy + q * ux) for p, q in ((min(s), min(t)), (max(s), min(t)), (max(s), max(t)), (min(s), max(t)))]
    return best[1] if best else ring * 4


def reference_points(rectangle: list[Point], first: Point) -> tuple[Point, Point, Point]:
    """The corner nearest to first, and the next two counter-clockwise."""
    i = min(range(4), key=lambda k: (math.dist(rectangle[k], first), k))
    return tuple(rectangle[(i + k) % 4] for k in range(3))  # type: ignore[return-value]


def rotation(p0: Point, p1: Point) -> float:
    """Degrees of the direction from p0 to p1."""
    return math.degrees(math.atan2(p1[1] - p0[1], p1[0] - p0[0]))


def lower_left_first(rectangle: list[Point]) -> list[Point]:
    """The same ring, from its corner with the least x, then y."""
    i = min(range(len(rectangle)), key=lambda k: rectangle[k])
    return rectangle[i:] + rectangle[:i]


def extent_source(grid_file: bool, given_box: bool, file_box: bool) -> str:
    """Which source a map's extent comes from."""
    return "grid" if grid_file else "argument" if given_box else "file" if file_box else "data"


def split_repeats(line: list[Point]) -> list[list[Point]]:
    """A line cut at its first inner vertex that occurs twice, so that no piece runs into itself there."""
    for i, p in enumerate(line[1:-1], 1):
        if line.count(p) > 1:
            return [line[: i + 1], line[i:]]
    return [line]


def crop_box(nx: int, ny: int, width: float, height: float, cell: float = 1.0, step: int = 8) -> tuple[int, int, int, int]:
    """The part of an nx by ny raster, in cells, that a map of a width and height covers about its
    centre: a corner, and as many whole steps as fit (x0, y0, x1, y1, the last ones out)."""

    def along(n: int, size: float) -> tuple[int, int]:
        low = round(max(0.0, n / 2 - 0.5 - size / 2 / cell))
        return low, low + min((n - 1 - low) // step * step, int(size / step) * step)

    (x0, x1), (y0, y1) = along(nx, width), along(ny, height)
    return x0, y0, x1, y1
