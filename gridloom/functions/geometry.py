"""Geometry as column expressions over arrays of points (struct<x,y>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise ring, not closed."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression used within a lambda would be computed
    for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def signed_area(ring: Column) -> Column:
    """Shoelace; positive if counter-clockwise; 0 for fewer than three points."""
    terms = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def centroid(ring: Column) -> Column:
    """Of a polygon; of its vertices where the area is 0."""

    def own(ring: Column) -> Column:
        cross = F.transform(ring, lambda p, i: F.struct((p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"]).alias("c"), (p["x"] + _next(ring, i)["x"]).alias("x"), (p["y"] + _next(ring, i)["y"]).alias("y")))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "x", "y", "sx", "sy")])
        sums = F.aggregate(cross, zero, lambda a, t: F.struct((a["a"] + t["c"]).alias("a"), (a["x"] + t["c"] * t["x"]).alias("x"), (a["y"] + t["c"] * t["y"]).alias("y"), (a["sx"] + t["x"] / 2).alias("sx"), (a["sy"] + t["y"] / 2).alias("sy")))
        return let(sums, lambda s: point(*[F.when(s["a"] != 0, s[c] / (3 * s["a"])).otherwise(s["s" + c] / F.size(ring)) for c in "xy"]))

    return let(ring, own)


def half_plane(a: Column, b: Column, c: Column) -> Column:
    """Points with a * x + b * y + c >= 0."""
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))


def box_planes(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    one, no = F.lit(1.0), F.lit(0.0)
    return F.array(half_plane(one, no, -x0), half_plane(-one, no, x1), half_plane(no, one, -y0), half_plane(no, -one, y1))


def diamond_planes(cx: Column, cy: Column, radius: float) -> Column:
    """|x - cx| + |y - cy| <= radius."""
    return F.array(*[half_plane(F.lit(-a), F.lit(-b), a * cx + b * cy + radius) for a in (1.0, -1.0) for b in (1.0, -1.0)])


def clipped(ring: Column, planes: Column) -> Column:
    """ring cut by convex planes, one after the other in a single fold, so that the expression does
    not grow. For concave rings the area is right; edges along the border may be doubled."""

    def cut(q: Column, h: Column) -> Column:
        def side(p: Column) -> Column:
            return h["a"] * p["x"] + h["b"] * p["y"] + h["c"]

        def pair(e: Column) -> Column:
            p, n, s, t = e["p"], e["n"], e["s"], e["t"]
            at = s / (s - t)
            met = point(p["x"] + (n["x"] - p["x"]) * at, p["y"] + (n["y"] - p["y"]) * at)
            return F.when((s >= 0) & (t >= 0), F.array(n)).when(s >= 0, F.array(met)).when(t >= 0, F.array(met, n)).otherwise(F.slice(F.array(n), 1, 0))

        sided = F.transform(q, lambda p: F.struct(p.alias("p"), side(p).alias("s")))
        edges = F.transform(sided, lambda e, i: F.struct(e["p"].alias("p"), F.get(q, (i + 1) % F.size(q)).alias("n"), e["s"].alias("s"), side(F.get(q, (i + 1) % F.size(q))).alias("t")))
        return F.flatten(F.transform(edges, pair))

    return F.aggregate(planes, ring, cut)


def clipped_area(ring: Column, planes: Column) -> Column:
    return F.abs(let(clipped(ring, planes), signed_area))


def rotated(p: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    t = F.radians(degrees)
    dx, dy = p["x"] - cx, p["y"] - cy
    return point(cx + F.cos(t) * dx - F.sin(t) * dy, cy + F.sin(t) * dx + F.cos(t) * dy)


def angle_difference(a: Column, b: Column) -> Column:
    """Between two directions in radians, folded to [0, pi]."""
    d = F.pmod(a - b, F.lit(2 * 3.141592653589793))
    return F.least(d, 2 * 3.141592653589793 - d)


def is_diagonal(dx: Column, dy: Column) -> Column:
    """A direction farther than pi/8 from every multiple of pi/2."""
    to_axis = F.pmod(F.atan2(dy, dx), F.lit(3.141592653589793 / 2))
    off = F.least(to_axis, 3.141592653589793 / 2 - to_axis)
    return off > 3.141592653589793 / 8


def plane_height(x: Column, y: Column, p1: Column, p2: Column) -> Column:
    """Height at (x, y) of the plane through p1 and p2 (struct<x,y,z>) that is level across them."""
    fx, fy, fz = p2["x"] - p1["x"], p2["y"] - p1["y"], p2["z"] - p1["z"]
    run = fx * fx + fy * fy
    return fx * fz / run * (x - p1["x"]) + fy * fz / run * (y - p1["y"]) + p1["z"]


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """Easting and northing on WGS 84: the transverse Mercator series of Krueger to third order."""
    # The WGS 84 ellipsoid and the scale and offsets of UTM.
    a, f, k0, east, south = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - ((zone % 100) * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = F.when(zone >= 32700, F.lit(south)).otherwise(F.lit(0.0))
    return point(k0 * radius * x + east, k0 * radius * y + north)


def from_utm(x: Column, y: Column, zone: Column) -> Column:
    """Longitude and latitude (x, y) on WGS 84 of an easting and northing: the inverse series to third
    order. The latitude follows from the conformal one by steps that each leave a 150th of the error."""
    # The WGS 84 ellipsoid and the scale and offsets of UTM.
    a, f, k0, east, south = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    e = 2 * n**0.5 / (1 + n)
    xi = (y - F.when(zone >= 32700, F.lit(south)).otherwise(F.lit(0.0))) / (k0 * radius)
    eta = (x - east) / (k0 * radius)
    u, v = xi, eta
    for j, c in enumerate(beta, 1):
        u = u - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    level = F.asinh(F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u)))
    q = level
    for _ in range(6):
        q = level + e * F.atanh(e * F.tanh(q))
    return point(F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone % 100) * 6 - 183, F.degrees(F.asin(F.tanh(q))))


def bounds(ring: Column) -> Column:
    """x0, y0, x1, y1 of the box around a ring."""

    def values(c: str) -> Column:
        return F.transform(ring, lambda p: p[c])

    return F.struct(*[f(values(c)).alias(f"{c}{i}") for i, f in ((0, F.array_min), (1, F.array_max)) for c in "xy"])


def is_box(ring: Column) -> Column:
    """Four corners, and sides along the axes."""
    p = [F.get(ring, i) for i in range(4)]
    turns = [(p[0][a] == p[1][a]) & (p[1][b] == p[2][b]) & (p[2][a] == p[3][a]) & (p[3][b] == p[0][b]) for a, b in (("x", "y"), ("y", "x"))]
    return (F.size(ring) == 4) & (turns[0] | turns[1])


def box_overlap(box: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area that a box (as by bounds) shares with another."""
    wide = F.least(box["x1"], x1) - F.greatest(box["x0"], x0)
    high = F.least(box["y1"], y1) - F.greatest(box["y0"], y0)
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def concave_vertices(ring: Column) -> Column:
    """Vertices at which a ring, gone through counter-clockwise, turns to the right."""

    def own(ring: Column) -> Column:
        def turn(p: Column, i: Column) -> Column:
            before, after = F.get(ring, (i - 1 + F.size(ring)) % F.size(ring)), _next(ring, i)
            return (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"])

        return F.filter(ring, lambda p, i: turn(p, i) < 0)

    return let(counter_clockwise(ring), own)


def side_planes(ring: Column, inward: Column) -> Column:
    """The half-planes of a counter-clockwise ring's sides, moved inward by a distance."""

    def of(ring: Column) -> Column:
        def side(p: Column, i: Column) -> Column:
            n = _next(ring, i)
            dx, dy = n["x"] - p["x"], n["y"] - p["y"]
            size = F.sqrt(dx * dx + dy * dy)
            return half_plane(-dy / size, dx / size, (dy * p["x"] - dx * p["y"]) / size - inward)

        return F.transform(ring, side)

    return let(F.filter(ring, lambda p, i: p != _next(ring, i)), of)  # sides of no length have no direction


def eroded(ring: Column, by: Column) -> Column:
    """A convex ring less all that lies nearer than by to its border; it may be empty. The sides of boxes are
    moved, which rounds once; cutting would round at each corner."""

    def moved(box: Column) -> Column:
        x0, y0, x1, y1 = box["x0"] + by, box["y0"] + by, box["x1"] - by, box["y1"] - by
        own = rectangle(x0, y0, x1, y1)
        return F.when((x0 < x1) & (y0 < y1), own).otherwise(F.slice(own, 1, 0))

    cut = let(counter_clockwise(ring), lambda own: clipped(own, side_planes(own, by)))
    return F.when(is_box(ring), let(bounds(ring), moved)).otherwise(cut)


def shared_area(a: Column, b: Column) -> Column:
    """Area that two rings share, whatever their turns. A ring is the sum of the triangles of its fan, each
    with the sign of its turn, so what they share is the sum of what the first ring shares with each; a
    convex ring is one piece, and what two boxes share is a product."""

    def convex(own: Column) -> Column:
        return clipped_area(a, side_planes(own, F.lit(0.0)))

    def fan(own: Column) -> Column:
        def triangle(i: Column) -> Column:
            corners = F.array(F.get(own, F.lit(0)), F.get(own, i), F.get(own, i + 1))
            return let(corners, lambda t: F.when(signed_area(t) == 0, 0.0).otherwise(F.signum(signed_area(t)) * convex(counter_clockwise(t))))

        each = F.transform(F.sequence(F.lit(1), F.size(own) - 2), triangle)
        return F.abs(F.aggregate(each, F.lit(0.0), lambda total, area: total + area))

    boxes = let(bounds(b), lambda o: box_overlap(bounds(a), *[o[c] for c in ("x0", "y0", "x1", "y1")]))
    return F.when(F.size(b) < 3, 0.0).when(is_box(a) & is_box(b), boxes).when(F.size(concave_vertices(b)) == 0, let(counter_clockwise(b), convex)).otherwise(fan(b))


def overlap(a: Column, b: Column) -> Column:
    """shared, together and iou (shared over together): areas of two rings."""
    total = F.abs(signed_area(a)) + F.abs(signed_area(b))
    return let(shared_area(a, b), lambda s: F.struct(s.alias("shared"), (total - s).alias("together"), F.when(total - s > 0, s / (total - s)).alias("iou")))


def scaled(ring: Column, factor: Column) -> Column:
    """A ring drawn larger or smaller about its centroid."""
    return let(centroid(ring), lambda c: F.transform(ring, lambda p: point(c["x"] + (p["x"] - c["x"]) * factor, c["y"] + (p["y"] - c["y"]) * factor)))


def border_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest side of a ring."""

    def side(p: Column, i: Column) -> Column:
        n = _next(ring, i)
        dx, dy = n["x"] - p["x"], n["y"] - p["y"]
        size = dx * dx + dy * dy
        at = F.when(size > 0, F.least(F.greatest(((x - p["x"]) * dx + (y - p["y"]) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        ex, ey = x - p["x"] - at * dx, y - p["y"] - at * dy
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(ring, side))
