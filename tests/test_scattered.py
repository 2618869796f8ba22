"""Heights between scattered points, against all triangles whose circles are empty."""

import itertools
import random

import numpy as np
import pytest

from gridloom.operators import scattered


def every_triangle(points):
    """Triangles of the Delaunay triangulation: those of all triples whose circle holds no other point."""
    p = np.array([q[:2] for q in points], float)
    t = np.array(list(itertools.combinations(range(len(p)), 3)))
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    bb, cc = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
    o = a + np.stack([(c - a)[:, 1] * bb - (b - a)[:, 1] * cc, (b - a)[:, 0] * cc - (c - a)[:, 0] * bb], 1) / d[:, None]
    r = ((o - a) ** 2).sum(1)
    away = ((p[None] - o[:, None]) ** 2).sum(2) >= r[:, None] * (1 - 1e-9)
    return t[away.all(1)], p


def height(x, y, points, triangles, p):
    for t in triangles:
        m = np.array([[*p[i], 1.0] for i in t]).T
        w = np.linalg.solve(m, [x, y, 1.0])
        if w.min() >= -1e-12:
            return float(sum(w[k] * points[i][2] for k, i in enumerate(t)))
    return None


@pytest.mark.parametrize(("tile", "halo"), [(15.0, 1.0), (1000.0, 0.0)])
def test_heights_between_scattered_points(spark, tile, halo):
    rng = random.Random(3)
    points = [(round(rng.uniform(-50, 50), 3), round(rng.gauss(0, 15), 3), rng.uniform(0, 9)) for _ in range(60)]
    targets = [(i, round(rng.uniform(-55, 55), 3), round(rng.uniform(-40, 40), 3)) for i in range(150)] + [(150, *points[0][:2]), (151, points[3][0], points[3][1]), (152, None, 1.0), (153, float("nan"), 1.0), (154, 0.0, 0.0), (155, 0.0, 0.0)]
    odd = [(*points[0][:2], points[0][2] + 1), (None, 1.0, 1.0), (1.0, 1.0, None), (float("inf"), 0.0, 0.0)]
    own = spark.createDataFrame(points + odd, "x double, y double, z double").repartition(3)
    got = {r["id"]: r["z"] for r in scattered.interpolated(own, spark.createDataFrame(targets, "id int, x double, y double"), tile, halo).collect()}
    triangles, p = every_triangle(points)
    assert len(got) == len(targets) and got[152] is got[153] is None
    outside = 0
    for i, x, y in targets[:152] + targets[154:]:
        want = height(x, y, points, triangles, p)
        outside += want is None
        assert got[i] == pytest.approx(want, abs=1e-9) if want is not None else got[i] is None, (i, x, y)
    assert 20 < outside < 130


def test_points_of_a_grid_give_one_triangulation(spark):
    """All points lie on circles with others; heights are the same whatever the tiles are."""
    rng = random.Random(4)
    points = [(float(i), float(j), float(rng.randrange(9))) for i in range(14) for j in range(11)]
    targets = [(i, rng.uniform(0, 13), rng.uniform(0, 10)) for i in range(120)] + [(120, 13.0, 4.5), (121, 0.0, 0.0)]
    own, at = spark.createDataFrame(points, "x double, y double, z double"), spark.createDataFrame(targets, "id int, x double, y double")
    found = [sorted(tuple(r) for r in scattered.interpolated(own, at, t, h).select("id", "z").collect()) for t, h in ((3.0, 0.2), (50.0, 0.0))]
    assert found[0] == found[1] and all(z is not None for _, z in found[0])
    assert found[0][120][1] == pytest.approx((points[13 * 11 + 4][2] + points[13 * 11 + 5][2]) / 2)


def test_points_that_span_nothing(spark):
    kind = "x double, y double, z double"
    at = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    for points in ([], [(1.0, 1.0, 3.0)], [(0.0, 0.0, 1.0), (2.0, 2.5, 3.0)], [(float(i), 0.0, 1.0) for i in range(9)]):
        assert [r["z"] for r in scattered.interpolated(spark.createDataFrame(points, kind), at, 5.0, 1.0).collect()] == [None]


def test_only_points_near_targets_are_dealt(spark, tmp_path):
    """However dense the points are; where they are sparse, buckets grow."""
    places = spark.createDataFrame([(500, 500, 0), (90, 910, 0), (-50, 5000, 0)], "x bigint, y bigint, tile bigint")
    sizes = []
    for step in (20, 5):
        points = spark.range((1000 // step) ** 2).selectExpr(f"id % {1000 // step} * {step} as x", f"id div {1000 // step} * {step} as y", "1.0D as z").where("x > 300 or y > 300")
        box = points.selectExpr("min(x) lowx", "max(x) highx", "min(y) lowy", "max(y) highy", "count(*) n").first()
        found, near = scattered.surroundings(places, points, box, 1 << 20, 1000, str(tmp_path / str(step)))
        sizes.append(near.count())
        assert found.count() == 3 and near.groupBy("tile").count().count() == 1
        lone = spark.createDataFrame([(100, 100, 0)], "x bigint, y bigint, tile bigint")
        wide, more = scattered.surroundings(lone, points, box, 1 << 20, 1000, str(tmp_path / f"{step}-lone"))
        assert wide.first()["grain"] > found.where("x = 500").first()["grain"] and more.count() >= scattered.LEAST
    assert max(sizes) < 3 * 16 * scattered.LEAST


def test_targets_between_clusters(spark):
    """Triangles of far points, found from few of them, are those found from all in one tile."""
    rng = random.Random(8)
    points = [(cx + rng.gauss(0, 0.4), cy + rng.gauss(0, 0.4), rng.uniform(0, 9)) for cx, cy in ((0, 0), (90, 3), (40, 70)) for _ in range(700)]
    targets = [(i, rng.uniform(0, 80), rng.uniform(0, 50)) for i in range(60)] + [(60 + i, *points[i * 50][:2]) for i in range(40)]
    own, at = spark.createDataFrame(points, "x double, y double, z double").repartition(3), spark.createDataFrame(targets, "id int, x double, y double")
    got = {r["id"]: r["z"] for r in scattered.interpolated(own, at, 25.0, 2.0).collect()}
    whole = {(round(x * 1000), round(y * 1000)): z for x, y, z in points}
    want, _ = scattered.heights(whole, [(round(x * 1000), round(y * 1000)) for _, x, y in targets], 200_000)
    assert [got[i] for i in range(100)] == pytest.approx(want) and sum(z is not None for z in want) > 60


def test_targets_on_the_hull_far_from_its_points(spark):
    """The points beside them on the hull count, though they are far beyond what is near."""
    rng = random.Random(9)
    points = [(rng.uniform(1, 99), rng.uniform(1, 99), 5.0) for _ in range(900)] + [(x, y, x + y) for x, y in ((0.0, 0.0), (0.0, 40.0), (0.0, 100.0), (100.0, 0.0), (100.0, 100.0))] + [(0.0, 70.0, 0.0)]
    at = spark.createDataFrame([(1, 0.0, 15.0), (2, 0.0, 55.0), (3, 0.0, 85.0), (4, 50.0, 0.0)], "id int, x double, y double")
    got = {r["id"]: r["z"] for r in scattered.interpolated(spark.createDataFrame(points, "x double, y double, z double"), at, 10.0, 1.0).collect()}
    assert got == pytest.approx({1: 15.0, 2: 20.0, 3: 50.0, 4: 50.0})
