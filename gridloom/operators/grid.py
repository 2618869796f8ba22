"""Regular grids and joins with them: a cell is arithmetic, never a range join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.operators import borders
from gridloom.plans.model import CELL, SQUARE_AREA

# Where the centres of half and quarter cells lie, in quarters of a cell.
DIAMONDS = ((2, 0), (-2, 0), (0, 2), (0, -2))
QUARTERS = ((-1, -1), (1, -1), (-1, 1), (1, 1))


def squares(spark: SparkSession, nx: int, ny: int, x0: float = 0.0, y0: float = 0.0, cell: float = CELL) -> DataFrame:
    """xidx, yidx, x, y (centre) of all cells, from one range: no join."""
    i = spark.range(nx * ny)
    cells = i.select((F.col("id") % max(nx, 1)).cast("int").alias("xidx"), F.floor(F.col("id") / max(nx, 1)).cast("int").alias("yidx"))
    return cells.withColumns({"x": F.lit(x0) + (F.col("xidx") + 0.5) * cell, "y": F.lit(y0) + (F.col("yidx") + 0.5) * cell})


def squares_over(points: DataFrame, x: str, y: str, cell: float = CELL) -> DataFrame:
    """All cells that the box around a table's points touches, numbered from its lower left one. No points, no
    cells."""
    ends = [f(F.floor(F.col(c) / cell)).alias(f"{n}{i}") for i, c in enumerate((x, y)) for n, f in (("low", F.min), ("high", F.max))]
    r = points.agg(*ends).first()  # one row
    if r["low0"] is None or r["low1"] is None:
        return squares(points.sparkSession, 0, 0, cell=cell)
    return squares(points.sparkSession, r["high0"] - r["low0"] + 1, r["high1"] - r["low1"] + 1, r["low0"] * cell, r["low1"] * cell, cell)


def around(cells: DataFrame, offsets: tuple[tuple[int, int], ...], cell: float = CELL) -> DataFrame:
    """Cells of a finer grid around each centre, once each, indexed in quarter units (qx, qy)."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    each = cells.withColumn("s", F.explode(steps))
    return each.select((F.col("xidx") * 4 + F.col("s.a")).alias("qx"), (F.col("yidx") * 4 + F.col("s.b")).alias("qy"), (F.col("x") + F.col("s.a") * (cell / 4)).alias("x"), (F.col("y") + F.col("s.b") * (cell / 4)).alias("y")).dropDuplicates(["qx", "qy"])


def diamonds(cells: DataFrame, cell: float = CELL) -> DataFrame:
    return around(cells, DIAMONDS, cell)


def quarters(cells: DataFrame, cell: float = CELL) -> DataFrame:
    return around(cells, QUARTERS, cell)


def turned(cells: DataFrame, degrees: float, cx: float, cy: float) -> DataFrame:
    """Centres of a grid that is rotated about a point."""
    p = g.rotated(g.point(F.col("x"), F.col("y")), F.lit(degrees), F.lit(cx), F.lit(cy))
    return cells.withColumn("__p", p).withColumns({"x": F.col("__p.x"), "y": F.col("__p.y")}).drop("__p")


def point_cells(points: DataFrame, x: str, y: str, cell: float = CELL) -> DataFrame:
    """points with xidx and yidx; points on a cell's edge lie in none and go."""
    fx, fy = F.col(x) / cell, F.col(y) / cell
    inside = (fx != F.floor(fx)) & (fy != F.floor(fy))
    return points.where(inside).withColumns({"xidx": F.floor(fx).cast("int"), "yidx": F.floor(fy).cast("int")})


def nearest_cell(points: DataFrame, x: str, y: str, nx: int, ny: int, cell: float = CELL) -> DataFrame:
    """points with the nearest cell of an nx by ny grid."""

    def near(c: str, n: int):
        return F.least(F.greatest(F.floor(F.col(c) / cell), F.lit(0)), F.lit(n - 1)).cast("int")

    return points.withColumns({"xidx": near(x, nx), "yidx": near(y, ny)})


def all_grids(cells: DataFrame, cell: float = CELL) -> DataFrame:
    """kind, qx, qy, x, y: the squares, diamonds and quarter cells of a map, in quarter units."""
    own = cells.select((F.col("xidx") * 4).alias("qx"), (F.col("yidx") * 4).alias("qy"), "x", "y")
    each = [("square", own), ("diamond", diamonds(cells, cell)), ("quarter", quarters(cells, cell))]
    return reduce(DataFrame.union, [df.select(F.lit(kind).alias("kind"), "qx", "qy", "x", "y") for kind, df in each])


def candidate_cells(shapes: DataFrame, ring: str, cell: float = CELL, pad: Column | float = 0.0) -> DataFrame:
    """shapes with one row per cell of the ring's bounding box, which pad widens."""

    def span(c: str) -> Column:
        values = F.transform(ring, lambda p: p[c])
        return F.sequence(F.floor((F.array_min(values) - pad) / cell), F.floor((F.array_max(values) + pad) / cell))

    wide = shapes.withColumn("xidx", F.explode(span("x")))
    return wide.withColumn("yidx", F.explode(span("y"))).withColumns({"xidx": F.col("xidx").cast("int"), "yidx": F.col("yidx").cast("int")})


def fill(shapes: DataFrame, ring: str, share: float = 0.5, cell: float = CELL) -> DataFrame:
    """shapes with one row per cell of which more than share is covered, and the area covered."""
    x, y = F.col("xidx") * cell, F.col("yidx") * cell
    cells = candidate_cells(with_box(shapes, ring), ring, cell).withColumn("area", box_area(ring, x, y, x + cell, y + cell))
    return cells.drop("__box").where(F.col("area") > share * SQUARE_AREA * (cell / CELL) ** 2)


def with_box(shapes: DataFrame, ring: str) -> DataFrame:
    """shapes with __box, the bounds of rings that are boxes: found once for each shape."""
    return shapes.withColumn("__box", F.when(g.is_box(F.col(ring)), g.bounds(F.col(ring))))


def box_area(ring: str, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a ring in an upright cell: a product for boxes, else the ring is cut."""
    cut = g.clipped_area(F.col(ring), g.box_planes(x0, y0, x1, y1))
    return F.when(F.col("__box").isNotNull(), g.box_overlap(F.col("__box"), x0, y0, x1, y1)).otherwise(cut)


def fill_core(shapes: DataFrame, ring: str, border: str, share: float = 0.5, cell: float = CELL) -> DataFrame:
    """The same, after a border of so many cells (a column, null for none) is taken off the shape; a
    negative one is added to it, with round corners. Convex shapes lose theirs by moved half-planes, all
    others as borders.with_bordered_area says."""
    marked = shapes.withColumn("__by", F.coalesce(F.col(border) * cell, F.lit(0.0)))
    turned = (F.col("__by") > 0) & (F.size(g.concave_vertices(F.col(ring))) > 0)
    marked = marked.withColumn("__round", (F.col("__by") < 0) | turned)
    cut = marked.where(~F.col("__round")).withColumn("__core", F.when(F.col("__by") > 0, g.eroded(F.col(ring), F.col("__by"))).otherwise(F.col(ring))).where(F.size("__core") > 0)
    x, y = F.col("xidx") * cell, F.col("yidx") * cell
    plain = candidate_cells(with_box(cut, "__core"), "__core", cell).withColumn("area", box_area("__core", x, y, x + cell, y + cell))
    enough = F.col("area") > share * SQUARE_AREA * (cell / CELL) ** 2
    plain = plain.where(enough).drop("__by", "__round", "__core", "__box")
    # apart, so that only cells of such shapes pass through the larger expressions and Python; shapes that are
    # alike but for whole cells between them do so once
    low = g.bounds(F.col(ring))
    moved = marked.where("__round").withColumns({f"__c{c}": F.floor(low[f"{c}0"] / cell) for c in "xy"})
    moved = moved.withColumn("__own", F.transform(ring, lambda p: g.point(p["x"] - F.col("__cx") * cell, p["y"] - F.col("__cy") * cell)))
    parts = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work on few bytes
    own = moved.select("__own", "__by").repartition(parts, "__own", "__by").distinct()
    near = borders.with_bordered_area(candidate_cells(own, "__own", cell, F.greatest(-F.col("__by"), F.lit(0.0))), "__own", "__by", x, y, cell)
    found = near.where(enough).groupBy("__own", "__by").agg(F.collect_list(F.struct("xidx", "yidx", "area")).alias("__cells"))
    each = moved.join(found.hint("merge"), ["__own", "__by"]).withColumn("__cell", F.explode("__cells"))
    near = each.withColumns({k: (F.col(f"__cell.{k}") + F.col(c)).cast("int") for k, c in (("xidx", "__cx"), ("yidx", "__cy"))} | {"area": F.col("__cell.area")})
    return plain.unionByName(near.select(*plain.columns))


def fill_fine(shapes: DataFrame, ring: str, offsets: tuple[tuple[int, int], ...], share: float, cell: float = CELL) -> DataFrame:
    """The same over diamonds or quarter cells, in quarter units. Each fine cell is told of once: a quarter
    by its cell, a diamond by the cell left of it or below it."""
    twice = offsets == DIAMONDS
    own = [o for o in offsets if min(o) >= 0] if twice else offsets
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in own])
    each = candidate_cells(with_box(shapes, ring), ring, cell, cell if twice else 0.0).withColumn("s", F.explode(steps))
    fine = each.withColumns({"qx": F.col("xidx") * 4 + F.col("s.a"), "qy": F.col("yidx") * 4 + F.col("s.b")}).drop("s", "xidx", "yidx")
    cx, cy = (F.col("qx") / 4 + 0.5) * cell, (F.col("qy") / 4 + 0.5) * cell
    if twice:
        area, base = g.clipped_area(F.col(ring), g.diamond_planes(cx, cy, cell / 2)), cell * cell / 2
    else:
        area, base = box_area(ring, cx - cell / 4, cy - cell / 4, cx + cell / 4, cy + cell / 4), cell * cell / 4
    return fine.withColumn("area", area).where(F.col("area") > share * base).drop("__box")


def free(cells: DataFrame, occupied: DataFrame, keys: tuple[str, ...] = ("xidx", "yidx")) -> DataFrame:
    """cells that nothing occupies yet."""
    return cells.join(occupied.select(*keys).distinct(), list(keys), "left_anti")
