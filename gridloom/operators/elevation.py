"""Elevation: cell size, clipping, lifting, water level, rasters and contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry as g
from gridloom.functions.number import numbered
from gridloom.plans.model import CELL

# The least height of a map, and what is added so that it is reached.
LEAST = 20


def cell_size(points: DataFrame) -> DataFrame:
    """One row: dx and dy, the steps between the two smallest distinct coordinates."""
    out = None
    for c in "xy":
        two = points.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(2)
        step = two.agg((F.max(c) - F.min(c)).alias(f"d{c}"))
        out = step if out is None else out.join(step)  # two single rows
    return out


def extent(points: DataFrame, cell: float) -> DataFrame:
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), (F.max("x") - F.min("x") + cell).alias("width"), (F.max("y") - F.min("y") + cell).alias("height"))


def clip(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Left-inclusive; plain comparisons that reach the scan."""
    return points.where((F.col("x") >= xmin) & (F.col("x") < xmax) & (F.col("y") >= ymin) & (F.col("y") < ymax))


def lifted(points: DataFrame) -> DataFrame:
    """If the least height of all is below LEAST, all are moved so that its floor is LEAST."""
    low = points.agg(F.min("z").alias("__low"))
    z = F.when(F.col("__low") < LEAST, F.col("z") - F.floor("__low") + LEAST).otherwise(F.col("z"))
    return points.join(F.broadcast(low)).withColumn("z", z).drop("__low")  # low is one row


def height_near(points: DataFrame, x: float, y: float, reach: float, name: str) -> DataFrame:
    """One row: the height at the first point, by x, y and z, within reach of (x, y), null without one."""
    near = points.where(F.col("x").between(x - reach, x + reach) & F.col("y").between(y - reach, y + reach))
    return near.agg(F.min_by("z", F.struct("x", "y", "z")).alias(name))


def level_water(points: DataFrame, p1: tuple[float, float], p2: tuple[float, float], reach: float) -> DataFrame:
    """Takes the slope of the plane through two water points off all heights; without a height near
    either point nothing changes."""
    z = height_near(points, *p1, reach, "__z1").join(height_near(points, *p2, reach, "__z2"))
    ends = [F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"), F.col(c).alias("z")) for p, c in ((p1, "__z1"), (p2, "__z2"))]
    fall = g.plane_height(F.col("x"), F.col("y"), *ends) - F.col("__z1")
    return points.join(F.broadcast(z)).withColumn("z", F.col("z") - F.coalesce(fall, F.lit(0.0))).drop("__z1", "__z2")  # z is one row


def densified(points: DataFrame, nx: int, ny: int, cell: float, order: str = "z") -> DataFrame:
    """x, y (cell numbers), z of a full raster: of several points in a cell the last by order counts,
    cells without any are 0."""
    spark = points.sparkSession
    own = points.groupBy(F.floor(F.col("x") / cell).cast("int").alias("x"), F.floor(F.col("y") / cell).cast("int").alias("y")).agg(F.max_by("z", order).alias("z"))
    i = spark.range(nx * ny)
    full = i.select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    return full.join(own, ["x", "y"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def downsampled(raster: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of factor by factor cells."""
    return raster.groupBy(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(F.avg("z").alias("z"))


def resampled(raster: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (tx, ty: positions in cell numbers of raster, and any others) with the bilinear height
    z; -1 where a neighbour is missing. Four neighbours by one equi-join."""
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    keyed = targets.withColumn("__id", F.struct(*targets.columns)).withColumn("__c", F.explode(corner))
    fx, fy = F.col("tx") - F.floor("tx"), F.col("ty") - F.floor("ty")
    w = F.when(F.col("__c.a") == 1, fx).otherwise(1 - fx) * F.when(F.col("__c.b") == 1, fy).otherwise(1 - fy)
    near = keyed.withColumns({"__w": w, "__x": (F.floor("tx") + F.col("__c.a")).cast("int"), "__y": (F.floor("ty") + F.col("__c.b")).cast("int")}).where("__w > 0")
    met = near.join(raster.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("z").alias("__z")), ["__x", "__y"], "left")
    return met.groupBy("__id").agg(F.when(F.count("*") == F.count("__z"), F.sum(F.col("__w") * F.col("__z"))).otherwise(-1.0).alias("z")).select("__id.*", "z")


def rotated(raster: DataFrame, nx: int, ny: int, degrees: float) -> DataFrame:
    """A raster turned about its centre, of the same size."""
    import math

    cx, cy, t = (nx - 1) / 2, (ny - 1) / 2, math.radians(-degrees)
    i = raster.sparkSession.range(nx * ny)
    cells = i.select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    at = cells.withColumns({"tx": F.lit(cx) + dx * math.cos(t) - dy * math.sin(t), "ty": F.lit(cy) + dx * math.sin(t) + dy * math.cos(t)})
    return resampled(raster, at).select("x", "y", "z")


def contours(raster: DataFrame, step: float) -> DataFrame:
    """Distinct vertices (x, y rounded, z the level) where levels, multiples of step, cross the edges
    between neighbouring raster points. Each point looks right and up; two equi-joins by arithmetic."""
    out = None
    for dx, dy in ((1, 0), (0, 1)):
        other = raster.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("z").alias("z2"))
        edge = raster.join(other, ["x", "y"]).where("z <> z2")
        low, high = F.least("z", "z2"), F.greatest("z", "z2")
        first, last = F.greatest(F.ceil(low / step), F.lit(0)), F.ceil(high / step) - 1
        level = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
        met = edge.withColumn("k", level).withColumn("level", F.col("k") * step)
        at = (F.col("level") - F.col("z")) / (F.col("z2") - F.col("z"))
        found = met.select(F.round((F.col("x") + dx * at) * CELL).cast("long").alias("x"), F.round((F.col("y") + dy * at) * CELL).cast("long").alias("y"), F.col("level").alias("z"))
        out = found if out is None else out.union(found)
    return out.distinct()


def strided(points: DataFrame, order: tuple[str, ...], n: int, group: str | None = None) -> DataFrame:
    """Every n-th row in an order, from the first; with group, in each group. Without, the first column
    of the order is a number, by whose whole part rows are dealt to be ranked."""
    if group:
        ranked = points.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    else:
        ranked = numbered(points, F.floor(order[0]), *order, name="__k")
    return ranked.where(F.col("__k") % n == 0).drop("__k")


def with_corner(points: DataFrame, extent_of: DataFrame) -> DataFrame:
    """points and a last row at the largest x and y of extent_of, with a height of -1, by which readers
    know the extent."""
    kinds = dict(points.dtypes)
    corner = extent_of.agg(F.max("x").cast(kinds["x"]).alias("x"), F.max("y").cast(kinds["y"]).alias("y"), F.lit(-1).cast(kinds["z"]).alias("z")).where("x is not null")
    return points.unionByName(corner)


def pixel(x: Column, y: Column, left: float, top: float, cell: float) -> tuple[Column, Column]:
    """Row and column of a position in a raster whose rows go down from its upper left corner."""
    return F.floor((F.lit(top) - y) / cell).cast("int"), F.floor((x - left) / cell).cast("int")


def position(row: Column, col: Column, left: float, top: float, cell: float) -> tuple[Column, Column]:
    """x and y of a pixel's centre."""
    return F.lit(left) + (col + 0.5) * cell, F.lit(top) - (row + 0.5) * cell


def window(pixels: DataFrame, box: tuple[float, float, float, float], left: float, top: float, cell: float) -> DataFrame:
    """x, y, z of the pixels (row, col, z) of a box (xmin, ymin, xmax, ymax) and of one more all around."""
    low, high = (pixel(F.lit(float(box[i])), F.lit(float(box[i + 1])), left, top, cell) for i in (0, 2))
    inside = pixels.where(F.col("row").between(high[0] - 1, low[0] + 1) & F.col("col").between(low[1] - 1, high[1] + 1))
    x, y = position(F.col("row"), F.col("col"), left, top, cell)
    return inside.select(x.alias("x"), y.alias("y"), "z")


def cropped(raster: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Cells of a box (x0, y0, x1, y1, the last ones out), counted from its corner."""
    x0, y0, x1, y1 = box
    inside = raster.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def rescaled(raster: DataFrame, step_x: float, step_y: float) -> DataFrame:
    """x, y, z of a raster whose cells are step_x by step_y cells of the given one (x, y, z), whole numbers
    or not. Heights are weighted by a triangle as wide as two cells, old ones or new ones, whichever are
    larger: first along rows, then along columns. Cells without a height have no weight; new cells
    that none reaches get no row."""

    def along(rows: DataFrame, c: str, other: str, step: float) -> DataFrame:
        wide, at = max(step, 1.0), F.col(c) + 0.5
        first, last = F.floor((at - wide) / step - 0.5) + 1, F.ceil((at + wide) / step - 0.5) - 1
        each = rows.where(first <= last).withColumn("__t", F.explode(F.sequence(first, last)))
        w = (1 - F.abs(at - (F.col("__t") + 0.5) * step) / wide) * F.col("__w")
        new = each.withColumn("__v", w).where("__v > 0").groupBy(F.col("__t").cast("int").alias(c), F.col(other))
        return new.agg(F.sum(F.col("__v") * F.col("z")).alias("__s"), F.sum("__v").alias("__w")).select("x", "y", (F.col("__s") / F.col("__w")).alias("z"), "__w")

    known = raster.where("z is not null").select("x", "y", F.col("z").cast("double").alias("z"), F.lit(1.0).alias("__w"))
    return along(along(known, "x", "y", step_x), "y", "x", step_y).select("x", "y", "z")
