"""Heights of a map's cells from an image of elevation, from the file to one row per cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.operators import elevation, scattered
from gridloom.plans.model import CELL
from gridloom.sources import geotiff

#: Map units of a tile that is triangulated by one task, and of its halo.
TILE, HALO = 512.0, 32.0
#: Fixed value: what cells without a height become.
NO_HEIGHT = -1.0


def image_points(spark: SparkSession, path: str, cell: float = CELL) -> DataFrame:
    """x, y, z: pixels of an image in map units, rescaled to cells if they are upright; pixels of an
    image in degrees are projected to the zone of its middle as they are. Pixels without a height count
    as NO_HEIGHT."""
    image, pixels = geotiff.described(path), geotiff.pixels(spark, path)
    filled = pixels.withColumn("z", F.coalesce("z", F.lit(NO_HEIGHT)))
    x0, dx, rx, y0, ry, dy = image.affine()
    width, height = image.one(geotiff.WIDTH), image.one(geotiff.HEIGHT)
    if image.geographic:
        middle = x0 + dx * width / 2 + rx * height / 2, y0 + ry * width / 2 + dy * height / 2
        at = g.to_utm(F.col("x"), F.col("y"), g.utm_zone(F.lit(middle[0]), F.lit(middle[1])))
        return filled.select(at.alias("at"), "z").select("at.x", "at.y", "z")
    if rx or ry:
        return filled.select("x", "y", "z")
    # as many whole cells as fit
    nx, ny = max(1, int(width * abs(dx) / cell)), max(1, int(height * abs(dy) / cell))
    sx, sy = width / nx, height / ny
    small = elevation.rescaled(filled.select(F.col("col").alias("x"), F.col("row").alias("y"), "z"), sx, sy)
    small = small.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return small.select((x0 + dx * sx * (F.col("x") + 0.5)).alias("x"), (y0 + dy * sy * (F.col("y") + 0.5)).alias("y"), "z")


def image_heights(spark: SparkSession, path: str, box: tuple[float, float, float, float], cell: float = CELL) -> DataFrame:
    """x, y (numbers of cells) and z of a map over a box (xmin, ymin, xmax, ymax, map units): heights of
    cells' centres between the image's points, which are read two cells beyond the box. Cells outside the
    points have no height."""
    xmin, ymin, xmax, ymax = box
    nx, ny = math.floor((xmax - xmin) / cell) + 1, math.floor((ymax - ymin) / cell) + 1
    points = image_points(spark, path, cell)
    near = points.where(F.col("x").between(xmin - 2 * cell, xmin + (nx + 2) * cell) & F.col("y").between(ymin - 2 * cell, ymin + (ny + 2) * cell))
    i = spark.range(nx * ny)
    at = i.select((F.col("id") % nx).cast("int").alias("xidx"), F.floor(F.col("id") / nx).cast("int").alias("yidx"))
    centres = at.select("xidx", "yidx", (xmin + cell / 2 + F.col("xidx") * cell).alias("x"), (ymin + cell / 2 + F.col("yidx") * cell).alias("y"))
    return scattered.interpolated(near, centres, TILE, HALO).select(F.col("xidx").alias("x"), F.col("yidx").alias("y"), "z")
