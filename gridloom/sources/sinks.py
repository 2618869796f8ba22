"""Sinks: result, height, contour and tag tables as CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans import model


def map_table(assignments: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Cells of the inclusive index box (xmin, ymin, xmax, ymax), moved to its corner; a sentinel row
    marks the far corner, so that readers know the extent."""
    xmin, ymin, xmax, ymax = box
    corner = assignments.sparkSession.createDataFrame([(float(xmax), float(ymax))], "xidx double, yidx double")
    rows = assignments.unionByName(corner, allowMissingColumns=True)
    inside = rows.where(F.col("xidx").between(xmin, xmax) & F.col("yidx").between(ymin, ymax))
    moved = inside.withColumns({"x": F.col("xidx") - xmin, "y": F.col("yidx") - ymin})
    return model.encoded(moved.select("x", "y", *[c for c in assignments.columns if c not in ("xidx", "yidx")]))


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def write_grids(grids: DataFrame, path: str) -> None:
    """The three grids of a map (kind, qx, qy, x, y), a folder for each."""
    grids.write.mode("overwrite").partitionBy("kind").parquet(path)
