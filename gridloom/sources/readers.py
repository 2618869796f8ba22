"""Sources: features, rules, elevation points, map files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import model

POINT = "struct<x:double,y:double>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON feature collection as rows: id, tags (from properties.tags, else from properties),
    geometry kind and rings or lines as arrays of points. A multi-polygon's rings follow each other."""
    schema = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    tags = F.coalesce(F.from_json(F.get_json_object("properties", "$.tags"), "map<string,string>"), F.from_json("properties", "map<string,string>"))
    kind = F.col("geometry.type")
    text = F.col("geometry.coordinates")

    def points(line):
        return F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    deep = F.from_json(text, "array<array<array<array<double>>>>")
    rings = F.from_json(text, "array<array<array<double>>>")
    line = F.from_json(text, "array<array<double>>")
    one = F.from_json(text, "array<double>")
    coords = (
        F.when(kind == "MultiPolygon", F.transform(F.flatten(deep), points))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(rings, points))
        .when(kind.isin("LineString", "MultiPoint"), F.array(points(line)))
        .when(kind == "Point", F.array(points(F.array(one))))
    )
    return raw.select(F.get_json_object("properties", "$.id").alias("id"), tags.alias("tags"), kind.alias("geom_type"), coords.alias("coords"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file: a JSON object by rule name, whose order counts. It is a configuration of some
    dozens of rules, read on the driver."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return rule_table(spark, json.loads(text))


def rule_table(spark: SparkSession, config: dict) -> DataFrame:
    def pairs(xs):
        return None if xs is None else [(str(k), str(v)) for k, v in xs]

    rows = []
    for i, (name, r) in enumerate(config.items()):
        m = r.get("modifiers") or {}
        types = [(j, c.get("menu"), c.get("cat1"), c.get("cat2"), float(c.get("weight", 1.0)), bool(c.get("dummy", False)), pairs(c.get("tags"))) for j, c in enumerate(r.get("cm_types", []))]
        rows.append((name, i, r.get("priority"), r.get("active"), pairs(r.get("tags", [])), pairs(r.get("exclude_tags")), pairs(r.get("required_tags")), r.get("exclude_ids"), r.get("allowed_ids"), r.get("process", []), types, (m.get("is_core"), m.get("border_size"), m.get("stride_x"), m.get("stride_y"), m.get("linear_name"))))
    return spark.createDataFrame(rows, model.RULES)


def elevation_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of every regular file of a folder, each line split at white space or, if it has commas,
    at these. Compressed files are read by suffix."""
    text = spark.read.text(path).where(F.trim("value") != "")
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = F.when(F.contains(line, F.lit(",")), F.split(line, " *, *")).otherwise(F.split(line, " "))
    return text.select(*[F.get(parts, i).try_cast("double").alias(c) for i, c in enumerate("xyz")]).where("x is not null and y is not null")


def map_cells(spark: SparkSession, path: str) -> DataFrame:
    """A map file with a header; z is rounded half to even, absent done columns count as not done."""
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select(*[F.col(f"`{c}`").cast(k) for c, k in (x.split(" ") for x in model.MAP.split(", ")) if c in raw.columns])
    if "done" not in typed.columns:
        typed = typed.withColumn("done", F.lit(0))
    return model.decoded(typed.withColumn("z", F.bround("z"))).where(F.coalesce("done", F.lit(0)) == 0)


def raster(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """An elevation raster in long form (x, y, z, as Parquet); nodata cells become -1. Image formats
    need a decoder, which is left to a converter."""
    df = spark.read.parquet(path).select("x", "y", F.col("z").cast("double"))
    return df if nodata is None else df.withColumn("z", F.when(F.col("z") == nodata, F.lit(-1.0)).otherwise(F.col("z")))


def grids(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a map's grids as sinks.write_grids() left them: kind, qx, qy, x, y."""
    return spark.read.parquet(path)
