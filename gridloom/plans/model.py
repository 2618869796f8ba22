"""Schemas of the map tables, and the sentinel codec of the file formats.

Inside the engine "unset" is null; files write it as -1. Cell indexes of the half and quarter grids
are kept in integer quarter units, so that joins never compare doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "id string, tags map<string,string>, geom_type string, coords array<array<struct<x:double,y:double>>>"
PAIRS = "array<struct<k:string,v:string>>"
CM_TYPE = f"struct<ord:int,menu:string,cat1:string,cat2:string,weight:double,dummy:boolean,tags:{PAIRS}>"
RULES = (
    f"name string, ord int, priority int, active boolean, tags {PAIRS}, exclude_tags {PAIRS}, required_tags {PAIRS}, "
    f"exclude_ids array<string>, allowed_ids array<string>, process array<string>, cm_types array<{CM_TYPE}>, "
    "modifiers struct<is_core:boolean,border_size:double,stride_x:int,stride_y:int,linear_name:string>"
)
ASSIGNMENTS = "xidx double, yidx double, z double, menu string, cat1 string, cat2 string, direction string, id int, name string, priority int"
POINTS = "x double, y double, z double"
MAP = "x double, y double, z double, menu string, cat1 string, cat2 string, direction string, done int"
TILES = "kind string, tile int, direction int, row int, col int, variant int, cost double, ports map<string,array<int>>"
BUILDINGS = (
    "profile string, building_type string, menu string, cat1 string, direction int, row int, col int, is_diagonal boolean, "
    "stories int, weight double, width int, height int, is_modular boolean"
)
MENUS = "profile string, label string, px int, py int"

# Metres of a cell's edge, and the areas of the three kinds of cell.
CELL = 8.0
SQUARE_AREA, DIAMOND_AREA, QUARTER_AREA = 64.0, 32.0, 16.0
#: Marks a row that any other one displaces.
BACKGROUND = -999


def quarter(index: Column) -> Column:
    """A cell index of any grid in integer quarter units."""
    return F.round(index * 4).cast("int")


def decoded(df: DataFrame) -> DataFrame:
    """-1 in a column of a map file becomes null."""
    for c, kind in df.dtypes:
        if c in ("z", "menu", "cat1", "cat2", "direction", "name", "priority"):
            unset = F.col(c) == (F.lit("-1") if kind == "string" else F.lit(-1))
            df = df.withColumn(c, F.when(~F.coalesce(unset, F.lit(False)), F.col(c)))
    return df


def encoded(df: DataFrame) -> DataFrame:
    """null in a column of a map becomes -1."""
    for c, kind in df.dtypes:
        if c in ("z", "menu", "cat1", "cat2", "direction", "name", "priority", "id"):
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit("-1") if kind == "string" else F.lit(-1).cast(kind)))
    return df
