"""Resolving competing assignments of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.plans.model import BACKGROUND

CELL_KEY = ("xidx", "yidx")


def valid(rows: DataFrame) -> DataFrame:
    """Distinct rows that set a type or a height."""
    return rows.distinct().where("menu is not null or z is not null")


def dominant(rows: DataFrame) -> DataFrame:
    """Where a cell has several rows: background goes; if a positive priority exists, only the least
    of those stays, with all rows of priority 0, and negative ones go."""
    own = Window.partitionBy(*CELL_KEY)
    p = F.col("priority")
    counted = rows.withColumns({"__n": F.count("*").over(own), "__low": F.min(F.when(p > 0, p)).over(own)})
    loses = (p == BACKGROUND) | (F.col("__low").isNotNull() & ((p > F.col("__low")) | (p < 0)))
    return counted.where(~((F.col("__n") > 1) & F.coalesce(loses, F.lit(False)))).drop("__n", "__low")


def best_ranked(rows: DataFrame, ranks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Of several rows of a cell with one priority and name, only the best of those with a rank stays,
    and all without. ranks: name, menu, cat1, ord; the first entry of a name, menu and cat1 counts.
    order settles equal ranks."""
    first = ranks.groupBy("name", "menu", "cat1").agg(F.min("ord").alias("__rank"))
    ranked = rows.join(first, ["name", "menu", "cat1"], "left")
    own = Window.partitionBy(*CELL_KEY, "priority", "name", F.col("__rank").isNull()).orderBy("__rank", *order)
    return ranked.withColumn("__r", F.row_number().over(own)).where("__rank is null or __r = 1").select(*rows.columns)


def resolved(rows: DataFrame, ranks: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return best_ranked(dominant(valid(rows)), ranks, order)
