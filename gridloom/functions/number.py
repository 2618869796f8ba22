"""Numbering rows in an order without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, chunk: Column, *order: str | Column, name: str = "idx") -> DataFrame:
    """rows with their number, from 0, in the given order. chunk never falls along the order: rows are
    ranked within each chunk, and only the chunks' sizes are summed up in one place."""
    own = rows.withColumn("__chunk", chunk)
    sizes = own.groupBy("__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy().orderBy(F.col("__chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__chunk").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = own.withColumn("__r", F.row_number().over(Window.partitionBy("__chunk").orderBy(*order)))
    met = ranked.join(starts, F.col("__chunk").eqNullSafe(F.col("__c")))
    return met.withColumn(name, F.col("__start") + F.col("__r") - 1).drop("__chunk", "__c", "__start", "__r")
