"""Work that has an order, in rounds of tiles of a map: who has to wait for another tile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_folder

_folders: list[str] = []
#: Map cells along the edge of a tile, within which things are settled in order by one task.
TILE = 64


def waiting(claims: DataFrame, *keys: str) -> DataFrame:
    """The turns that some open one of another tile precedes at a key; claims: tile, turn, and the keys
    that the turn reaches for. The least two first turns of tiles at a key tell; at most as many rows
    meet at one as there are tiles that reach it."""
    first = claims.groupBy(*keys, "tile").agg(F.min("turn").alias("turn"))
    two = first.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "tile"))), 1, 2).alias("two")).where(F.size("two") > 1)
    met = claims.join(two, list(keys))
    other = F.when(F.get("two", 0)["tile"] != F.col("tile"), F.get("two", 0)["turn"]).otherwise(F.get("two", 1)["turn"])
    return met.where(other < F.col("turn")).select("turn").distinct()


def spread(rows: DataFrame, *order: str) -> DataFrame:
    """rows by tile, in order. Much work on few bytes: as many partitions as are set, which aren't merged."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tile").sortWithinPartitions("tile", *order)


def new_folder(spark: SparkSession, name: str) -> str:
    """For the tables of all rounds, which cut the lineage and which the result reads. It stays until
    sweep() deletes it."""
    _folders.append(f"{shared_folder(spark)}/gridloom-{name}/{uuid.uuid4().hex}")
    return _folders[-1]


def sweep(spark: SparkSession) -> None:
    """Delete the folders of all rounds so far. Only for callers who have written whatever reads them."""
    jvm = spark.sparkContext._jvm
    while _folders:
        target = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df, cut from its lineage: what reads it often doesn't plan and compute it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
