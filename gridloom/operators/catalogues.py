"""Catalogues of tiles, buildings and menus as small tables, and layers for a whole map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import model

# The kind of building that any unknown kind falls back to.
FALLBACK = "residential"


def tiles(spark: SparkSession, entries: dict[tuple[int, ...], dict[str, list[int] | None]], kind: str, cost: float = 1.0) -> DataFrame:
    """A tile catalogue from entries (direction, row, col and, by choice, variant) -> ports by direction
    name, None for a closed side. n_connections is the number of open sides."""
    rows = [(kind, i, k[0], k[1], k[2], k[3] if len(k) > 3 else 0, cost, {d: list(p) for d, p in ports.items() if p is not None}) for i, (k, ports) in enumerate(entries.items())]
    return spark.createDataFrame(rows, model.TILES).withColumn("n_connections", F.size(F.map_keys("ports")))


def fitting(tile_table: DataFrame, needed: dict[str, int]) -> DataFrame:
    """Tiles with exactly the needed sides open, each at the needed port."""
    own = F.size(F.map_keys("ports")) == len(needed)
    for side, port in needed.items():
        own = own & F.coalesce(F.array_contains(F.try_element_at("ports", F.lit(side)), port), F.lit(False))
    return tile_table.where(own)


def buildings(catalogue: DataFrame, profile: str, kind: str) -> DataFrame:
    """The catalogue of one profile and kind; an unknown kind is residential, an unknown profile has
    no rows."""
    own = catalogue.where(F.col("profile") == profile)
    known = own.groupBy().agg(F.coalesce(F.bool_or(F.col("building_type") == kind), F.lit(False)).alias("__known"))
    return own.join(F.broadcast(known)).where(F.col("building_type") == F.when(F.col("__known"), kind).otherwise(FALLBACK)).drop("__known")  # one row


def sizes(catalogue: DataFrame) -> DataFrame:
    """Per orientation and size whether any building is modular."""
    return catalogue.groupBy("is_diagonal", "width", "height").agg(F.bool_or("is_modular").alias("is_modular"))


def largest_footprint(catalogue: DataFrame, factor: float) -> DataFrame:
    return catalogue.groupBy("is_diagonal").agg((F.max(F.col("width") * F.col("height")) * factor).alias("area"))


def row_col(qx: Column, qy: Column, xmin: Column, ymin: Column, diagonal: bool) -> tuple[Column, Column]:
    """Row and column of a fine cell (quarter units) in a footprint's matrix. Diamonds are turned by
    45 degrees, so that their neighbours along a side are neighbours in the matrix: these are two
    quarters away in x and in y."""
    dx, dy = qx - xmin, qy - ymin
    if diagonal:
        return ((dx + dy) / 4).cast("int"), ((dx - dy) / 4).cast("int")
    return (dy / 2).cast("int"), (dx / 2).cast("int")


def default_layer(spark: SparkSession, name: str, nx: int, ny: int, cm_type: dict[str, str]) -> DataFrame:
    """One type for every cell of the map, which any other row displaces."""
    from gridloom.operators.grid import squares

    types = {c: F.lit(cm_type.get(c)).cast("string") for c in ("menu", "cat1", "cat2")}
    return squares(spark, nx, ny).select("xidx", "yidx").withColumns({**types, "name": F.lit(name), "priority": F.lit(model.BACKGROUND)})
