"""Assigning types to cells: fixed, by draw for an element or a cell, and on cells of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import draw

#: Weights are scaled to integers by this.
SCALE = 1000


def weights(cm_types: Column) -> Column:
    """Integer weights; a missing one counts 1."""
    return F.transform(cm_types, lambda t: F.round(F.coalesce(t["weight"], F.lit(1.0)) * SCALE).cast("long"))


def drawn(cells: DataFrame, cm_types: str, *keys: str, salt: int = 0) -> DataFrame:
    """cells with the type drawn for their keys, as menu, cat1 and cat2; a dummy type leaves them
    unset."""
    at = draw.pick(draw.number(*[F.col(k) for k in keys], salt=salt), weights(F.col(cm_types)))
    t = F.get(F.col(cm_types), at)
    real = ~F.coalesce(t["dummy"], F.lit(False))
    return cells.withColumns({c: F.when(real, t[c]) for c in ("menu", "cat1", "cat2")})


def strided(cells: DataFrame, element: str, sx: int | str, sy: int | str) -> DataFrame:
    """Every sx-th column and sy-th row (numbers, or columns) of each element's cells, from its first
    on, never its last; a stride of one leaves all. Ends are aggregated and joined back, so that an
    element's cells needn't meet in one task; never by a broadcast, as there are as many ends as elements."""
    for c, stride in (("xidx", sx), ("yidx", sy)):
        if stride == 1:
            continue
        s = F.col(stride) if isinstance(stride, str) else F.lit(stride)
        ends = cells.groupBy(F.col(element).alias("__element")).agg(F.min(c).alias("__low"), F.max(c).alias("__high"))
        cells = cells.join(ends.hint("merge"), F.col(element).eqNullSafe(F.col("__element"))).drop("__element").where((s <= 1) | (((F.col(c) - F.col("__low")) % s == 0) & (F.col(c) < F.col("__high")))).drop("__low", "__high")
    return cells


def from_tag(cells: DataFrame, first: str) -> DataFrame:
    """Cells of elements with a first matching type (a struct column), which they get."""
    return cells.where(F.col(first).isNotNull()).withColumns({c: F.col(f"{first}.{c}") for c in ("menu", "cat1", "cat2")})


def random_area(cells: DataFrame, cm_types: str, element: str, salt: int = 0) -> DataFrame:
    return drawn(cells, cm_types, element, salt=salt)


def random_cell(cells: DataFrame, cm_types: str, element: str, salt: int = 0) -> DataFrame:
    return drawn(cells, cm_types, element, "xidx", "yidx", salt=salt)


#: The cluster variant draws for each cell as well, but takes no stride.
random_clusters = random_cell


def on_line(cells: DataFrame, assigned: DataFrame, line_rule: str, cm_types: str, salt: int = 0) -> DataFrame:
    """A draw on the cells that rule line_rule has already set."""
    there = assigned.where((F.col("name") == line_rule) & F.col("menu").isNotNull()).select("xidx", "yidx")
    return drawn(cells.join(there, ["xidx", "yidx"]), cm_types, "xidx", "yidx", salt=salt)
