"""Labels, directions and screen positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps between neighbouring cells and their names.
STEPS = {(0, 1): "u", (0, -1): "d", (1, 0): "r", (-1, 0): "l", (1, 1): "ur", (1, -1): "dr", (-1, 1): "ul", (-1, -1): "dl"}
# Pixels of a square and the two corners that clicks are counted from.
SQUARE_PX, LEFT_PX, BOTTOM_PX = 16, 233, 451


def direction(dx: Column, dy: Column) -> Column:
    """Name of a step to one of the eight neighbours; null for any other."""
    table = F.create_map(*[F.lit(x) for (a, b), name in STEPS.items() for x in (a * 3 + b, name)])
    near = (F.abs(dx) <= 1) & (F.abs(dy) <= 1)
    return F.when(near, F.try_element_at(table, (dx * 3 + dy).cast("int")))


def opposite(name: Column) -> Column:
    return F.translate(name, "udrl", "dulr")


def numbered(kind: str, row: Column, col: Column, per_row: int) -> Column:
    """'Road Tile 5' of a catalogue laid out in rows."""
    return F.concat(F.lit(f"{kind} "), (row * per_row + col + 1).cast("int").cast("string"))


def direction_label(direction: Column) -> Column:
    return F.concat(F.lit("Direction "), (direction + 1).cast("int").cast("string"))


def click(x: Column, y: Column) -> Column:
    return F.struct((x * SQUARE_PX + LEFT_PX).cast("int").alias("px"), (BOTTOM_PX - y * SQUARE_PX).cast("int").alias("py"))
