"""Paging a map, height steps, and covering ground with brushes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import labels
from gridloom.functions.number import numbered

# Squares of a page and its margins, brush sizes, start height.
PAGE, RIGHT, TOP, BOTTOM = 26, 2, 2, 2
BRUSHES = (15, 7, 3)
START_HEIGHT = 20
USED_X, USED_Y = PAGE - RIGHT, PAGE - TOP - BOTTOM


def sizes(cells: DataFrame) -> DataFrame:
    """One row: full pages and even remainders (nx, ny, rx, ry) and what they cover (w, h)."""
    total = cells.agg((F.max("x").cast("int") + 1).alias("tx"), (F.max("y").cast("int") + 1).alias("ty"))
    even = lambda c, n: (F.floor((F.col(c) % n) / 2) * 2).cast("int")
    got = total.select(F.floor(F.col("tx") / USED_X).cast("int").alias("nx"), F.floor(F.col("ty") / USED_Y).cast("int").alias("ny"), even("tx", USED_X).alias("rx"), even("ty", USED_Y).alias("ry"))
    return got.withColumns({"w": F.col("nx") * USED_X + F.col("rx"), "h": F.col("ny") * USED_Y + F.col("ry")})


def paged(cells: DataFrame) -> DataFrame:
    """cells with page_x (0 is the right-most, the last takes the remainder), page_y (0 is the lowest)
    and positions on the page. Cells in no page go."""
    own = cells.join(F.broadcast(sizes(cells)))  # one row
    inside = own.where("x >= 0 and y >= 0 and x < w and y < h")
    page = inside.withColumns({"page_x": (F.ceil((F.col("w") - F.col("x")) / USED_X) - 1).cast("int"), "page_y": F.floor(F.col("y") / USED_Y).cast("int")})
    left = F.when(F.col("page_x") < F.col("nx"), F.col("w") - (F.col("page_x") + 1) * USED_X).otherwise(0)
    low = F.when(F.col("page_y") < F.col("ny"), F.col("page_y") * (PAGE - TOP) - (F.col("page_y") + 1) * BOTTOM).otherwise(F.col("h") - (PAGE - TOP))
    return page.withColumns({"px": F.col("x") - left, "py": F.col("y") - low}).drop("nx", "ny", "rx", "ry", "w", "h")


def height_steps(cells: DataFrame) -> DataFrame:
    """page_x, page_y, z, before, steps: heights of a page in order, and the steps from the height
    before, which a page takes over from the one before it (pages go from right to left, then up)."""
    levels = cells.where("z is not null").select("page_x", "page_y", "z").distinct()
    per_page = levels.groupBy("page_y", "page_x").agg(F.max("z").alias("last"))
    # one row per page: a map has few
    carried = per_page.withColumn("start", F.coalesce(F.lag("last").over(Window.partitionBy().orderBy("page_y", "page_x")), F.lit(START_HEIGHT)))
    own = Window.partitionBy("page_y", "page_x").orderBy("z")
    before = F.coalesce(F.lag("z").over(own), F.col("start"))
    return levels.join(carried, ["page_y", "page_x"]).withColumn("before", before).select("page_x", "page_y", "z", F.col("before").cast("double").alias("before"), (F.col("z") - F.col("before")).alias("steps"))


def in_menu(groups: DataFrame, menus: DataFrame) -> DataFrame:
    """Groups whose menu and cat1 have an entry; the positions of all four labels are joined."""
    out = groups
    for c, how in (("menu", "inner"), ("cat1", "inner"), ("cat2", "left"), ("direction", "left")):
        side = menus.select(F.col("label").alias(c), F.struct("px", "py").alias(f"{c}_at"))
        out = out.join(side, c, how)
    return out


def cover(full: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy cover of the true cells: (brush, x, y of its centre). Larger brushes first, each over x,
    then y; a brush needs all its cells, and takes them."""
    left, out = full.copy(), []
    for size in BRUSHES:
        for x in range(left.shape[0] - size + 1):
            for y in range(left.shape[1] - size + 1):
                block = left[x : x + size, y : y + size]
                if block.all():
                    out.append((size, x + size // 2, y + size // 2))
                    block[:] = False
    out += [(1, int(x), int(y)) for x, y in np.argwhere(left)]
    return out


def brushes(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, brush, x, y: strokes that set the cells (px, py) of each group. Only ground and brush
    menus are covered by larger ones. A group lies on one page, so it is no larger than a page."""
    kinds = dict(cells.dtypes)
    menu = keys.index("menu")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = rows["px"].to_numpy().astype(int), rows["py"].to_numpy().astype(int)
        if str(key[menu].as_py()).startswith(("Ground", "Brush")):
            grid = np.zeros((x.max() - x.min() + 1, y.max() - y.min() + 1), bool)
            grid[x - x.min(), y - y.min()] = True
            found = [(b, a + int(x.min()), c + int(y.min())) for b, a, c in cover(grid)]
        else:
            found = [(1, int(a), int(b)) for a, b in zip(x, y, strict=True)]
        own = {k: pa.array([v.as_py()] * len(found), v.type) for k, v in zip(keys, key, strict=True)}
        return pa.table(own | {n: pa.array([f[i] for f in found], pa.int32()) for i, n in enumerate(("brush", "x", "y"))})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "brush int", "x int", "y int"])
    return cells.groupBy(*keys).applyInArrow(run, schema)


def actions(strokes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Clicks in order, numbered within each page."""
    at = labels.click(F.col("x"), F.col("y"))
    own = Window.partitionBy("page_y", "page_x").orderBy(*order)
    return strokes.withColumns({"seq": F.row_number().over(own), "click": at})


# Squares of a map at the start.
START_SQUARES = 40


def resizes(pages: DataFrame, map_: str, order: str, start: tuple[int, int] = (START_SQUARES, START_SQUARES)) -> DataFrame:
    """map_, order, button, clicks: what brings the editor from one page's size (nx, ny) to the next
    one's, two squares a click. A size shrinks or grows on one side, and unless the map has its first
    size (start) still, the opposite way on the other one, so that the part shown moves."""
    own = Window.partitionBy(map_).orderBy(order)
    told = pages.select(map_, order, "nx", "ny", *[F.coalesce(F.lag(c).over(own), F.lit(n)).alias(f"{c}_before") for c, n in zip(("nx", "ny"), start, strict=True)])
    first = (F.col("nx_before") == start[0]) & (F.col("ny_before") == start[1])

    def clicks(c: str, side: str) -> list[Column]:
        n = F.floor(F.abs(F.col(f"{c}_before") - F.col(c)) / 2).cast("int")
        smaller = F.col(c) <= F.col(f"{c}_before")
        away = F.struct(F.when(smaller, f"{side}_minus").otherwise(f"{side}_plus").alias("button"), n.alias("clicks"))
        other = F.struct(F.when(smaller, f"{side}_plus2").otherwise(f"{side}_minus2").alias("button"), F.when(first, 0).otherwise(n).alias("clicks"))
        return [away, other]

    each = told.withColumn("c", F.explode(F.array(*clicks("nx", "horizontal"), *clicks("ny", "vertical"))))
    return each.where("c.clicks > 0").select(map_, order, "c.button", "c.clicks")


def extents(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and the box of each group's cells on its page."""
    return cells.groupBy(*keys).agg(*[f(f"p{c}").alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"])


def start_size(cells: DataFrame) -> tuple[int, int]:
    """The size of a map in the editor that a file of it was saved with."""
    r = cells.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    return (START_SQUARES, START_SQUARES) if r["x"] is None else (int(r["x"] // 1) + RIGHT, int(r["y"] // 1) + BOTTOM)


def page_list(cells: DataFrame) -> DataFrame:
    """page_x, page_y, nx, ny: every page of a map and the squares that the editor shows for it. Pages of a
    remainder of nothing are left out."""
    own = sizes(cells)
    each = own.withColumn("page_x", F.explode(F.sequence(F.lit(0), F.col("nx")))).withColumn("page_y", F.explode(F.sequence(F.lit(0), F.col("ny"))))
    some = each.where("(page_x < nx or rx > 0) and (page_y < ny or ry > 0)")

    def shown(page: str, n: str, rest: str, margin: int) -> Column:
        p = F.col(page)
        return F.when(p < F.col(n), (p + 1) * PAGE - p * margin).otherwise(p * PAGE - (p - 1) * margin + F.col(rest)).cast("int")

    return some.select("page_x", "page_y", shown("page_x", "nx", "rx", RIGHT).alias("nx"), shown("page_y", "ny", "ry", TOP + BOTTOM).alias("ny"))


def stream(cells: DataFrame, strokes: DataFrame | None = None, start: tuple[int, int] = (START_SQUARES, START_SQUARES)) -> DataFrame:
    """seq, page_y, page_x, action, what, times, px, py: all that the editor is told for a map, in one
    order over all pages, which go from right to left, then up. On a page: clicks that resize the map (action
    button), then for each height the keys that lead to it (key, + or -) and the click of each of its cells
    (height), then strokes (page_x, page_y, menu, brush, x, y) if given (brush, what is the menu). Cells
    without a height get no click. Rows are numbered page by page; sizes of pages alone are summed up in one
    place, so the order survives whatever way rows are written."""
    none = F.lit(None).cast("int")
    own = paged(cells)

    def rows(df: DataFrame, part: int, action: str, what: Column, times: Column, at: Column | None, *order: Column) -> DataFrame:
        keys = [*[o.cast("double") for o in order], *[F.lit(0.0)] * (4 - len(order))]
        px, py = (at["px"], at["py"]) if at is not None else (none, none)
        return df.select("page_y", "page_x", F.lit(part).alias("__part"), *[k.alias(f"__{i}") for i, k in enumerate(keys)], F.lit(action).alias("action"), what.cast("string").alias("what"), times.cast("int").alias("times"), px.alias("px"), py.alias("py"))

    number = F.col("page_y").cast("long") * (1 << 20) + F.col("page_x")
    pages = page_list(cells).withColumns({"map": F.lit(0), "page": number})
    sized = resizes(pages, "map", "page", start).withColumns({"page_y": F.floor(F.col("page") / (1 << 20)).cast("int"), "page_x": (F.col("page") % (1 << 20)).cast("int")})
    turn = F.when(F.col("button").startswith("vertical"), 2).otherwise(0) + F.when(F.col("button").endswith("2"), 1).otherwise(0)
    found = rows(sized, 0, "button", F.col("button"), F.col("clicks"), None, turn)
    steps = height_steps(own).where("steps <> 0")
    found = found.union(rows(steps, 1, "key", F.when(F.col("steps") > 0, "+").otherwise("-"), F.abs("steps"), None, F.col("z"), F.lit(0)))
    clicks = own.where("z is not null")
    found = found.union(rows(clicks, 1, "height", F.lit(None), F.lit(1), labels.click(F.col("px"), F.col("py")), F.col("z"), F.lit(1), F.col("x"), F.col("y")))
    if strokes is not None:
        menus = strokes.select(F.col("menu").alias("__menu")).distinct().withColumn("__m", F.rank().over(Window.orderBy("__menu")))  # few
        met = strokes.join(menus, F.col("menu").eqNullSafe(F.col("__menu")))
        found = found.union(rows(met, 2, "brush", F.col("menu"), F.lit(1), labels.click(F.col("x"), F.col("y")), F.col("__m"), -F.col("brush"), F.col("x"), F.col("y")))
    order = ["page_y", "page_x", "__part", "__0", "__1", "__2", "__3"]
    return numbered(found, number, *order, name="seq").select((F.col("seq") + 1).cast("long").alias("seq"), "page_y", "page_x", "action", "what", "times", "px", "py")
