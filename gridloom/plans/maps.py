"""A whole map from features and rules: match, number, run the stages, add the background, resolve.

Elements are features matched with a rule; each has a ring. The operators bound here assign types to
the cells of rings. Stages that need catalogues are passed over unless the caller gives operators for them;
building_operators() and network_operators() make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import labels
from gridloom.functions.number import numbered
from gridloom.operators import assign, catalogues, grid, network, outlines, resolve, rounds, routing, rules, tiling
from gridloom.plans import schedule
from gridloom.plans.model import CELL

# Stages that place buildings, the kind in the catalogue, and how its entries are named
# and laid out.
BUILDING_STAGES = {"residential_buildings": ("residential", "Building", 4), "churches": ("church", "Church", 3), "barns": ("barn", "Barn", 3)}

# Stages that lay tiles, and the kind in the catalogue; how tiles are named and laid out.
NETWORK_STAGES = {"road_tiles": "road", "rail_tiles": "rail", "stream_tiles": "stream", "fence_tiles": "fence"}
TILE_NAME, TILES_PER_ROW = "Road Tile", 3

COLUMNS = ("xidx", "yidx", "z", "menu", "cat1", "cat2", "direction", "id", "name", "priority")


def rows(cells: DataFrame) -> DataFrame:
    """cells as assignments: what an operator doesn't set is null."""
    kinds = {"z": "double", "menu": "string", "cat1": "string", "cat2": "string", "direction": "string"}
    return cells.select(*[F.col(c) if c in cells.columns else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS])


def cells_of(elements: DataFrame) -> DataFrame:
    """Cells of the elements' rings, less the border that a rule's modifiers ask for."""
    border = F.when(F.col("modifiers.is_core").isNotNull(), F.col("modifiers.border_size"))
    return grid.fill_core(elements.withColumn("__border", border), "ring", "__border").drop("__border", "ring", "area")


def strides(cells: DataFrame) -> DataFrame:
    """Of the elements with a stride every so many columns and rows; a stride may be of one of them."""
    sx, sy = (F.coalesce(F.col(f"modifiers.stride_{c}"), F.lit(1)) for c in "xy")
    own = cells.withColumns({"__sx": sx, "__sy": sy})
    return assign.strided(own, "idx", "__sx", "__sy").drop("__sx", "__sy")


def operators(salt: int = 0) -> dict[str, schedule.Operator]:
    def from_tag(own: DataFrame, state: DataFrame) -> DataFrame:
        typed = own.withColumn("kind", rules.first_type(F.col("tags"), F.col("cm_types"))).where("kind is not null")
        return rows(assign.from_tag(strides(cells_of(typed)), "kind"))

    def random_area(own: DataFrame, state: DataFrame) -> DataFrame:
        return rows(assign.random_area(strides(cells_of(own)), "cm_types", "idx", salt=salt))

    def random_cell(own: DataFrame, state: DataFrame) -> DataFrame:
        return rows(assign.random_cell(strides(cells_of(own)), "cm_types", "idx", salt=salt))

    def random_clusters(own: DataFrame, state: DataFrame) -> DataFrame:
        return rows(assign.random_clusters(cells_of(own), "cm_types", "idx", salt=salt))

    def linear(own: DataFrame, state: DataFrame) -> DataFrame:
        there = state.where("menu is not null").select("xidx", "yidx", F.col("name").alias("__line")).distinct()
        on_line = cells_of(own).withColumn("__line", F.col("modifiers.linear_name")).join(there, ["xidx", "yidx", "__line"], "left_semi")
        return rows(assign.drawn(on_line, "cm_types", "xidx", "yidx", salt=salt))

    return {"type_from_tag": from_tag, "type_random_area": random_area, "type_random_individual": random_cell, "type_random_clusters": random_clusters, "type_from_linear": linear}


def building_operators(catalogue: DataFrame, profile: str, size: tuple[int, int], taken: DataFrame | None = None, salt: int = 0) -> dict[str, schedule.Operator]:
    """Operators that place buildings of a catalogue (BUILDINGS) on the rings of elements: rule by rule
    within a step, and not on what is taken before (ax, ay, priority), on tiles of networks, or on what
    earlier steps have placed. They are for one map, and place buildings as they are called."""
    there = taken

    def on_outlines(stage: str) -> schedule.Operator:
        kind, label, per_row = BUILDING_STAGES[stage]

        def run(own: DataFrame, state: DataFrame) -> DataFrame:
            nonlocal there
            mine = catalogues.buildings(catalogue, profile, kind)
            turn = F.col("ord").cast("long") * (1 << 40) + F.col("idx")
            tiles = outlines.taken_squares(state.where(F.col("cat2").startswith(TILE_NAME)).select("xidx", "yidx", "priority"))
            before = tiles if there is None else tiles.unionByName(there)
            placed = outlines.placed(own.select(F.col("idx").alias("building"), turn.alias("place"), "priority", "ring"), mine, size, before)
            new = outlines.taken_by(placed)
            there = new if there is None else there.union(new.select(*there.columns))
            found = outlines.drawn(placed, mine, label, per_row, salt).drop("priority")
            return rows(found.join(own.select(F.col("idx").alias("building"), "id", "name", "priority"), "building"))

        return run

    return {stage: on_outlines(stage) for stage in BUILDING_STAGES}


def network_operators(tile_table: DataFrame, size: tuple[int, int], bucket: float = 64.0) -> dict[str, schedule.Operator]:
    """Operators that lay tiles of a catalogue (TILES) along the lines of elements (lines, arrays of
    points, beside ring). Rule by rule, lines are cut where they meet, routed in order of their type and
    number, and given tiles that agree. Cells of a rule's routes are closed to the rules that follow,
    until one with a priority below 1 opens all again. Elements without a type take part, but get no
    rows. The operators are for one map, and lay networks as they are called."""
    nx, ny = size
    closed: DataFrame | None = None

    def lay(own: DataFrame, tiles: list[tiling.Tile]) -> DataFrame:
        lines = own.select("idx", "name", F.posexplode("lines").alias("k", "coords"))
        clipped = network.collected(lines.select(F.struct("idx", "k").alias("line"), "name", "coords"), nx * CELL, ny * CELL)
        edges = network.noded(clipped.select(F.struct("line.*", "piece").alias("line"), "name", "coords"), bucket)
        each = numbered(edges, F.floor(F.col("line.idx") / 100_000), "line", "part", name="edge_id")
        each = each.select("edge_id", F.col("line.idx").alias("idx"), F.transform("points", lambda p: F.struct((p["x"] / CELL).alias("x"), (p["y"] / CELL).alias("y"))).alias("line"))
        typed = own.select("idx", "id", "name", "priority", rules.first_type(F.col("tags"), F.col("cm_types")).alias("kind"))
        ranked = each.join(typed.select("idx", F.col("kind.ord").cast("long").alias("rank")), "idx")
        known = rounds.written(ranked.select("edge_id", "rank", "idx", "line"), rounds.new_folder(own.sparkSession, "edges"))
        path = routing.routed(known, size, {side for t in tiles for side in t.ports}, [t.ports for t in tiles], closed)
        path = rounds.written(path, rounds.new_folder(own.sparkSession, "paths"))
        laid = tiling.tiled(path.join(known.select("edge_id", "rank", F.lit(0).cast("long").alias("component")), "edge_id"), tiles)
        leave(path, own)
        return laid.join(known.select("edge_id", "idx"), "edge_id").join(typed.where("kind is not null"), "idx")

    def leave(path: DataFrame, own: DataFrame) -> None:
        """Close the cells of a rule's routes, or open all."""
        nonlocal closed
        if not own.where("priority < 1").isEmpty():
            closed = None
            return
        cells = path.where("pos is not null").select("xidx", "yidx")
        closed = cells if closed is None else closed.union(cells)

    def on_lines(kind: str) -> schedule.Operator:
        def run(own: DataFrame, state: DataFrame) -> DataFrame:
            of_kind = tile_table.where(F.col("kind") == kind)
            tiles = [tiling.Tile(r["tile"], r["cost"], {k: tuple(v) for k, v in r["ports"].items()}) for r in of_kind.select("tile", "cost", "ports").collect()]
            found = None
            for (ord_,) in own.select("ord").distinct().orderBy("ord").collect():  # rules, of a rule file
                new = lay(own.where(F.col("ord") == ord_), tiles)
                found = new if found is None else found.union(new)
            if found is None:
                return state.limit(0)
            looks = of_kind.select("tile", labels.numbered(TILE_NAME, F.col("row"), F.col("col"), TILES_PER_ROW).alias("cat2"), labels.direction_label(F.col("direction")).alias("direction"))
            return rows(found.join(looks, "tile").select("xidx", "yidx", "kind.menu", "kind.cat1", "cat2", "direction", "id", "name", "priority").distinct())

        return run

    return {stage: on_lines(kind) for stage, kind in NETWORK_STAGES.items()}


def build(features: DataFrame, rule_table: DataFrame, place: Column, size: tuple[int, int], background: dict[str, str], more: dict[str, schedule.Operator] | None = None, salt: int = 0) -> DataFrame:
    """Assignments of an nx by ny map: of features (id, tags, ring) by the rules, in their stages, over
    a background. place: a whole number that rises along the features."""
    elements = rules.indexed(rules.match(features, rule_table), place)
    nothing = elements.limit(0).select(F.lit(0).alias("xidx"), F.lit(0).alias("yidx"), "id", "name", "priority")
    found = schedule.run(rule_table, elements, operators(salt) | (more or {}), rows(nothing))
    nx, ny = size
    inside = found.where(F.col("xidx").between(0, nx - 1) & F.col("yidx").between(0, ny - 1))
    layer = catalogues.default_layer(features.sparkSession, "default_ground", nx, ny, background).withColumn("id", F.lit(None).cast(dict(features.dtypes)["id"]))
    ranks = rule_table.select("name", F.inline("cm_types")).select("name", "menu", "cat1", "ord")
    return resolve.resolved(inside.unionByName(rows(layer)), ranks, ("id", "cat1", "cat2"))
