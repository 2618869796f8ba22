"""Networks of lines: collecting, intersecting and splitting them, degrees, components, and what
routes over cells make of them, by joins and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.labels import STEPS
from gridloom.operators import rounds


def segments(lines: DataFrame) -> DataFrame:
    """line, pos, ax, ay, bx, by: the straight pieces of lines (line, name, coords)."""
    each = lines.where(F.size("coords") > 1).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("coords") - 2)))
    a, b = F.get("coords", F.col("pos")), F.get("coords", F.col("pos") + 1)
    return each.select("line", "name", "pos", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def collected(lines: DataFrame, width: float, height: float) -> DataFrame:
    """line, name, piece, coords: lines (line, name, coords) as far as they lie on a map of a width and
    height; a line that leaves it and comes back gives a piece each time."""
    segs = segments(lines)
    enter, leave, inside = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for c, size in (("x", width), ("y", height)):
        a, d = F.col(f"a{c}"), F.col(f"b{c}") - F.col(f"a{c}")
        enter.append(F.when(d > 0, -a / d).when(d < 0, (size - a) / d).otherwise(0.0))
        leave.append(F.when(d > 0, (size - a) / d).when(d < 0, -a / d).otherwise(1.0))
        inside = inside & ((d != 0) | a.between(0.0, size))
    on_map = segs.where(inside).withColumns({"t": F.greatest(*enter), "u": F.least(*leave)}).where("t < u")

    def at(t: str) -> Column:
        return F.struct((F.col("ax") + F.col(t) * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col(t) * (F.col("by") - F.col("ay"))).alias("y"))

    own = Window.partitionBy("line").orderBy("pos")
    on = (F.lag("pos").over(own) == F.col("pos") - 1) & (F.lag("u").over(own) == 1) & (F.col("t") == 0)
    piece = on_map.withColumn("new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("piece", F.sum("new").over(own))
    joined = piece.groupBy("line", "name", "piece").agg(F.min(F.struct(F.col("pos"), at("t").alias("p"))).alias("first"), F.sort_array(F.collect_list(F.struct("pos", at("u").alias("p")))).alias("rest"))
    return joined.select("line", "name", "piece", F.concat(F.array("first.p"), F.transform("rest", lambda r: r["p"])).alias("coords"))


def components(edges: DataFrame) -> DataFrame:
    """edges with component, the least node (long) that can be reached from src and dst (long).

    Every label hooks to its least neighbour, and the trees that this gives are drawn together to their
    roots by doubling; what is left are links between roots. All steps are joins and aggregations,
    written to the shared folder."""
    folder, tables = rounds.new_folder(edges.sparkSession, "components"), 0

    def written(df: DataFrame) -> DataFrame:
        nonlocal tables
        tables += 1
        return rounds.written(df, f"{folder}/{tables}")

    edges = written(edges)
    ends = written(edges.select("src", "dst").distinct())
    links = written(ends.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct())
    label = ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        up = written(links.groupBy("hi").agg(F.min("lo").alias("up")))
        while True:
            above = up.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            if up.join(above, "up", "left_semi").isEmpty():
                break
            up = written(up.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("up")))
        label = written(label.join(up.withColumnRenamed("hi", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        hi = links.join(up, "hi").select(F.col("up").alias("a"), F.col("lo").alias("b"))
        both = hi.join(up.withColumnsRenamed({"hi": "b", "up": "c"}), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        links = written(both.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    return edges.join(label.withColumnRenamed("node", "src"), "src")


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def crossings(segs: DataFrame, bucket: float) -> DataFrame:
    """line, pos, t (place on the segment, 0 to 1), x, y: where segments of different lines of one
    name meet. Segments at one place, however many lines have them, are compared once: with each goes the
    least and the last line, which tell whether a line other than one's own is there. Both sides are
    dealt to square buckets of the plane and joined on them; a pair counts in the first that both have."""
    shape = ["name", "ax", "ay", "bx", "by"]
    own = segs.where(F.col("line").isNotNull())
    places = own.groupBy(*shape).agg(F.min("line").alias("low"), F.max("line").alias("high"))

    def dealt(side: str) -> DataFrame:
        s = places.select(*[F.col(c).alias(f"{side}_{c}") for c in places.columns])

        def end(c: str, of: Callable[..., Column]) -> Column:
            return F.floor(of(f"{side}_a{c}", f"{side}_b{c}") / bucket)

        first = s.withColumns({f"{side}_first_{c}": end(c, F.least) for c in "xy"})
        for c in "xy":
            first = first.withColumn(f"b{c}", F.explode(F.sequence(F.col(f"{side}_first_{c}"), end(c, F.greatest))))
        return first.withColumn("name", F.col(f"{side}_name"))

    # much work on few rows: as many partitions as are set, which aren't merged
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["name", "bx", "by"]
    both = dealt("p").repartition(parts, *keys).join(dealt("q").hint("merge"), keys)
    once = [F.col(f"b{c}") == F.greatest(f"p_first_{c}", f"q_first_{c}") for c in "xy"]
    p, q = (F.struct(*[f"{k}_{c}" for c in shape[1:]]) for k in "pq")
    met = both.where(once[0] & once[1] & (p < q))  # each pair once; both sides are told
    rx, ry = F.col("p_bx") - F.col("p_ax"), F.col("p_by") - F.col("p_ay")
    sx, sy = F.col("q_bx") - F.col("q_ax"), F.col("q_by") - F.col("q_ay")
    qx, qy = F.col("q_ax") - F.col("p_ax"), F.col("q_ay") - F.col("p_ay")
    den = _cross(rx, ry, sx, sy)
    t, u = _cross(qx, qy, sx, sy) / den, _cross(qx, qy, rx, ry) / den
    hit = met.where(den != 0).withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1")
    sides = [F.struct(F.col("name"), *[F.col(f"{k}_{c}").alias(c) for c in shape[1:]], F.col(at).alias("t"), F.col(f"{o}_low").alias("low"), F.col(f"{o}_high").alias("high")) for k, at, o in (("p", "t", "q"), ("q", "u", "p"))]
    at = hit.select(F.inline(F.array(*sides))).groupBy(*shape, "t").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cuts = at.groupBy(*shape).agg(F.collect_list(F.struct("t", "low", "high")).alias("cuts"))
    each = own.join(cuts.hint("merge"), shape).select("line", "pos", *shape[1:], F.inline("cuts")).where((F.col("low") != F.col("line")) | (F.col("high") != F.col("line")))
    placed = each.select("line", "pos", "t", *[(F.col(f"a{c}") + F.col("t") * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xy"])
    return placed.dropDuplicates(["line", "pos", "t"])


def noded(lines: DataFrame, bucket: float) -> DataFrame:
    """edge (line and number), line, src, dst, and the piece's points: lines cut where they meet others."""
    segs = segments(lines)
    cuts = crossings(segs, bucket)
    ends = segs.select("line", "pos", F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(False).alias("cut"))
    own = Window.partitionBy("line")
    last = segs.withColumn("m", F.max("pos").over(own)).where("pos = m").select("line", "pos", F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(False).alias("cut"))
    points = ends.union(last).union(cuts.select("line", "pos", "t", "x", "y", F.lit(True).alias("cut")))
    along = points.groupBy("line", (F.col("pos") + F.col("t")).alias("s")).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("cut").alias("cut"))
    order = own.orderBy("s")
    piece = along.withColumn("k", F.coalesce(F.sum(F.col("cut").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the point of a cut ends one piece and begins the next
    both = piece.withColumn("k", F.explode(F.when(F.col("cut"), F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k"))))
    pieces = both.groupBy("line", "k").agg(F.sort_array(F.collect_list(F.struct("s", "x", "y"))).alias("pts")).where(F.size("pts") > 1)
    return pieces.select("line", F.col("k").alias("part"), F.struct(F.get("pts", 0)["x"].alias("x"), F.get("pts", 0)["y"].alias("y")).alias("src"), F.struct(F.element_at("pts", -1)["x"].alias("x"), F.element_at("pts", -1)["y"].alias("y")).alias("dst"), F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def degrees(edges: DataFrame) -> DataFrame:
    """Nodes and the number of edges that end there."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def snapped(edges: DataFrame, cell: float) -> DataFrame:
    """edges with cells (x, y, and pos, the vertex), those of each edge's vertices, without repeats in a
    row."""

    def at(p: Column) -> Column:
        return F.struct(F.floor(p["x"] / cell).cast("int").alias("x"), F.floor(p["y"] / cell).cast("int").alias("y"))

    own = F.transform("points", lambda p, i: F.struct(at(p).alias("c"), at(F.get("points", i - 1)).alias("b"), i.alias("i")))
    fresh = F.filter(own, lambda p: (p["i"] == 0) | (p["c"] != p["b"]))
    return edges.withColumn("cells", F.transform(fresh, lambda p: F.struct(p["c"]["x"].alias("x"), p["c"]["y"].alias("y"), p["i"].alias("pos"))))


def with_directions(path: DataFrame) -> DataFrame:
    """Route squares with the names of the steps into and out of each (null at the ends).
    Edges without a route have none."""
    from gridloom.functions.labels import direction, opposite

    own = Window.partitionBy("edge_id").orderBy("pos")
    nx, ny = F.lead("xidx").over(own), F.lead("yidx").over(own)
    px, py = F.lag("xidx").over(own), F.lag("yidx").over(own)
    return path.where("pos is not null").withColumns({"to": direction(nx - F.col("xidx"), ny - F.col("yidx")), "back": opposite(direction(F.col("xidx") - px, F.col("yidx") - py))})


def several(path: DataFrame) -> DataFrame:
    """path without edges that have one square (pos 0) or none, before anything is sorted: they have no sides, so
    that they get no tiles and change none."""
    return path.join(path.where("pos <> 0").select("edge_id").distinct(), "edge_id", "left_semi")


def valid_path(path: DataFrame) -> DataFrame:
    """edge_id and whether all consecutive squares are neighbours. Edges without a route have none."""
    own = Window.partitionBy("edge_id").orderBy("pos")
    near = F.greatest(F.abs(F.col("xidx") - F.lag("xidx").over(own)), F.abs(F.col("yidx") - F.lag("yidx").over(own)))
    return path.where("pos is not null").withColumn("step", near).groupBy("edge_id").agg(F.coalesce(F.bool_and(F.col("step") == 1), F.lit(True)).alias("valid"))


def node_tiles(needs: DataFrame, tiles: DataFrame) -> DataFrame:
    """node and tile: tiles with exactly the ports (names) that a node's edges need. A node's ports are
    gathered once and looked up whole, so that no row is made for tiles that have some of them only. A
    missing port is on no tile."""
    wanted = needs.where("node is not null").groupBy("node").agg(F.sort_array(F.collect_set("port")).alias("__ports"), F.bool_and(F.col("port").isNotNull()).alias("__known"))
    own = tiles.select("tile", F.sort_array("ports").alias("__ports")).where(F.size(F.array_distinct("__ports")) == F.size("__ports")).where("not exists(__ports, p -> p is null) and size(__ports) > 0").distinct()
    return wanted.where("__known").join(F.broadcast(own), "__ports").select("node", "tile")


def tile_paths(squares: DataFrame, tiles: list[tuple[int, float, dict[str, int]]]) -> DataFrame:
    """edge_id, pos, tile: per edge the cheapest row of tiles, one a square, whose ports agree at every
    border. squares: edge_id, pos, to, back. tiles: number, cost, port value by direction name; a
    catalogue of some dozens. A layered shortest path, per edge."""

    by_sides: dict[frozenset[str], list[int]] = {}
    for i, (_, _, ports) in enumerate(tiles):
        by_sides.setdefault(frozenset(ports), []).append(i)

    def row_of(own: list[tuple[int, int, str | None, str | None]]) -> list[tuple[int, int, int]]:
        layers: list[dict[int, tuple[float, int | None]]] = []
        for _, _, to, back in own:
            here: dict[int, tuple[float, int | None]] = {}
            for i in by_sides.get(frozenset(d for d in (to, back) if d), ()):
                _, cost, ports = tiles[i]
                if not layers:
                    here[i] = (cost, None)
                    continue
                port = own[len(layers) - 1][2]
                before = [(c + cost, j) for j, (c, _) in layers[-1].items() if tiles[j][2][port] == ports[back]]
                if before:
                    here[i] = min(before)
            if not here:
                return []
            layers.append(here)
        out: list[tuple[int, int, int]] = []
        at: int | None = min(layers[-1], key=lambda i: (layers[-1][i][0], i))
        for k in range(len(layers) - 1, -1, -1):
            out.append((own[k][0], own[k][1], tiles[at][0]))
            at = layers[k][at][1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("edge_id", "pos", "to", "back")), strict=True))
        out: list[tuple[int, int, int]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["edge_id", "pos", "tile"])

        for _, own in groupby(rows, key=lambda r: r[0]):
            out += row_of(list(own))
            if len(out) >= 8192:
                yield batch()
                out = []
        if out:
            yield batch()

    own = squares.select("edge_id", "pos", "to", "back").repartition("edge_id").sortWithinPartitions("edge_id", "pos")
    return own.mapInArrow(run, "edge_id bigint, pos int, tile int")


def path_cells(cells: DataFrame, path: DataFrame) -> DataFrame:
    """cells that lie on a path, by both their indexes."""
    return cells.join(path.select("xidx", "yidx").distinct(), ["xidx", "yidx"], "left_semi")


def occupied(before: DataFrame, path: DataFrame) -> DataFrame:
    """Cells occupied so far, and those of a path that has been taken."""
    return before.select("xidx", "yidx").union(path.select("xidx", "yidx")).distinct()
