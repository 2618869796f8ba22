"""Tiles of a whole network: one for each square of its routes, which agree at every border and node.

A route is cut where it meets others. What its ends may be follows from all routes that end there:
tiles with just the sides that they need, from which each can be gone through. Then routes choose in
order: the first pair of tiles that a row of tiles connects, and the cheapest such row; its ends are
fixed for those that come later. Routes wait only for earlier ones at their own ends, so they are
settled in rounds of map tiles, whatever the size of a component.

Cases: routes of one square, and rows of nulls (edges without a route), get no tiles, nor do routes that
nothing connects; of equal tiles the smaller number counts; a route that ends where it begins
has one tile there; routes of other networks (component) don't count; an empty catalogue gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import labels
from gridloom.operators import rounds
from gridloom.operators.routing import OPPOSITE

NODE = "struct<x:int,y:int>"
ROUTE = f"component bigint, rank bigint, edge_id bigint, part int, src {NODE}, dst {NODE}, squares array<struct<pos:int,x:int,y:int>>, begin array<string>, finish array<string>"
EDGE = f"{ROUTE}, starts array<int>, ends array<int>"


class Tile(NamedTuple):
    number: int
    cost: float
    ports: dict[str, Any]  # what it has at its open sides; equal ports fit


def cut(path: DataFrame) -> DataFrame:
    """component, rank, edge_id, part, pos, xidx, yidx: routes cut at inner squares with more than two
    connections in their component, which then belong to both parts."""
    own = Window.partitionBy("component", "edge_id").orderBy("pos")

    def step(shift: Any) -> Column:
        return labels.direction(shift("xidx").over(own) - F.col("xidx"), shift("yidx").over(own) - F.col("yidx"))

    stepped = path.where("pos is not null").withColumns({"__to": step(F.lead), "__from": step(F.lag)})
    open_ = stepped.select("component", "xidx", "yidx", F.explode(F.array_compact(F.array("__to", "__from"))).alias("side"))
    busy = open_.groupBy("component", "xidx", "yidx").agg(F.count_distinct("side").alias("__n")).where("__n > 2")
    met = stepped.join(busy, ["component", "xidx", "yidx"], "left")
    marked = met.withColumn("__cut", F.col("__n").isNotNull() & F.col("__to").isNotNull() & F.col("__from").isNotNull())
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("part", F.coalesce(F.sum(F.col("__cut").cast("int")).over(before), F.lit(0)).cast("int"))
    parts = F.when(F.col("__cut"), F.array(F.col("part"), F.col("part") + 1)).otherwise(F.array("part"))
    return counted.withColumn("part", F.explode(parts)).select("component", "rank", "edge_id", "part", "pos", "xidx", "yidx")


def routes(squares: DataFrame) -> DataFrame:
    """One row per route (ROUTE) of cut squares; begin and finish are the sides that all routes at its ends
    need there. An end that nothing goes on from gets the side across, too."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("xidx").cast("int").alias("x"), F.col("yidx").cast("int").alias("y"))))
    each = squares.groupBy("component", "edge_id", "part").agg(F.min("rank").cast("long").alias("rank"), listed.alias("squares")).where(F.size("squares") > 1)

    def node(i: int) -> Column:
        at = F.element_at("squares", i)
        return F.struct(at["x"].alias("x"), at["y"].alias("y"))

    def side(i: int, j: int) -> Column:
        a, b = F.element_at("squares", i), F.element_at("squares", j)
        return labels.direction(b["x"] - a["x"], b["y"] - a["y"])

    each = each.withColumns({"src": node(1), "dst": node(-1), "__a": side(1, 2), "__b": side(-1, -2)}).where("__a is not null and __b is not null")
    need = each.select("component", F.inline(F.array(F.struct(F.col("src").alias("at"), F.col("__a").alias("side")), F.struct(F.col("dst").alias("at"), F.col("__b").alias("side")))))
    sides = need.groupBy("component", "at").agg(F.collect_set("side").alias("sides"))
    lone = F.when(F.size("sides") == 1, F.concat("sides", F.array(labels.opposite(F.get("sides", 0))))).otherwise(F.col("sides"))
    sides = sides.select("component", "at", F.sort_array(lone).alias("sides"))
    first = each.join(sides.withColumnsRenamed({"at": "src", "sides": "begin"}), ["component", "src"])
    both = first.join(sides.withColumnsRenamed({"at": "dst", "sides": "finish"}), ["component", "dst"])
    return both.select(F.col("component").cast("long").alias("component"), "rank", F.col("edge_id").cast("long").alias("edge_id"), "part", "src", "dst", "squares", "begin", "finish")


class Rows:
    """The rows of tiles along one route: the tiles of each square that fit one of the square before."""

    def __init__(self, r: dict[str, Any], tiles: list[Tile]):
        xy = [(s["x"], s["y"]) for s in r["squares"]]
        self.loop = r["src"] == r["dst"]
        self.out = [labels.STEPS.get((b[0] - a[0], b[1] - a[1])) for a, b in zip(xy, xy[1:], strict=False)]
        self.sides = [set(r["begin"]), *[{OPPOSITE.get(a), b} for a, b in zip(self.out, self.out[1:], strict=False)], set(r["finish"])]
        self.fit = [] if None in self.out else [[t for t in tiles if set(t.ports) == sides] for sides in self.sides]

    def cheapest(self, start: int) -> list[dict[int, tuple[float, int | None]]]:
        """Per square the tiles that start leads to: cost, and the tile before."""
        layers: list[dict[int, tuple[float, int | None]]] = [{t.number: (t.cost, None) for t in self.fit[0] if t.number == start}] if self.fit else []
        ports = {t.number: t.ports for t in self.fit[0]} if self.fit else {}
        for k, fit in enumerate(self.fit[1:]):
            went, here = self.out[k], {}
            by_port: dict[Any, tuple[float, int]] = {}
            for i, (cost, _) in layers[-1].items():
                by_port[ports[i][went]] = min(by_port.get(ports[i][went], (cost, i)), (cost, i))
            for t in fit:
                best = by_port.get(t.ports[OPPOSITE[went]])
                if best:
                    here[t.number] = (best[0] + t.cost, best[1])
            layers.append(here)
            ports = {t.number: t.ports for t in fit}
        return layers

    def ends(self, start: int) -> set[int]:
        layers = self.cheapest(start)
        found = set(layers[-1]) if layers else set()
        return found & {start} if self.loop else found

    def row(self, start: int, end: int) -> list[int] | None:
        layers = self.cheapest(start)
        if not layers or end not in layers[-1] or (self.loop and start != end):
            return None
        out, at = [], end
        for here in layers[::-1]:
            out.append(at)
            at = here[at][1]
        return out[::-1]


def open_ends(edges: DataFrame, tiles: list[Tile]) -> DataFrame:
    """edges (ROUTE) with starts and ends: the tiles at either end from which the other one is reached. Routes of
    one shape that need the same sides are looked at once a task."""

    def both(r: dict[str, Any]) -> tuple[list[int], list[int]]:
        rows = Rows(r, tiles)
        found = {t.number: rows.ends(t.number) for t in rows.fit[0]} if rows.fit else {}
        return sorted(s for s, e in found.items() if e), sorted(set().union(*found.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Any, tuple[list[int], list[int]]] = {}
        for b in batches:
            starts, ends = [], []
            for r in b.to_pylist():
                at = r["src"]
                shape = tuple((s["x"] - at["x"], s["y"] - at["y"]) for s in r["squares"]), tuple(r["begin"]), tuple(r["finish"])
                if shape not in known:
                    known[shape] = both(r)
                start, end = known[shape]
                starts.append(start)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], [*b.schema.names, "starts", "ends"])

    # much work on few bytes: as many partitions as are set, which aren't merged
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "component", "edge_id", "part").mapInArrow(run, EDGE)


def consistent(edges: DataFrame) -> DataFrame:
    """edges (EDGE) with only those starts and ends that all routes at the node agree on. Routes that no
    row of tiles connects have no say."""
    each = edges.select("component", F.inline(F.array(F.struct(F.col("src").alias("at"), F.col("starts").alias("of")), F.struct(F.col("dst").alias("at"), F.col("ends").alias("of"))))).where(F.size("of") > 0)
    count = each.groupBy("component", "at").agg(F.count("*").alias("n"))
    votes = each.select("component", "at", F.explode("of").alias("tile")).groupBy("component", "at", "tile").agg(F.count("*").alias("k"))
    agreed = votes.join(count, ["component", "at"]).where("k = n").groupBy("component", "at").agg(F.sort_array(F.collect_list("tile")).alias("of"))
    none = F.array().cast("array<int>")
    at_src = edges.drop("starts", "ends").join(agreed.withColumnsRenamed({"at": "src", "of": "starts"}), ["component", "src"], "left")
    both = at_src.join(agreed.withColumnsRenamed({"at": "dst", "of": "ends"}), ["component", "dst"], "left")
    return both.withColumns({"starts": F.coalesce("starts", none), "ends": F.coalesce("ends", none)}).select(*edges.columns)


def settle(rows: Iterator[dict[str, Any]], tiles: list[Tile]) -> Iterator[tuple[bool, list[int]]]:
    """Whether each route is settled, and its tiles. Routes come by map tile and in order."""
    here, fixed, held = None, {}, set()
    for r in rows:
        if r["tile"] != here:
            here, fixed, held = r["tile"], {}, set()
        a, b = ((r["component"], r[k]["x"], r[k]["y"]) for k in ("src", "dst"))
        if r["waits"] or a in held or b in held:
            held |= {a, b}
            yield False, []
            continue
        starts, ends = ([fixed[k]] if k in fixed else r[of] for k, of in ((a, "starts"), (b, "ends")))
        rows_ = Rows(r, tiles)
        found = next((row for s in starts for e in ends if (row := rows_.row(s, e))), [])
        if found:
            fixed[a], fixed[b] = found[0], found[-1]
        yield True, found


def one_round(left: DataFrame, tiles: list[Tile]) -> DataFrame:
    """left (EDGE and tile) with settled and row (numbers of tiles)."""
    turn = F.struct("rank", "edge_id", "part", "component")
    claims = left.select("component", "tile", turn.alias("turn"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("at"))
    waiting = rounds.waiting(claims, "component", "at").select("turn.component", "turn.edge_id", "turn.part").withColumn("waits", F.lit(True))
    flagged = left.join(waiting, ["component", "edge_id", "part"], "left").select(*left.columns, F.coalesce("waits", F.lit(False)).alias("waits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def rows() -> Iterator[dict[str, Any]]:
            for b in batches:
                if b.num_rows:
                    kept.append(b)
                    yield from b.to_pylist()

        out: list[tuple[bool, list[int]]] = []
        for one in settle(rows(), tiles):
            out.append(one)
            if len(out) == kept[0].num_rows:
                b = kept.pop(0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s for s, _ in out]), pa.array([t for _, t in out], pa.list_(pa.int32()))], [*b.schema.names[:-1], "settled", "row"])
                out = []

    return rounds.spread(flagged, "rank", "edge_id", "part", "component").mapInArrow(run, f"{EDGE}, tile bigint, settled boolean, row array<int>")


def tiled(path: DataFrame, tiles: list[Tile]) -> DataFrame:
    """component, edge_id, part, pos, xidx, yidx, tile: the squares of routes (component, rank, edge_id,
    pos, xidx, yidx; routes choose in order of rank, then edge) with their tiles, of a catalogue of some
    dozens. Every round is written to the shared folder, which the result reads."""
    spark = path.sparkSession
    folder = rounds.new_folder(spark, "tiles")
    home = F.floor(F.col("src.x") / rounds.TILE).cast("long") * (1 << 32) + F.floor(F.col("src.y") / rounds.TILE)
    agreed = consistent(open_ends(routes(cut(path)), tiles)).withColumn("tile", home.cast("long"))
    agreed.where(F.size("starts") > 0).where(F.size("ends") > 0).write.parquet(f"{folder}/0")
    left = spark.read.parquet(f"{folder}/0")
    number, done = 0, None
    while True:
        number += 1
        one_round(left, tiles).write.parquet(f"{folder}/{number}")
        after = spark.read.parquet(f"{folder}/{number}")
        new = after.where("settled").where(F.size("row") > 0)
        squares = new.select("component", "edge_id", "part", F.inline(F.arrays_zip("squares", F.col("row").alias("tile"))))
        squares = squares.select("component", "edge_id", "part", F.col("squares.pos").alias("pos"), F.col("squares.x").alias("xidx"), F.col("squares.y").alias("yidx"), "tile")
        done = squares if done is None else done.union(squares)
        rest = after.where("not settled").drop("settled", "row")
        if rest.isEmpty():
            return done
        ends = F.array(F.struct(F.col("src").alias("at"), F.get("row", 0).alias("of")), F.struct(F.col("dst").alias("at"), F.element_at("row", -1).alias("of")))
        fixed = new.select("component", F.inline(ends)).groupBy("component", "at").agg(F.min("of").alias("of"))
        at_src = rest.join(fixed.withColumnsRenamed({"at": "src", "of": "__s"}), ["component", "src"], "left")
        both = at_src.join(fixed.withColumnsRenamed({"at": "dst", "of": "__e"}), ["component", "dst"], "left")
        one = {k: F.when(F.col(f).isNull(), F.col(k)).otherwise(F.array(f)) for k, f in (("starts", "__s"), ("ends", "__e"))}
        left = both.withColumns(one).select(*rest.columns)
