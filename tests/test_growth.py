"""Queries over tables with larger keys, many copies and many rows: rows against SQL, and how work is dealt."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import queries as engine
from gridloom.functions import geometry as g
from gridloom.operators import assign, grid, network


@pytest.fixture
def given(spark, tmp_path):
    """Writes tables, and compares a query's rows over them with its SQL."""

    def compare(name, **tables):
        duck = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(str(tmp_path / f"{t}.parquet"))
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = engine.queries()[name](spark, str(tmp_path))
        cols = ", ".join(df.columns)
        want = duck.execute(f"SELECT {cols} FROM ({engine.oracle_sql()[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert want and sorted(got, key=repr) == sorted(want, key=repr)
        return got

    return compare


def parts(spark, rows):
    return spark.createDataFrame([(k, s, "STANDARD BRASS", "Brand#11") for k, s in rows], "p_partkey long, p_size int, p_type string, p_brand string")


def test_boxes_lose_borders_exactly(given, spark):
    """Cells that are half covered to the last digit: the boxes' sides are moved, not cut."""
    given("core_fill", part=parts(spark, [(8884, 31), (9434, 31), (33134, 31), (40862, 31), (38978, 31)]))


def test_crossings_of_copies(spark):
    """Lines at one place are compared once with others (all pairs would be 3 billion), and each gets its own cuts. A
    line's own pieces don't cut it, unless another line lies there, too."""
    began = time.time()
    cross = [(0.0, 0.0), (8.0, 8.0)], [(0.0, 8.0), (8.0, 0.0)]
    loop = [(20.0, 0.0), (28.0, 8.0), (28.0, 0.0), (20.0, 8.0)]
    rows = [(5000, "road", loop), (5001, "road", loop[2:]), (None, "road", loop[:2]), (5002, "rail", cross[0])]
    lines = spark.createDataFrame(rows, "line long, name string, coords array<struct<x:double,y:double>>")
    ends = [F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in c]) for c in cross]
    copies = spark.range(10_000, 50_000).select(F.col("id").alias("line"), F.lit("road").alias("name"), F.when(F.col("id") % 2 == 0, ends[0]).otherwise(ends[1]).alias("coords"))
    got = {tuple(r) for r in network.crossings(network.segments(lines.union(copies)), 4.0).select("line", "pos", "t", "x", "y").collect()}
    own = {(5000, 0, 0.5, 24.0, 4.0), (5000, 1, 1.0, 28.0, 0.0), (5001, 0, 0.5, 24.0, 4.0), (5001, 0, 0.0, 28.0, 0.0)}
    assert got == own | {(k, 0, 0.5, 4.0, 4.0) for k in range(10_000, 50_000)}
    assert time.time() - began < 60


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_ends_of_elements_are_not_broadcast(spark):
    """There are as many as elements, and they would pass through the driver."""
    cells = spark.range(500).select((F.col("id") % 50).alias("id"), F.floor(F.col("id") / 50).cast("int").alias("xidx"), F.floor(F.col("id") / 50 % 5).cast("int").alias("yidx"))
    df = assign.strided(cells, "id", 3, 2)
    assert "BroadcastHashJoin" not in executed(df) and df.count() > 0


def test_node_tiles_gather_ports_once(spark):
    """One shuffle of the needs; missing ports and nodes, ports told twice, and tiles with a port twice."""
    needs = spark.createDataFrame([(1, "u"), (1, "d"), (1, "u"), (2, "l"), (3, "u"), (3, None), (None, "l"), (4, "u")], "node long, port string")
    tiles = spark.createDataFrame([(7, ["d", "u"]), (8, ["l"]), (9, ["u", "u"]), (6, []), (5, ["u", "d", "l"])], "tile int, ports array<string>")
    df = network.node_tiles(needs, tiles)
    plan = executed(df)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 7), (2, 8)]
    assert plan.count("hashpartitioning(node#") == 1


@pytest.mark.parametrize("name", ["core_fill", "polygon_iou", "ring_concave", "random_cell", "rule_match", "unprocessed_tags", "first_match_type"])
def test_rows_are_dealt_by_their_number(given, name, spark, monkeypatch):
    """A small file is work for several tasks."""
    given(name, part=parts(spark, [(k, k % 50 + 1) for k in range(20_000)]).coalesce(1))
    monkeypatch.setattr(engine, "table", lambda *_: parts(spark, [(k, k % 50 + 1) for k in range(20_000)]))
    seen = [engine.rectangles(spark, ""), engine.tagged(spark, "")]
    assert all(df.rdd.getNumPartitions() == 3 for df in seen)


def test_shapes_alike_but_for_whole_cells(spark):
    """Their borders are worked out once (a million cells would take minutes), and areas are as for each alone."""
    began = time.time()
    ell = [(1.0, 2.0), (41.0, 2.0), (41.0, 20.0), (17.0, 20.0), (17.0, 36.0), (1.0, 36.0)]
    i, j = F.col("id") % 300 - 150, F.floor(F.col("id") / 300)
    ring = F.array(*[g.point(i * 8 + x, j * 8 + y) for x, y in ell])
    shapes = spark.range(40_000).select("id", ring.alias("ring"), F.lit(0.25).alias("border"), i.alias("i"), j.alias("j"))
    cells = grid.fill_core(shapes, "ring", "border").select("id", F.col("xidx") - F.col("i"), F.col("yidx") - F.col("j"), "area").toPandas()
    one = grid.fill_core(shapes.where("id = 450"), "ring", "border").select(F.col("xidx") - F.col("i"), F.col("yidx") - F.col("j"), "area")
    want = sorted(tuple(r) for r in one.collect())
    assert want and len(cells) == 40_000 * len(want)
    assert sorted(cells.iloc[:, 1:].drop_duplicates().itertuples(index=False, name=None)) == want
    assert time.time() - began < 60
