"""Queries of the grid-map engine over the driver's tables, each with SQL that gives the same rows.

The tables stand in for map data by projections: lineitem for assignments and elevation points, part
for features and rectangles, orders and supplier for points and lines, events for moves over cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry as g
from gridloom.functions import labels, number, planning
from gridloom.operators import assign, catalogues, elevation, grid, network, outlines, packing, paging, resolve, rounds, routing, rules, scattered, tiling
from gridloom.plans import maps
from gridloom.plans import schedule as plan
from gridloom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:  # a literal with a point is a decimal in SQL; the engine computes in doubles
            SQL[f.__name__] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int = 8192) -> DataFrame:
    """rows of a table by their key, so many to a task: much work follows on few bytes, which Spark would deal by
    their size. Counting a table reads the ends of its files only."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


# ---- assignments and their resolution ----

ROWS_SQL = """
rows_ AS (SELECT DISTINCT CAST(l_orderkey % 64 AS INTEGER) AS xidx, CAST(l_partkey % 64 AS INTEGER) AS yidx,
  l_linenumber - 3 AS priority, l_returnflag AS name, l_linestatus AS menu, l_quantity AS z FROM lineitem),
counted AS (SELECT *, count(*) OVER c AS n, min(CASE WHEN priority > 0 THEN priority END) OVER c AS low
  FROM rows_ WINDOW c AS (PARTITION BY xidx, yidx)),
dominant AS (SELECT xidx, yidx, priority, name, menu, z FROM counted
  WHERE NOT (n > 1 AND coalesce(priority = -999 OR (low IS NOT NULL AND (priority > low OR priority < 0)), false)))
"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 64).cast("int").alias("xidx"), (F.col("l_partkey") % 64).cast("int").alias("yidx"), (F.col("l_linenumber") - 3).alias("priority"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("menu"), F.col("l_quantity").alias("z"))


@query(f"WITH {ROWS_SQL} SELECT priority, name, count(*) AS n_rows, count(DISTINCT xidx * 64 + yidx) AS n_cells, CAST(sum(z) AS BIGINT) AS sum_z FROM dominant GROUP BY priority, name")
def cell_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.dominant(resolve.valid(assignments(spark, sf_dir)))
    return rows.groupBy("priority", "name").agg(F.count("*").alias("n_rows"), F.countDistinct(F.col("xidx") * 64 + F.col("yidx")).alias("n_cells"), F.sum("z").cast("long").alias("sum_z"))


RANKS = [("A", "F", "F", 1), ("A", "O", "O", 0), ("N", "O", "O", 0), ("R", "F", "F", 2), ("N", "O", "O", 3)]


@query(f"""WITH {ROWS_SQL}, ranks AS (SELECT * FROM (VALUES ('A','F',1),('A','O',0),('N','O',0),('R','F',2)) t(name, menu, r)),
ranked AS (SELECT d.*, r FROM dominant d LEFT JOIN ranks USING (name, menu)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY xidx, yidx, priority, name, r IS NULL ORDER BY r, z, menu) AS k FROM ranked)
SELECT xidx, yidx, priority, name, menu, z FROM numbered WHERE r IS NULL OR k = 1""")
def rank_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = spark.createDataFrame(RANKS, "name string, menu string, cat1 string, ord int")
    rows = assignments(spark, sf_dir).withColumn("cat1", F.col("menu"))
    return resolve.resolved(rows, ranks, ("z", "menu")).drop("cat1")


@query(f"""WITH {ROWS_SQL}, inside AS (SELECT * FROM dominant WHERE xidx BETWEEN 4 AND 40 AND yidx BETWEEN 8 AND 50)
SELECT CAST(xidx - 4 AS DOUBLE) AS x, CAST(yidx - 8 AS DOUBLE) AS y, coalesce(z, -1) AS z, coalesce(menu, '-1') AS menu, coalesce(name, '-1') AS name, coalesce(priority, -1) AS priority FROM inside
UNION ALL SELECT 36, 42, -1, '-1', '-1', -1""")
def map_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.dominant(resolve.valid(assignments(spark, sf_dir)))
    doubles = rows.withColumns({"xidx": F.col("xidx").cast("double"), "yidx": F.col("yidx").cast("double")})
    return sinks.map_table(doubles, (4, 8, 40, 50)).select("x", "y", "z", "menu", "name", "priority")


@query(f"""WITH {ROWS_SQL} SELECT DISTINCT xidx, yidx FROM rows_ r WHERE priority > 0 AND NOT EXISTS
(SELECT 1 FROM rows_ o WHERE o.priority < 0 AND o.xidx = r.xidx AND o.yidx = r.yidx)""")
def free_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assignments(spark, sf_dir)
    return grid.free(rows.where("priority > 0").select("xidx", "yidx").distinct(), rows.where("priority < 0"))


# ---- rules ----

CONFIG = {
    "plain": {"priority": 1, "tags": [["band", "0"], ["band", "1"]], "process": ["type_from_tag"], "cm_types": [{"menu": "Ground 1", "cat1": "Grass", "tags": [["band", "1"]]}, {"menu": "Ground 1", "cat1": "Dirt", "tags": [["type", "PROMO"], ["band", "0"]]}]},
    "brand": {"priority": 2, "tags": [["brand", "Brand#11"], ["brand", "Brand#23"]], "exclude_tags": [["band", "2"]], "process": ["type_random_area"], "cm_types": [{"menu": "Foliage", "cat1": "Bush", "weight": 2.0}, {"dummy": True, "weight": 1.0}]},
    "typed": {"priority": 3, "tags": [["type", "PROMO"], ["type", "STANDARD"]], "required_tags": [["band", "3"]], "process": ["road_tiles"], "cm_types": [{"menu": "Road", "cat1": "Dirt", "tags": [["type", "PROMO"]]}]},
    "banned": {"priority": 4, "tags": [["band", "4"]], "exclude_ids": ["7", "40", "41"], "process": ["fence_tiles", "type_random_area"], "cm_types": [{"menu": "Fence", "cat1": "Stone", "tags": [["band", "4"]]}]},
    "listed": {"priority": 5, "tags": [["band", "1"]], "allowed_ids": ["1", "2", "3", "5", "8", "13", "21", "34"], "process": ["type_from_church_outline"], "cm_types": [{"menu": "Church", "cat1": "Church", "tags": [["brand", "Brand#11"]]}]},
    "off": {"priority": 6, "active": False, "tags": [["band", "0"]], "process": ["type_from_tag"], "cm_types": [{"menu": "Never", "cat1": "Never", "tags": [["band", "0"]]}]},
}

FEATURES_SQL = """
f AS (SELECT CAST(p_partkey AS VARCHAR) AS id, split_part(p_type, ' ', 1) AS type, p_brand AS brand, CAST(p_size // 10 AS VARCHAR) AS band FROM part),
m AS (
  SELECT *, 'plain' AS name, 1 AS priority FROM f WHERE band IN ('0', '1')
  UNION ALL SELECT *, 'brand', 2 FROM f WHERE brand IN ('Brand#11', 'Brand#23') AND band <> '2'
  UNION ALL SELECT *, 'typed', 3 FROM f WHERE type IN ('PROMO', 'STANDARD') AND band = '3'
  UNION ALL SELECT *, 'banned', 4 FROM f WHERE band = '4' AND id NOT IN ('7', '40', '41')
  UNION ALL SELECT *, 'listed', 5 FROM f WHERE band = '1' AND id IN ('1', '2', '3', '5', '8', '13', '21', '34'))
"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_type", "p_brand", "p_size")
    tags = F.create_map(F.lit("type"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("brand"), F.col("p_brand"), F.lit("band"), F.floor(F.col("p_size") / 10).cast("string"))
    return dealt(p, "id").select("id", tags.alias("tags"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match(tagged(spark, sf_dir), readers.rule_table(spark, CONFIG))


@query(f"WITH {FEATURES_SQL} SELECT id, name, priority FROM m")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("id", "name", "priority")


@query(f"WITH {FEATURES_SQL}, u AS (SELECT * FROM f WHERE id NOT IN (SELECT id FROM m)) SELECT 'type' AS key, type AS value FROM u UNION SELECT 'brand', brand FROM u UNION SELECT 'band', band FROM u")
def unprocessed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unprocessed_tags(tagged(spark, sf_dir), matched(spark, sf_dir))


@query(f"""WITH {FEATURES_SQL} SELECT id, name, CASE name WHEN 'plain' THEN 'Ground 1' WHEN 'typed' THEN 'Road' WHEN 'banned' THEN 'Fence' ELSE 'Church' END AS menu,
CASE name WHEN 'plain' THEN CASE WHEN band = '1' THEN 'Grass' ELSE 'Dirt' END WHEN 'typed' THEN 'Dirt' WHEN 'banned' THEN 'Stone' ELSE 'Church' END AS cat1
FROM m WHERE name IN ('plain', 'banned') OR (name = 'typed' AND type = 'PROMO') OR (name = 'listed' AND brand = 'Brand#11')""")
def first_match_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.first_type(F.col("tags"), F.col("cm_types"))
    return assign.from_tag(matched(spark, sf_dir).withColumn("kind", kind), "kind").select("id", "name", "menu", "cat1")


@query(f"""WITH {FEATURES_SQL}, steps AS (SELECT * FROM (VALUES
  (1, 0, 'type_from_tag', 'element', 'plain'), (2, 0, 'type_random_area', 'element', 'brand'),
  (3, 0, 'collect_lines', 'element', 'typed'), (3, 1, 'node_lines', 'rule', 'typed'), (3, 2, 'search_paths', 'rule', 'typed'), (3, 3, 'road_tiles', 'rule', 'typed'),
  (4, 0, 'collect_lines', 'element', 'banned'), (4, 0, 'type_random_area', 'element', 'banned'), (4, 1, 'node_lines', 'rule', 'banned'), (4, 4, 'search_paths', 'rule', 'banned'), (4, 5, 'fence_tiles', 'rule', 'banned'),
  (5, 0, 'collect_outlines', 'element', 'listed'), (5, 1, 'churches', 'rule', 'listed')) t(priority, stage, operator, mode, name))
SELECT s.priority, stage, operator, mode, name, count(m.id) AS n_elements FROM steps s LEFT JOIN m USING (name) GROUP BY ALL""")
def stage_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = plan.schedule(readers.rule_table(spark, CONFIG)).withColumn("name", F.explode("rules"))
    count = matched(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return steps.join(count, "name", "left").select("priority", "stage", "operator", "mode", "name", F.coalesce("n", F.lit(0)).alias("n_elements"))


@query(f"WITH {FEATURES_SQL}, o AS (SELECT m.*, CASE name WHEN 'plain' THEN 0 WHEN 'brand' THEN 1 WHEN 'typed' THEN 2 WHEN 'banned' THEN 3 ELSE 4 END AS ord FROM m) SELECT row_number() OVER (ORDER BY CAST(id AS BIGINT), ord) - 1 AS idx, id, name FROM o")
def element_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements numbered by feature, then by rule."""
    return rules.indexed(matched(spark, sf_dir), F.col("id").cast("long"), chunk=64).select("idx", "id", "name")


# ---- grids ----


PLACES = "SELECT o_orderkey, o_totalprice / 100 AS x, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 100).alias("x"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("y"))


#: The cells that the box around all places touches: i (number), nx, and x0 and y0 of its corner.
EXTENT_SQL = f"""p AS ({PLACES}), e AS (SELECT floor(min(x) / 8) AS cx, floor(min(y) / 8) AS cy, floor(max(x) / 8) AS dx, floor(max(y) / 8) AS dy FROM p),
t AS (SELECT unnest(range(CAST((dx - cx + 1) * (dy - cy + 1) AS BIGINT))) AS i, CAST(dx - cx + 1 AS BIGINT) AS nx, cx * 8 AS x0, cy * 8 AS y0 FROM e)"""


def place_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.squares_over(places(spark, sf_dir), "x", "y")


@query(f"WITH {EXTENT_SQL} SELECT CAST(i % nx AS INTEGER) AS xidx, CAST(i // nx AS INTEGER) AS yidx, (i % nx + 0.5) * 8.0 + x0 AS x, (i // nx + 0.5) * 8.0 + y0 AS y FROM t")
def grid_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square grid over the box around all places."""
    return place_squares(spark, sf_dir)


@query(f"WITH {EXTENT_SQL} SELECT DISTINCT CAST(4 * (i % nx) + a AS INTEGER) AS qx, CAST(4 * (i // nx) + b AS INTEGER) AS qy FROM t, (VALUES (2, 0), (-2, 0), (0, 2), (0, -2)) s(a, b)")
def diamond_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.diamonds(place_squares(spark, sf_dir)).select("qx", "qy")


@query(f"WITH {EXTENT_SQL} SELECT CAST(4 * (i % nx) + a AS INTEGER) AS qx, CAST(4 * (i // nx) + b AS INTEGER) AS qy, (i % nx + 0.5) * 8.0 + x0 + 2 * a AS x, (i // nx + 0.5) * 8.0 + y0 + 2 * b AS y FROM t, (VALUES (-1, -1), (1, -1), (-1, 1), (1, 1)) s(a, b)")
def subsquare_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.quarters(place_squares(spark, sf_dir))


@query(f"WITH {EXTENT_SQL} SELECT CAST(i % nx AS INTEGER) AS xidx, CAST(i // nx AS INTEGER) AS yidx, round(200 + cos(radians(30)) * ((i % nx + 0.5) * 8 + x0 - 200) - sin(radians(30)) * ((i // nx + 0.5) * 8 + y0 - 160), 4) AS x, round(160 + sin(radians(30)) * ((i % nx + 0.5) * 8 + x0 - 200) + cos(radians(30)) * ((i // nx + 0.5) * 8 + y0 - 160), 4) AS y FROM t")
def grid_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.turned(place_squares(spark, sf_dir), 30.0, 200.0, 160.0)
    return cells.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


@query(f"WITH p AS ({PLACES}) SELECT CAST(floor(x / 8) AS INTEGER) AS xidx, CAST(floor(y / 8) AS INTEGER) AS yidx, count(*) AS n FROM p WHERE x / 8 <> floor(x / 8) AND y / 8 <> floor(y / 8) GROUP BY 1, 2")
def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.point_cells(places(spark, sf_dir), "x", "y").groupBy("xidx", "yidx").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({PLACES}) SELECT o_orderkey, CAST(least(greatest(floor(x / 8), 0), 199) AS INTEGER) AS xidx, CAST(least(greatest(floor(y / 8), 0), 149) AS INTEGER) AS yidx FROM p")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.nearest_cell(places(spark, sf_dir), "x", "y", 200, 150).select("o_orderkey", "xidx", "yidx")


RECT_SQL = """
r AS (SELECT p_partkey AS id, (p_partkey % 97) * 5.0 AS x0, (p_partkey % 89) * 3.0 AS y0, p_size * 1.53 + 3.01 AS w, p_size * 0.71 + 5.03 AS h FROM part),
c AS (SELECT r.*, CAST(unnest(range(CAST(floor(x0 / 8) AS BIGINT), CAST(floor((x0 + w) / 8) AS BIGINT) + 1)) AS INTEGER) AS xidx FROM r),
d AS (SELECT c.*, CAST(unnest(range(CAST(floor(y0 / 8) AS BIGINT), CAST(floor((y0 + h) / 8) AS BIGINT) + 1)) AS INTEGER) AS yidx FROM c),
a AS (SELECT id, xidx, yidx, greatest(least(x0 + w, xidx * 8 + 8) - greatest(x0, xidx * 8), 0) * greatest(least(y0 + h, yidx * 8 + 8) - greatest(y0, yidx * 8), 0) AS area FROM d),
cells AS (SELECT * FROM a WHERE area > 32)
"""


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % 97) * 5.0, (k % 89) * 3.0
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), g.rectangle(x0, y0, x0 + (s * 1.53 + 3.01), y0 + (s * 0.71 + 5.03)).alias("ring"))


def rectangle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill(rectangles(spark, sf_dir), "ring").drop("ring")


@query(f"WITH {RECT_SQL} SELECT id, xidx, yidx FROM cells")
def rect_majority_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangle_cells(spark, sf_dir).select("id", "xidx", "yidx")


@query("""WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 41) * 11.0 + 40 AS cx, (s_suppkey % 37) * 13.0 + 40 AS cy, (s_suppkey % 5) * 4.0 + 10 AS r FROM supplier)
SELECT id, round(2 * r * r, 3) AS area, round(cx, 3) AS x, round(cy, 3) AS y, round(2 * r * r, 3) AS by_cell FROM s""")
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamond-shaped polygons: area, centroid, and the sum of their areas over the cells they touch."""
    rings = diamonds(spark, sf_dir)
    cells = grid.candidate_cells(rings, "ring")
    x, y = F.col("xidx") * 8.0, F.col("yidx") * 8.0
    part = cells.withColumn("a", g.clipped_area(F.col("ring"), g.box_planes(x, y, x + 8.0, y + 8.0))).groupBy("id").agg(F.round(F.sum("a"), 3).alias("by_cell"))
    own = rings.select("id", F.round(g.signed_area(F.col("ring")), 3).alias("area"), g.centroid(F.col("ring")).alias("p"))
    return own.join(part, "id").select("id", "area", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), "by_cell")


def diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cx, cy, r = (k % 41) * 11.0 + 40, (k % 37) * 13.0 + 40, (k % 5) * 4.0 + 10
    ring = F.array(g.point(cx + r, cy), g.point(cx, cy + r), g.point(cx - r, cy), g.point(cx, cy - r))
    return dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 1024).select(k.alias("id"), ring.alias("ring"))


@query("""WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 41) * 11.0 + 40 AS cx, (s_suppkey % 37) * 13.0 + 40 AS cy, (s_suppkey % 5) * 4.0 + 10 AS r FROM supplier),
c AS (SELECT s.*, unnest(range(CAST(floor((cx - r) / 8) AS BIGINT) - 1, CAST(floor((cx + r) / 8) AS BIGINT) + 2)) AS i FROM s),
d AS (SELECT c.*, unnest(range(CAST(floor((cy - r) / 8) AS BIGINT) - 1, CAST(floor((cy + r) / 8) AS BIGINT) + 2)) AS j FROM c),
q AS (SELECT DISTINCT id, cx, cy, r, 4 * i + a AS qx, 4 * j + b AS qy FROM d, (VALUES (2, 0), (-2, 0), (0, 2), (0, -2)) t(a, b)),
u AS (SELECT *, (qx / 4 + 0.5) * 8.0 AS x, (qy / 4 + 0.5) * 8.0 AS y FROM q),
o AS (SELECT *, greatest(least(cx + cy + r, x + y + 4) - greatest(cx + cy - r, x + y - 4), 0) * greatest(least(cx - cy + r, x - y + 4) - greatest(cx - cy - r, x - y - 4), 0) / 2 AS area FROM u)
SELECT id, qx, qy, round(area, 3) AS area FROM o WHERE round(area, 6) > 16""")
def diamond_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamond cells (quarter units) more than half covered by each polygon."""
    found = grid.fill_fine(diamonds(spark, sf_dir), "ring", grid.DIAMONDS, 0.5)
    return found.select("id", "qx", "qy", F.round("area", 3).alias("area"))


@query(f"""WITH {RECT_SQL} SELECT id, CAST(4 * c.xidx + s.a AS INTEGER) AS qx, CAST(4 * c.yidx + s.b AS INTEGER) AS qy FROM (SELECT d.*, unnest([{{'a': -1, 'b': -1}}, {{'a': 1, 'b': -1}}, {{'a': -1, 'b': 1}}, {{'a': 1, 'b': 1}}]) AS s FROM d) c
WHERE greatest(least(x0 + w, xidx * 8 + 4 + 2 * s.a + 2) - greatest(x0, xidx * 8 + 4 + 2 * s.a - 2), 0) * greatest(least(y0 + h, yidx * 8 + 4 + 2 * s.b + 2) - greatest(y0, yidx * 8 + 4 + 2 * s.b - 2), 0) > 8""")
def quarter_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill_fine(rectangles(spark, sf_dir), "ring", grid.QUARTERS, 0.5).select("id", F.col("qx").cast("int").alias("qx"), F.col("qy").cast("int").alias("qy"))


@query(f"""WITH {RECT_SQL}, q AS (SELECT id, CAST(4 * c.xidx + s.a AS INTEGER) AS qx, CAST(4 * c.yidx + s.b AS INTEGER) AS qy FROM (SELECT d.*, unnest([{{'a': -1, 'b': -1}}, {{'a': 1, 'b': -1}}, {{'a': -1, 'b': 1}}, {{'a': 1, 'b': 1}}]) AS s FROM d) c
WHERE greatest(least(x0 + w, xidx * 8 + 4 + 2 * s.a + 2) - greatest(x0, xidx * 8 + 4 + 2 * s.a - 2), 0) * greatest(least(y0 + h, yidx * 8 + 4 + 2 * s.b + 2) - greatest(y0, yidx * 8 + 4 + 2 * s.b - 2), 0) > 8)
SELECT id, qx, qy FROM q WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM q o WHERE o.id % 2 = 0 AND o.qx = q.qx AND o.qy = q.qy)""")
def quarter_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter cells of every second shape that the others have not occupied before."""
    found = quarter_fill(spark, sf_dir)
    return grid.free(found.where("id % 2 = 1"), found.where("id % 2 = 0"), ("qx", "qy")).select("id", "qx", "qy")


@query("""WITH r AS (SELECT p_partkey AS id, (p_partkey % 97) * 5.0 AS x0, (p_partkey % 89) * 3.0 AS y0, p_size * 1.53 + 3.01 AS w, p_size * 0.71 + 5.03 AS h, CASE WHEN p_partkey % 2 = 0 THEN 3.44 ELSE 0.0 END AS d FROM part),
b AS (SELECT id, x0 + d AS x1, y0 + d AS y1, x0 + w - d AS x2, y0 + h - d AS y2 FROM r WHERE w > 2 * d AND h > 2 * d),
c AS (SELECT b.*, CAST(unnest(range(CAST(floor(x1 / 8) AS BIGINT), CAST(floor(x2 / 8) AS BIGINT) + 1)) AS INTEGER) AS xidx FROM b),
e AS (SELECT c.*, CAST(unnest(range(CAST(floor(y1 / 8) AS BIGINT), CAST(floor(y2 / 8) AS BIGINT) + 1)) AS INTEGER) AS yidx FROM c)
SELECT id, xidx, yidx FROM e WHERE greatest(least(x2, xidx * 8 + 8) - greatest(x1, xidx * 8), 0) * greatest(least(y2, yidx * 8 + 8) - greatest(y1, yidx * 8), 0) > 32""")
def core_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of shapes of which every second one is less a border of 0.43 cells."""
    border = F.when(F.col("id") % 2 == 0, 0.43)
    return grid.fill_core(rectangles(spark, sf_dir).withColumn("border", border), "ring", "border").select("id", "xidx", "yidx")


@query("""WITH r AS (SELECT p_partkey AS id, (p_partkey % 97) * 5.0 AS x0, (p_partkey % 89) * 3.0 AS y0, p_size * 1.53 + 3.01 AS w, p_size * 0.71 + 5.03 AS h, p_partkey % 2 = 0 AS cut, CASE WHEN p_partkey % 2 = 0 THEN 1.8536 ELSE 4.8904 END AS d FROM part),
l AS (SELECT *, x0 + w AS x1, y0 + h AS y1, x0 + 0.45 * w AS xn, y0 + 0.55 * h AS yn FROM r),
c AS (SELECT l.*, cx, unnest(generate_series(floor((y0 - d) / 8)::bigint, floor((y1 + d) / 8)::bigint)) AS cy FROM (SELECT *, unnest(generate_series(floor((x0 - d) / 8)::bigint, floor((x1 + d) / 8)::bigint)) AS cx FROM l) l),
b AS (SELECT *, list_sort([least(greatest(v, cx * 8), cx * 8 + 8) for v in [x0 - d, x0, x0 + d, xn - d, xn, xn + d, x1 - d, x1, x1 + d, cx * 8, cx * 8 + 8]]) AS bp FROM c),
p AS (SELECT *, bp[j] AS a0, (bp[j + 1] - bp[j]) / 128 AS wide FROM b, range(1, 11) t(j) WHERE bp[j + 1] > bp[j]),
s AS (SELECT *, a0 + (k + 0.5) * wide AS x FROM p, range(128) t(k)),
e AS (SELECT *, d * d - greatest(x0 - x, x - x1, 0) ** 2 AS a, d * d - greatest(x0 - x, x - xn, 0) ** 2 AS b FROM s),
t AS (SELECT id, cx, cy, wide,
CASE WHEN cut THEN y0 + d WHEN a < 0 THEN NULL ELSE y0 - sqrt(a) END AS low,
CASE WHEN cut AND (x < x0 + d OR x > x1 - d) THEN NULL WHEN cut AND x <= xn - d THEN y1 - d WHEN cut AND x < xn THEN least(y1 - d, yn - sqrt(d * d - (xn - x) ** 2)) WHEN cut THEN yn - d
WHEN a < 0 THEN NULL WHEN b < 0 THEN yn + sqrt(a) ELSE greatest(yn + sqrt(a), y1 + sqrt(b)) END AS high FROM e)
SELECT id, cx AS xidx, cy AS yidx FROM t GROUP BY 1, 2, 3 HAVING sum(CASE WHEN low IS NULL OR high IS NULL THEN 0 ELSE greatest(least(high, cy * 8 + 8) - greatest(low, cy * 8), 0) * wide END) > 32""")
def border_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of shapes with a turn: of every second one less a border of 0.2317 cells, of the others with one of
    0.6113 cells around them."""
    p = [F.get("ring", i) for i in range(3)]
    xn, yn = (p[0][c] + f * (p[2][c] - p[0][c]) for c, f in (("x", 0.45), ("y", 0.55)))
    turned = F.array(p[0], p[1], g.point(p[1]["x"], yn), g.point(xn, yn), g.point(xn, p[2]["y"]), g.point(p[0]["x"], p[2]["y"]))
    border = F.when(F.col("id") % 2 == 0, 0.2317).otherwise(-0.6113)
    shapes = rectangles(spark, sf_dir).withColumn("ring", turned).withColumn("border", border)
    return grid.fill_core(shapes, "ring", "border").select("id", "xidx", "yidx")


@query(f"""WITH {EXTENT_SQL} SELECT 'square' AS kind, count(*) AS n, min(4 * (i % nx)) AS low, max(4 * (i // nx)) AS high FROM t
UNION ALL SELECT kind, count(*), min(qx), max(qy) FROM (SELECT DISTINCT kind, 4 * (i % nx) + a AS qx, 4 * (i // nx) + b AS qy FROM t, (VALUES ('diamond', 2, 0), ('diamond', -2, 0), ('diamond', 0, 2), ('diamond', 0, -2), ('quarter', -1, -1), ('quarter', 1, -1), ('quarter', -1, 1), ('quarter', 1, 1)) s(kind, a, b)) GROUP BY kind""")
def grid_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three grids over all places: how many cells, and how far they reach."""
    every = grid.all_grids(place_squares(spark, sf_dir))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.min("qx").cast("long").alias("low"), F.max("qy").cast("long").alias("high"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size * 1.53 + 3.01 AS w, p_size * 0.71 + 5.03 AS h, (p_partkey % 13) * 1.5 AS dx, (p_partkey % 7) * 0.5 AS dy FROM part),
i AS (SELECT *, greatest(w - dx, 0) * greatest(h - dy, 0) AS shared FROM r)
SELECT id, round(shared, 4) AS shared, round(2 * w * h - shared, 4) AS together, round(shared / (2 * w * h - shared), 6) AS iou FROM i""")
def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles and themselves moved aside: areas shared and together."""
    k = F.col("id")
    moved = F.transform("ring", lambda p: g.point(p["x"] + (k % 13) * 1.5, p["y"] + (k % 7) * 0.5))
    both = rectangles(spark, sf_dir).withColumn("o", g.overlap(F.col("ring"), moved))
    return both.select("id", F.round("o.shared", 4).alias("shared"), F.round("o.together", 4).alias("together"), F.round("o.iou", 6).alias("iou"))


@query("SELECT p_partkey AS id, CAST(p_size + 1 AS DOUBLE) AS x, 2.0 AS y, round(2.25 * ((p_size + 3) * 2.0 + (p_size + 1) * 3.0), 4) AS scaled_area FROM part")
def ring_concave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped rings of either direction: their concave corner, and their area drawn half as large again."""
    s = F.col("p_size")
    corners = ((F.lit(0), F.lit(0)), (s + 3, F.lit(0)), (s + 3, F.lit(2)), (s + 1, F.lit(2)), (s + 1, F.lit(5)), (F.lit(0), F.lit(5)))
    ring = F.array(*[g.point(x, y) for x, y in corners])
    own = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.reverse(ring)).otherwise(ring).alias("ring"))
    corner = F.explode(g.concave_vertices(F.col("ring")))
    area = F.abs(g.signed_area(g.scaled(F.col("ring"), F.lit(1.5))))
    return own.select("id", "ring", corner.alias("p")).select("id", "p.x", "p.y", F.round(area, 4).alias("scaled_area"))


@query("""WITH a AS (SELECT p_partkey AS id, atan2(p_size - 25.0, p_partkey % 41 - 20.0) AS a, atan2(p_partkey % 17 - 8.0, p_size - 13.0) AS b FROM part),
d AS (SELECT id, (a - b) - floor((a - b) / (2 * pi())) * (2 * pi()) AS d FROM a) SELECT id, round(least(d, 2 * pi() - d), 6) AS angle FROM d""")
def angle_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    angle = g.angle_difference(F.atan2(s - 25.0, k % 41 - 20.0), F.atan2(k % 17 - 8.0, s - 13.0))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(angle, 6).alias("angle"))


# ---- draws ----

TYPES = "array(named_struct('menu', 'Ground', 'cat1', 'Grass', 'cat2', 'g', 'weight', 2.0D, 'dummy', false), named_struct('menu', 'Ground', 'cat1', 'Mud', 'cat2', 'm', 'weight', 0.5D, 'dummy', false), named_struct('menu', CAST(NULL AS STRING), 'cat1', CAST(NULL AS STRING), 'cat2', CAST(NULL AS STRING), 'weight', 1.5D, 'dummy', true))"
U_SQL = "(CAST(t AS BIGINT) * t + t * 48271 + 11) % 1000003"
PICK_SQL = f"CASE WHEN {U_SQL} * 4000 < 2000::BIGINT * 1000003 THEN 'Grass' WHEN {U_SQL} * 4000 < 2500::BIGINT * 1000003 THEN 'Mud' END"


def with_types(df: DataFrame) -> DataFrame:
    return df.withColumn("types", F.expr(TYPES))


@query(f"WITH {RECT_SQL}, k AS (SELECT *, (5 + (id % 1000003) * 7919) % 1000003 AS t FROM cells) SELECT id, xidx, yidx, {PICK_SQL} AS cat1 FROM k")
def random_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.random_area(with_types(rectangle_cells(spark, sf_dir)), "types", "id", salt=5).select("id", "xidx", "yidx", "cat1")


CELL_T = "(5 + (id % 1000003) * 7919 + (xidx % 1000003) * 104729 + (yidx % 1000003) * 611953) % 1000003"


@query(f"WITH {RECT_SQL}, k AS (SELECT *, {CELL_T} AS t FROM cells) SELECT id, xidx, yidx, {PICK_SQL} AS cat1 FROM k")
def random_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.random_cell(with_types(rectangle_cells(spark, sf_dir)), "types", "id", salt=5).select("id", "xidx", "yidx", "cat1")


@query(f"WITH {RECT_SQL}, k AS (SELECT *, {CELL_T} AS t FROM cells) SELECT id, count(*) AS n, count({PICK_SQL}) AS n_set FROM k GROUP BY id")
def random_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = assign.random_clusters(with_types(rectangle_cells(spark, sf_dir)), "types", "id", salt=5)
    return cells.groupBy("id").agg(F.count("*").alias("n"), F.count("cat1").alias("n_set"))


@query(f"WITH {RECT_SQL}, s AS (SELECT *, min(xidx) OVER w AS x1, max(xidx) OVER w AS x2 FROM cells WINDOW w AS (PARTITION BY id)), t AS (SELECT * FROM s WHERE (xidx - x1) % 3 = 0 AND xidx < x2), v AS (SELECT *, min(yidx) OVER w AS y1, max(yidx) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY id)) SELECT id, xidx, yidx FROM v WHERE (yidx - y1) % 2 = 0 AND yidx < y2")
def stride_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.strided(rectangle_cells(spark, sf_dir), "id", 3, 2).select("id", "xidx", "yidx")


@query(f"WITH p AS ({PLACES}), c AS (SELECT o_orderkey AS id, CAST(floor(x / 8) AS INTEGER) AS xidx, CAST(floor(y / 8) AS INTEGER) AS yidx FROM p WHERE x / 8 <> floor(x / 8) AND y / 8 <> floor(y / 8)), k AS (SELECT *, {CELL_T} AS t FROM c) SELECT id, xidx, yidx, {PICK_SQL} AS cat1 FROM k")
def single_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.point_cells(places(spark, sf_dir), "x", "y").withColumnRenamed("o_orderkey", "id")
    return assign.random_cell(with_types(cells), "types", "id", salt=5).select("id", "xidx", "yidx", "cat1")


@query(f"""WITH {ROWS_SQL}, line AS (SELECT DISTINCT xidx, yidx FROM rows_ WHERE name = 'R' AND priority = 1), cells AS (SELECT 0 AS id, i % 64 AS xidx, i // 64 AS yidx FROM range(64 * 64) r(i)),
k AS (SELECT c.*, (9 + xidx * 7919 + yidx * 104729) % 1000003 AS t FROM cells c SEMI JOIN line USING (xidx, yidx)) SELECT CAST(xidx AS INTEGER) AS xidx, CAST(yidx AS INTEGER) AS yidx, {PICK_SQL} AS cat1 FROM k""")
def linear_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = assignments(spark, sf_dir).where("name = 'R' and priority = 1").select("xidx", "yidx", "name", "menu").distinct().dropDuplicates(["xidx", "yidx"])
    return assign.on_line(with_types(grid.squares(spark, 64, 64)), line, "R", "types", salt=9).select("xidx", "yidx", "cat1")


# ---- elevation ----

POINTS_SQL = "pts AS (SELECT CAST(l_orderkey % 512 AS DOUBLE) AS x, CAST(l_partkey % 512 AS DOUBLE) AS y, l_quantity AS z FROM lineitem)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 512).cast("double").alias("x"), (F.col("l_partkey") % 512).cast("double").alias("y"), F.col("l_quantity").alias("z"))


@query(f"WITH {POINTS_SQL}, a AS (SELECT DISTINCT x FROM pts ORDER BY x LIMIT 2), b AS (SELECT DISTINCT y FROM pts ORDER BY y LIMIT 2) SELECT (SELECT max(x) - min(x) FROM a) AS dx, (SELECT max(y) - min(y) FROM b) AS dy")
def elev_cell_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.cell_size(points(spark, sf_dir))


@query(f"WITH {POINTS_SQL} SELECT min(x) AS xmin, min(y) AS ymin, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pts")
def elev_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.extent(points(spark, sf_dir), 1.0)


@query(f"WITH {POINTS_SQL} SELECT z, count(*) AS n FROM pts WHERE x >= 100 AND x < 300 AND y >= 50 AND y < 400 GROUP BY z")
def elev_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.clip(points(spark, sf_dir), 100, 50, 300, 400).groupBy("z").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL}, m AS (SELECT min(z) AS low FROM pts) SELECT CASE WHEN low < 20 THEN z - floor(low) + 20 ELSE z END AS z, count(*) AS n FROM pts, m GROUP BY 1")
def elev_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.lifted(points(spark, sf_dir)).groupBy("z").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS_SQL}, a AS (SELECT arg_min(z, (x * 1000 + y) * 1000 + z) AS z1 FROM pts WHERE x BETWEEN 99.5 AND 104.5 AND y BETWEEN 79.5 AND 84.5), b AS (SELECT arg_min(z, (x * 1000 + y) * 1000 + z) AS z2 FROM pts WHERE x BETWEEN 399.5 AND 404.5 AND y BETWEEN 299.5 AND 304.5)
SELECT x, y, round(sum(z - coalesce(300 * (z2 - z1) / (300.0 * 300 + 220 * 220) * (x - 102) + 220 * (z2 - z1) / (300.0 * 300 + 220 * 220) * (y - 82), 0)), 4) AS z FROM pts, a, b GROUP BY x, y""")
def water_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.level_water(points(spark, sf_dir), (102.0, 82.0), (402.0, 302.0), 2.5).groupBy("x", "y").agg(F.round(F.sum("z"), 4).alias("z"))


RASTER_SQL = f"{POINTS_SQL}, own AS (SELECT CAST(floor(x / 4) AS INTEGER) AS x, CAST(floor(y / 4) AS INTEGER) AS y, max(z) AS z FROM pts GROUP BY 1, 2), raster AS (SELECT CAST(i % 128 AS INTEGER) AS x, CAST(i // 128 AS INTEGER) AS y FROM range(128 * 128) t(i)), dense AS (SELECT x, y, coalesce(z, 0) AS z FROM raster LEFT JOIN own USING (x, y))"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.densified(points(spark, sf_dir), 128, 128, 4.0)


@query(f"WITH {RASTER_SQL} SELECT * FROM dense")
def elev_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir)


@query(f"WITH {RASTER_SQL} SELECT x // 2 AS x, y // 2 AS y, round(avg(z), 4) AS z FROM dense GROUP BY 1, 2")
def elev_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.downsampled(dense(spark, sf_dir), 2).withColumn("z", F.round("z", 4))


@query(f"""WITH {RASTER_SQL}, small AS (SELECT x // 2 AS x, y // 2 AS y, avg(z) AS z FROM dense GROUP BY 1, 2),
e AS (SELECT a.x, a.y, a.z, b.z AS z2, 1 AS dx, 0 AS dy FROM small a JOIN small b ON b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.x, a.y, a.z, b.z, 0, 1 FROM small a JOIN small b ON b.y = a.y + 1 AND b.x = a.x),
l AS (SELECT *, unnest(range(CAST(greatest(ceil(least(z, z2) / 5.0), 0) AS BIGINT), CAST(ceil(greatest(z, z2) / 5.0) AS BIGINT))) * 5.0 AS level FROM e WHERE z <> z2)
SELECT DISTINCT CAST(round((x + dx * ((level - z) / (z2 - z))) * 8.0) AS BIGINT) AS x, CAST(round((y + dy * ((level - z) / (z2 - z))) * 8.0) AS BIGINT) AS y, CAST(level AS DOUBLE) AS z FROM l""")
def contour_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.contours(elevation.downsampled(dense(spark, sf_dir), 2), 5.0)


@query(f"""WITH {RASTER_SQL}, t AS (SELECT x, y, x * 0.5 + 3.25 AS tx, y * 0.5 + 1.5 AS ty FROM raster)
SELECT t.x, t.y, round(CASE WHEN count(d.z) = count(*) THEN sum(d.z * (1 - abs(tx - d.x)) * (1 - abs(ty - d.y))) ELSE -1 END, 4) AS z
FROM t LEFT JOIN dense d ON abs(tx - d.x) < 1 AND abs(ty - d.y) < 1 GROUP BY t.x, t.y""")
def raster_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dense(spark, sf_dir).select("x", "y", (F.col("x") * 0.5 + 3.25).alias("tx"), (F.col("y") * 0.5 + 1.5).alias("ty"))
    return elevation.resampled(dense(spark, sf_dir), at).select("x", "y", F.round("z", 4).alias("z"))


@query()
def scattered_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the corners of a grid between points that lie irregularly."""
    li = table(spark, sf_dir, "lineitem")
    points = li.select((F.col("l_orderkey") % 512 + (F.col("l_suppkey") % 17) / 20.0).alias("x"), (F.col("l_partkey") % 512 + (F.col("l_linenumber") % 7) / 9.0).alias("y"), F.col("l_quantity").alias("z"))
    k = F.col("o_orderkey")
    corners = table(spark, sf_dir, "orders").select(k.alias("id"), ((k % 64) * 8.0).alias("x"), ((k % 61) * 8.4).alias("y"))
    return scattered.interpolated(points, corners, 64.0, 4.0).select("id", "x", "y", "z")


@query(f"""WITH {RASTER_SQL}, t AS (SELECT x, y, 63.5 + (x - 63.5) * cos(radians(-30)) - (y - 63.5) * sin(radians(-30)) AS tx, 63.5 + (x - 63.5) * sin(radians(-30)) + (y - 63.5) * cos(radians(-30)) AS ty FROM raster),
c AS (SELECT t.*, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM t),
w AS (SELECT *, CAST(floor(tx) + a AS INTEGER) AS nx, CAST(floor(ty) + b AS INTEGER) AS ny, CASE WHEN a = 1 THEN tx - floor(tx) ELSE 1 - (tx - floor(tx)) END * CASE WHEN b = 1 THEN ty - floor(ty) ELSE 1 - (ty - floor(ty)) END AS weight FROM c)
SELECT w.x, w.y, round(CASE WHEN count(d.z) = count(*) THEN sum(weight * d.z) ELSE -1 END, 4) AS z FROM w LEFT JOIN dense d ON d.x = nx AND d.y = ny WHERE weight > 0 GROUP BY w.x, w.y""")
def raster_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster turned by 30 degrees, -1 where nothing was."""
    return elevation.rotated(dense(spark, sf_dir), 128, 128, 30.0).withColumn("z", F.round("z", 4))


@query(f"WITH {RASTER_SQL} SELECT x - 12 AS x, y - 36 AS y, z FROM dense WHERE x BETWEEN 12 AND 12 + 103 AND y BETWEEN 36 AND 36 + 55")
def raster_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a raster that a map of 104 by 56 cells covers about its centre."""
    return elevation.cropped(dense(spark, sf_dir), planning.crop_box(128, 128, 104.0, 56.0))


@query(f"WITH {RASTER_SQL} SELECT 1000 + (x + 0.5) * 4 AS x, 2512 - (y + 0.5) * 4 AS y, z FROM dense WHERE y BETWEEN 52 - 1 AND 102 + 1 AND x BETWEEN 25 - 1 AND 75 + 1")
def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a box and one more all around, at their positions."""
    pixels = dense(spark, sf_dir).select(F.col("y").alias("row"), F.col("x").alias("col"), "z")
    return elevation.window(pixels, (1100.0, 2103.0, 1300.0, 2301.0), 1000.0, 2512.0, 4.0)


@query(f"WITH {POINTS_SQL}, r AS (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) AS k FROM pts) SELECT x, y, z FROM r WHERE (k - 1) % 5 = 0 UNION ALL SELECT max(x), max(y), -1 FROM pts")
def stride_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth point of all, and a row that marks the far corner."""
    own = points(spark, sf_dir)
    return elevation.with_corner(elevation.strided(own, ("x", "y", "z"), 5), own)


@query(f"WITH {POINTS_SQL}, r AS (SELECT x, y, z, row_number() OVER (PARTITION BY x ORDER BY y, z) AS k FROM pts) SELECT x, y, z FROM r WHERE (k - 1) % 7 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elevation.strided(points(spark, sf_dir), ("y", "z"), 7, "x")


@query("SELECT c_custkey, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS epsg FROM (SELECT c_custkey, (c_custkey % 360) - 180.0 + 0.5 AS lon, (c_custkey % 160) - 80.0 + 0.5 AS lat FROM customer)")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", g.utm_zone((k % 360) - 180.0 + 0.5, (k % 160) - 80.0 + 0.5).alias("epsg"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey % 360) - 180.0 + 0.5 AS lon, (c_custkey % 160) - 80.0 + 0.5 AS lat FROM customer),
c AS (SELECT *, 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n, radians(lat) AS phi, radians(lon - (least(floor((lon + 180) / 6) + 1, 60) * 6 - 183)) AS lam FROM p),
e AS (SELECT *, 2 * sqrt(n) / (1 + n) AS ecc, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS radius FROM c),
t AS (SELECT *, sinh(atanh(sin(phi)) - ecc * atanh(ecc * sin(phi))) AS tau FROM e),
z AS (SELECT *, atan2(tau, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tau * tau)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM t)
SELECT c_custkey, round(0.9996 * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) + 500000, 2) AS east,
round(0.9996 * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END, 2) AS north FROM z""")
def utm_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eastings and northings of positions on a raster of degrees."""
    k = F.col("c_custkey")
    lon, lat = (k % 360) - 180.0 + 0.5, (k % 160) - 80.0 + 0.5
    p = g.to_utm(lon, lat, g.utm_zone(lon, lat))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(p["x"], 2).alias("east"), F.round(p["y"], 2).alias("north"))


@query("SELECT c_custkey, round((c_custkey % 360) - 180.0 + 0.5, 7) AS lon, round((c_custkey % 160) - 80.0 + 0.5, 7) AS lat FROM customer")
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a raster of degrees, projected and back."""
    k = F.col("c_custkey")
    lon, lat = (k % 360) - 180.0 + 0.5, (k % 160) - 80.0 + 0.5
    there = table(spark, sf_dir, "customer").select("c_custkey", g.utm_zone(lon, lat).alias("zone"), g.to_utm(lon, lat, g.utm_zone(lon, lat)).alias("p"))
    back = there.select("c_custkey", g.from_utm(F.col("p.x"), F.col("p.y"), F.col("zone")).alias("q"))
    return back.select("c_custkey", F.round("q.x", 7).alias("lon"), F.round("q.y", 7).alias("lat"))


@query(f"""WITH {RASTER_SQL}, near AS (SELECT x, y, z, unnest(range(CAST(floor((x - 2.0) / 2.5 - 0.5) AS BIGINT), CAST(floor((x + 3.5) / 2.5 - 0.5) AS BIGINT) + 2)) AS t FROM dense),
w AS (SELECT t, y, z, 1 - abs(x + 0.5 - (t + 0.5) * 2.5) / 2.5 AS w FROM near),
a AS (SELECT t AS x, y, sum(w * z) / sum(w) AS z, sum(w) AS v FROM w WHERE w > 0 GROUP BY t, y),
far AS (SELECT x, y, z, v, unnest(range(CAST(floor((y - 2.0) / 2.5 - 0.5) AS BIGINT), CAST(floor((y + 3.5) / 2.5 - 0.5) AS BIGINT) + 2)) AS t FROM a),
u AS (SELECT x, t, z, (1 - abs(y + 0.5 - (t + 0.5) * 2.5) / 2.5) * v AS w, 1 - abs(y + 0.5 - (t + 0.5) * 2.5) / 2.5 AS own FROM far)
SELECT CAST(x AS INTEGER) AS x, CAST(t AS INTEGER) AS y, round(sum(w * z) / sum(w), 3) AS z FROM u WHERE own > 0 GROUP BY x, t""")
def raster_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster with cells two and a half times as wide and high."""
    return elevation.rescaled(dense(spark, sf_dir), 2.5, 2.5).withColumn("z", F.round("z", 3))


# ---- pages ----

CELLS_SQL = """
cells AS (SELECT DISTINCT CAST(l_orderkey % 133 AS DOUBLE) AS x, CAST(l_partkey % 101 AS DOUBLE) AS y, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2),
tot AS (SELECT CAST(max(x) AS INTEGER) + 1 AS tx, CAST(max(y) AS INTEGER) + 1 AS ty FROM cells),
sz AS (SELECT tx // 24 AS nx, ty // 22 AS ny, (tx % 24) // 2 * 2 AS rx, (ty % 22) // 2 * 2 AS ry FROM tot),
sizes AS (SELECT *, nx * 24 + rx AS w, ny * 22 + ry AS h FROM sz),
paged AS (SELECT x, y, z, CAST(ceil((w - x) / 24.0) - 1 AS INTEGER) AS page_x, CAST(floor(y / 22.0) AS INTEGER) AS page_y, nx, ny, w, h FROM cells, sizes WHERE x < w AND y < h)
"""


def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 133).cast("double").alias("x"), (F.col("l_partkey") % 101).cast("double").alias("y")).agg(F.max("l_quantity").alias("z"))


@query(f"WITH {CELLS_SQL} SELECT CAST(nx AS INTEGER) AS nx, CAST(ny AS INTEGER) AS ny, CAST(rx AS INTEGER) AS rx, CAST(ry AS INTEGER) AS ry, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM sizes")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.sizes(map_cells(spark, sf_dir))


@query(f"""WITH {CELLS_SQL} SELECT x, y, z, page_x, page_y, x - CASE WHEN page_x < nx THEN w - (page_x + 1) * 24 ELSE 0 END AS px,
y - CASE WHEN page_y < ny THEN page_y * 24 - (page_y + 1) * 2 ELSE h - 24 END AS py FROM paged""")
def page_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.paged(map_cells(spark, sf_dir))


@query(f"""WITH {CELLS_SQL}, levels AS (SELECT DISTINCT page_x, page_y, z FROM paged), p AS (SELECT page_x, page_y, max(z) AS m FROM levels GROUP BY 1, 2),
s AS (SELECT page_x, page_y, coalesce(lag(m) OVER (ORDER BY page_y, page_x), 20) AS start FROM p)
SELECT page_x, page_y, z, coalesce(lag(z) OVER w, start) AS before, z - coalesce(lag(z) OVER w, start) AS steps FROM levels JOIN s USING (page_x, page_y) WINDOW w AS (PARTITION BY page_x, page_y ORDER BY z)""")
def height_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.height_steps(paging.paged(map_cells(spark, sf_dir)))


@query("""WITH p AS (SELECT c_nationkey AS map, c_custkey AS seq, CAST(c_custkey % 37 + 10 AS INTEGER) AS nx, CAST(c_custkey % 23 + 20 AS INTEGER) AS ny FROM customer),
b AS (SELECT *, coalesce(lag(nx) OVER w, 40) AS bx, coalesce(lag(ny) OVER w, 40) AS b_y FROM p WINDOW w AS (PARTITION BY map ORDER BY seq)),
c AS (SELECT map, seq, CASE WHEN nx <= bx THEN 'horizontal_minus' ELSE 'horizontal_plus' END AS button, abs(bx - nx) // 2 AS clicks FROM b
UNION ALL SELECT map, seq, CASE WHEN nx <= bx THEN 'horizontal_plus2' ELSE 'horizontal_minus2' END, abs(bx - nx) // 2 FROM b WHERE NOT (bx = 40 AND b_y = 40)
UNION ALL SELECT map, seq, CASE WHEN ny <= b_y THEN 'vertical_minus' ELSE 'vertical_plus' END, abs(b_y - ny) // 2 FROM b
UNION ALL SELECT map, seq, CASE WHEN ny <= b_y THEN 'vertical_plus2' ELSE 'vertical_minus2' END, abs(b_y - ny) // 2 FROM b WHERE NOT (bx = 40 AND b_y = 40))
SELECT map, seq, button, CAST(clicks AS INTEGER) AS clicks FROM c WHERE clicks > 0""")
def map_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that bring a map from page size to page size."""
    k = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("map"), k.alias("seq"), (k % 37 + 10).cast("int").alias("nx"), (k % 23 + 20).cast("int").alias("ny"))
    return paging.resizes(pages, "map", "seq")


@query(f"""WITH {CELLS_SQL}, own AS (SELECT *, x - CASE WHEN page_x < nx THEN w - (page_x + 1) * 24 ELSE 0 END AS px, y - CASE WHEN page_y < ny THEN page_y * 24 - (page_y + 1) * 2 ELSE h - 24 END AS py FROM paged),
pg AS (SELECT a.p AS page_x, b.p AS page_y, CASE WHEN a.p < nx THEN (a.p + 1) * 26 - a.p * 2 ELSE a.p * 26 - (a.p - 1) * 2 + rx END AS nx, CASE WHEN b.p < ny THEN (b.p + 1) * 26 - b.p * 4 ELSE b.p * 26 - (b.p - 1) * 4 + ry END AS ny
  FROM sizes, range(1000) a(p), range(1000) b(p) WHERE a.p <= nx AND b.p <= ny AND (a.p < nx OR rx > 0) AND (b.p < ny OR ry > 0)),
b AS (SELECT *, coalesce(lag(nx) OVER w, 40) AS bx, coalesce(lag(ny) OVER w, 40) AS b_y FROM pg WINDOW w AS (ORDER BY page_y, page_x)),
c AS (SELECT page_y, page_x, 0 AS turn, CASE WHEN nx <= bx THEN 'horizontal_minus' ELSE 'horizontal_plus' END AS button, abs(bx - nx) // 2 AS clicks FROM b
UNION ALL SELECT page_y, page_x, 1, CASE WHEN nx <= bx THEN 'horizontal_plus2' ELSE 'horizontal_minus2' END, abs(bx - nx) // 2 FROM b WHERE NOT (bx = 40 AND b_y = 40)
UNION ALL SELECT page_y, page_x, 2, CASE WHEN ny <= b_y THEN 'vertical_minus' ELSE 'vertical_plus' END, abs(b_y - ny) // 2 FROM b
UNION ALL SELECT page_y, page_x, 3, CASE WHEN ny <= b_y THEN 'vertical_plus2' ELSE 'vertical_minus2' END, abs(b_y - ny) // 2 FROM b WHERE NOT (bx = 40 AND b_y = 40)),
levels AS (SELECT DISTINCT page_x, page_y, z FROM paged), p AS (SELECT page_x, page_y, max(z) AS m FROM levels GROUP BY 1, 2),
s AS (SELECT page_x, page_y, coalesce(lag(m) OVER (ORDER BY page_y, page_x), 20) AS start FROM p),
k AS (SELECT page_x, page_y, z, z - coalesce(lag(z) OVER w, start) AS steps FROM levels JOIN s USING (page_x, page_y) WINDOW w AS (PARTITION BY page_x, page_y ORDER BY z)),
every AS (SELECT page_y, page_x, 0 AS part, turn AS a, 0 AS b, 0 AS x, 0 AS y, 'button' AS action, button AS what, clicks AS times, NULL AS px, NULL AS py FROM c WHERE clicks > 0
UNION ALL SELECT page_y, page_x, 1, z, 0, 0, 0, 'key', CASE WHEN steps > 0 THEN '+' ELSE '-' END, abs(steps), NULL, NULL FROM k WHERE steps <> 0
UNION ALL SELECT page_y, page_x, 1, z, 1, x, y, 'height', NULL, 1, px * 16 + 233, 451 - py * 16 FROM own)
SELECT row_number() OVER (ORDER BY page_y, page_x, part, a, b, x, y) AS seq, CAST(page_y AS INTEGER) AS page_y, CAST(page_x AS INTEGER) AS page_x, action, what, CAST(times AS INTEGER) AS times, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py FROM every""")
def action_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything the editor is told for the heights of a map, in one order over all pages."""
    return paging.stream(map_cells(spark, sf_dir))


MENUS = [("Ground 1", 10, 20), ("Foliage", 30, 40), ("A", 50, 60), ("N", 70, 80), ("O", 90, 100)]


@query("""WITH g AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'Ground 1' WHEN l_linenumber % 3 = 1 THEN 'Foliage' ELSE 'Missing' END AS menu, l_returnflag AS cat1, l_linestatus AS cat2 FROM lineitem),
m AS (SELECT * FROM (VALUES ('Ground 1', 10, 20), ('Foliage', 30, 40), ('A', 50, 60), ('N', 70, 80), ('O', 90, 100)) t(label, px, py))
SELECT menu, cat1, cat2, a.px AS menu_px, b.px AS cat1_px, c.px AS cat2_px FROM g JOIN m a ON menu = a.label JOIN m b ON cat1 = b.label LEFT JOIN m c ON cat2 = c.label""")
def menu_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Ground 1").when(F.col("l_linenumber") % 3 == 1, "Foliage").otherwise("Missing")
    groups = li.select(kind.alias("menu"), F.col("l_returnflag").alias("cat1"), F.col("l_linestatus").alias("cat2")).distinct().withColumn("direction", F.lit(None).cast("string"))
    found = paging.in_menu(groups, spark.createDataFrame(MENUS, "label string, px int, py int"))
    return found.select("menu", "cat1", "cat2", F.col("menu_at.px").alias("menu_px"), F.col("cat1_at.px").alias("cat1_px"), F.col("cat2_at.px").alias("cat2_px"))


@query()
def brush_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes for the cells of each page, by height band."""
    cells = paging.paged(map_cells(spark, sf_dir)).withColumn("menu", F.when(F.col("z") > 12, "Ground 1").otherwise("Walls"))
    return paging.actions(paging.brushes(cells, ("page_x", "page_y", "menu")), ("menu", "brush", "x", "y"))


@query(f"""WITH {CELLS_SQL}, p AS (SELECT page_x, page_y, z > 12 AS high, x - CASE WHEN page_x < nx THEN w - (page_x + 1) * 24 ELSE 0 END AS px, y - CASE WHEN page_y < ny THEN page_y * 24 - (page_y + 1) * 2 ELSE h - 24 END AS py FROM paged)
SELECT page_x, page_y, high, min(px) AS xmin, min(py) AS ymin, max(px) AS xmax, max(py) AS ymax FROM p GROUP BY ALL""")
def group_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the low and the high cells of each page."""
    return paging.extents(paging.paged(map_cells(spark, sf_dir)).withColumn("high", F.col("z") > 12), ("page_x", "page_y", "high"))


@query("""SELECT p_partkey AS id, 'Road Tile ' || (p_size // 9 * 9 + p_size % 9 + 1) AS tile, 'Direction ' || (p_partkey % 4 + 1) AS direction,
CAST(p_size * 16 + 233 AS INTEGER) AS px, CAST(451 - (p_partkey % 24) * 16 AS INTEGER) AS py FROM part""")
def tile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tiles laid out nine in a row, of directions, and where on the screen a square is."""
    k, s = F.col("p_partkey"), F.col("p_size")
    at = labels.click(s, k % 24)
    return table(spark, sf_dir, "part").select(k.alias("id"), labels.numbered("Road Tile", F.floor(s / 9), s % 9, 9).alias("tile"), labels.direction_label(k % 4).alias("direction"), at["px"].alias("px"), at["py"].alias("py"))


# ---- networks ----

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    coords = F.array(g.point((k % 61) * 7.0, (k % 53) * 9.0 + 1.5), g.point(((k * 7) % 61) * 7.0 + 3.25, ((k * 11) % 53) * 9.0))
    return table(spark, sf_dir, "supplier").select(k.alias("line"), F.lit("road").alias("name"), coords.alias("coords"))


@query("""WITH s AS (SELECT s_suppkey AS line, (s_suppkey % 61) * 7.0 AS ax, (s_suppkey % 53) * 9.0 + 1.5 AS ay, ((s_suppkey * 7) % 61) * 7.0 + 3.25 AS bx, ((s_suppkey * 11) % 53) * 9.0 AS b_y FROM supplier),
p AS (SELECT a.line, (b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax) AS nt, (b.ax - a.ax) * (a.b_y - a.ay) - (b.ay - a.ay) * (a.bx - a.ax) AS nu, (a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax) AS d FROM s a JOIN s b ON a.line <> b.line
  WHERE least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.b_y) <= greatest(b.ay, b.b_y) AND least(b.ay, b.b_y) <= greatest(a.ay, a.b_y)),
q AS (SELECT DISTINCT line, nt / d AS t FROM p WHERE d <> 0 AND nt / d BETWEEN 0 AND 1 AND nu / d BETWEEN 0 AND 1)
SELECT line, count(*) AS n, round(sum(t), 4) AS sum_t FROM q GROUP BY line""")
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = network.crossings(network.segments(lines(spark, sf_dir)), 64.0)
    return met.groupBy("line").agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("sum_t"))


@query("""WITH s AS (SELECT s_suppkey AS line, (s_suppkey % 61) * 7.0 AS ax, (s_suppkey % 53) * 9.0 + 1.5 AS ay, ((s_suppkey * 7) % 61) * 7.0 + 3.25 AS bx, ((s_suppkey * 11) % 53) * 9.0 AS b_y FROM supplier),
p AS (SELECT a.line, (b.ax - a.ax) * (b.b_y - b.ay) - (b.ay - a.ay) * (b.bx - b.ax) AS nt, (b.ax - a.ax) * (a.b_y - a.ay) - (b.ay - a.ay) * (a.bx - a.ax) AS nu, (a.bx - a.ax) * (b.b_y - b.ay) - (a.b_y - a.ay) * (b.bx - b.ax) AS d FROM s a JOIN s b ON a.line <> b.line),
q AS (SELECT DISTINCT line, nt / d AS t, 1 AS cut FROM p WHERE d <> 0 AND nt / d BETWEEN 0 AND 1 AND nu / d BETWEEN 0 AND 1),
e AS (SELECT line, t, max(cut) AS cut FROM (SELECT * FROM q UNION ALL SELECT line, 0, 0 FROM s UNION ALL SELECT line, 1, 0 FROM s) GROUP BY line, t),
k AS (SELECT line, t, sum(cut) OVER w AS part, lead(t) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY line ORDER BY t))
SELECT k.line, CAST(part AS BIGINT) AS part, round(ax + t * (bx - ax), 4) AS x1, round(ay + t * (b_y - ay), 4) AS y1, round(ax + t2 * (bx - ax), 4) AS x2, round(ay + t2 * (b_y - ay), 4) AS y2, 2 AS points FROM k JOIN s USING (line) WHERE t2 IS NOT NULL""")
def line_noding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at their crossings: ends of the pieces, in order, and how many points they have."""
    cut = network.noded(lines(spark, sf_dir), 64.0)
    ends = [F.round(f"{p}.{c}", 4).alias(f"{c}{i}") for p, i in (("src", 1), ("dst", 2)) for c in "xy"]
    return cut.select("line", F.col("part").cast("long").alias("part"), *ends, F.size("points").alias("points"))


@query("WITH e AS (SELECT l_orderkey % 50 AS src, l_partkey % 50 AS dst FROM lineitem) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return network.degrees(li.select((F.col("l_orderkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst")))


@query(f"""WITH {ROWS_SQL}, path AS (SELECT DISTINCT xidx, yidx FROM rows_ WHERE priority = 2 AND z > 25), cells AS (SELECT CAST(i % 80 AS INTEGER) AS xidx, CAST(i // 80 AS INTEGER) AS yidx FROM range(80 * 60) t(i)),
taken AS (SELECT xidx, yidx FROM path UNION SELECT DISTINCT xidx, yidx FROM rows_ WHERE priority < 0)
SELECT xidx, yidx, (xidx, yidx) IN (SELECT (xidx, yidx) FROM path) AS on_path, (xidx, yidx) IN (SELECT (xidx, yidx) FROM taken) AS occupied FROM cells""")
def path_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a map: those on a path, and those occupied once the path is taken."""
    rows, cells = assignments(spark, sf_dir), grid.squares(spark, 80, 60).select("xidx", "yidx")
    path = rows.where("priority = 2 and z > 25")
    on_path = network.path_cells(cells, path).withColumn("on_path", F.lit(True))
    taken = network.occupied(rows.where("priority < 0"), path).withColumn("occupied", F.lit(True))
    both = cells.join(on_path, ["xidx", "yidx"], "left").join(taken, ["xidx", "yidx"], "left")
    return both.select("xidx", "yidx", F.coalesce("on_path", F.lit(False)).alias("on_path"), F.coalesce("occupied", F.lit(False)).alias("occupied"))


#: Cells along the edge of the map of networks.
NET_SIZE = 256


def net_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, name, coords: a line for each supplier, across the map in cell units."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    x, y = (k * 389) % (NET_SIZE - 32) + 16.3, (k * 631) % (NET_SIZE - 33) + 16.6
    bend = g.point(x + (n % 7) - 3.2, y + (n % 5) - 1.7)
    ends = g.point(x, y), g.point(x + (k * 13) % 29 - 14.1, y + (k * 17) % 31 - 15.4)
    return table(spark, sf_dir, "supplier").select(k.alias("line"), F.lit("road").alias("name"), F.array(ends[0], bend, ends[1]).alias("coords"), n.alias("rank"))


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, rank, line: the lines, cut where they meet."""
    lines = net_lines(spark, sf_dir)
    edges = network.noded(network.collected(lines, NET_SIZE, NET_SIZE).select("line", "name", "coords"), 32.0)
    each = number.numbered(edges, F.floor(F.col("line") / 1000), "line", "part", name="edge_id")
    return each.join(lines.select("line", "rank"), "line").select("edge_id", (F.col("rank") % 4).alias("rank"), F.col("points").alias("line"))


@query()
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a network of lines over the cells of a map, where some tile has the sides in use."""
    return routing.routed(path_edges(spark, sf_dir), (NET_SIZE, NET_SIZE), tiles=[t.ports for t in junction_tiles()])


def tile_set() -> list[tuple[int, float, dict[str, int]]]:
    """Straight and bent tiles with one or two port values, and ends."""
    names = ("u", "d", "l", "r")
    pairs = [{a: p, b: q} for i, a in enumerate(names) for b in names[i + 1 :] for p in (0, 1) for q in (0, 1)]
    ends = [{a: p} for a in names for p in (0, 1)]
    return [(i, 1.0 + 0.5 * sum(t.values()), t) for i, t in enumerate(pairs + ends)]


@query()
def tile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles along the routes, agreeing at every border."""
    return network.tile_paths(network.with_directions(network.several(path_search(spark, sf_dir))), tile_set())


def junction_tiles() -> list[tiling.Tile]:
    """Tiles with two, three and four open sides, of one or two port values each."""
    sides = [c for n in (2, 3, 4) for c in combinations("udlr", n)]
    ports = [dict(zip(c, p, strict=True)) for c in sides for p in product((0, 1), repeat=len(c))]
    return [tiling.Tile(i, 1.0 + 0.5 * sum(t.values()), t) for i, t in enumerate(ports)]


@query()
def network_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles along all routes, agreeing at borders and where routes meet; routes choose in order."""
    own = rounds.written(path_edges(spark, sf_dir), rounds.new_folder(spark, "edges"))
    path = network.several(routing.routed(own, (NET_SIZE, NET_SIZE), tiles=[t.ports for t in junction_tiles()]))
    return tiling.tiled(path.join(own.select("edge_id", "rank", F.lit(0).cast("long").alias("component")), "edge_id"), junction_tiles())


@query("""WITH needs AS (SELECT DISTINCT l_orderkey AS node, CASE l_linenumber % 4 WHEN 0 THEN 'u' WHEN 1 THEN 'd' WHEN 2 THEN 'l' ELSE 'r' END AS port FROM lineitem),
tiles AS (SELECT * FROM (VALUES (1, ['u','d']), (2, ['l','r']), (3, ['u','l','r']), (4, ['u','d','l','r']), (5, ['u']), (6, ['d']), (7, ['d','u'])) t(tile, ports)),
p AS (SELECT tile, len(ports) AS m, unnest(ports) AS port FROM tiles), c AS (SELECT node, count(*) AS n FROM needs GROUP BY node)
SELECT node, tile FROM needs JOIN p USING (port) JOIN c USING (node) GROUP BY node, tile, n, m HAVING count(*) = n AND m = n""")
def node_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 1 << 18)
    port = F.get(F.array(*[F.lit(x) for x in "udlr"]), F.col("l_linenumber") % 4)
    tiles = spark.createDataFrame([(1, ["u", "d"]), (2, ["l", "r"]), (3, ["u", "l", "r"]), (4, ["u", "d", "l", "r"]), (5, ["u"]), (6, ["d"]), (7, ["d", "u"])], "tile int, ports array<string>")
    return network.node_tiles(li.select(F.col("l_orderkey").alias("node"), port.alias("port")), tiles)


MOVES_SQL = "mv AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 3 AS x, event_id % 3 AS y, ts FROM events), st AS (SELECT user_id, event_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM mv WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"WITH {MOVES_SQL} SELECT user_id, event_id, CASE WHEN abs(dx) <= 1 AND abs(dy) <= 1 THEN CASE dx * 3 + dy WHEN 1 THEN 'u' WHEN -1 THEN 'd' WHEN 3 THEN 'r' WHEN -3 THEN 'l' WHEN 4 THEN 'ur' WHEN 2 THEN 'dr' WHEN -2 THEN 'ul' WHEN -4 THEN 'dl' END END AS direction FROM st")
def direction_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value").cast("long") % 3).alias("x"), (F.col("event_id") % 3).alias("y"), "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", labels.direction(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("direction"))


# ---- buildings ----


@query("WITH v AS (SELECT p_partkey AS id, p_size - 25.0 AS dx, p_partkey % 41 - 20.0 AS dy FROM part), a AS (SELECT *, atan2(dy, dx) - floor(atan2(dy, dx) / (pi() / 2)) * (pi() / 2) AS r FROM v) SELECT id, least(r, pi() / 2 - r) > pi() / 8 AS is_diagonal FROM a")
def orientation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), g.is_diagonal(F.col("p_size") - 25.0, k % 41 - 20.0).alias("is_diagonal"))


@query()
def building_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of parts, as cells, packed with tiles of three sizes."""
    p = table(spark, sf_dir, "part")
    size = F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int") + 1)
    deep = F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int") + 1)
    cells = p.withColumn("row", F.explode(size)).withColumn("col", F.explode(deep)).where("not (row = 0 and col = 0 and p_partkey % 5 = 0)")
    return packing.packed(cells.select(F.col("p_partkey").alias("building"), "row", "col"), [(1, 1), (2, 1), (2, 2)])


@query("""WITH r AS (SELECT p_partkey AS id, p_size - 25.0 AS ax, p_partkey % 41 - 20.0 AS ay, p_partkey % 13 - 6.0 AS bx, p_size % 11 - 5.0 AS b_y FROM part),
a AS (SELECT id, atan2(ay, ax) - floor(atan2(ay, ax) / (pi() / 2)) * (pi() / 2) AS t FROM r WHERE ax * b_y - ay * bx <> 0)
SELECT id, least(t, pi() / 2 - t) > pi() / 8 AS is_diagonal FROM a""")
def footprint_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines with an area, and whether they lie diagonally. They are parallelograms by two sides."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = (s - 25.0, k % 41 - 20.0), (k % 13 - 6.0, s % 11 - 5.0)
    ring = F.array(g.point(F.lit(0), F.lit(0)), g.point(*a), g.point(a[0] + b[0], a[1] + b[1]), g.point(*b))
    own = table(spark, sf_dir, "part").select(k.alias("id"), ring.alias("ring"))
    return packing.footprint(own, "ring").select("id", "is_diagonal")


@query("""WITH c AS (SELECT l_orderkey AS building, l_linenumber % 2 = 0 AS matches, l_quantity / 50 AS iou, l_partkey * 1000 + l_suppkey AS candidate FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY matches DESC, iou DESC, candidate) AS k FROM c) SELECT building, matches, iou, candidate FROM r WHERE k = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each building's candidates the one of its orientation with the largest overlap."""
    li = table(spark, sf_dir, "lineitem")
    return packing.best_candidate(li.select(F.col("l_orderkey").alias("building"), (F.col("l_linenumber") % 2 == 0).alias("matches"), (F.col("l_quantity") / 50).alias("iou"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("candidate")))


@query("""WITH e AS (SELECT p_partkey AS edge_id, [p_size * 1.7, p_size * 1.7 + 3, p_size * 1.7 + 3.5, p_partkey % 50 * 2.0] AS xs, [1.5, 1.5, 2.5, p_partkey % 31 * 1.0] AS ys FROM part),
p AS (SELECT edge_id, unnest(range(4)) AS i, CAST(floor(unnest(xs) / 8.0) AS INTEGER) AS x, CAST(floor(unnest(ys) / 8.0) AS INTEGER) AS y FROM e),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY edge_id ORDER BY i))
SELECT edge_id, i AS pos, x, y FROM l WHERE i = 0 OR x <> px OR y <> py""")
def snapped_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the vertices of lines, without repeats in a row; pos is the vertex."""
    k, s = F.col("p_partkey"), F.col("p_size")
    xy = ((s * 1.7, F.lit(1.5)), (s * 1.7 + 3, F.lit(1.5)), (s * 1.7 + 3.5, F.lit(2.5)), (k % 50 * 2.0, k % 31 * 1.0))
    own = table(spark, sf_dir, "part").select(k.alias("edge_id"), F.array(*[g.point(x, y) for x, y in xy]).alias("points"))
    cells = network.snapped(own, 8.0).select("edge_id", F.explode("cells").alias("c"))
    return cells.select("edge_id", F.col("c.pos").cast("long").alias("pos"), "c.x", "c.y")


CATALOGUE = [(2, 2, False, 1, 1.0, "Building 1"), (2, 2, False, 2, 0.5, "Building 2"), (2, 2, False, 3, 2.0, "Building 3"), (2, 1, False, 1, 1.0, "Building 4"), (2, 1, True, 2, 1.0, "Building 5")]


@query(f"""WITH b AS (SELECT p_partkey AS building, CAST(2 AS INTEGER) AS "rows", CAST(1 + p_size % 2 AS INTEGER) AS cols, p_partkey % 7 = 0 AS is_diagonal FROM part),
k AS (SELECT *, (3 + building * 7919) % 1000003 AS t FROM b WHERE NOT (cols = 2 AND is_diagonal))
SELECT building, CASE WHEN cols = 1 AND is_diagonal THEN 'Building 5' WHEN cols = 1 THEN 'Building 4' WHEN {U_SQL} * 8000 < 3000::BIGINT * 1000003 THEN 'Building 1' WHEN {U_SQL} * 8000 < 6000::BIGINT * 1000003 THEN 'Building 2' ELSE 'Building 3' END AS label FROM k""")
def building_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    placed = table(spark, sf_dir, "part").select(k.alias("building"), F.lit(2).alias("rows"), (1 + s % 2).cast("int").alias("cols"), (k % 7 == 0).alias("is_diagonal"))
    catalogue = spark.createDataFrame(CATALOGUE, "rows int, cols int, is_diagonal boolean, stories int, weight double, label string")
    return packing.chosen(placed, catalogue, "building", salt=3).select("building", "label")


@query("""WITH c AS (SELECT p_size % 3 + 1 AS width, p_size % 4 + 1 AS height, p_partkey % 2 = 0 AS is_diagonal, p_partkey % 5 = 0 AS is_modular FROM part)
SELECT is_diagonal, width, height, bool_or(is_modular) AS is_modular FROM c GROUP BY 1, 2, 3""")
def catalogue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.sizes(catalogue(spark, sf_dir))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select((s % 3 + 1).alias("width"), (s % 4 + 1).alias("height"), (k % 2 == 0).alias("is_diagonal"), (k % 5 == 0).alias("is_modular"))


@query("WITH c AS (SELECT p_size % 3 + 1 AS width, p_size % 4 + 1 AS height, p_partkey % 2 = 0 AS is_diagonal FROM part) SELECT is_diagonal, max(width * height) * 1.5 AS area FROM c GROUP BY 1")
def largest_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.largest_footprint(catalogue(spark, sf_dir), 1.5)


@query(f"""WITH {ROWS_SQL}, layer AS (SELECT CAST(i % 64 AS INTEGER) AS xidx, CAST(i // 64 AS INTEGER) AS yidx, -999 AS priority, 'default_ground' AS name, 'Ground' AS menu FROM range(64 * 64) t(i)),
every AS (SELECT xidx, yidx, priority, name, menu FROM rows_ UNION SELECT * FROM layer),
n AS (SELECT *, count(*) OVER c AS n, min(CASE WHEN priority > 0 THEN priority END) OVER c AS low FROM every WINDOW c AS (PARTITION BY xidx, yidx))
SELECT name, priority, count(*) AS n FROM n WHERE NOT (n > 1 AND coalesce(priority = -999 OR (low IS NOT NULL AND (priority > low OR priority < 0)), false)) GROUP BY 1, 2""")
def default_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = catalogues.default_layer(spark, "default_ground", 64, 64, {"menu": "Ground"}).select("xidx", "yidx", "priority", "name", "menu")
    rows = assignments(spark, sf_dir).select("xidx", "yidx", "priority", "name", "menu").union(layer).withColumn("z", F.lit(None).cast("double"))
    return resolve.dominant(resolve.valid(rows)).groupBy("name", "priority").agg(F.count("*").alias("n"))


HOUSES = [("Modular", "Block", 0, r, c, d, 2, 1.0, w, h, True) for d in (False, True) for r, (w, h) in enumerate(((1, 1), (2, 1), (1, 2), (2, 2))) for c in (0, 1)]
HOUSES += [("Houses", "House", 1, r, 0, d, s, 2.0, w, h, False) for d in (False, True) for s in (1, 3) for r, (w, h) in enumerate(((2, 2), (3, 2), (2, 3)))]


@query()
def building_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of a catalogue on outlines of all parts, each on what those before it have left free.
    Every fifth one has another outline beside it."""
    k, s = F.col("p_partkey"), F.col("p_size")

    def ring(x, y):
        w, h = s % 5 * 3 + 6.3, k % 4 * 3 + 5.1
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        return F.array(*[g.rotated(g.point(a, b), k % 8 * 11.25, x, y) for a, b in corners])

    x, y = k % 499 * 9.0 + 20, k % 487 * 11.0 + 20
    rings = F.when(k % 5 == 0, F.array(ring(x, y), ring(x + 17, y + 4))).otherwise(F.array(ring(x, y)))
    own = outlines.parts(table(spark, sf_dir, "part").select(k.alias("idx"), (s % 2 + 1).alias("priority"), rings.alias("rings")), "rings", "idx")
    columns = "menu string, cat1 string, direction int, row int, col int, is_diagonal boolean, stories int, weight double, width int, height int, is_modular boolean"
    catalogue = spark.createDataFrame(HOUSES, columns)
    return outlines.drawn(outlines.placed(own, catalogue, (570, 680)), catalogue, "Building", 4)


MAP_X, MAP_Y = 64, 40


@query(f"""WITH {FEATURES_SQL}, {RECT_SQL}, o AS (SELECT m.*, CASE name WHEN 'plain' THEN 0 WHEN 'brand' THEN 1 WHEN 'typed' THEN 2 WHEN 'banned' THEN 3 ELSE 4 END AS ord FROM m),
x AS (SELECT o.*, row_number() OVER (ORDER BY CAST(id AS BIGINT), ord) - 1 AS idx FROM o),
t AS (SELECT *, (7 + (idx % 1000003) * 7919) % 1000003 AS t FROM x),
y AS (SELECT id, name, priority, CASE name WHEN 'plain' THEN 'Ground 1' WHEN 'brand' THEN 'Foliage' ELSE 'Fence' END AS menu, CASE name WHEN 'plain' THEN CASE WHEN band = '1' THEN 'Grass' ELSE 'Dirt' END WHEN 'brand' THEN 'Bush' ELSE 'Stone' END AS cat1,
  CASE WHEN name = 'plain' AND band = '0' THEN 1 ELSE 0 END AS r FROM t WHERE name IN ('plain', 'banned') OR (name = 'brand' AND {U_SQL.replace("t", "t.t")} * 3000 < 2000::BIGINT * 1000003)),
every AS (SELECT c.xidx, c.yidx, y.* FROM y JOIN cells c ON CAST(y.id AS BIGINT) = c.id WHERE c.xidx BETWEEN 0 AND {{MAP_X}} - 1 AND c.yidx BETWEEN 0 AND {{MAP_Y}} - 1
  UNION ALL SELECT CAST(i % {{MAP_X}} AS INTEGER), CAST(i // {{MAP_X}} AS INTEGER), NULL, 'default_ground', -999, 'Ground 1', 'Grass', NULL FROM range({{MAP_X}} * {{MAP_Y}}) s(i)),
n AS (SELECT *, count(*) OVER c AS n, min(CASE WHEN priority > 0 THEN priority END) OVER c AS low FROM every WINDOW c AS (PARTITION BY xidx, yidx)),
dom AS (SELECT * FROM n WHERE NOT (n > 1 AND coalesce(priority = -999 OR (low IS NOT NULL AND (priority > low OR priority < 0)), false))),
k AS (SELECT *, row_number() OVER (PARTITION BY xidx, yidx, priority, name, r IS NULL ORDER BY r, id, cat1) AS k FROM dom)
SELECT CAST(xidx AS DOUBLE) AS x, CAST(yidx AS DOUBLE) AS y, menu, cat1, coalesce(id, '-1') AS id, name, priority FROM k WHERE r IS NULL OR k = 1 UNION ALL SELECT {{MAP_X}} - 1, {{MAP_Y}} - 1, '-1', '-1', '-1', '-1', -1""".replace("{MAP_X}", "64").replace("{MAP_Y}", "40"))
def map_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole map: features matched, numbered, assigned in their stages, resolved over a background, and
    written as a table."""
    shaped = tagged(spark, sf_dir).join(rectangles(spark, sf_dir).withColumn("id", F.col("id").cast("string")), "id")
    rows = maps.build(shaped, readers.rule_table(spark, CONFIG), F.col("id").cast("long"), (MAP_X, MAP_Y), {"menu": "Ground 1", "cat1": "Grass"}, salt=7)
    doubles = rows.withColumns({"xidx": F.col("xidx").cast("double"), "yidx": F.col("yidx").cast("double")})
    return sinks.map_table(doubles, (0, 0, MAP_X - 1, MAP_Y - 1)).select("x", "y", "menu", "cat1", "id", "name", "priority")


@query("WITH d AS (SELECT s_suppkey AS id, 4 * (s_suppkey % 9) + 2 AS qx, 4 * (s_suppkey % 7) AS qy FROM supplier) SELECT id, CAST((qx - 2 + qy) // 4 AS INTEGER) AS r, CAST((qx - 2 - qy) / 4 AS INTEGER) AS c FROM d")
def diagonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r, c = catalogues.row_col(4 * (k % 9) + 2, 4 * (k % 7), F.lit(2), F.lit(0), True)
    return table(spark, sf_dir, "supplier").select(k.alias("id"), r.alias("r"), c.alias("c"))
