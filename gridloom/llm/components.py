"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remove, session, stored_at

#: Far more than the logarithm of any path's length.
ROUNDS = 100


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root for every node of edges, root being the smallest node reachable.

    A round hooks the larger neighbours of every node, then its smaller ones, to the smallest node
    of its neighbourhood; the number of rounds grows with the logarithm of the longest path. All
    steps are joins and aggregations, so a node with very many neighbours is no single row or task.
    Each round is written to the shared folder; ROUNDS of them would do for any graph that can be stored,
    and more are an error. No edges give no rows."""
    spark = session(edges)
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    now, path = stored_at(now, "edges")
    mark = None
    for _ in range(ROUNDS):
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select("u", "v"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low2, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        new, new_path = stored_at(small, "edges")
        found = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        remove(spark, path)
        now, path = new, new_path
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components aren't settled after {ROUNDS} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
