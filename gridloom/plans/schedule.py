"""The stage registry: which operators a rule's processes run, and in which order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stages of each process, and whether a stage runs by element or by rule.
PROCESSES = {
    "type_from_tag": ((0, "type_from_tag", "element"),),
    "type_random_individual": ((0, "type_random_individual", "element"),),
    "type_random_area": ((0, "type_random_area", "element"),),
    "type_random_clusters": ((0, "type_random_clusters", "element"),),
    "single_object_random": ((0, "single_object_random", "element"),),
    "type_from_linear": ((6, "type_from_linear", "element"),),
    "road_tiles": ((0, "collect_lines", "element"), (1, "node_lines", "rule"), (2, "search_paths", "rule"), (3, "road_tiles", "rule")),
    "rail_tiles": ((0, "collect_lines", "element"), (1, "node_lines", "rule"), (2, "search_paths", "rule"), (3, "rail_tiles", "rule")),
    "stream_tiles": ((0, "collect_lines", "element"), (1, "node_lines", "rule"), (2, "search_paths", "rule"), (3, "stream_tiles", "rule")),
    "fence_tiles": ((0, "collect_lines", "element"), (1, "node_lines", "rule"), (4, "search_paths", "rule"), (5, "fence_tiles", "rule")),
    "type_from_residential_building_outline": ((0, "collect_outlines", "element"), (1, "residential_buildings", "rule")),
    "type_from_church_outline": ((0, "collect_outlines", "element"), (1, "churches", "rule")),
    "type_from_barn_outline": ((0, "collect_outlines", "element"), (1, "barns", "rule")),
}

Operator = Callable[[DataFrame, DataFrame], DataFrame]


def schedule(rules: DataFrame) -> DataFrame:
    """priority, stage, operator, mode, rules (names in order): one row per step, in running order."""
    spark = rules.sparkSession
    table = spark.createDataFrame([(p, s, o, m) for p, xs in PROCESSES.items() for s, o, m in xs], "process string, stage int, operator string, mode string")
    each = rules.where(F.coalesce("active", F.lit(True))).select("name", "ord", "priority", F.explode("process").alias("process"))
    steps = each.join(table, "process").groupBy("priority", "stage", "operator", "mode").agg(F.sort_array(F.collect_set(F.struct("ord", "name"))).alias("own"))
    return steps.select("priority", "stage", "operator", "mode", F.transform("own", lambda o: o["name"]).alias("rules"), F.get("own", 0)["ord"].alias("first")).orderBy("priority", "stage", "first", "operator")


def run(rules: DataFrame, elements: DataFrame, operators: dict[str, Operator], state: DataFrame) -> DataFrame:
    """Runs the steps in order: each operator gets the elements of its rules and what has been
    assigned so far, and returns rows to append. The schedule is as small as the rule table, so the
    driver walks it; the DataFrames stay lazy."""
    for step in schedule(rules).collect():
        if step["operator"] in operators:
            own = elements.where(F.col("name").isin(step["rules"]))
            state = state.unionByName(operators[step["operator"]](own, state), allowMissingColumns=True)
    return state
