"""Matching features against an ordered rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.number import numbered


def has(tags: Column, pair: Column) -> Column:
    return F.coalesce(F.try_element_at(tags, pair["k"]) == pair["v"], F.lit(False))


def allowed(tags: Column, feature_id: Column) -> Column:
    """Conditions besides a first matching tag: no excluded tag, all required ones, id admitted."""
    nothing = F.array().cast("array<struct<k:string,v:string>>")
    excluded = F.exists(F.coalesce("exclude_tags", nothing), lambda p: has(tags, p))
    required = F.forall(F.coalesce("required_tags", nothing), lambda p: has(tags, p))
    banned = F.coalesce(F.array_contains("exclude_ids", feature_id), F.lit(False))
    listed = F.col("allowed_ids").isNull() | F.coalesce(F.array_contains("allowed_ids", feature_id), F.lit(False))
    return ~excluded & required & ~banned & listed


def match(features: DataFrame, rules: DataFrame) -> DataFrame:
    """features joined to all active rules that match: a tag in common, on which both sides are
    exploded and equi-joined, then the other conditions. The rule table is a configuration of some
    dozens of rows and is broadcast, so that features that are dealt by id stay so."""
    active = rules.where(F.coalesce("active", F.lit(True)))
    by_tag = active.withColumn("__t", F.explode("tags")).withColumns({"__k": F.col("__t.k"), "__v": F.col("__t.v")}).drop("__t", "tags")
    each = features.withColumn("__tag", F.explode(F.map_entries("tags"))).withColumns({"__k": F.col("__tag.key"), "__v": F.col("__tag.value")}).drop("__tag")
    met = each.join(F.broadcast(by_tag.withColumnRenamed("id", "__rule_id") if "id" in by_tag.columns else by_tag), ["__k", "__v"])
    return met.where(allowed(F.col("tags"), F.col("id"))).drop("__k", "__v").dropDuplicates(["id", "name"])


def unmatched(features: DataFrame, matched: DataFrame) -> DataFrame:
    return features.join(matched.select("id").hint("merge"), "id", "left_anti")


def unprocessed_tags(features: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct key and value of the features that no rule matches."""
    return unmatched(features, matched).select(F.explode(F.map_entries("tags")).alias("e")).select("e.key", "e.value").distinct()


def first_type(tags: Column, cm_types: Column) -> Column:
    """The first type, in the order of the rule, with any matching tag; null without one."""
    return F.get(F.filter(cm_types, lambda t: F.exists(F.coalesce(t["tags"], F.array().cast("array<struct<k:string,v:string>>")), lambda p: has(tags, p))), 0)


def indexed(matched: DataFrame, order: Column, chunk: int = 100_000) -> DataFrame:
    """matched with idx, the number of each element: by the place of its feature (order, a whole number
    that rises along the input), then by the order of the rules."""
    own = matched.withColumn("__at", order)
    return numbered(own, F.floor(F.col("__at") / chunk), "__at", "ord").drop("__at")
