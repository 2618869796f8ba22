"""Features that arrive as a stream: matched and filled without state, resolved per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import grid, resolve, rules


def assignments(stream: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Cells of arriving features (with a ring) and the type that the first matching type of
    each rule gives, for the rules that rules.match() admits. Each row depends on one feature, so there is no
    state and no watermark."""
    active = rule_table.where(F.coalesce("active", F.lit(True))).withColumnRenamed("tags", "rule_tags").drop("id").withColumn("t", F.explode(F.array_distinct("rule_tags")))
    each = stream.withColumn("e", F.explode(F.map_entries("tags")))
    met = each.join(active, (F.col("e.key") == F.col("t.k")) & (F.col("e.value") == F.col("t.v")))
    # of a feature's tags that one rule names, the rule's first stands for all: no repeats, no state
    once = F.get(F.filter("rule_tags", lambda p: rules.has(F.col("tags"), p)), 0) == F.col("t")
    met = met.where(once & rules.allowed(F.col("tags"), F.col("id"))).drop("e", "t")
    kind = rules.first_type(F.col("tags"), F.col("cm_types"))
    typed = met.withColumn("kind", kind).where("kind is not null")
    cells = grid.fill(typed, "ring")
    return cells.select("xidx", "yidx", F.lit(None).cast("double").alias("z"), F.col("kind.menu").alias("menu"), F.col("kind.cat1").alias("cat1"), "name", "priority")


def maintain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps dominant assignments at path, a folder per batch; a batch resolves against the one before."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = batch.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        resolve.dominant(resolve.valid(batch)).write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:  # a batch that is run again needs the one before it, and none before that
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
