"""A session with the settings this engine is designed for."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "gridloom", **settings: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow for grouped functions; settings override."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | settings
    return SparkSession.builder.master(master).appName(app).config(map=own).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, for tables that cut a long lineage. Where it is unset, a
    temporary one if all runs on this machine, which is removed at exit; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gridloom-shared-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
