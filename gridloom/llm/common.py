"""What the operators of this subpackage share: the shared folder, code shipping, ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the contracts define it, for Java's and Python's regex alike.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()
_scratch: list[str] = []
_tables: dict[str, Any] = {}
#: Bytes of an Arrow batch between Spark and Python; it may hold one long text more.
ARROW_BYTES = "8m"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers on other
    machines can import it whatever the driver's working directory is; and keep Arrow batches small,
    as they hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="gridloom-")
    target = os.path.join(folder, "gridloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def worker_tables(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: the tables of one operator. Another operator's are
    let go first, as workers are used again and an executor's memory is for all of them."""
    if name not in _tables:
        _tables.clear()
        gc.collect()
        _tables[name] = make()
    return _tables[name]


def settled(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """run, an Arrow function of a task, and then its freed memory given back to the system: workers
    outlive their tasks, and what they hold on to is missing elsewhere."""

    @wraps(run)
    def both(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return both


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all
    runs on one machine, as in tests, a temporary one, removed at exit; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gridloom-shared-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def unique(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path. It stays until sweep() or swept_scratch() deletes it, as results read it."""
    path = f"{shared_folder(spark)}/gridloom/{unique(name)}"
    _scratch.append(path)
    return path


@contextlib.contextmanager
def swept_scratch(spark: SparkSession, before: list[str]) -> Iterator[None]:
    """Delete the folders in before, then list there those that are made inside, and no others."""
    while before:
        remove(spark, before.pop())
    release(spark)
    first = len(_scratch)
    try:
        yield
    finally:
        before += _scratch[first:]
        del _scratch[first:]


def sweep(spark: SparkSession) -> None:
    """Delete all scratch folders so far. Only for callers who have written whatever read them."""
    while _scratch:
        remove(spark, _scratch.pop())
    release(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Unlike a local
    checkpoint, the rows outlive any executor."""
    spark = session(df)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like stored(), and the folder, for remove() once nothing reads it any more."""
    spark = session(df)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null text counts 0. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Rows of a sample that are broadcast at most: some 24 bytes each.
BROADCAST = 50_000


def least_hashed(rows: DataFrame, groups: list[str], most: int) -> DataFrame:
    """The distinct rows (groups and h, a hash) with the most least h of each group. Only rows below
    a threshold, at which a group has four times as many as are wanted, are ranked, so no
    group is ranked as a whole, however large it or one of its rows is."""
    counts = rows.groupBy(*groups).agg(F.approx_count_distinct("h", 0.03).alias("distinct"))
    counts = stored(counts, "sample-counts")
    share = F.least(F.lit(1.0), F.lit(4.0 * most) / F.greatest("distinct", F.lit(1)))
    low = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    # h as a number from 0 to 1
    near = rows.join(low, groups).where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share).select(*groups, "h").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy("h"))).where(F.col("r") <= most).drop("r")
    ranked = stored(ranked, "sample")
    return F.broadcast(ranked) if ranked.count() <= BROADCAST else ranked
