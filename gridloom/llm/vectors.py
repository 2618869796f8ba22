"""What the searches over vectors share: which rows take part, and query sets in bounded blocks.

A block of queries travels to the tasks that read the vectors, so vectors are neither copied nor
shuffled for a search; a block has QUERY_BYTES at most, about, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

#: Bytes of the queries of a block, as doubles.
QUERY_BYTES = 1 << 23
#: Scores that are held at once by a task.
SCORES = 1 << 21


def usable(table: DataFrame, key: str, vector: str, *, zero: bool) -> tuple[DataFrame, int, int]:
    """id and vec (array of double) of the rows that take part, their number and their dimension.
    Left out are null ids, null vectors, vectors with null or non-finite components, empty ones,
    those not of the most frequent dimension and, unless zero, those of zeros only."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0), F.lit(False))
    if not zero:
        good = good & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("vec"), good.alias("good")).where("good and id is not null").drop("good")
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return rows, 0, 0
    return rows.where(F.size("vec") == sizes["d"]), sizes["n"], sizes["d"]


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of a list column of doubles; lists are dense and of length d."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def query_set(rows: DataFrame, every: int) -> DataFrame:
    """id and vec of the queries, one for each id that every divides: of rows that repeat an id the one
    whose vector comes first."""
    return stored(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec")), "search-queries")


def query_blocks(queries: DataFrame, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids (in order) and vectors of the queries, dealt by hash to blocks of a bounded size."""
    blocks = -(-queries.count() * d * 8 // QUERY_BYTES)
    for k in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        ids = own["id"].to_numpy()
        by = np.argsort(ids, kind="stable")
        if len(ids):
            yield ids[by], matrix(own["vec"], d)[by]


def others(qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) at which ids holds a query's own id; qids are in order."""
    at = np.minimum(np.searchsorted(qids, ids), len(qids) - 1)
    row = np.flatnonzero(qids[at] == ids)
    return at[row], row
