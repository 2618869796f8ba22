"""Exact top-k search by vector approximation.

A VA-file, a table of its own beside the vectors, has one byte per component: the number of its cell
between the component's least and largest value. A search reads the cells only. They bound the score
of every vector from both sides, and what isn't among a query's best by the lower bounds may still be,
by its upper one, or is left aside. Exact vectors are then read in order of their upper bounds, first
as many as are wanted; then those whose bound is not below the least of their exact scores, after which
the result is certain. Only candidates are joined with exact vectors.

Scores are integer inner products of components floor(scale * x); ties go to the smaller id. Of
vectors that are equal only the first few ids can be among the best of any query, so a very frequent
vector is cut down to these before the search, exactly.

Cases: null vectors and vectors with null or non-finite components take no part; vectors of zeros
do; with fewer than k candidates all are returned; rows that repeat an id are candidates each, but
never of a query with that id, which is one query, of the vector that comes first; bounds of numbers
too large for exact doubles are widened by what rounding may cost and exact scores are Python
integers, ranked as such, and shown as the nearest 64-bit ones; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import session, settled, ship, stored
from gridloom.llm.vectors import SCORES, matrix, others, query_blocks, query_set, usable

CELLS = 256
#: Integers up to here are exact as doubles, and so are sums that stay below.
EXACT = 2.0**53
#: Components up to here have products that are finite; beyond, cells bound nothing.
LARGE = 2.0**400
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
#: A score as (beyond 64 bits: 1 or -1, then its digits in an order of strings; nearest 64-bit integer).
SCORE = "beyond int, digits string, score bigint"


def top_k(table: DataFrame, *, k: int, every: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id every divides, against all others."""
    spark = session(table)
    ship(spark)
    rows, n, d = usable(table, key, vector, zero=True)
    if not n:
        return spark.createDataFrame([], RESULT)
    queries = query_set(rows, every)
    vectors = distinct(rows, k)
    edges = Edges(vectors, d, scale)
    cells = stored(approximated(vectors, edges), "va-cells")
    found = [certain(candidates(cells, edges, qids, q, k), vectors, queries, k, scale) for qids, q in query_blocks(queries, d)]
    if not found:
        return spark.createDataFrame([], RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("digits"), F.desc("score"), "vec_id")
    each = reduce(DataFrame.union, found).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """id, vec, h (hash of vec) and copies: what can be among the k best of a query. Of equal vectors
    that is the first k + 1 ids, as one may be the query's own, and k rows of each at most."""
    each = rows.groupBy(F.xxhash64("vec").alias("h"), "vec", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    first = Window.partitionBy("h", "vec").orderBy("id")
    return stored(each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"), "va-vectors")


class Edges:
    """Of each component the lowest integer and the width of its cells, in integers."""

    def __init__(self, vectors: DataFrame, d: int, scale: int):
        self.d, self.scale = d, scale
        bounds = vectors.select(F.posexplode("vec")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()
        self.low = np.floor(scale * np.array([r["low"] for r in bounds]))
        high = np.floor(scale * np.array([r["high"] for r in bounds]))
        self.large = not (np.abs(self.low).max() < LARGE and np.abs(high).max() < LARGE)
        self.step = np.ones(d) if self.large else np.maximum(np.ceil((high - self.low + 1) / CELLS), 1)
        self.most = np.maximum(np.abs(self.low), np.abs(self.low + self.step * CELLS))

    def cells(self, x: np.ndarray) -> np.ndarray:
        if self.large:
            return np.zeros(x.shape, np.uint8)
        return np.clip(np.floor((np.floor(self.scale * x) - self.low) / self.step), 0, CELLS - 1).astype(np.uint8)

    def lowest(self, cells: np.ndarray) -> np.ndarray:
        """The smallest integers of the cells."""
        return self.low + self.step * cells

    def widths(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a score may be above and below the product with the cells' lowest integers."""
        if self.large:
            return np.full(len(q), np.inf), np.full(len(q), -np.inf)
        size = np.abs(q) @ self.most
        slack = np.where(size < EXACT / 4, 0.0, size * (self.d + 8) * 2.0**-50)
        # the division into cells rounds, too, once integers are beyond doubles' exact ones
        wide = self.step - 1 + np.where(self.most < EXACT / 4, 0.0, self.most * 2.0**-48)
        return np.maximum(q, 0) @ wide + np.maximum(-q, 0) @ (wide - self.step + 1) + slack, -(np.maximum(-q, 0) @ wide + np.maximum(q, 0) @ (wide - self.step + 1)) - slack


def approximated(vectors: DataFrame, edges: Edges) -> DataFrame:
    """id, h, copies and cell (a byte per component): the VA-file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = edges.cells(matrix(b.column(3), edges.d)).tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([cell[i : i + edges.d] for i in range(0, len(cell), edges.d)], pa.binary())], ["id", "h", "copies", "cell"])

    return vectors.select("id", "h", "copies", "vec").mapInArrow(settled(run), "id bigint, h bigint, copies int, cell binary")


def candidates(cells: DataFrame, edges: Edges, qids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, h, copies, upper, lower: of each task what may be among a query's k best."""
    with np.errstate(over="ignore"):
        own = np.floor(edges.scale * q)
    if edges.large:
        own = np.zeros_like(own)
    above, below = edges.widths(own)
    reach = above - below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(qids), -np.inf)  # each query's k-th best product so far
        kept: list[tuple[np.ndarray, ...]] = []

        def cut(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
            """Raise least to the k-th best of each query, and drop what is out of its reach."""
            i, *rest, base = (np.concatenate(c) for c in zip(*rows, strict=True))
            by = np.lexsort((-base, i))
            i, base, rest = i[by], base[by], [c[by] for c in rest]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            full = first[np.diff(np.append(first, len(i))) >= k]
            least[i[full]] = base[full + k - 1]
            good = base >= least[i] - reach[i]
            return [(i[good], *[c[good] for c in rest], base[good])]

        def columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            cell = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, edges.d)
            return b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), edges.lowest(cell).T

        for b in batches:
            if not b.num_rows:
                continue
            ids, h, copies, low = columns(b)
            step = max(1, SCORES // len(ids))
            for a in range(0, len(qids), step):
                base = own[a : a + step] @ low
                mine, row = others(qids[a : a + step], ids)
                base[mine, row] = -np.inf
                if len(ids) > k:  # what the batch alone makes certain
                    kth = np.partition(base, len(ids) - k, axis=1)[:, len(ids) - k]
                    least[a : a + step] = np.maximum(least[a : a + step], kth)
                i, j = np.nonzero((base >= (least[a : a + step] - reach[a : a + step])[:, None]) & (base > -np.inf))
                if len(i):
                    kept.append((i + a, ids[j], h[j], copies[j], base[i, j]))
            if sum(len(x[0]) for x in kept) > 4 * k * len(qids) + SCORES:
                kept = cut(kept)
        if kept:
            i, ids, h, copies, base = cut(kept)[0]
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(ids), pa.array(h), pa.array(copies), pa.array(base + above[i]), pa.array(base + below[i])], ["query_id", "vec_id", "h", "copies", "upper", "lower"])

    return cells.mapInArrow(settled(run), "query_id bigint, vec_id bigint, h bigint, copies int, upper double, lower double")


def certain(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, copies and exact scores of what is needed for each query's k best."""
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "h")
    ranked = found.withColumn("r", F.row_number().over(by_bound))
    # the k-th largest lower bound leaves aside what can't reach it; bounds have one width per query
    least = F.max(F.when(F.col("r") == k, F.col("lower"))).over(Window.partitionBy("query_id"))
    ranked = stored(ranked.withColumn("least", least).where("least is null or upper >= least").drop("least", "lower"), "va-candidates")
    first = stored(read(ranked.where(F.col("r") <= k), vectors, queries, scale), "va-first")
    # none that is left can pass the k exact scores unless its bound does; beyond 64 bits all are read
    sure = first.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("s"), F.max(F.abs("beyond")).alias("b"))
    enough = sure.where(F.col("m") >= k).where("b = 0").select("query_id", (F.col("s").cast("double") - F.abs("s").cast("double") * 2.0**-52).alias("s"))
    rest = ranked.where(F.col("r") > k).join(enough, "query_id", "left").where("s is null or upper >= s").drop("s")
    return first.union(read(rest, vectors, queries, scale))


def read(wanted: DataFrame, vectors: DataFrame, queries: DataFrame, scale: int) -> DataFrame:
    """query_id, vec_id, copies and SCORE of the wanted pairs, by their exact vectors."""
    exact = wanted.join(vectors.select(F.col("id").alias("vec_id"), "h", "vec"), ["vec_id", "h"]).join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("own")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = len(b.column(3)[0])
            scores = products(matrix(b.column(3), d), matrix(b.column(4), d), scale)
            shown = [shape(s) for s in scores]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array([x[i] for x in shown], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64()))]], ["query_id", "vec_id", "copies", "beyond", "digits", "score"])

    return exact.select("query_id", "vec_id", "copies", "vec", "own").mapInArrow(settled(run), f"query_id bigint, vec_id bigint, copies int, {SCORE}")


def products(x: np.ndarray, y: np.ndarray, scale: int) -> list[int]:
    """Integer inner products of the rows of x with those of y."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(scale * x), np.floor(scale * y)
        size = np.abs(a * b).sum(axis=1)
        total = (a * b).sum(axis=1)
    out = []
    for i, (s, t) in enumerate(zip(size.tolist(), total.tolist(), strict=True)):
        if s < EXACT:
            out.append(int(t))
        else:
            out.append(sum(whole(u, scale) * whole(v, scale) for u, v in zip(x[i].tolist(), y[i].tolist(), strict=True)))
    return out


def whole(v: float, scale: int) -> int:
    """floor(scale * v); doubles from EXACT on are integers, and don't overflow as such."""
    return int(v) * scale if abs(v) >= EXACT else math.floor(scale * v)


def shape(score: int) -> tuple[int, str, int]:
    """The fields of SCORE."""
    if -(2**63) <= score < 2**63:
        return 0, "", score
    text = str(abs(score))
    if score > 0:
        return 1, f"{len(text):05d}{text}", 2**63 - 1
    return -1, f"{99999 - len(text):05d}" + text.translate(str.maketrans("0123456789", "9876543210")), -(2**63)
