"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Nearness is the inner product. Vectors get one more component that makes all norms equal, so the
largest inner product is the smallest angle. A rotation learned on a bounded sample (principal axes
and further bases of the same space, then alternating between signs and the rotation that fits them
best) turns them into codes of BITS bits. A code is split into substrings of PART bits, each indexed:
its distinct values, and the rows of each. For a radius, the pigeonhole principle says how far some
substring of a code within it may be from the query's: values that near are probed, and of their rows
all that are within the radius are retrieved. The radius is the least that holds SHARE of the true
neighbours of sample queries. What is retrieved is ranked by exact inner products of the original
vectors. Queries that find fewer than k search again with a wider radius, until they have k.

The sample has SAMPLE vectors at most, by a hash of their id; every vector is indexed. A block of
queries goes to the tasks that read the vectors; each builds its tables once for all of them.

Cases: null vectors, vectors of zeros, and those with null or non-finite components take no part;
equal scores go to the smaller id; rows that repeat an id are candidates each, but never of a query
with that id, which is one query, of the vector that comes first; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import session, settled, ship, stored
from gridloom.llm.vectors import matrix, query_blocks, query_set, usable

BITS, PART = 256, 64
SAMPLE, SAMPLE_QUERIES = 8192, 256
SHARE = 0.975
ROUNDS = 12
#: How much wider a radius gets for queries that found too few.
WIDER = 16
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


class Codes:
    """The learned rotation, the radius, and the norm that all vectors are brought to."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.norm = norm
        x = self.lifted(sample)
        d = x.shape[1]
        # principal axes, then, with more bits than components, more bases of the same space
        bases = [np.linalg.eigh(x.T @ x)[1][:, ::-1]]
        while sum(b.shape[1] for b in bases) < BITS:
            bases.append(np.linalg.qr(rng.normal(size=(d, d)))[0])
        axes = np.concatenate(bases, axis=1)[:, :BITS]
        v = x @ axes
        r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = axes @ r
        self.radius = self._radius(sample, k)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def of(self, x: np.ndarray, *, query: bool = False) -> np.ndarray:
        """Codes as substrings (n, BITS / PART); a query has nothing in the added component."""
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lifted(x)
        return np.packbits(x @ self.turn >= 0, axis=1).view(np.uint64)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        """Measured on a few of the sample as queries, by brute force over the sample."""
        q = sample[:SAMPLE_QUERIES]
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(sample) - 1))]
        bits = np.bitwise_count(self.of(q, query=True)[:, None] ^ self.of(sample)[near]).sum(axis=2)
        return int(np.quantile(bits, SHARE, method="higher")) if bits.size else BITS


class Tables:
    """Of every substring of the codes: its distinct values, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.values, self.rows, self.starts = [], [], []
        for c in codes.T:
            order = np.argsort(c, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(c[order]) != 0))
            self.values.append(c[order][new])
            self.rows.append(order)
            self.starts.append(np.append(new, len(c)))
        self.probed = self.found = 0

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code at most radius from code. If all of the first rest + 1 substrings differ by more
        than least and the others by least or more, the distance is above radius: so one doesn't."""
        least, rest = divmod(radius, len(code))
        seen = []
        for j, (values, rows, starts) in enumerate(zip(self.values, self.rows, self.starts, strict=True)):
            reach = least if j <= rest else least - 1
            near = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= reach) if reach >= 0 else []
            if len(near):
                size = starts[near + 1] - starts[near]
                seen.append(rows[np.repeat(starts[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        if not seen:
            return np.zeros(0, np.int64)
        some = np.unique(np.concatenate(seen))
        found = some[np.bitwise_count(self.codes[some] ^ code).sum(axis=1) <= radius]
        self.probed += len(some)
        self.found += len(found)
        return found


def best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id, the query's own id left out."""
    other = ids != query
    ids, scores = ids[other], scores[other]
    by = np.lexsort((ids, -scores))[:k]
    return ids[by], scores[by]


def searched(rows: DataFrame, codes: Codes, qids: np.ndarray, q: np.ndarray, radius: int, d: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of each task the k best that its tables retrieve for each query."""
    own = codes.of(q, query=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), d)
            tables = Tables(codes.of(x))
            got = []
            for query, vec, code in zip(qids.tolist(), q, own, strict=True):
                found = tables.within(code, radius)
                if len(found):
                    got.append((query, *best(query, ids[found], (x[found] * vec).sum(axis=1), k)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int64()), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(settled(run), "query_id bigint, vec_id bigint, score double")


def nearest(table: DataFrame, *, k: int, every: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id every divides, against all others."""
    spark = session(table)
    ship(spark)
    rows, n, d = usable(table, key, vector, zero=False)
    if not n:
        return spark.createDataFrame([], RESULT)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    norm = (rows.agg(F.max(square)).first()[0] or 0.0) ** 0.5
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("vec").collect()
    codes = Codes(np.array([r[0] for r in sample], np.float64), norm, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = []
    for qids, q in query_blocks(query_set(rows, every), d):
        radius = BITS if n <= 2 * k else codes.radius
        while True:
            local = searched(rows, codes, qids, q, radius, d, k)
            top = stored(local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
            full = top.where(F.col("rank") == k).select("query_id") if radius < BITS else top.select("query_id").distinct()
            found.append(top.join(full, "query_id", "left_semi"))
            if radius >= BITS:
                break
            few = ~np.isin(qids, full.toArrow()["query_id"].to_numpy())  # at most the block's queries
            if not few.any():
                break
            qids, q, radius = qids[few], q[few], min(BITS, radius + WIDER)
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)
