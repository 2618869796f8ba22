"""Vector compression by product codes, with codebooks from Yinyang Lloyd rounds on integers.

A vector's components become integers floor(scale * x), and its equal consecutive parts get the number
of the nearest entry of their codebook. Codebooks begin as the vectors with the smallest ids; each round
assigns all parts, then replaces every entry by the mean of its parts, rounded down.

A round doesn't compare a part with every entry. Entries are in groups; each part keeps an upper bound
of the distance to its own entry, and for each group a lower bound of the distance to its other
entries. Bounds drift by as much as entries moved. Where every lower bound stays above the upper one,
nothing changes. Else the own distance is computed, and then only groups whose bound is not above it
are scanned. Bounds are doubles with a margin; what decides is compared as integers, ties going to the
lower number.

Codes and bounds are rows of a table beside the vectors, which each round reads and writes anew in the
shared folder, so that no executor holds state; the table before is deleted. A task's sums ride on its
last row. Driver and tasks exchange codebooks and their sums only, of a size that is fixed by the parameters.

Cases: null vectors, empty ones, vectors with null or non-finite components and those not of the most
frequent dimension get no row; vectors of zeros do; null ids come last when codebooks begin; repeated
rows are rows each, and of rows that share an id the first by components comes first; with fewer
vectors than entries, codebooks have as many entries; entries that no part has stay; numbers so large that
a squared distance doesn't fit 64 bits are refused, and so is a dimension that the number of parts doesn't
divide; other columns are ignored; an empty table gives an empty result and empty codebooks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import remove, session, settled, ship, stored_at
from gridloom.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a group, about.
GROUP = 4
#: Bounds count as equal within this share, and this much.
MARGIN = 1e-9
#: Rows that are assigned at once.
BLOCK = 8192


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group number for each entry of a codebook: some rounds of clustering, from entries far apart."""
    k = len(entries)
    groups = max(1, -(-k // GROUP))
    x = entries.astype(float)
    seeds = [0]
    for _ in range(1, groups):
        seeds.append(int(((x[:, None] - x[seeds]) ** 2).sum(2).min(1).argmax()))
    middle = x[seeds]
    of = np.zeros(k, np.int64)
    for _ in range(5):
        of = ((x[:, None] - middle) ** 2).sum(2).argmin(1)
        middle = np.array([x[of == g].mean(0) if (of == g).any() else middle[g] for g in range(groups)])
    return of


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries), exactly."""
    d = x[:, None, :] - entries[None]
    return (d * d).sum(2)


class Part:
    """One part position: its codebook, how far entries moved in the last round, and their groups."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray, groups: np.ndarray):
        self.entries, self.moved = entries, moved
        self.groups = [np.flatnonzero(groups == g) for g in range(int(groups.max(initial=0)) + 1)]
        self.group_of = groups
        self.group_moved = np.array([moved[g].max(initial=0.0) for g in self.groups])

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and bounds of parts that have none yet: every entry is compared."""
        d = squared(x, self.entries)
        code = d.argmin(1)
        rows = np.arange(len(x))
        upper = np.sqrt(d[rows, code].astype(float))
        other = d.astype(float)
        other[rows, code] = np.inf
        lower = np.sqrt(np.stack([other[:, g].min(1, initial=np.inf) for g in self.groups], 1))
        return code, upper, lower

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes and bounds after entries moved, and how many distances that took."""
        code, upper, lower = code.copy(), upper + self.moved[code], lower - self.group_moved
        rows = np.flatnonzero(lower.min(1) <= upper * (1 + MARGIN) + MARGIN)
        if not len(rows):
            return code, upper, lower, 0
        own = x[rows] - self.entries[code[rows]]
        best = (own * own).sum(1)  # integers: of own entry, then of the best so far
        old_distance = np.sqrt(best.astype(float))
        upper[rows] = old_distance
        scan = lower[rows] <= (old_distance * (1 + MARGIN) + MARGIN)[:, None]
        old, new, count = code[rows], code[rows].copy(), len(rows)
        seen: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g, entries in enumerate(self.groups):
            at = np.flatnonzero(scan[:, g])
            if not len(at):
                continue
            d = squared(x[rows[at]], self.entries[entries])
            count += d.size
            k = d.argmin(1)  # entries are in order: ties go to the lower number
            least, number = d[np.arange(len(at)), k], entries[k]
            better = (least < best[at]) | ((least == best[at]) & (number < new[at]))
            best[at[better]], new[at[better]] = least[better], number[better]
            seen.append((g, at, d))
        # an old entry in a group that wasn't scanned is another one of its group now
        left = np.flatnonzero((new != old) & ~scan[np.arange(len(rows)), self.group_of[old]])
        g = self.group_of[old[left]]
        lower[rows[left], g] = np.minimum(lower[rows[left], g], old_distance[left])
        for g, at, d in seen:
            other = np.where(self.groups[g][None] == new[at][:, None], np.inf, d.astype(float))
            lower[rows[at], g] = np.sqrt(other.min(1))
        code[rows], upper[rows] = new, np.sqrt(best.astype(float))
        return code, upper, lower, count


def list_column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(rows.reshape(-1), kind))


def assigned(rows: DataFrame, parts: list[Part], d: int, scale: int) -> DataFrame:
    """rows with new codes and bounds (code, upper, lower) of their integers (v); the last row of each
    task has the sums of its parts: per part and entry their number and the sum of their components. rows
    that have vec in place of v are assigned for the first time."""
    fresh = "vec" in rows.columns
    kinds = dict(rows.dtypes)
    wide = d // len(parts)
    entries = max(len(p.entries) for p in parts)
    groups = [len(p.groups) for p in parts]

    def block(b: pa.RecordBatch, sums: np.ndarray) -> list[pa.Array]:
        x = np.floor(scale * matrix(b.column("vec"), d)).astype(np.int64) if fresh else b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        codes, uppers, lowers = [], [], []
        known = None if fresh else [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("code", "upper", "lower")]
        low = 0
        for i, p in enumerate(parts):
            own = np.ascontiguousarray(x[:, i * wide : (i + 1) * wide])
            if known is None:
                code, upper, lower = p.first(own)
            else:
                code, upper, lower, _ = p.again(own, known[0][:, i].astype(np.int64), known[1][:, i], known[2][:, low : low + groups[i]])
            low += groups[i]
            codes.append(code)
            uppers.append(upper)
            lowers.append(lower)
            np.add.at(sums[i, :, 0], code, 1)
            np.add.at(sums[i, :, 1:], code, own)
        return [b.column("key"), b.column("label"), list_column(x, pa.int64()), list_column(np.stack(codes, 1), pa.int32()), list_column(np.stack(uppers, 1), pa.float64()), list_column(np.concatenate(lowers, 1), pa.float64())]

    names = ["key", "label", "v", "code", "upper", "lower", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(parts), entries, 1 + wide), np.int64)
        held: list[pa.Array] | None = None
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                if held:
                    yield pa.RecordBatch.from_arrays([*held, pa.nulls(len(held[0]), pa.list_(pa.int64()))], names)
                held = block(whole.slice(low, BLOCK), sums)
        if held:
            own = pa.array([None] * (len(held[0]) - 1) + [sums.reshape(-1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*held, own], names)

    schema = f"key {kinds['key']}, label {kinds['label']}, v array<bigint>, code array<int>, upper array<double>, lower array<double>, sums array<bigint>"
    return rows.mapInArrow(settled(run), schema)


def compressed(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """key, label, code (numbers of entries, by part) and error (squared distance of the integers, summed
    over parts) of every vector that takes part; and the codebooks by part and entry."""
    spark = session(table)
    ship(spark)
    x = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0), F.lit(False))
    rows = table.where(good).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), x.alias("vec"))
    most = F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), most.alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return rows.select("key", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("bigint").alias("error")).withColumnsRenamed({"key": key}), [[] for _ in range(parts)]
    d = sizes["d"]
    if d % parts:
        raise ValueError(f"{d} components can't be cut into {parts} equal parts")
    if d * (2.0 * (scale * sizes["most"] + 1)) ** 2 >= 2.0**62:
        raise ValueError("components are too large for distances of 64 bits")
    rows = rows.where(F.size("vec") == d)
    begin = rows.select("key", "vec").orderBy(F.col("key").asc_nulls_last(), "vec").limit(entries).collect()
    wide = d // parts
    start = np.floor(scale * np.array([r["vec"] for r in begin], float)).astype(np.int64).reshape(-1, parts, wide)
    books = [np.ascontiguousarray(start[:, i]) for i in range(parts)]
    groups = [grouped(b) for b in books]
    moved = [np.zeros(len(b)) for b in books]
    state, before = rows, None
    for n in range(rounds + 1):
        own = [Part(b, m, g) for b, m, g in zip(books, moved, groups, strict=True)]
        state, path = stored_at(assigned(state, own, d, scale), f"codes-{n}")
        if before:
            remove(spark, before)
        before = path
        if n == rounds:
            break
        each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x"))
        total = each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        sums = np.zeros(parts * len(begin) * (1 + wide), object)
        for r in total:
            sums[r["at"]] = int(r["x"])
        sums = sums.reshape(parts, len(begin), 1 + wide)
        for i, b in enumerate(books):
            new = b.copy()
            for k in range(len(b)):
                if sums[i, k, 0]:
                    new[k] = [int(s) // int(sums[i, k, 0]) for s in sums[i, k, 1:]]
            moved[i] = np.sqrt(((new - b) ** 2).sum(1).astype(float))
            books[i] = new

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, wide)
            code = b.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            off = v - np.stack([books[i][code[:, i]] for i in range(parts)], 1) if b.num_rows else v
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), b.column("code"), pa.array((off * off).sum((1, 2)), pa.int64())], ["key", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    found = state.select("key", "label", "v", "code").mapInArrow(settled(errors), f"key {kinds['key']}, label {kinds['label']}, code array<int>, error bigint")
    return found.withColumnsRenamed({"key": key}), [b.tolist() for b in books]


def label_errors(found: DataFrame) -> DataFrame:
    """found with label_error, the sum of error over rows of the same label; nulls are one label."""
    total = found.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return found.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
