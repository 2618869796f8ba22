"""Suffix-array dedup: longest-previous-factor arrays over groups that hold all copies of a string.

A string of `length` bytes that occurs twice is sought over all documents. Every window of that many
bytes has an anchor, the least hashed SEED-gram in it, leftmost on ties: equal windows have equal
anchors at equal offsets. Neighbouring windows with one anchor form a segment, and segments meet by
anchor, so groups are small and the work is spread. Then, in order:

1. Segments are known by a digest of 128 bits. One that occurs twice repeats as a whole; an anchor with
   a single digest repeats nowhere else. Neither needs the texts again.
2. A group of distinct segments that is too large for one array (SORTED bytes) is split. Its windows
   are dealt by the anchor's offset into ranges of half the width: all windows of a range share the
   bytes around the anchor that each of them holds, their core, so pieces meet by core. Pieces that
   became equal become one; those whose core is alone repeat nowhere; what is still too large is split
   again. A range of one offset has whole windows as cores, so this ends, after at most nine rounds, and
   each round lists a piece of a segment at most twice. It holds at any size of a group.
3. The pieces of a group are put together in order of first occurrence. Their windows are sorted as
   suffixes, by prefix doubling over the bytes themselves; common prefixes of neighbours are read off
   the ranks of the doublings. A window's longest previous factor is its longer common prefix with the
   two nearest entries of the suffix array that lie before it in the text (previous and next smaller
   positions), the longest next factor likewise with those after it. Where the first reaches `length` the
   window is a later copy, where the second does, it has one.

covered() returns, per document, what is to be removed: with keep_first only later copies, so the
first stays; else all copies.

Cases: null and empty texts have no windows; texts are compared as UTF-8 bytes, so characters can be
cut; matches never cross documents. Rows that repeat an id and text are copies of each other; with
keep_first they are one document, as nothing says which is the first, and stay or go alike. Null ids
are one id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import release, session, settled, ship, stored, worker_tables

LENGTH = 400
SEED = 32
BATCH = 1 << 20
#: Bytes of segments that are sorted in one array, about.
SORTED = 1 << 20
#: Bytes that the first ranks of suffixes compare.
WORD = 8
_BASE = 0xA0761D6478BD642F
_M = np.uint64(0xBF58476D1CE4E5B9)


class Rolling:
    """Hashes of all substrings of one length, by a running polynomial modulo 2**64. They only choose
    anchors: substrings that are equal have equal ones, and nothing is concluded from equal hashes."""

    def __init__(self, seed: int = 21):
        self.value = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, n: int) -> np.ndarray:
        """One hash for each position with n bytes from it on."""
        if len(data) < n:
            return np.zeros(0, np.uint64)
        if len(self.up) <= len(data):
            size = max(len(data) + 1, 2 * BATCH)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=total[1:])
        h = (total[n:] - total[:-n]) * self.down[: len(data) - n + 1]
        h = (h ^ (h >> np.uint64(30))) * _M
        return h ^ (h >> np.uint64(31))


def rolling() -> Rolling:
    return worker_tables("lpf", Rolling)


def anchors(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of data the anchor's position; and the hashes of all seed-grams."""
    h = rolling().of(data, seed)
    width = length - seed + 1
    low = (h & ~np.uint64((1 << 28) - 1)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    return (low & np.uint64((1 << 28) - 1)).astype(np.int64), h


def segments(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and the anchor's offset in the first window, of
    every segment."""
    at, h = anchors(data, length, seed)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.diff(np.append(first, len(at))), h[at[first]].view(np.int64), at[first] - first


def halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def digested(data: bytes) -> tuple[int, int]:
    return halves(hashlib.blake2b(data, digest_size=16).digest())


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = F.col(f"`{text}`").cast("binary")
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(raw).alias("h"), raw.alias("text"))


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """doc, h, start, n, off, anchor, d0, d1: every segment of every document."""
    seed = min(SEED, max(1, length // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, hashes, column = b.column(0), b.column(1), b.column(2)
            rows: list[tuple[np.ndarray, ...]] = []
            of: list[int] = []
            d0: list[int] = []
            d1: list[int] = []
            for i in range(b.num_rows):
                t = column[i].as_py()
                if len(t) >= length:
                    first, n, anchor, off = segments(np.frombuffer(t, np.uint8), length, seed)
                    for s, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True):
                        x, y = digested(t[s:e])
                        d0.append(x), d1.append(y)
                    rows.append((first, n, off, anchor))
                    of += [i] * len(first)
                if len(of) >= 50_000 or (i + 1 == b.num_rows and of):
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [docs.take(pa.array(of)), hashes.take(pa.array(of)), *[pa.array(np.concatenate([r[c] for r in rows]), k) for c, k in enumerate(kinds)], pa.array(d0, pa.int64()), pa.array(d1, pa.int64())],
                        ["doc", "h", "start", "n", "off", "anchor", "d0", "d1"],
                    )
                    rows, of, d0, d1 = [], [], [], []

    return texts.where(F.octet_length("text") >= length).mapInArrow(settled(run), "doc bigint, h bigint, start int, n int, off int, anchor bigint, d0 bigint, d1 bigint")


class Suffixes:
    """The suffix array of the positions starts of data, ordered by their first length bytes, then by
    position, and the common prefixes of neighbours, length at most."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.ranks: list[tuple[int, np.ndarray]] = []  # ranks of all positions by their first bytes
        padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
        word = padded[: len(data)].astype(np.uint64)
        for k in range(1, WORD):
            word <<= np.uint64(8)
            word |= padded[k : len(data) + k]
        size = WORD
        rank = dense(word)
        while size < length:
            if size <= length:
                self.ranks.append((size, rank))
            step = min(size, length - size)
            pair = rank[: len(rank) - step].astype(np.int64)
            pair *= len(data) + 1
            pair += rank[step:]
            size += step
            rank = pair if size == length else dense(pair)
        last = rank[starts]
        self.array = np.lexsort((np.arange(len(starts)), last))
        self.position = starts[self.array]
        last = last[self.array]
        self.same = np.append(False, last[1:] == last[:-1])
        self.common = self._common(length)

    def _common(self, length: int) -> np.ndarray:
        """Of each entry and the one before it: by ever shorter steps over equal ranks, then bytes'."""
        out = np.zeros(len(self.array), np.int32)
        out[self.same] = length
        left = np.flatnonzero(~self.same[1:]) + 1
        a, b = self.position[left].copy(), self.position[left - 1].copy()
        done = np.zeros(len(left), np.int32)
        for size, rank in reversed(self.ranks):
            end = np.maximum(a, b) + done
            inside = np.flatnonzero((done + size < length) & (end < len(rank)))
            equal = inside[rank[a[inside] + done[inside]] == rank[b[inside] + done[inside]]]
            done[equal] += size
        out[left] = done  # to a multiple of WORD: only whether length is reached counts beyond that
        return out


def dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(x)
    y = x[order]
    step = np.empty(len(x), np.int32)
    step[:1] = 0
    np.not_equal(y[1:], y[:-1], out=step[1:])
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out


def nearest_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each entry of a suffix array the common prefix with the nearest entry above it whose position
    is smaller (0 without one), by jumping over entries whose own jump is known. common: of each entry
    and the one above it."""
    n = len(position)
    jump = np.arange(-1, n - 1)
    low = common.copy()
    low[:1] = 0
    left = np.arange(n)
    while len(left):
        left = left[jump[left] >= 0]
        left = left[position[jump[left]] > position[left]]
        over = jump[left]
        # all between an entry and its jump are larger than the entry: so are those past a larger jump
        new_low, new_jump = np.minimum(low[left], low[over]), jump[over]
        low[left], jump[left] = new_low, new_jump
    low[jump < 0] = 0
    return low


def factors(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous and the longest next factor of each of the starts."""
    above, below = suffixes.common, np.append(suffixes.common[1:], 0)
    out = []
    for p in (suffixes.position, -suffixes.position):
        longest = np.maximum(nearest_smaller(p, above), nearest_smaller(p[::-1], below[::-1])[::-1])
        of_start = np.empty(len(longest), np.int32)
        of_start[suffixes.array] = longest
        out.append(of_start)
    return out[0], out[1]


def runs(flags: np.ndarray, length: int) -> list[dict[str, int]]:
    """Bytes covered by the flagged windows, merged."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.append(True, np.diff(at) > length))
    last = np.append(new[1:], len(at)) - 1
    return [{"s": int(a), "e": int(b) + length} for a, b in zip(at[new], at[last], strict=True)]


#: A piece of a segment: its group, its digest, the segment it is of and where in it; the document and
#: byte of its first occurrence, by which pieces are ordered; windows, the anchor's offset, bytes.
PIECE = "grp bigint, d0 bigint, d1 bigint, r0 bigint, r1 bigint, rel int, doc bigint, start int, n int, off int, piece binary"
SPANS = "array<struct<s:int,e:int>>"


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PIECE.split(", ")])


def pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted segments (doc, h, start, n, off, anchor, d0, d1, reach, total) as pieces with their
    total, by a join with the texts."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("anchor", "d0", "d1", "start", "n", "off", "reach", "total")).alias("own"))
    both = texts.join(lists, ["doc", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                t, rows = t.as_py(), own.as_py()
                for low in range(0, len(rows), 4096):
                    part = rows[low : low + 4096]
                    got = piece_batch([(r["anchor"], r["d0"], r["d1"], r["d0"], r["d1"], 0, doc, r["start"], r["n"], r["off"], t[r["start"] : r["start"] + r["reach"]]) for r in part])
                    yield got.append_column("total", pa.array([r["total"] for r in part], pa.int64()))

    return both.select("doc", "text", "own").mapInArrow(settled(run), f"{PIECE}, total bigint")


def split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of the pieces: windows by ranges of the anchor's offset, each with its core's digest as
    its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                piece, off, n = r["piece"], r["off"], r["n"]
                lowest = off - n + 1  # the anchor's offset in the last window
                for k in range(lowest // width, off // width + 1):
                    # windows whose offset is in k * width to (k + 1) * width - 1
                    a, z = max(0, off - ((k + 1) * width - 1)), min(n - 1, off - k * width)
                    begin, end = off - k * width, off - ((k + 1) * width - 1) + length
                    core = piece[max(begin, 0) : end] if end <= len(piece) else piece[max(begin, 0) :]
                    group = digested(f"{r['grp']}:{width}:{k}:".encode() + core)[0]
                    part = piece[a : z + length]
                    out.append((group, *digested(part), r["r0"], r["r1"], r["rel"] + a, r["doc"], r["start"] + a, z - a + 1, off - a, part))
            if out:
                yield piece_batch(out)

    return rows.mapInArrow(settled(run), PIECE)


def sorted_groups(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """r0, r1, spans: bytes of the segment that windows cover which have a previous occurrence in
    another piece of their group; without keep_first, a next one counts as well."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def solve(own: list[tuple]) -> pa.RecordBatch:
        # windows never cross pieces, as only those inside one are starts
        data = np.frombuffer(b"".join(r[4] for r in own), np.uint8)
        size = np.array([len(r[4]) for r in own])
        base, n = np.cumsum(size) - size, np.array([r[3] for r in own])
        starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
        previous, following = factors(Suffixes(data, starts, length))
        flags = previous >= length if keep_first else (previous >= length) | (following >= length)
        spans = [[{"s": x["s"] + r[2], "e": x["e"] + r[2]} for x in runs(f, length)] for r, f in zip(own, np.split(flags, np.cumsum(n)[:-1]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.int64()), pa.array(spans, kind)], ["r0", "r1", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        size, last, before = 0, None, None
        for b in batches:
            for grp, d0, d1, doc, start, r0, r1, rel, n, piece in zip(*[b.column(c).to_pylist() for c in range(10)], strict=True):
                if before == (grp, d0, d1):  # a row of the document that repeats: the same segment
                    continue
                before = (grp, d0, d1)
                if size >= SORTED and grp != last:  # only between groups
                    yield solve(own)
                    own, size = [], 0
                own.append((r0, r1, rel, n, piece))
                size += len(piece)
                last = grp
        if own:
            yield solve(own)

    dealt = rows.repartition("grp").sortWithinPartitions("grp", "doc", "start", "d0", "d1").select("grp", "d0", "d1", "doc", "start", "r0", "r1", "rel", "n", "piece")
    return dealt.mapInArrow(settled(run), f"r0 bigint, r1 bigint, spans {SPANS}").where(F.size("spans") > 0)


def inner(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """r0, r1, spans of all segments in rows (pieces with their groups' size, total): groups that fit
    an array are sorted, larger ones split until they do."""
    found = stored(sorted_groups(rows.where(F.col("total") <= SORTED).drop("total"), length, keep_first), "lpf-factors")
    large = rows.where(F.col("total") > SORTED).drop("total").dropDuplicates(["d0", "d1"])
    width = 1
    while width <= length:
        width *= 2
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("n") + length - 1).alias("e")))
    place = F.struct("doc", "start", "r0", "r1", "rel")
    while large.limit(1).count():
        width //= 2
        parts = stored(split(large, width, length), "lpf-parts")
        firsts = parts.groupBy("grp", "d0", "d1").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("piece").alias("piece"))
        firsts = stored(firsts, "lpf-firsts")
        # pieces that became equal repeat as a whole: all of them, or all but the first
        twice = firsts.where("copies > 1").select("grp", "d0", "d1", "first")
        again = parts.drop("piece").join(twice, ["grp", "d0", "d1"])
        if keep_first:
            again = again.where(place != F.col("first"))
        shifted = F.transform(whole, lambda x: F.struct((x["s"] + F.col("rel")).alias("s"), (x["e"] + F.col("rel")).alias("e")))
        found = found.union(stored(again.select("r0", "r1", shifted.alias("spans")), "lpf-factors"))
        groups = firsts.groupBy("grp").agg(F.count("*").alias("several"), F.sum(F.octet_length("piece")).alias("total")).where("several > 1").drop("several")
        left = firsts.join(groups, "grp").select("grp", "d0", "d1", "first.r0", "first.r1", "first.rel", "first.doc", "first.start", "n", "off", "piece", "total")
        left = stored(left, "lpf-left")
        found = found.union(stored(sorted_groups(left.where(F.col("total") <= SORTED).drop("total"), length, keep_first), "lpf-factors"))
        large = left.where(F.col("total") > SORTED).drop("total")
    return found


def merged(spans: DataFrame) -> DataFrame:
    """doc, h and spans, apart from each other and in order, of overlapping ones (start, end) in own."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column(2).to_pylist():
                one: list[dict[str, int]] = []
                for x in sorted(own, key=lambda x: x["start"]):
                    if one and x["start"] <= one[-1]["end"]:
                        one[-1]["end"] = max(one[-1]["end"], x["end"])
                    else:
                        one.append(dict(x))
                out.append(one)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["doc", "h", "spans"])

    return spans.mapInArrow(settled(run), "doc bigint, h bigint, spans array<struct<start:int,end:int>>")


def covered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """doc (id, -1 for null), h (hash of the content) and spans (start and end in bytes, apart from
    each other and in order), for documents with any."""
    spark = session(docs)
    ship(spark)
    texts = texts_of(docs, key, text)
    found = stored(occurrences(texts, length), "lpf-segments")
    digests = found.groupBy("anchor", "d0", "d1").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "start", "h", "n", "off")).alias("first"))
    digests = stored(digests, "lpf-digests")
    busy = digests.groupBy("anchor").agg(F.count("*").alias("several"), F.sum(F.col("first.n") + length - 1).alias("total")).where("several > 1").drop("several")
    alike = stored(digests.join(busy, "anchor").select("anchor", "d0", "d1", "total", "first.*", (F.col("first.n") + length - 1).alias("reach")), "lpf-anchors")
    release(spark)
    got = stored(pieces(texts, alike), "lpf-pieces")
    release(spark)
    within = inner(got, length, keep_first).groupBy("r0", "r1").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    within = stored(within.withColumnsRenamed({"r0": "d0", "r1": "d1"}), "lpf-spans")
    release(spark)
    told = digests.join(within, ["d0", "d1"], "left").select("anchor", "d0", "d1", "copies", "first", "spans").where("copies > 1 or size(spans) > 0")
    own = found.join(told, ["anchor", "d0", "d1"])
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("n") + length - 1).alias("e")))
    some = F.coalesce("spans", F.array().cast(SPANS))
    is_first = (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start")) & (F.col("first.h") == F.col("h"))
    inside = F.when(is_first, some).otherwise(whole) if keep_first else F.when(F.col("copies") > 1, whole).otherwise(some)
    spans = own.select("doc", "h", F.explode(F.transform(inside, lambda x: F.struct((x["s"] + F.col("start")).alias("start"), (x["e"] + F.col("start")).alias("end")))).alias("x"))
    return merged(spans.groupBy("doc", "h").agg(F.collect_set("x").alias("own")))


def cut_documents(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, own in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                t = t.as_py() or b""
                at, kept, digest = 0, len(t), hashlib.sha256()
                for x in own or []:
                    digest.update(t[at : x["start"]])
                    at, kept = x["end"], kept - (x["end"] - x["start"])
                digest.update(t[at:])
                for o, v in zip(out, (len(t), len(t) - kept, len(own or []), digest.hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(F.col(f"`{text}`").cast("binary")).alias("h"), F.col(f"`{text}`").cast("binary").alias("text"))
    joined = rows.join(spans, ["doc", "h"], "left").select("id", "text", "spans")
    return joined.mapInArrow(settled(run), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", key)
