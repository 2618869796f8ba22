"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: the sum of one random number per byte, shifted left
once per byte of age, so it depends on the last WINDOW bytes only. Where it is small, and was not
in the few bytes before, a chunk ends. Chunks therefore move with their content: an insertion changes
the chunks it touches and no other. Gaps that grow too long are cut at a fixed distance from their
start. All of it is computed in numpy, by doubling instead of byte by byte.

Chunks are known by a digest of 128 bits. Of all occurrences of a digest the first one, in order of
(id, hash of the text, position), stays. Later ones count as removed where neighbouring ones add up to
RUN bytes: shorter repeats are common phrases. A repeated passage seldom begins and ends with a chunk;
so later chunks in shorter runs are compared with the first occurrence byte by byte, and up to RUN equal
bytes on either side of it count too. What then adds up to RUN bytes goes, and so does any
text, however short, that is covered as a whole. A passage without a whole chunk in it is not found. A
digest's first occurrence is found with a partial aggregation, stored and joined back by a join of two
plain exchanges, which adaptive execution splits: a passage in very many documents is no single
task. Of texts only the bytes around chunks are joined by digest.

Cases: null and empty texts have no chunks; texts in any script are cut at bytes; rows that repeat an
id and text count as one document, and rows that repeat an id with another text as documents each;
rows with a null id are never changed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import session, settled, ship, stored, worker_tables

WINDOW = 16
#: One byte in EVERY ends a chunk, if none of the APART bytes before it does.
EVERY, APART = 16, 12
LONGEST = 512
#: Bytes that neighbouring repeats must have together, unless they are a whole text.
RUN = 96
BATCH = 1 << 20


class Chunker:
    """Random tables, made once per worker."""

    def __init__(self, seed: int = 11):
        self.gear = np.random.default_rng(seed).integers(0, 1 << 16, 256).astype(np.uint16)

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Text number, first byte, length and digest of every chunk."""
        gap = bytes(WINDOW + APART)  # what each text is preceded by
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(x for t in texts for x in (gap, t))
        data = np.frombuffer(joined, np.uint8)
        first = np.cumsum(sizes + len(gap)) - sizes
        h = self.gear[data]
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint16(step)
            step *= 2
        hit = (h < (1 << 16) // EVERY).astype(np.int32)
        run = np.concatenate([np.zeros(APART + 1, np.int32), np.cumsum(hit, dtype=np.int32)])
        before = run[APART : APART + len(hit)] - run[: len(hit)]
        end = np.flatnonzero((hit == 1) & (before == 0)) + 1
        of = np.searchsorted(first, end - 1, side="right") - 1
        end = end[(of >= 0) & (end > first[of]) & (end < first[of] + sizes[of])]  # neither in a gap nor at the end of a text
        full = sizes > 0
        edge = np.unique(np.concatenate([first[full], end, (first + sizes)[full]]))
        begin, stop = edge[:-1], edge[1:]
        of = np.searchsorted(first, begin, side="right") - 1
        inside = (of >= 0) & (stop <= first[of] + sizes[of])
        begin, stop, of = begin[inside], stop[inside], of[inside]
        parts = -(-(stop - begin) // LONGEST)
        if len(parts) and parts.max() > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(begin, parts) + nth * LONGEST
            stop = np.minimum(np.repeat(stop, parts), begin + LONGEST)
            of = np.repeat(of, parts)
        digest = [hashlib.blake2b(joined[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
        return of, begin - first[of], stop - begin, digest


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, h (hash of the text) and raw (its bytes) of every row with an id and a text."""
    raw = F.col(f"`{text}`").cast("binary")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(raw).alias("h"), raw.alias("raw")).dropna()


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, h, pos, len, digest: a row per chunk of each document."""
    ship(session(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = worker_tables("cdc", Chunker)
        for b in batches:
            ids, hashes, column = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            low = 0
            while low < b.num_rows:
                texts, size, high = [], 0, low
                while high < b.num_rows and size < BATCH:
                    texts.append(column[high].as_py())
                    size += len(texts[-1])
                    high += 1
                of, pos, length, digest = chunker.chunks(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low + of], pa.int64()), pa.array(hashes[low + of], pa.int64()), pa.array(pos, pa.int32()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())], ["doc", "h", "pos", "len", "digest"])
                low = high

    return texts_of(docs, key, text).mapInArrow(settled(run), "doc bigint, h bigint, pos int, len int, digest binary")


def around(docs: DataFrame, rows: DataFrame, key: str, text: str, reach: int) -> DataFrame:
    """rows (doc, h, pos, len, digest) with the bytes of the chunk, up to reach bytes before and after
    it, and the size of the text. A text is joined once, to all rows of its document."""
    lists = rows.groupBy("doc", "h").agg(F.collect_set(F.struct("pos", "len", "digest")).alias("all"))
    each = texts_of(docs, key, text).join(lists, ["doc", "h"]).select("doc", "h", "raw", F.inline("all"))
    low, end = F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + F.col("len")
    parts = {"before": F.substring("raw", low + 1, F.col("pos") - low), "body": F.substring("raw", F.col("pos") + 1, F.col("len")), "after": F.substring("raw", end + 1, F.lit(reach))}
    return each.select("doc", "h", "pos", "len", "digest", *[c.alias(n) for n, c in parts.items()], F.octet_length("raw").alias("size"))


def in_common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def widened(here: DataFrame, there: DataFrame) -> DataFrame:
    """doc, h, start, end, size: chunks of here (as from around()) with the bytes on either side that
    their digest's first occurrence, in there, has too. In one document the two don't overlap."""
    first = there.select("digest", F.col("doc").alias("doc_2"), F.col("h").alias("h_2"), (F.col("pos") + F.col("len")).alias("end_2"), F.col("before").alias("before_2"), "body", F.col("after").alias("after_2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                left = in_common(r["before"][::-1], r["before_2"][::-1])
                right = in_common(r["after"], r["after_2"])
                if (r["doc"], r["h"]) == (r["doc_2"], r["h_2"]):
                    room = max(r["pos"] - r["end_2"], 0)
                    left = min(left, room)
                    right = min(right, room - left)
                out.append((r["doc"], r["h"], r["pos"] - left, r["pos"] + r["len"] + right, r["size"]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc", "h", "start", "end", "size"])

    met = here.join(first, ["digest", "body"]).select("doc", "h", "pos", "len", "size", "before", "after", "doc_2", "h_2", "end_2", "before_2", "after_2")
    return met.mapInArrow(settled(run), "doc bigint, h bigint, start int, end int, size int")


def repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """doc, h (hash of the text's bytes) and spans (start and end in bytes, in order) of what repeats an
    earlier passage."""
    chunks = chunked(docs, key, text)
    first = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "pos")).alias("first")).where("n > 1").drop("n")
    again = chunks.join(stored(first, "cdc-first"), "digest")
    marked = again.select("doc", "h", "pos", "len", "digest", (F.struct("doc", "h", "pos") > F.col("first")).alias("later"))
    marked = stored(marked, "cdc-chunks")
    by_pos, in_run = Window.partitionBy("doc", "h").orderBy("pos"), Window.partitionBy("doc", "h", "run")
    starts = marked.where("later").select("doc", "h", "pos", "len", "digest", (F.col("pos") + F.col("len")).alias("end"))
    starts = starts.withColumn("new", F.when(F.col("pos") > F.coalesce(F.lag("end").over(by_pos), F.lit(-1)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by_pos))
    sized = starts.withColumns({"start": F.min("pos").over(in_run), "stop": F.max("end").over(in_run)})
    enough = F.col("stop") - F.col("start") >= run
    long = sized.where(enough).select("doc", "h", "start", F.col("stop").alias("end"), F.lit(None).cast("int").alias("size")).distinct()
    short = sized.where(~enough).select("doc", "h", "pos", "len", "digest")
    source = marked.where("not later").join(short.select("digest").distinct(), "digest", "left_semi")
    wide = widened(around(docs, short, key, text, run), around(docs, source, key, text, run))
    by_start = Window.partitionBy("doc", "h").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    pieces = long.union(wide).withColumn("new", F.when(F.col("start") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0))
    pieces = pieces.withColumn("run", F.sum("new").over(by_start))
    runs = pieces.groupBy("doc", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("size").alias("size"))
    runs = runs.where((F.col("end") - F.col("start") >= run) | ((F.col("start") == 0) & (F.col("end") == F.col("size"))))
    return runs.groupBy("doc", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """docs without later copies of passages. Bytes of a character cut in two go with it."""
    found = repeated(docs, key=key, text=text, run=run).toDF("__gridloom_doc", "__gridloom_h", "__gridloom_spans")
    raw, spans = F.col(f"`{text}`").cast("binary"), F.col("__gridloom_spans")
    state = F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(spans, state, lambda s, x: F.struct(F.concat(s["out"], F.substring(raw, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")))
    rest = F.concat(cut["out"], F.substring(raw, cut["at"] + 1, F.octet_length(raw)))
    joined = docs.join(found.hint("shuffle_hash"), (F.col(f"`{key}`").cast("long") == F.col("__gridloom_doc")) & (F.xxhash64(raw) == F.col("__gridloom_h")), "left")
    clean = F.when(spans.isNull(), F.col(f"`{text}`")).otherwise(F.decode(rest, "UTF-8"))
    return joined.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
