"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Two permutations, the second shifted circularly, give all coordinates of a signature. Documents with
the same words in the same order form a class, which its node stands for from then on: the smallest
id, and half the words' digest, as an id may repeat with other texts. Classes meet in bands of ROWS
coordinates, and in pairs of neighbouring bands, which only very similar sets share. In a bucket no
pairs are listed: the class that meets most others is compared with the rest. What exact Jaccard
similarity confirms, on sets of the words themselves, is contracted to components.

Buckets that still hold several components go on. A class outside the largest component of such a
bucket differs from its centre, so its rarest shingles are not those that the bucket has in common.
Sorted by rarity, two sets similar enough must share a shingle so early in both that what follows
can still add up to the similarity: the classes are joined on those shingles, and what meets across
components is compared. This is exact and needs no pairs of a group either. So every pair of classes
that shares a band is compared, known to be connected, or proven to be too different: nothing
is capped, and rows grow with the input.

At a similarity of 0.8 a pair shares none of BANDS bands of ROWS with probability 3e-6.

Cases: null and empty texts, and texts of white space only, have no shingles and are linked with
nothing; texts shorter than a shingle are one shingle; rows that repeat an id and its words are one
document, and rows that repeat an id with other words are documents each, linked by their own words
only; rows with a null id come back with a null component, as kept; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import release, session, settled, ship, stored, worker_tables
from gridloom.llm.components import components
from gridloom.llm.shingles import Circulant, WordHashes, alike, exact_shingles, mix, normal, shingle_sets

BANDS, ROWS = 42, 6
#: Texts handled together by a worker, in bytes.
BATCH = 1 << 20
NODE = "struct<doc:bigint,alt:bigint>"


def tools() -> tuple[WordHashes, Circulant]:
    """Tables of a Python worker."""
    return worker_tables("minhash", lambda: (WordHashes(), Circulant(BANDS * ROWS)))


def slices(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about BATCH bytes of text each."""
    low = size = 0
    texts: list[bytes] = []
    for i, t in enumerate(b.column(column)):
        t = t.as_py() or b""
        texts.append(t)
        size += len(t)
        if size >= BATCH:
            yield b.slice(low, i + 1 - low), texts
            low, size, texts = i + 1, 0, []
    if texts:
        yield b.slice(low), texts


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One number per band, then one per pair of neighbouring bands."""
    v = signature.astype(np.uint64).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return np.concatenate([h, mix(h[0::2] * np.uint64(3) + h[1::2])]).view(np.int64)


def halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc, h (hash of the text as it is), n (size of the set), d0 and d1 (digest of the words, null
    without words), bands."""
    ship(session(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, circulant = tools()
        for whole in batches:
            for part, texts in slices(whole, 2):
                texts = [normal(t) for t in texts]
                sets = shingle_sets(texts, width, words)
                d0, d1, bands = [], [], []
                for t, s in zip(texts, sets, strict=True):
                    if len(s):
                        x, y = halves(hashlib.blake2b(t, digest_size=16).digest())
                        d0.append(x), d1.append(y), bands.append(band_hashes(circulant.signature(s)))
                    else:
                        d0.append(None), d1.append(None), bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc", "h", "n", "d0", "d1", "bands"],
                )

    raw = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{key}`").cast("long"), F.xxhash64(raw), raw.cast("binary"))
    return source.mapInArrow(settled(run), "doc bigint, h bigint, n bigint, d0 bigint, d1 bigint, bands array<bigint>")


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node and words (normal text) of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, texts in slices(whole, 1):
                texts = [normal(t) for t in texts]
                alt = pa.array([halves(hashlib.blake2b(t, digest_size=16).digest())[0] for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), alt, pa.array(texts, pa.binary())], ["doc", "alt", "words"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text")).dropna()
    return source.mapInArrow(settled(run), "doc bigint, alt bigint, words binary").select(F.struct("doc", "alt").alias("node"), "words")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough, by the words themselves; texts has node and
    words. Pairs with one b come in a row, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for part in batches:
            good = []
            for i, (b, x, y) in enumerate(zip(part.column(1), part.column(2), part.column(3), strict=True)):
                if b != last:
                    last, own = b, exact_shingles(y.as_py().split(), width)
                if alike(exact_shingles(x.as_py().split(), width), own, percent):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("words").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(settled(run), f"a {NODE}, b {NODE}")


def members(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """doc, h, n, d0, d1, node (null without words or id) and root (null where nothing is linked):
    one row per row of docs."""
    sigs = stored(signatures(docs, key, text, width), "minhash-signatures")
    classes = sigs.where("d0 is not null and doc is not null").groupBy("d0", "d1").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.select("d0", "d1", F.struct("doc", F.col("d0").alias("alt")).alias("node"), "n", "bands"), "minhash-classes")
    met = classes.select("node", "n", F.explode("bands").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(met.join(full, "bucket"), "minhash-buckets")
    edges = links(docs, shared, key, text, width, percent)
    roots = components(edges)
    member = sigs.select("doc", "h", "n", "d0", "d1").join(classes.select("d0", "d1", "node"), ["d0", "d1"], "left")
    return member.join(roots, "node", "left")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    named = members(docs, key, text, width, percent)
    # a class that is linked with nothing is its own component; so is a document without shingles
    found = F.when(F.col("doc").isNotNull(), F.coalesce("root.doc", "node.doc", "doc"))
    return named.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc") == found, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: one of its first node's. Rows without an id stay, and of
    rows without words those that agree in id and text stay once. Of rows that agree in id and text the
    one stays whose other columns come first as JSON."""
    named = members(docs, key, text, width, percent).where("doc is not null")
    first = F.col("node").isNull() | ((F.col("doc") == F.col("node.doc")) & F.coalesce(F.col("root") == F.col("node"), F.lit(True)))
    kept = named.where(first).groupBy("doc", "d0", "d1").agg(F.min(F.struct("h")).alias("low"), F.collect_set("h").alias("all"), F.count("*").alias("rows"))
    # without words, texts differ in white space only, or are null: each of these is a document
    each = F.when(F.col("d0").isNull(), F.col("all")).otherwise(F.array("low.h"))
    kept = kept.select("doc", F.explode(each).alias("h"), F.col("rows") > 1)
    kept = stored(kept.toDF("__gridloom_doc", "__gridloom_h", "__gridloom_more"), "minhash-kept")
    own = docs.withColumn("__gridloom_own", F.xxhash64(F.col(f"`{text}`")))
    match = (F.col(f"`{key}`").cast("long") == F.col("__gridloom_doc")) & (F.col("__gridloom_own") == F.col("__gridloom_h"))
    stay = own.join(kept.where("not __gridloom_more").hint("shuffle_hash"), match, "left_semi")
    if kept.where("__gridloom_more").limit(1).count():
        rest = own.join(kept.where("__gridloom_more").hint("shuffle_hash"), match, "left_semi")
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
        one = rest.groupBy(F.col(f"`{key}`").alias("__gridloom_key"), "__gridloom_own").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), others).alias("__gridloom_row"))
        stay = stay.unionByName(one.select("__gridloom_row.*", "__gridloom_own"))
    return stay.drop("__gridloom_own").unionByName(docs.where(F.col(f"`{key}`").isNull()))


def links(docs: DataFrame, shared: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) of classes that connect all similar ones; shared: bucket, node, n, size."""
    busy = shared.select("node").distinct()
    texts = stored(words_of(docs, key, text).join(busy, "node", "left_semi").dropDuplicates(["node"]), "minhash-texts")
    score = stored(shared.groupBy("node").agg(F.sum("size").alias("score")), "minhash-scores")
    rows = shared.join(score, "node").select("bucket", "node", "n", F.col("node").alias("label"), "score")
    pairs = stored(stars(rows, percent), "minhash-pairs")
    good = stored(confirmed(pairs, texts, width, percent), "minhash-links")
    rest = stored(mixed(rows.drop("score"), components(good)), "minhash-mixed")
    release(session(docs))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(across(rest, texts, width, percent).join(done, ["a", "b"], "left_anti"), "minhash-pairs")
    return good.union(stored(confirmed(more, texts, width, percent), "minhash-links"))


def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their labels brought up to date."""
    labelled = rows.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("label"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return labelled.join(several, "bucket", "left_semi")


def compatible(n: str, m: str, percent: int):
    """Sets so different in size can't be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's rows with its pivot b, the one that meets most others. A pair
    that meets in several buckets has the same pivot in all of them, and is listed once."""
    best = rows.groupBy("bucket").agg(F.max(F.struct("score", "node", "n")).alias("q")).select("bucket", F.col("q.node").alias("pivot"), F.col("q.n").alias("pn"))
    met = rows.join(best, "bucket").where("node <> pivot").where(compatible("n", "pn", percent))
    return met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def shingles_of(texts: DataFrame, width: int) -> DataFrame:
    """node, n and shingle: every shingle of every text, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = tools()
        for whole in batches:
            for part, left in slices(whole, 1):
                sets = shingle_sets(left, width, words)
                sizes = np.array([len(x) for x in sets])
                nodes = part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["node", "n", "shingle"])

    return texts.select("node", "words").mapInArrow(settled(run), f"node {NODE}, n bigint, shingle bigint")


def across(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a < b) across components of rows that may be similar enough: they share a shingle at
    positions i and j, rarest first, with 1 + min(n - i, m - j) still enough for the similarity. Of
    two classes in a bucket one at least is outside its largest component; that one looks for the
    other."""
    groups = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    largest = groups.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"))
    nodes = rows.join(largest, "bucket").groupBy("node").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("main.label")).alias("outside"))
    nodes = stored(nodes, "minhash-rest")
    each = stored(shingles_of(texts.join(nodes.select("node"), "node", "left_semi"), width), "minhash-shingles")
    rarity = each.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    # shingles of one class only come first, and need no rank: how many there are is enough
    shared = each.join(rarity, "shingle")
    alone = shared.groupBy("node").agg(F.count("*").alias("common"))
    by_rarity = Window.partitionBy("node").orderBy("f", "shingle")
    ranked = shared.join(alone, "node").withColumn("i", F.row_number().over(by_rarity) + F.col("n") - F.col("common") - 1)
    early = ranked.where(F.col("i") * 100 <= F.col("n") * (100 - percent)).select("node", "n", "shingle", "i").join(nodes, "node")
    early = stored(early, "minhash-early")
    x = early.where("outside").select(F.col("node").alias("x"), F.col("n").alias("xn"), F.col("i").alias("xi"), F.col("label").alias("xl"), "shingle")
    y = early.select(F.col("node").alias("y"), F.col("n").alias("yn"), F.col("i").alias("yi"), F.col("label").alias("yl"), "shingle")
    reach = F.least(F.col("xn") - F.col("xi"), F.col("yn") - F.col("yi"))
    met = x.join(y, "shingle").where("x <> y and xl <> yl").where(compatible("xn", "yn", percent)).where(reach * (100 + percent) >= percent * (F.col("xn") + F.col("yn")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
