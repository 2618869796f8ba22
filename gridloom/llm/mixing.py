"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every source has a token target. Document rates that stay as close to 1 as possible in relative
entropy, meet the targets and never pass a cap are exponentially tilted: min(cap, exp(lambda * z)),
z being a document's size over its source's mean size. The multipliers maximise a concave dual; its
gradient and curvature are sums over the documents, taken by one aggregation per Newton step for all
sources together; a job takes several steps. A step that leaves the bracket known to hold the root is replaced by its midpoint.

The sums only depend on a histogram of (source, size), which is aggregated once, before any
iteration, so iterations don't touch documents. They are summed as decimals: order plays no part,
and reruns agree to the bit.

Rates are rounded to whole copies along documents in order of size: a document gets the whole
numbers that the running sum of rates passes. So a source's total is off by about one document at
most; of OFFSETS points to start the sum from, each source takes the one that comes nearest. Documents of one source and size are interchangeable; large groups of them are split by a hash
and ranked apart, so no key is too large for a task.

Cases: null sources are a source of their own, last in order; null or absent sizes count 0 and such
documents are taken without words; a source of size 0 has target 0; repeated rows each count; an
empty table gives an empty result; all columns of the input come back. Working columns have names
that begin with __mixing_; a table that has a column of the result's names is refused, unless a
prefix for these is given. Rows alike in key, size and source are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import stored

# Weights of sources in order, repeating; share of all sizes; cap of a rate.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
STEPS = 60
#: Newton steps of one job.
AT_ONCE = 4
TOLERANCE = 1e-10
#: Starts of a source's running sum that are tried.
OFFSETS = 128
#: Documents of one source and size that are ranked together.
GROUP = 20_000
EXACT = "decimal(38,9)"
ADDED = ("source_size", "target", "rate", "copies")
#: What names of working columns begin with.
P = "__mixing_"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds sid (order by code point, null last),
    weight and target: share of all sizes by weight, but cap times source_size at most, what is in
    excess going to the others by weight. Its rows are as many as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("sid") % len(weights))
    named = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", w)
    # the level at which all that is capped below it and the others' weights make up the total
    filling = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "sid")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    capped = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = named.withColumn("level", (total - capped) / left)
    # the first source, in filling order, that isn't full at its level gives the level of the rest
    open_at = level.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("source_size") * cap, F.col("level")))
    first_open = F.first("open", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(F.col("source_size") * cap, first_open * F.col("weight")), F.col("source_size") * cap)
    return open_at.select("source", "sid", "weight", "source_size", target.alias("target"))


def mixed(sized: DataFrame, *, source: str = "source", size: str = "size", key: str | tuple[str, ...] = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, prefix: str = "") -> DataFrame:
    """sized with source_size, target, rate (double) and copies (long), their names behind prefix.
    key: columns that tell documents apart, by which they are ranked."""
    clash = {f"{prefix}{c}" for c in ADDED} & set(sized.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; choose a prefix")
    own = (key,) if isinstance(key, str) else key
    rows = sized.withColumns({f"{P}size": F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long"), f"{P}source": F.col(f"`{source}`"), f"{P}key": F.xxhash64(*[F.col(f"`{c}`") for c in own])})
    counts = stored(rows.groupBy(F.col(f"{P}source").alias("__source"), F.col(f"{P}size").alias("__size")).agg(F.count("*").alias("n")), "mix-histogram")
    per_source = counts.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("__size") > 0, F.col("__size"))).alias("least"))
    aimed = targets(per_source.select(F.col("__source").alias("source"), "source_size"), weights, share, cap)
    per_source = stored(per_source.join(aimed.withColumnRenamed("source", "source2").drop("source_size"), F.col("__source").eqNullSafe(F.col("source2"))).drop("source2"), "mix-sources")
    histogram = stored(counts.join(per_source.select(F.col("__source").alias("s2"), "sid", "docs", "source_size"), F.col("__source").eqNullSafe(F.col("s2"))).select("sid", "__size", "n", (F.col("__size") * F.col("docs") / F.greatest("source_size", F.lit(1))).alias("z")), "mix-sid")
    rates = balanced(histogram, per_source, cap)
    return rounded(rows, per_source, histogram, rates, cap, prefix).drop(f"{P}size", f"{P}source", f"{P}key")


def tilt(lam: Column, z: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * z, F.lit(50.0))))


def balanced(histogram: DataFrame, per_source: DataFrame, cap: float) -> DataFrame:
    """sid and lam, by Newton steps on the dual of all sources at once; lam is null where every
    document is at the cap."""
    s, t = F.col("source_size"), F.col("target")
    low_z = F.col("least") * F.col("docs") / F.greatest(s, F.lit(1))
    full = t >= cap * s * (1 - 1e-12)
    state = per_source.select(
        "sid", "target",
        F.when(~full, F.lit(0.0)).alias("lam"),
        F.when(t >= s, F.lit(0.0)).otherwise(F.log(t / s) / low_z).alias("low"),
        F.when(t < s, F.lit(0.0)).otherwise(F.log(F.lit(cap)) / low_z).alias("high"),
        F.lit(None).cast("double").alias("off"),
    )
    state = stored(state, "mix-state")
    rate = tilt(F.col("lam"), F.col("z"), cap)
    mass = F.col("n") * F.col("__size")
    slope = F.when(F.col("lam") * F.col("z") < F.log(F.lit(cap)), mass * F.col("z") * rate).otherwise(F.lit(0.0))
    off = F.col("sum") - F.col("target")
    low, high = F.when(off <= 0, F.col("lam")).otherwise(F.col("low")), F.when(off >= 0, F.col("lam")).otherwise(F.col("high"))
    new = F.col("lam") - off / F.col("slope")
    good = (F.col("slope") > 0) & (new > low) & (new < high)
    near = F.abs(off) <= F.col("target") * TOLERANCE
    lam = F.when(near, F.col("lam")).otherwise(F.when(good, new).otherwise((low + high) / 2))
    after = [lam.alias("lam"), low.alias("low"), high.alias("high"), (F.abs(off) / F.greatest("target", F.lit(1.0))).alias("off")]
    for _ in range(0, STEPS, AT_ONCE):
        for _ in range(AT_ONCE):  # one plan: each step is one aggregation, and carries its source's state along
            sums = [F.sum(x.cast(EXACT)).cast("double").alias(c) for x, c in ((mass * rate, "sum"), (slope, "slope"))]
            same = [F.first(c).alias(c) for c in ("target", "lam", "low", "high")]
            state = histogram.join(state.drop("off"), "sid").groupBy("sid").agg(*sums, *same).select("sid", "target", *after)
        state = stored(state, "mix-state")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("sid", "lam")


def rounded(rows: DataFrame, per_source: DataFrame, histogram: DataFrame, rates: DataFrame, cap: float, prefix: str) -> DataFrame:
    """rows with source_size, target, rate and copies."""
    rate = F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(tilt(F.col("lam"), F.col("z"), cap))
    by_size = histogram.join(rates, "sid").join(per_source.select("sid", F.col("__source").alias("s"), "source_size", "target"), "sid")
    by_size = by_size.select("sid", F.col("__size").alias("z"), "s", "source_size", "target", rate.alias("rate"), F.ceil(F.col("n") / GROUP).cast("long").alias("parts"))
    by_size = stored(by_size.withColumnsRenamed({c: P + c for c in by_size.columns}), "mix-rates")
    size, source, own = F.col(f"{P}size"), F.col(f"{P}source"), F.col(f"{P}key")
    met = source.eqNullSafe(F.col(f"{P}s")) & (size == F.col(f"{P}z"))
    part = F.pmod(own, F.col(f"{P}parts"))
    told = rows.join(by_size, met).withColumn(f"{P}part", part)
    keys = rows.select(size.alias(f"{P}size"), source.alias(f"{P}source"), own.alias(f"{P}key")).join(by_size, met).withColumn("part", part)
    groups = keys.groupBy(F.col(f"{P}sid").alias("sid"), F.col(f"{P}z").alias("z"), "part").agg(F.count("*").alias("m"), F.first(f"{P}rate").alias("r"), F.first(f"{P}target").alias("aim"))
    running = Window.partitionBy("sid").orderBy("z", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum((F.col("m") * F.col("r")).cast(EXACT)).over(running), F.lit(0)).cast("double")
    groups = stored(groups.withColumn("base", base), "mix-base")
    tried = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn("u", (F.col("k") + 0.5) / OFFSETS)
    words = F.col("z") * (F.floor(F.col("base") + F.col("m") * F.col("r") + F.col("u")) - F.floor(F.col("base") + F.col("u")))
    totals = tried.groupBy("sid", "k", "u").agg(F.sum(words).alias("words"), F.first("aim").alias("aim"))
    best = totals.groupBy("sid").agg(F.min_by("u", F.struct(F.abs(F.col("words") - F.col("aim")), "k")).alias("u"))
    base = groups.join(best, "sid").select(F.col("sid").alias(f"{P}sid3"), F.col("z").alias(f"{P}z3"), F.col("part").alias(f"{P}part3"), (F.col("base") + F.col("u")).alias(f"{P}base"))
    within = Window.partitionBy(f"{P}sid", f"{P}z", f"{P}part").orderBy(F.xxhash64(own, F.lit(1)), own)
    ranked = told.withColumn(f"{P}rank", F.row_number().over(within)).join(base, (F.col(f"{P}sid") == F.col(f"{P}sid3")) & (F.col(f"{P}z") == F.col(f"{P}z3")) & (F.col(f"{P}part") == F.col(f"{P}part3")))
    at, rank, rate = F.col(f"{P}base"), F.col(f"{P}rank"), F.col(f"{P}rate")
    to = F.floor(at + rank * rate) - F.floor(at + (rank - 1) * rate)
    copies = F.least(F.greatest(to, F.lit(0)), F.lit(int(cap))).cast("long")
    added = {"source_size": F.col(f"{P}source_size"), "target": F.col(f"{P}target"), "rate": rate, "copies": copies}
    return ranked.select(*[F.col(f"`{c}`") for c in rows.columns], *[added[c].alias(f"{prefix}{c}") for c in ADDED])
