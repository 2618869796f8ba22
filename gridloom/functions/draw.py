"""Seeded weighted draws, in integers only, so that every engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime: draws are numbers below it.
MODULUS = 1_000_003


def number(*keys: Column, salt: int = 0) -> Column:
    """An integer in [0, MODULUS) from integer keys: two multiplicative rounds."""
    factors = (7919, 104_729, 611_953, 15_485_863)
    total = F.lit(salt).cast("long")
    for k, f in zip(keys, factors, strict=False):
        total = total + F.pmod(k.cast("long"), F.lit(MODULUS)) * f
    once = F.pmod(total, F.lit(MODULUS))
    return F.pmod(once * once + once * 48_271 + 11, F.lit(MODULUS))


def pick(u: Column, weights: Column) -> Column:
    """0-based index of the first entry whose running share of weights (array of long) is above u.
    null if nothing has a weight."""
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(weights, state, lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["i"] + 1).alias("i"), F.when(s["at"].isNull() & (u * total < (s["sum"] + w) * MODULUS), s["i"]).otherwise(s["at"]).alias("at")))
    return found["at"]
