"""Runs of repeated words: bit-parallel comparison of a text with itself, shifted.

Words get numbers, and bit k of all numbers is one big integer, a plane. For a lag q every plane is
shifted by q and XORed with itself; the OR over planes marks the places that differ from those q words
on. Stretches of zeros that are long enough for a run are isolated by AND with shifts of doubling
lengths. A stretch that a smaller lag has given already is the same run with a multiple of its period.

Not every lag is tried. A run of period q >= d has words that are equal q apart at three multiples of d
in a row, d being the power of two below q; one comparison of the text's rows of d words finds such lags
for all q from d to 2 d - 1. What lies within a run of a smaller period is no evidence, as two periods of
a stretch as long as their sum have a common divisor that is one. So a text of n words costs some
n log n comparisons and the planes of the lags that are left.

A run is a stretch of words with smallest period q, of times * q and least words or more, that no
neighbouring word extends. Words are what lies between ASCII white space.

Cases: null and empty texts have no run; texts are read whole, and each is one row of one task; repeated
rows get equal results; rows without or with repeated ids are rows like others, as texts are compared with
nothing but themselves; other columns are carried along, and names of results that are columns already
are refused; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import session, settled, ship

LEAST, TIMES = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words, by first appearance."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def planes(ids: np.ndarray) -> list[int]:
    """Bit k of all numbers as one integer, the first word lowest."""
    bits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(bits)]


def set_bits(x: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(x.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))


def begins(equal: int, length: int) -> int:
    """Bits at which so many ones in a row begin."""
    have = 1
    while have < length and equal:
        step = min(have, length - have)
        equal &= equal >> step
        have += step
    return equal


def stretches(own: list[int], n: int, lag: int, length: int) -> list[tuple[int, int]]:
    """Where (start, end) so many words in a row, or more, equal those lag words on."""
    ones = (1 << (n - lag)) - 1
    mismatch = 0
    for k, p in enumerate(own):
        mismatch |= p ^ (p >> lag)
        if k == 1 and not begins(ones & ~mismatch, length):  # most lags end here
            return []
    at = begins(ones & ~mismatch, length)
    if not at:
        return []
    first, last = set_bits(at & ~(at << 1)), set_bits(at & ~(at >> 1))
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def likely(ids: np.ndarray, d: int, reach: np.ndarray, times: int) -> list[int]:
    """Lags from d to 2 d - 1 at which words at times - 1 multiples of d in a row equal those a lag on,
    beyond what lies in one known run; reach: the end of the furthest run that begins at a word or before."""
    n = len(ids)
    rows = -(-n // d) + 1
    padded = np.full(rows * d, -1, ids.dtype)
    padded[:n] = ids
    a = padded.reshape(rows, d)
    equal = a[1:] == a[:-1, :1]
    hits = equal[: max(len(equal) - times + 2, 0)].copy()
    for k in range(1, times - 1):
        hits &= equal[k : k + len(hits)]
    row, off = np.nonzero(hits)
    at = row * d
    new = at + (times - 2) * d + d + off + 1 > reach[at]
    return np.unique(off[new] + d).tolist()


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length and period of every run, by start, then period. times is 3 or more."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found")
    n = len(ids)
    if n < least:
        return []
    own, known, reach = planes(ids), {}, np.zeros(n, np.int64)
    d = 1
    while times * d <= n:
        fresh = []
        for q in likely(ids, d, reach, times):
            if times * q > n:
                break
            for start, end in stretches(own, n, q, max(least - q, (times - 1) * q, 1)):
                if (start, end + q) not in known:
                    known[start, end + q] = q
                    fresh.append((start, end + q))
        if fresh:
            for start, end in fresh:
                reach[start] = max(reach[start], end)
            np.maximum.accumulate(reach, out=reach)
        d *= 2
    return sorted((start, end - start, q) for (start, end), q in known.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equals the first by start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES, digests: bool = False) -> DataFrame:
    """docs without the text, and n_runs, the strongest run (start, length, period, exponent_milli; nulls
    without a run), and runs with the collapsed text, or the SHA-256 digests of both."""
    ship(session(docs))
    keep = [c for c in docs.columns if c != text]
    more = ["runs_sha256 string", "collapsed_sha256 string"] if digests else ["runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]
    added = ["n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", *more]
    if {a.split()[0] for a in added} & set(keep):
        raise ValueError("a name of the result is a column already")
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                b = whole.slice(low, 512)
                out: list[list] = [[] for _ in added]
                for t in b.column(b.num_columns - 1).to_pylist():
                    words = (t or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space
                    found = runs(numbers(words), least, times)
                    best = strongest(found)
                    left = b" ".join([words[i] for i in np.flatnonzero(kept(len(words), found))]) if found else b" ".join(words)
                    row = [len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None]
                    if digests:
                        listed = "".join([f"{s},{n},{q}\n" for s, n, q in found])
                        row += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                    else:
                        row += [[{"start": s, "length": n, "period": q} for s, n, q in found], left.decode("utf-8", "surrogatepass")]
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                shown = [pa.string(), pa.string()] if digests else [pa.list_(RUN), pa.string()]
                types = [pa.int64()] * 5 + shown
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(o, k) for o, k in zip(out, types, strict=True)]], names=[*keep, *[a.split()[0] for a in added]])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string"))
    return chosen.mapInArrow(settled(run), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *added]))
