"""Word shingles as 64-bit hashes, and circulant MinHash signatures of their sets (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

#: Universe of the circulant permutations; shingle hashes are folded into it.
BITS = 22
SIZE = 1 << BITS
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def normal(text: bytes) -> bytes:
    """The words of a text in lower case (A-Z only), with one space between them."""
    return b" ".join(text.lower().split())


def exact_shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves; the whole sequence, if it is shorter; none without words."""
    if len(words) >= width:
        return set(zip(*[words[i:] for i in range(width)], strict=False))
    return {tuple(words)} if words else set()


def alike(a: set, b: set, percent: int) -> bool:
    """100 * intersection >= percent * union, for sets that aren't empty."""
    if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class WordHashes:
    """Hashes of all words of a batch of normal texts: their bytes go eight by eight through a
    bijection that isn't linear, so words of one length up to eight bytes never meet, and no
    arrangement of letters makes longer ones meet. Words beyond LONG bytes are digested apart."""

    LONG = 256

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and how many words each text has."""
        joined = b" ".join(texts) + b" " * 9
        data = np.frombuffer(joined, np.uint8)
        gap = np.flatnonzero(data[: len(data) - 8] == 32)
        begin, end = np.append(0, gap[:-1] + 1), gap
        some = end > begin
        begin, end = begin[some], end[some]
        # eight bytes from each position on
        eight = np.ndarray((len(data) - 7,), np.uint64, buffer=joined, strides=(1,))
        size = end - begin
        h = mix(size.astype(np.uint64) * _M1)
        left = np.flatnonzero(size <= self.LONG)
        at = 0
        while len(left):
            block = eight[begin[left] + at]
            spare = np.clip(8 - (size[left] - at), 0, 7).astype(np.uint64) * np.uint64(8)
            block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> spare
            h[left] = mix(h[left] * _M1 ^ block)
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > self.LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(joined[begin[i] : end[i]], digest_size=8).digest(), "little")
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        return h, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingle_sets(texts: list[bytes], width: int, words: WordHashes) -> list[np.ndarray]:
    """Per normal text the sorted distinct hashes of its shingles of width words; of the whole
    sequence, if it is shorter; none without words."""
    h, counts = words.of(texts)
    x = np.full(len(h), width, np.uint64)
    for k in range(width):
        if len(h) > k:
            x[: len(h) - k] = mix(x[: len(h) - k] * _M1 + h[k:])
    out, low = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(x[low : low + n - width + 1]))
        elif n:
            y = np.full(1, n, np.uint64)
            for k in range(n):
                y = mix(y * _M1 + h[low + k])
            out.append(y)
        else:
            out.append(np.zeros(0, np.uint64))
        low += n
    return out


class Circulant:
    """C-MinHash: a first permutation scatters the universe, a second one, shifted circularly by k,
    gives coordinate k. The values of all coordinates for one element are neighbours in the second
    permutation, so a signature is the minimum over a few contiguous rows."""

    def __init__(self, coordinates: int, seed: int = 20240607):
        self.k = coordinates
        pi = np.random.default_rng(seed).permutation(SIZE).astype(np.uint32)
        round_ = np.concatenate([pi, pi[: coordinates - 1]])
        self.rows = np.lib.stride_tricks.sliding_window_view(round_, coordinates)

    @staticmethod
    def scatter(x: np.ndarray) -> np.ndarray:
        """Fold into the universe and permute it: an odd factor and a shifted xor are bijections."""
        y = (x >> np.uint64(64 - BITS)).astype(np.uint64)
        y = (y * np.uint64(0x2545F491)) & np.uint64(SIZE - 1)
        return (y ^ (y >> np.uint64(BITS // 2))).astype(np.int64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum of every coordinate; shingles must not be empty."""
        at = self.scatter(shingles)
        low = np.full(self.k, SIZE, np.uint32)
        for i in range(0, len(at), 2048):
            np.minimum(low, self.rows[at[i : i + 2048]].min(axis=0), out=low)
        return low
