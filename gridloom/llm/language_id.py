"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows; two gated recurrent units read each window, one in either
direction, and a softmax over both states labels every position. A document's probabilities are the
mean over all its positions: every byte of every text counts. The network is trained in numpy by
backpropagation through time with Adam, on windows of a bounded sample: at most SAMPLE documents per
language, those with the least hashes of id and text, and WINDOWS windows spread evenly over each of
them. Neither source nor id nor any label is an input of a prediction.

Cases: null text, and text without a letter, is 'und' with score 0; the empty text likewise; long
texts go through in blocks; equal probabilities go to the language that comes first by code point;
repeated rows get equal results and count once in the sample; an empty table gives an empty result;
without any labelled document there is nothing to learn and every text is 'und'; a null id counts as
not held out; other columns are carried along (predicted() refuses names that are there already).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import held_out, least_hashed, session, settled, ship

LENGTH = 64
HIDDEN = 8
SAMPLE = 1000
WINDOWS = 5
EPOCHS = 3
#: Steps of training at least, however small the sample.
STEPS = 240
BATCH = 256
#: Windows read at once when predicting.
BLOCK = 4096
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is a letter: of a Unicode category that begins with L, so not ½, ² or Ⅷ."""
    return any(map(str.isalpha, text))


class Network:
    """Weights of both directions along the first axis, batches along the last. Gates: update, reset,
    candidate. The first two are computed as 0.5 + 0.5 * tanh, a logistic of twice the argument."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        g = np.random.default_rng(seed)
        h, c = hidden, max(1, len(labels))
        self.labels, self.h = labels, h
        self.p = {
            "x": g.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
            "u": g.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32),
            "b": np.zeros((2, h, 1), np.float32),
            "v": g.normal(0, 1 / np.sqrt(2 * h), (2, c, h)).astype(np.float32),
            "o": np.zeros((c, 1), np.float32),
        }

    def step(self, first: np.ndarray, second: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """first, second: the bytes that the two directions read now."""
        h = self.h
        gates = np.empty((2, 3 * h, state.shape[2]), np.float32)
        np.take(self.p["x"][0], first, axis=1, out=gates[0], mode="clip")
        np.take(self.p["x"][1], second, axis=1, out=gates[1], mode="clip")
        rec = np.matmul(self.p["u"], state)
        zr = gates[:, : 2 * h]
        zr += rec[:, : 2 * h]
        np.tanh(zr, out=zr)
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r = zr[:, :h], zr[:, h:]
        inner = rec[:, 2 * h :]
        inner += self.p["b"]
        n = gates[:, 2 * h :]
        n += r * inner
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        return new, z, r, n, inner

    def logits(self, t: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
        """Scores (length, classes, n) of windows t (length, n); states and gates of each step."""
        length, n = t.shape
        state = np.zeros((2, self.h, n), np.float32)
        out = np.zeros((length, len(self.labels), n), np.float32)
        out += self.p["o"]
        states, kept = [state], []
        for k in range(length):
            state, *rest = self.step(t[k], t[length - 1 - k], state)
            states.append(state)
            kept.append(rest)
            part = np.matmul(self.p["v"], state)
            out[k] += part[0]
            out[length - 1 - k] += part[1]
        return out, states, kept

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (length, classes, n) of every position of windows (n, length)."""
        t = np.ascontiguousarray(windows.T)
        length, n = t.shape
        state = np.zeros((2, self.h, n), np.float32)
        out = np.zeros((length, len(self.labels), n), np.float32)
        out += self.p["o"]
        for k in range(length):
            state = self.step(t[k], t[length - 1 - k], state)[0]
            part = np.matmul(self.p["v"], state)
            out[k] += part[0]
            out[length - 1 - k] += part[1]
        return softmax(out)

    def gradient(self, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy over all positions, through time."""
        t = np.ascontiguousarray(windows.T)
        length, n = t.shape
        out, states, kept = self.logits(t)
        d = softmax(out)
        d[:, y, np.arange(n)] -= 1
        d *= weight / (weight.sum() * length)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = d.sum(axis=(0, 2))[:, None]
        back = np.zeros((2, self.h, n), np.float32)
        for k in range(length - 1, -1, -1):
            dl = np.stack([d[k], d[length - 1 - k]])
            g["v"] += np.matmul(dl, states[k + 1].transpose(0, 2, 1))
            ds = back + np.matmul(self.p["v"].transpose(0, 2, 1), dl)
            z, r, c, inner = kept[k]
            prev = states[k]
            dn = ds * (1 - z) * (1 - c * c)
            dz = ds * (prev - c) * z * (1 - z) * 2
            dinner = dn * r
            dr = dn * inner * r * (1 - r) * 2
            g["b"] += dinner.sum(axis=2, keepdims=True)
            rec = np.concatenate([dz, dr, dinner], axis=1)
            g["u"] += np.matmul(rec, prev.transpose(0, 2, 1))
            back = ds * z + np.matmul(self.p["u"].transpose(0, 2, 1), rec)
            own = np.concatenate([dz, dr, dn], axis=1)
            for side, at in ((0, t[k]), (1, t[length - 1 - k])):
                one = np.zeros((n, 256), np.float32)
                one[np.arange(n), at] = 1
                g["x"][side] += own[side] @ one
        return g

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        if not len(windows) or len(self.labels) < 2:
            return
        epochs = max(epochs, -(-STEPS // ((len(windows) - 1) // BATCH + 1)))
        weight = (1.0 / np.bincount(y, minlength=len(self.labels))[y]).astype(np.float32)
        rng = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step, total = 0, epochs * ((len(windows) - 1) // BATCH + 1)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for low in range(0, len(order), BATCH):
                own = order[low : low + BATCH]
                step += 1
                rate = 0.02 * (1 - step / (total + 1))
                for k, g in self.gradient(windows[own], y[own], weight[own]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (n, classes) over all positions of each text; 0 for empty texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // LENGTH)
        flat = np.frombuffer(b"".join(t.ljust(int(c) * LENGTH, b" ") for t, c in zip(texts, counts, strict=True)), np.uint8).reshape(-1, LENGTH)
        total = np.zeros((len(texts), len(self.labels)))
        of = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        room = sizes[of] - (np.arange(len(of)) - first[of]) * LENGTH  # bytes of each window that are text
        for low in range(0, len(flat), BLOCK):
            p = self.positions(flat[low : low + BLOCK])
            left = room[low : low + BLOCK]
            for i in np.flatnonzero(left < LENGTH):
                p[left[i] :, :, i] = 0
            np.add.at(total, of[low : low + BLOCK], p.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    """Along the second axis, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def cut_evenly(text: bytes, windows: int = WINDOWS) -> list[bytes]:
    """At most windows windows, spread over the whole text."""
    n = -(-len(text) // LENGTH)
    chosen = range(n) if n <= windows else [(k * (n - 1)) // (windows - 1) for k in range(windows)]
    return [text[k * LENGTH : (k + 1) * LENGTH].ljust(LENGTH, b" ") for k in chosen]


def sample(docs: DataFrame, key: str, text: str, label: str, allowed: Column, per_label: int = SAMPLE) -> DataFrame:
    """label and windows of at most per_label documents of each label."""
    fit = docs.where(allowed & F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    fit = fit.select(F.col(f"`{label}`").alias("label"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").cast("binary").alias("text"))
    ids = least_hashed(fit.select("label", "h"), ["label"], per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(y, w) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in cut_evenly(t)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.binary())], ["label", "piece"])

    chosen = fit.join(ids, ["label", "h"], "left_semi").dropDuplicates(["label", "h"])
    return chosen.select("label", "text").mapInArrow(settled(run), "label string, piece binary")


def learned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", allowed: Column | None = None) -> Network:
    """A network trained on the sample of docs that allowed admits (all but the held-out ones)."""
    ship(session(docs))
    if allowed is None:
        allowed = ~held_out(F.col(f"`{key}`"))
    rows = sorted((r["label"], bytes(r["piece"])) for r in sample(docs, key, text, label, allowed).collect())
    labels = sorted({y for y, _ in rows})
    net = Network(labels)
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, LENGTH)
    net.train(windows, np.array([labels.index(y) for y, _ in rows], np.int64))
    return net


def predicted(docs: DataFrame, net: Network, *, text: str = "text", lang: str = "lang_pred", score: str = "score", drop: bool = False) -> DataFrame:
    """docs with the predicted language and its probability as two more columns; drop: without the
    text."""
    ship(session(docs))
    if {lang, score} & set(docs.columns):
        raise ValueError(f"{lang} or {score} is a column already; choose other names")
    at = docs.columns.index(text)
    keep = [c for c in docs.columns if not drop or c != text]
    where = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                texts = b.column(at).to_pylist()
                known = [t is not None and bool(net.labels) and has_letter(t) for t in texts]
                p = net.documents([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
                best = p.argmax(axis=1) if net.labels else np.zeros(len(texts), int)
                names = [net.labels[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores = [min(1.0, float(row[i])) if k else 0.0 for row, i, k in zip(p, best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in where], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang, score])

    schema = ", ".join([*[f"`{c}` {k}" for c, k in docs.dtypes if c in keep], f"`{lang}` string", f"`{score}` double"])
    return docs.mapInArrow(settled(run), schema)
