"""Toxicity by a chain of linear classifiers.

The chain predicts its categories one after the other. Each is a logistic regression over the
presence of words and word beginnings, and of the probabilities of all categories before it. When later
models are trained, the earlier categories' probabilities are predicted out of fold, by models that
have not seen the document, so a later model sees them as good as they will be on new texts.

It learns from a sample of the labelled documents, at most SAMPLE for each combination of labels, by
a hash of their id, weighted back to the combination's true share. Scoring reads every word of every
text, with the words' contributions looked up in a table.

Cases: null and empty texts get the base rate; null labels leave a document out of training; an id
that is labelled in several ways counts for each of them, and once for each; of rows that repeat a
sampled id the text with the least hash counts; of features that tell equally much those that come
first by code point are taken; without labelled documents every probability is 0; a category with a
single value has that value as its probability; repeated rows get equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST, least_hashed, session, settled, ship, stored

SAMPLE = 1000
FOLDS = 4
FEATURES = 4000
LEAST = 5
STEPS = 250
RIDGE = 2e-4
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")
CACHE = 300_000


def features(text: str | None) -> set[str]:
    """Words in lower case, and beginnings of longer ones, marked by a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


class Linear:
    """Logistic regression on sparse rows (column indexes) and a few dense columns."""

    def __init__(self, width: int, dense: int):
        self.w, self.d, self.b = np.zeros(width), np.zeros(dense), 0.0

    def scores(self, at: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Each row is summed on its own, in the order of its columns, so its score is the same whatever
        rows are beside it."""
        n = len(starts) - 1
        total = np.bincount(np.repeat(np.arange(n), np.diff(starts)), self.w[at], n).astype(float) + self.b
        for column, weight in zip(dense.T, self.d, strict=True):
            total = total + column * weight
        return total

    def fit(self, at: np.ndarray, starts: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
        """Adam on the weighted mean log-loss with a ridge, all rows at each step."""
        weight = weight / weight.sum()
        rate = float((weight * y).sum())
        self.b = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
        if rate in (0.0, 1.0):
            return self
        sizes = np.diff(starts)
        m = [np.zeros(len(self.w) + len(self.d) + 1), np.zeros(len(self.w) + len(self.d) + 1)]
        for step in range(1, STEPS + 1):
            p = probability(self.scores(at, starts, dense))
            g = weight * (p - y)
            grad = np.concatenate([np.bincount(at, np.repeat(g, sizes), len(self.w)) + RIDGE * self.w, dense.T @ g + RIDGE * self.d, [g.sum()]])
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad * grad - m[1])
            move = 0.1 * (1 - step / (STEPS + 1)) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-10)
            self.w -= move[: len(self.w)]
            self.d -= move[len(self.w) : -1]
            self.b -= float(move[-1])
        return self


class Chain:
    """vocabulary: column of each feature; models: one per category, in order."""

    def __init__(self, names: list[str], vocabulary: dict[str, int], models: list[Linear]):
        self.names, self.vocabulary, self.models = names, vocabulary, models
        self.columns: dict[str, tuple[int, ...]] = {}

    def row(self, text: str | None) -> list[int]:
        """Distinct columns of a text's features."""
        known, out = self.columns, set()
        for w in set(WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                keys = [w, *[w[:n] + "*" for n in PREFIXES if len(w) > n]]
                own = known[w] = tuple(self.vocabulary[k] for k in keys if k in self.vocabulary)
                if len(known) > CACHE:
                    known.clear()
            out.update(own)
        return sorted(out)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(n, categories)."""
        rows = [self.row(t) for t in texts]
        at = np.array([c for r in rows for c in r], np.int64)
        starts = np.cumsum([0, *map(len, rows)])
        dense = np.zeros((len(texts), 0))
        for model in self.models:
            dense = np.column_stack([dense, probability(model.scores(at, starts, dense))])
        return dense


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def trained(rows: list[list[str]], labels: np.ndarray, weight: np.ndarray, names: list[str], seed: int = 9) -> Chain:
    """rows: features of the sampled documents; labels (n, categories) of 0 and 1."""
    count: dict[str, int] = {}
    for r in rows:
        for f in r:
            count[f] = count.get(f, 0) + 1
    usual = sorted(f for f, n in count.items() if n >= LEAST)
    first = {f: i for i, f in enumerate(usual)}
    flat = [np.array(sorted(first[f] for f in r if f in first), np.int64) for r in rows]
    chosen = np.zeros(len(usual), bool)
    n = np.array([count[f] for f in usual], float)
    for y in labels.T:
        hits = np.bincount(np.concatenate([*flat, np.zeros(0, np.int64)]), np.repeat(y.astype(float), list(map(len, flat))), len(usual))
        rate = y.mean() if len(y) else 0.0
        odd = (hits - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9)
        chosen[np.lexsort((np.arange(len(odd)), -odd))[:FEATURES]] = True
    place = np.cumsum(chosen) - 1
    kept = [place[r[chosen[r]]] for r in flat]
    at, starts = np.concatenate([*kept, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, kept)])
    fold = np.random.default_rng(seed).permutation(len(rows)) % FOLDS
    width, dense, models = int(chosen.sum()), np.zeros((len(rows), 0)), []

    def some(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [kept[i] for i in np.flatnonzero(mask)]
        return np.concatenate([*own, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, own)])

    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(Linear(width, dense.shape[1]).fit(at, starts, dense, y, weight))
        if c + 1 < labels.shape[1]:
            unseen = np.zeros(len(rows))
            for k in range(FOLDS):
                inside, outside = fold != k, fold == k
                if inside.any() and outside.any():
                    model = Linear(width, dense.shape[1]).fit(*some(inside), dense[inside], y[inside], weight[inside])
                    unseen[outside] = probability(model.scores(*some(outside), dense[outside]))
            dense = np.column_stack([dense, unseen])
    return Chain(names, {f: int(place[i]) for f, i in first.items() if chosen[i]}, models)


def sample(docs: DataFrame, labels: DataFrame, names: list[str], key: str, text: str, per_group: int) -> DataFrame:
    """features, the labels and n (documents of that combination), per_group of each at most."""
    known = labels.select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{c}`").cast("int").alias(f"y{i}") for i, c in enumerate(names)]).dropna()
    own = [f"y{i}" for i in range(len(names))]
    known = known.withColumn("h", F.xxhash64("id"))
    counts = known.select("id", *own).distinct().groupBy(*own).agg(F.count("*").alias("n"))
    picked = known.join(least_hashed(known.select(*own, "h"), own, per_group), [*own, "h"], "left_semi").select("id", *own).distinct()
    picked = stored(picked.join(counts, own), "toxicity-sample")
    if per_group * 2 ** len(names) <= BROADCAST:  # its size is bounded by this, whatever the tables hold
        picked = F.broadcast(picked)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(picked, "id")
    one = texts.groupBy("id", "n", *own).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("t.text", "n", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([sorted(features(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([got, *b.columns[1:]], ["features", "n", *own])

    return rows.mapInArrow(settled(run), ", ".join(["features array<string>", "n bigint", *[f"{c} int" for c in own]]))


def learned(docs: DataFrame, labels: DataFrame, names: list[str], *, key: str = "doc_id", text: str = "text", per_group: int = SAMPLE) -> Chain:
    """A chain over the 0/1 columns names of labels, in that order."""
    ship(session(docs))
    got = sample(docs, labels, names, key, text, per_group).toArrow()
    y = np.column_stack([got[f"y{i}"].to_numpy() for i in range(len(names))]).reshape(-1, len(names))
    rows = got["features"].to_pylist()
    by = sorted(range(len(rows)), key=lambda i: (tuple(y[i]), rows[i]))
    rows, y = [rows[i] for i in by], y[by]
    n = got["n"].to_numpy()[by].astype(float)
    group = np.unique(y, axis=0, return_inverse=True)[1].ravel() if len(rows) else np.zeros(0, int)
    weight = n / np.maximum(np.bincount(group, minlength=1)[group], 1)
    return trained(rows, y, weight, names) if rows else Chain(names, {}, [])


def scored(docs: DataFrame, chain: Chain, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and p_<category> (double) of every document."""
    ship(session(docs))
    names = chain.names
    if key in [f"p_{c}" for c in names]:
        raise ValueError(f"{key} is the name of a probability, too; rename it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                b = whole.slice(low, 512)
                p = chain.probabilities(b.column(1).to_pylist()) if chain.models else np.zeros((b.num_rows, len(names)))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in p.T]], ["id", *[f"p_{c}" for c in names]])

    kind = dict(docs.dtypes)[key]
    found = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(settled(run), ", ".join([f"id {kind}", *[f"`p_{c}` double" for c in names]]))
    return found.withColumnRenamed("id", key)
