"""SentencePiece encoding and decoding with vectorised merge rounds.

A model file of the BPE kind is read once per Python worker. Texts are cut into words at points no
piece of the vocabulary can span; the distinct words of a batch lie in one flat numpy symbol array
and are merged together. A round finds the best pair of every word (a segmented minimum of pair
ranks), merges its non-overlapping occurrences from the left in all words at once, and compacts;
words without a pair left are taken out. If merging all occurrences at once brings forth a pair as
good as the one merged, only the leftmost is merged in that word and round, which is the order the
library follows, so ids equal the library's.

Cases: null text is encoded as the empty text (no ids, decoded to ''); very long texts and words
need memory in proportion to their length only; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are not touched or needed.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import session, settled, ship, worker_tables

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Words a worker remembers, or a batch has: half of them in use, half from before. Words that come
#: again move from the old half to the other; when that is full, it becomes the old one.
CACHE_WORDS = 300_000
#: Characters encoded in one go.
CHUNK_CHARS = 1 << 19


class Bpe:
    """Encoder and decoder for one BPE model."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisation without white-space removal is supported")
        kinds = [p.type for p in m.pieces]
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.n = len(m.pieces)
        self.unk = kinds.index(2)
        self.kind = kinds
        self.text = [p.piece for p in m.pieces]
        self.byte_id = [self.unk] * 256
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        #: Symbols: piece ids, then characters that only occur inside pieces, then the unknown one.
        self.symbol = dict(ids)
        for piece in ids:
            for ch in piece:
                if ch not in self.symbol:
                    self.symbol[ch] = self.n + len(self.symbol) - len(ids)
        self.stranger = max(self.symbol.values(), default=0) + self.n + 1
        order = {s: r for r, s in enumerate(sorted({m.pieces[i].score for i in ids.values()}, reverse=True))}
        left, right, rank, made = [], [], [], []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[m.pieces[i].score]), made.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(rank, np.int32)[by], np.int32(NONE))
        self.makes = np.append(np.array(made, np.int32)[by], np.int32(0))
        inside = {ch for piece in ids if len(piece) > 1 for ch in piece}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            self.cut = re.compile(r"(?s).+")
        elif "\n" not in inside:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.number = [str(i) for i in range(self.n)]
        self.plain = [p.replace(SPACE, " ") if k == 1 else "" for p, k in zip(self.text, kinds, strict=True)]
        self.by_char = np.full(0x110000, self.stranger, np.int32)
        for ch, i in self.symbol.items():
            if len(ch) == 1:
                self.by_char[ord(ch)] = i
        self.known: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table; the last entry stands for absence."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols of every word after all merge rounds."""
        out: list[list[int]] = [[] for _ in words]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.by_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        at = np.full(len(sym), len(self.keys) - 1)  # the pair that begins at each symbol
        same = np.flatnonzero(word[1:] == word[:-1]) if len(sym) else np.zeros(0, np.int64)
        at[same] = self._pairs(sym[same], sym[same + 1])
        while len(sym):
            rank = self.ranks[at]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            done = best == NONE
            if done.any():
                over = np.repeat(done, size)
                ends, ids, of = np.cumsum(size[done]), sym[over].tolist(), word[starts[done]].tolist()
                low = 0
                for w, high in zip(of, ends.tolist(), strict=True):
                    out[w] = ids[low:high]
                    low = high
                live = ~over
                sym, word, at, rank, best, size = sym[live], word[live], at[live], rank[live], best[~done], size[~done]
                if not len(sym):
                    break
                starts = np.cumsum(size) - size
            seg = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == best[seg])
            # of adjacent hits every other one, counted from the left
            first = np.append(True, (np.diff(hit) != 1) | (np.diff(seg[hit]) != 0))
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            new = self._merged(sym, word, at, hit)
            worst = np.flatnonzero(np.append(True, np.diff(seg[hit]) != 0))
            if len(worst) < len(hit):  # some word merges twice: look whether order would matter
                nsym, nword, nat = new
                nstarts = np.flatnonzero(np.append(True, nword[1:] != nword[:-1]))
                nbest = np.minimum.reduceat(self.ranks[nat], nstarts)
                redo = nbest <= best
                if redo.any():
                    lead = np.zeros(len(hit), bool)
                    lead[worst] = True
                    new = self._merged(sym, word, at, hit[lead | ~redo[seg[hit]]])
            sym, word, at = new
        return out

    def _merged(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sym, at = sym.copy(), at.copy()
        sym[hit] = self.makes[at[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        place = (np.cumsum(keep) - 1)[hit]
        sym, word, at = sym[keep], word[keep], at[keep]
        mark = np.zeros(len(sym), bool)
        mark[place] = True
        mark[place[place > 0] - 1] = True
        touched = np.flatnonzero(mark)
        inner = touched[touched + 1 < len(sym)]
        inner = inner[word[inner] == word[inner + 1]]
        at[touched] = len(self.keys) - 1
        at[inner] = self._pairs(sym[inner], sym[inner + 1])
        return sym, word, at

    def pieces(self, text: str) -> list[str]:
        """The words of a text."""
        if not text:
            return []
        s = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + s if self.dummy_prefix else s)

    def _learn(self, words: list[str]) -> None:
        number, plain, n = self.number, self.plain, self.n
        for w, symbols in zip(words, self.merge(words), strict=True):
            if max(symbols) < n:
                self.known[w] = (",".join([number[s] for s in symbols]), len(symbols), "".join([plain[s] for s in symbols]))
                continue
            ids: list[int] = []
            pos = 0
            for s in symbols:
                if s < n:
                    ids.append(s)
                    pos += len(self.text[s])
                else:
                    ids.extend(self.byte_id[b] for b in w[pos].encode())
                    pos += 1
            self.known[w] = (",".join(map(str, ids)), len(ids), self.surface(ids))

    def surface(self, ids: list[int]) -> str:
        """What a run of ids stands for, before the dummy prefix goes."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if self.kind[i] == 6:
                pending.append(int(self.text[i][1:-1], 16))
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if self.kind[i] == 2:
                out.append(" ⁇ ")
            elif self.kind[i] == 1:
                out.append(self.text[i].replace(SPACE, " "))
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the dummy prefix."""
        s = self.surface(ids)
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s

    def entries(self, words: list[str]) -> list[tuple[str, int, str]]:
        """(ids as text, number of ids, decoded text) of every word, in order."""
        known, old, missing = self.known, self.old, []
        distinct = dict.fromkeys(words)
        for w in distinct:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    missing.append(w)
        if missing:
            if len(known) + len(missing) > CACHE_WORDS // 2:  # what is in use moves on, the rest grows old
                self.old, self.known = known, {w: known[w] for w in distinct if w in known}
                known = self.known
            size = low = 0
            for k, w in enumerate(missing):
                size += len(w)
                if size > CHUNK_CHARS:
                    self._learn(missing[low : k + 1])
                    low, size = k + 1, 0
            self._learn(missing[low:])
        return [known[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries(self.pieces(text or "")) for i in e[0].split(",")]


def model(path: str, proto: bytes | None = None) -> Bpe:
    """The model at path, read once per process and kept while no other operator needs the room."""

    def make() -> Bpe:
        if proto is not None:
            return Bpe(proto)
        with open(path, "rb") as f:
            return Bpe(f.read())

    return worker_tables(f"bpe {path}", make)


def encoded(docs: DataFrame, model_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of docs: the columns named in keep, n_tokens, and by choice ids with the
    decoded text, or their SHA-256 digests (ids_sha256, decoded_sha256). The model file is read on
    the driver and travels with the tasks."""
    ship(session(docs))
    with open(model_path, "rb") as f:
        proto = f.read()
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = pa_schema(docs, keep, ids, digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path, proto)
        for b in batches:
            for low in range(0, max(b.num_rows, 1), 512):
                part = b.slice(low, 512)
                if part.num_rows:
                    gc.disable()  # the many small strings of the cache hold no cycles
                    yield encode_batch(bpe, part, list(keep), ids, digests)
                    gc.enable()

    return chosen.mapInArrow(settled(run), schema)


def pa_schema(docs: DataFrame, keep: tuple[str, ...], ids: bool, digests: bool) -> str:
    kinds = dict(docs.dtypes)
    cols = [f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens bigint"]
    cols += ["ids array<int>", "decoded string"] if ids else []
    cols += ["ids_sha256 string", "decoded_sha256 string"] if digests else []
    return ", ".join(cols)


def encode_batch(bpe: Bpe, b: pa.RecordBatch, keep: list[str], ids: bool, digests: bool) -> pa.RecordBatch:
    words, ends = [], []
    for t in b.column(b.num_columns - 1).to_pylist():
        words.extend(bpe.pieces(t or ""))
        ends.append(len(words))
    found = bpe.entries(words)
    counts, id_lists, texts, id_digests, text_digests = [], [], [], [], []
    low = 0
    for high in ends:
        own = found[low:high]
        low = high
        counts.append(sum(e[1] for e in own))
        text = "".join([e[2] for e in own])
        if bpe.dummy_prefix and text.startswith(" "):
            text = text[1:]
        if ids:
            id_lists.append([int(i) for e in own for i in e[0].split(",")])
            texts.append(text)
        if digests:
            id_digests.append(hashlib.sha256(",".join([e[0] for e in own]).encode()).hexdigest())
            text_digests.append(hashlib.sha256(text.encode()).hexdigest())
    arrays = [b.column(i) for i in range(len(keep))] + [pa.array(counts, pa.int64())]
    names = [*keep, "n_tokens"]
    if ids:
        arrays += [pa.array(id_lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
        names += ["ids", "decoded"]
    if digests:
        arrays += [pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
        names += ["ids_sha256", "decoded_sha256"]
    return pa.RecordBatch.from_arrays(arrays, names)
