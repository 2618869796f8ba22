"""Operators of the subpackage against brute force on small tables with every kind of odd row."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann_mih, cdc_dedup, components, language_id, lpf_dedup, minhash_dedup, mixing, queries, secret_scan, sentencepiece_bpe, shingles, toxicity, va_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
WORDS = "the of and in to thon erea blee shou ing tion".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefghij") * rng.randrange(3) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty and long texts, repeats, near copies and shared passages."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(3, 200)) for _ in range(40)]
    passage = prose(rng, 120)
    texts = [*base, *base[:5], *[passage + " " + prose(rng, 40) for _ in range(4)], *[prose(rng, 30) + " " + passage for _ in range(3)]]
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n ", "one", "One", "x" * 3000, "abcd " * 900, "é" * 500 + "中文 " * 200, "password = hunter22 token:short AKIA" + "Q7" * 10 + " " + "0f" * 20, "secret=token: abcdefgh 'api_key' : \"Zz9.-_=+/\"", prose(rng, 4000)]
    out = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "é"][i % 4], len(t) if t is not None else None, 0.5, 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets_of(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(spark, docs, empty, rows, tmp_path):
    ledger = str(tmp_path / "ledger")
    got = secret_scan.scanned(docs, ledger).select("doc_id", secret_scan.spans(F.col("found")).alias("s")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["s"]) for r in got))) == sorted(repr((r[0], secrets_of(r[1]))) for r in rows)
    assert sum(bool(r["s"]) for r in got) >= 2
    before = spark.read.parquet(ledger).count()
    assert before == len({r[1] or "" for r in rows})  # each content once
    secret_scan.scanned(docs, ledger)
    assert spark.read.parquet(ledger).count() == before  # nothing is scanned again
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, "[0-9a-f]+", 0, 30))
    again = secret_scan.scanned(docs, ledger, rules=newer)
    assert spark.read.parquet(ledger).count() == 2 * before  # only the new version of one rule
    assert again.where(F.exists("found", lambda x: (x["kind"] == 2) & (x["end"] - x["start"] < 30))).count() == 0
    clean = secret_scan.redacted(docs, str(tmp_path / "other"))
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not [r for r in clean.collect() if secrets_of(r["text"])]
    assert secret_scan.scanned(empty, str(tmp_path / "none")).count() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(6)
    parts = {"en": "the and of thing ous", "de": "der die schung keit ein", "fr": "le que eux ment èau"}
    rows = [(i, " ".join(rng.choice(parts[k].split()) for _ in range(rng.randrange(5, 60))), k, None, 0, 0.0, 0) for i, k in enumerate(rng.choices(list(parts), k=300))]
    table = spark.createDataFrame(rows, DOCS)
    net = language_id.learned(table)
    got = {r["doc_id"]: r for r in language_id.predicted(table, net, lang="lang_pred", score="p").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.95
    odd = language_id.predicted(docs.select("doc_id", "text"), net).collect()
    assert {r["lang_pred"] for r in odd if not re.search(r"[^\W\d_]", r["text"] or "")} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in odd) and len(odd) == docs.count()
    assert language_id.learned(empty).labels == [] and language_id.predicted(docs, language_id.learned(empty), lang="l", score="s").where("l <> 'und'").count() == 0


def test_network_reads_every_byte():
    """Documents' probabilities against gates written out, byte by byte and unit by unit."""
    net = language_id.Network(["a", "b", "c"], hidden=3, seed=20)
    rng = np.random.default_rng(21)
    net.p["b"] += rng.normal(size=net.p["b"].shape).astype(np.float32)
    net.p["o"] += rng.normal(size=net.p["o"].shape).astype(np.float32)
    texts = [b"", b"x", bytes(rng.integers(0, 256, language_id.LENGTH).tolist()), bytes(rng.integers(0, 256, 2 * language_id.LENGTH + 9).tolist())]

    def sigmoid(v):
        return 1 / (1 + math.exp(-v))

    def states(side, data):
        p, h, out = {k: v.astype(float) for k, v in net.p.items()}, [0.0] * 3, []
        for byte in data:
            rec = [sum(p["u"][side, i, j] * h[j] for j in range(3)) for i in range(9)]
            x = [p["x"][side, i, byte] for i in range(9)]
            new = []
            for i in range(3):
                z, r = sigmoid(2 * (x[i] + rec[i])), sigmoid(2 * (x[3 + i] + rec[3 + i]))
                n = math.tanh(x[6 + i] + r * (rec[6 + i] + p["b"][side, i, 0]))
                new.append((1 - z) * n + z * h[i])
            h = new
            out.append(h)
        return out

    want = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        for low in range(0, len(t), language_id.LENGTH):
            w = t[low : low + language_id.LENGTH].ljust(language_id.LENGTH, b" ")
            there, back = states(0, w), states(1, w[::-1])[::-1]
            for at in range(min(language_id.LENGTH, len(t) - low)):
                score = [net.p["o"][c, 0] + sum(net.p["v"][0, c, i] * there[at][i] + net.p["v"][1, c, i] * back[at][i] for i in range(3)) for c in range(3)]
                e = np.exp(np.array(score, float) - max(score))
                want[k] += e / e.sum()
    want /= np.maximum([len(t) for t in texts], 1)[:, None]
    assert np.abs(net.documents(texts) - want).max() < 1e-5


def test_samples_are_bounded_and_distinct(spark):
    from gridloom.llm.common import least_hashed

    rows = [("a", 5)] * 3000 + [("a", i * 2**50) for i in range(-8000, 8000)] + [("b", 1), ("b", 2), (None, 3)]
    df = spark.createDataFrame(rows, "g string, h long")
    got = sorted((r["g"], r["h"]) for r in least_hashed(df, ["g"], 100).collect() if r["g"])
    assert got == sorted([("a", h) for h in sorted({h for g, h in rows if g == "a"})[:100]] + [("b", 1), ("b", 2)])
    texts = [(1, "one text"), (1, "another text")] * 50 + [(2, "third one here")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    allowed = F.lit(True)
    assert language_id.sample(docs, "doc_id", "text", "lang", allowed).count() == 3
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 1, 1), (3, None, 1)], "doc_id long, x int, y int")
    got = toxicity.sample(docs, labels, ["x", "y"], "doc_id", "text", 10).collect()
    assert sorted((r["n"], r["y0"], r["y1"]) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 1, 1)]


def test_network_gradient():
    net = language_id.Network(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    w, y, weight = rng.integers(0, 256, (6, 9)).astype(np.uint8), rng.integers(0, 3, 6), np.ones(6, np.float32)

    def loss():
        return float((-np.log(net.positions(w)[:, y, np.arange(6)]).mean(axis=0)).mean())

    for k, g in net.gradient(w, y, weight).items():
        i = int(np.abs(g).argmax())
        flat, old = net.p[k].reshape(-1), net.p[k].reshape(-1)[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-2 - g.reshape(-1)[i]) < 2e-3


def test_toxicity(spark, docs, empty):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(400):
        bad, poor = rng.random() < 0.3, rng.random() < 0.2
        rows.append((i, prose(rng, 40) + (" nasty vile" if bad else "") + (" ### junkish" if poor else ""), None, None, 0, 0.0, 0))
        marks.append((i, int(poor), int(bad) if i % 50 else None))
    labels = spark.createDataFrame(marks, "doc_id long, low_quality int, toxic int")
    chain = toxicity.learned(spark.createDataFrame(rows[:300], DOCS), labels, ["low_quality", "toxic"])
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.scored(spark.createDataFrame(rows[300:], DOCS), chain).collect()}
    assert np.mean([(got[i] > 0.5) == ("nasty" in t) for i, t, *_ in rows[300:]]) > 0.9
    assert toxicity.scored(docs, chain).count() == docs.count()
    none = toxicity.learned(empty, labels, ["low_quality", "toxic"])
    assert {r["p_toxic"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    # every probability from the definition, feature by feature, earlier ones feeding later models
    for r in rows[300:330] + [(999, None), (998, ""), (997, "zzz nasty")]:
        known = {chain.vocabulary[f] for f in toxicity.features(r[1]) if f in chain.vocabulary}
        p = []
        for model in chain.models:
            score = model.b + sum(model.w[c] for c in known) + sum(d * x for d, x in zip(model.d, p, strict=True))
            p.append(1 / (1 + math.exp(-score)))
        assert np.abs(chain.probabilities([r[1]])[0] - p).max() < 1e-9


def test_chain_is_fed_out_of_fold(monkeypatch):
    """Later models are trained on probabilities by models that haven't seen the document."""
    rng = np.random.default_rng(22)
    rows = [sorted(set(rng.choice(list("abcdefgh"), 4))) for _ in range(200)]
    y = np.column_stack([[("a" in r) ^ (rng.random() < 0.2) for r in rows], [("b" in r) for r in rows]]).astype(int)
    fits = []
    fit = toxicity.Linear.fit
    monkeypatch.setattr(toxicity.Linear, "fit", lambda self, at, starts, dense, y, weight: fits.append((len(y), dense.copy())) or fit(self, at, starts, dense, y, weight))
    weight = np.ones(200)
    toxicity.trained(rows, y, weight, ["x", "y"])
    assert [n for n, _ in fits] == [200, 150, 150, 150, 150, 200]
    last = fits[-1][1][:, 0]
    assert last.min() >= 0 and last.max() <= 1
    fold = np.random.default_rng(9).permutation(200) % toxicity.FOLDS
    columns = {f: i for i, f in enumerate("abcdefgh")}
    flat = [np.array([columns[f] for f in r]) for r in rows]
    for k in range(toxicity.FOLDS):
        own = [flat[i] for i in np.flatnonzero(fold != k)]
        model = fit(toxicity.Linear(8, 0), np.concatenate(own), np.cumsum([0, *map(len, own)]), np.zeros((150, 0)), y[fold != k, 0].astype(float), weight[fold != k])
        for i in np.flatnonzero(fold == k):
            assert abs(last[i] - 1 / (1 + math.exp(-(model.b + model.w[flat[i]].sum())))) < 1e-6


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 16))
    rows = [(i, v.astype(float).tolist(), 0) for i, v in enumerate(x)]
    rows += [(400 + i, rows[i % 3][1], 0) for i in range(60)]  # copies and ties
    rows += [rows[7], rows[7], (7, rows[8][1], 0)]  # ids that repeat
    odd = [(900, None, 0), (901, [], 0), (902, [None] * 16, 0), (903, [float("nan")] * 16, 0), (904, [float("inf")] * 16, 0), (905, [0.0] * 16, 0), (906, [1.0] * 3, 0), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int"), rows


def nearest_by_brute_force(rows, k, every, score):
    """(query, rank, id, score), a query being the first vector of its id."""
    out = []
    for i in sorted({r[0] for r in rows if r[0] % every == 0}):
        q = min(r[1] for r in rows if r[0] == i)
        near = sorted((-score(q, r[1]), r[0]) for r in rows if r[0] != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return out


def integer_product(a, b):
    return sum((int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)) * (int(y) * 256 if abs(y) >= 2**53 else math.floor(256 * y)) for x, y in zip(a, b))


def tuples(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("cells", [2, 256])
def test_va_file(monkeypatch, spark, vectors, cells):
    monkeypatch.setattr(va_file, "CELLS", cells)  # 2: bounds are wide, and rounds of exact vectors needed
    table, rows = vectors
    rows = [*rows, (905, [0.0] * 16, 0)]
    assert tuples(va_file.top_k(table, k=5, every=5)) == nearest_by_brute_force(rows, 5, 5, integer_product)
    if cells == 256:
        assert tuples(va_file.top_k(table, k=3, every=7)) == nearest_by_brute_force(rows, 3, 7, integer_product)
        assert va_file.top_k(table.where("vec_id < 3"), k=5, every=2).count() == 4
        assert va_file.top_k(table.where("vec_id < 0"), k=5, every=2).count() == 0
        assert va_file.top_k(table, k=5, every=10**6).select("query_id").distinct().count() == 1  # id 0


def test_va_file_beyond_doubles(spark):
    """Scores that doubles can't tell apart, beyond 64 bits, and beyond what doubles hold."""
    rng = random.Random(18)
    for scale in (1e6, 1e12, 1e200):
        rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(4)]) for i in range(40)]
        rows += [(40 + i, [math.nextafter(v, scale) for v in rows[i][1]]) for i in range(20)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = nearest_by_brute_force(rows, 4, 10, integer_product)
        assert tuples(va_file.top_k(df, k=4, every=10)) == [(*w[:3], max(-(2**63), min(2**63 - 1, w[3]))) for w in want]


def test_ann(spark, vectors):
    table, rows = vectors
    want = nearest_by_brute_force(rows, 20, 20, lambda a, b: float(np.dot(a, b)))
    truth = {(q, i) for q, _, i, _ in want}
    got = ann_mih.nearest(table, k=20, every=20).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & truth) / len(truth) >= 0.9
    x = {}
    for r in rows:
        x.setdefault(r[0], []).append(r[1])
    for r in got:
        assert any(abs(r["score"] - np.dot(min(x[r["query_id"]]), v)) < 1e-9 for v in x[r["vec_id"]]) and r["vec_id"] != r["query_id"]
    assert len(got) == len(want) and {(r["query_id"], r["rank"]) for r in got} == {w[:2] for w in want}
    assert ann_mih.nearest(table.where("vec_id < 0"), k=20, every=20).count() == 0
    assert ann_mih.nearest(table.where("vec_id < 2"), k=20, every=1).count() == 2


def test_ann_recall_on_embeddings(spark):
    """On the given embeddings: every query's neighbours against brute force, and what is probed."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    truth = {(int(i), int(ids[j])) for a, i in enumerate(ids) if i % 20 == 0 for j in np.lexsort((ids, -s[a]))[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in ann_mih.nearest(table, k=20, every=20).collect()}
    assert len(got) == len(truth) and len(got & truth) / len(truth) >= 0.9
    codes = ann_mih.Codes(x, float(np.sqrt((x * x).sum(axis=1).max())), 20)
    tables = ann_mih.Tables(codes.of(x))
    queries = codes.of(x[:100], query=True)
    for q in queries:
        tables.within(q, codes.radius)
    assert tables.probed < 0.5 * 100 * len(x) and tables.found < 0.2 * 100 * len(x)


def test_hamming_tables_are_exact():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    codes[300:] = codes[rng.integers(0, 5, 200)] ^ (np.uint64(1) << rng.integers(0, 64, (200, 4)).astype(np.uint64))
    tables = ann_mih.Tables(codes)
    for radius in (0, 3, 9, 20, 110, 128, 256):
        d = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert (tables.within(codes[7], radius) == np.flatnonzero(d <= radius)).all()


def test_chunks_follow_content():
    rng = random.Random(10)
    c = cdc_dedup.Chunker()
    texts = [bytes(rng.choices(b"abcdefgh ", k=k)) for k in (0, 1, 40, 3000)] + [b"a" * 2000]
    of, pos, length, digest = c.chunks(texts)
    for i, t in enumerate(texts):
        own = of == i
        assert length[own].sum() == len(t) and (np.cumsum(length[own]) - length[own] == pos[own]).all()
    shifted = c.chunks([b"inserted " + texts[3]])[3]
    assert len({d for d, i in zip(digest, of) if i == 3} - set(shifted)) <= 2
    gear = c.gear.tolist()
    for i, t in enumerate(texts):  # every edge, from the definition, byte by byte
        h, hits, edges = 0, [], [0]
        padded = bytes(cdc_dedup.WINDOW + cdc_dedup.APART) + t
        for k, byte in enumerate(padded):
            h = ((h << 1) + gear[byte]) & 0xFFFF
            hits.append(h < (1 << 16) // cdc_dedup.EVERY)
            at = k - cdc_dedup.WINDOW - cdc_dedup.APART + 1
            if hits[-1] and not any(hits[-1 - cdc_dedup.APART : -1]) and 0 < at < len(t):
                edges.append(at)
        edges.append(len(t))
        want = [(a + x, min(b - a - x, cdc_dedup.LONGEST)) for a, b in zip(edges, edges[1:]) for x in range(0, b - a, cdc_dedup.LONGEST)]
        got = list(zip(pos[of == i].tolist(), length[of == i].tolist()))
        assert got == want
        assert [d for d, k in zip(digest, of) if k == i] == [hashlib.blake2b(t[a : a + n], digest_size=16).digest() for a, n in got]


def repeats_by_brute_force(rows):
    """Spans of each (id, text), from the chunks of all, chunk by chunk and byte by byte."""
    keys = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda x: (x[0], hash_of(x[1])))
    c, run = cdc_dedup.Chunker(), cdc_dedup.RUN
    first, later = {}, {}
    for key in keys:
        of, pos, length, digest = c.chunks([key[1].encode()])
        for p, n, d in zip(pos.tolist(), length.tolist(), digest):
            if first.setdefault(d, (key, p)) != (key, p):
                later.setdefault(key, []).append((p, p + n, d))
    out = {}
    for key, chunks in later.items():
        t = key[1].encode()
        groups = []
        for x in chunks:
            if groups and x[0] <= groups[-1][-1][1]:
                groups[-1].append(x)
            else:
                groups.append([x])
        spans = []
        for g in groups:
            if g[-1][1] - g[0][0] >= run:
                spans.append((g[0][0], g[-1][1]))
                continue
            for a, z, d in g:
                key2, a2 = first[d]
                u, z2 = key2[1].encode(), a2 + z - a
                room = max(a - z2, 0) if key2 == key else run
                left = right = 0
                while left < min(room, run, a, a2) and t[a - left - 1] == u[a2 - left - 1]:
                    left += 1
                while right < min(room - left if key2 == key else run, len(t) - z, len(u) - z2) and t[z + right] == u[z2 + right]:
                    right += 1
                spans.append((a - left, z + right))
        gone = []
        for a, z in sorted(spans):
            if gone and a <= gone[-1][1]:
                gone[-1] = (gone[-1][0], max(z, gone[-1][1]))
            else:
                gone.append((a, z))
        gone = [x for x in gone if x[1] - x[0] >= run or x == (0, len(t))]
        if gone:
            out[key] = gone
    return out


def hash_of(text):
    import xxhash

    return int.from_bytes(xxhash.xxh64(text.encode(), seed=42).digest(), "big", signed=True)


def test_cdc(docs, empty, rows):
    found = {(r["doc"], r["h"]): [tuple(x) for x in r["spans"]] for r in cdc_dedup.repeated(docs).collect()}
    assert found == {(i, hash_of(t)): spans for (i, t), spans in repeats_by_brute_force([(r[0], r[1]) for r in rows]).items()}
    assert {i for i, _ in found} >= {*(i for i in range(41, 45) if len(rows[i][1]) > 300), *range(46, 52)}  # copies, a shared passage
    assert not [i for i, _ in found if i < 40]  # first copies stay
    clean = cdc_dedup.deduplicated(docs)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    texts = {r[0]: r[1] for r in rows}
    for (i, _), spans in found.items():
        if texts[i].isascii():
            edges = [0, *[x for s in spans for x in s], len(texts[i])]
            assert by_id[i] == "".join(texts[i][a:b] for a, b in zip(edges[0::2], edges[1::2]))
    assert cdc_dedup.repeated(empty).count() == 0


def test_cdc_repeated_ids(spark):
    rng = random.Random(19)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (1, a), (2, a + b), (3, None), (3, ""), (None, a)]
    found = {(r["doc"], r["h"]): [tuple(x) for x in r["spans"]] for r in cdc_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i, hash_of(t)): s for (i, t), s in repeats_by_brute_force(rows).items()} and {i for i, _ in found} == {2}


def test_cdc_short_texts(spark):
    rng = random.Random(11)
    texts = [prose(rng, n) for n in (1, 2, 4, 6, 9, 12)]
    assert all(0 < len(t) < cdc_dedup.RUN for t in texts)
    rows = [(i, t) for i, t in enumerate([*texts, *texts, *[texts[3]] * 300, prose(rng, 9)])]
    found = {r["doc"]: [tuple(s) for s in r["spans"]] for r in cdc_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: [(0, len(t))] for i, t in rows[len(texts) : -1]}


def test_cdc_short_passages(spark):
    """Passages of 100 to 250 bytes with other text on both sides: all with a whole chunk in them are
    found, and what is found is an earlier copy."""
    rng = random.Random(12)

    def noise(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    passages = [noise(rng.randrange(100, 250)) for _ in range(200)]
    rows = [(i, noise(150) + passages[i % 200] + noise(150)) for i in range(400)]
    rows += [(400, noise(90) + passages[0] + noise(400) + passages[0])]
    found = {r["doc"]: r["spans"] for r in cdc_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, spans in found.items():
        for s in spans:
            piece = rows[i][1][s["start"] : s["end"]]
            assert len(piece) >= cdc_dedup.RUN and piece in (rows[0][1] if i == 400 else rows[i - 200][1])
    of, _, _, digest = cdc_dedup.Chunker().chunks([t.encode() for _, t in rows])
    sets = [{d for d, k in zip(digest, of) if k == i} for i in range(401)]
    assert set(found) == {400, *(i for i in range(200, 400) if sets[i] & sets[i - 200])}
    assert len(found) >= 0.95 * 200 + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cdc_dedup.repeated(empty).count() == 0


def shingle_model(t, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components_of(sets, percent=80):
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, empty, rows, width):
    sets = {r[0]: shingle_model(r[1], width) for r in rows if r[0] is not None}
    root = components_of(sets)
    got = minhash_dedup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.deduplicated(docs, width=width)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(root.values()))
    assert kept.where("doc_id is null").count() == sum(r[0] is None for r in rows)
    assert minhash_dedup.deduplicated(empty).count() == 0


def test_minhash_of_repeated_ids(spark):
    """Rows are told apart by id and words; words by their bytes, whatever the letters."""
    rng = random.Random(15)
    a, b, c = (prose(rng, 60) for _ in range(3))
    signs = [""]
    for _ in range(10):  # letters in an order that polynomial hashes can't tell from its complement
        signs = [signs[0] + signs[0].translate(str.maketrans("xy", "yx")) if signs[0] else "xy"]
    odd, even = signs[0], signs[0].translate(str.maketrans("xy", "yx"))
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (3, b.upper()), (3, c), (4, a), (7, "k " + odd), (8, "k " + even), (9, None), (9, " "), (9, " "), (10, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, nth int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df, width=2).collect())
    sets = {k: shingle_model(t, 2) for k, (_, t) in enumerate(rows)}
    root = components_of(sets)
    smallest = {v: min(rows[k][0] for k in root if root[k] == v) for v in root.values()}
    want = sorted((i, len(sets[k]), smallest[root[k]], smallest[root[k]] == i) for k, (i, _) in enumerate(rows))
    assert got == want and (8, 1, 8, True) in got
    kept = minhash_dedup.deduplicated(df, width=2).collect()
    # one of the rows of a, of b and of c; both long words; a null and a blank text of document 9
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] != 9) == sorted([(1, a), (1, b), (3, c), (7, "k " + odd), (8, "k " + even), (10, "")])
    assert sorted(str(r["text"]) for r in kept if r["doc_id"] == 9) == [" ", "None"]


def test_family_of_chained_copies(spark):
    """Copies of copies, each a little different: components as by brute force."""
    rng = random.Random(11)
    words = prose(rng, 120).split()
    texts = []
    for _ in range(120):
        base = list(rng.choice(texts)) if texts and rng.random() < 0.9 else list(words)
        for _ in range(rng.randrange(1, 9)):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        texts.append(base)
    sets = [shingle_model(" ".join(t), 2) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if v in (a, b) else v for v in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, width=2).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_signature_estimates_similarity():
    rng = np.random.default_rng(12)
    c = shingles.Circulant(252)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = c.signature(x[:900]), c.signature(x[100:])
    assert abs((a == b).mean() - 0.8) < 0.12


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in root} == root


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", "text", "bucket", F.coalesce(F.size(F.split(F.trim("text"), r"\s+")), F.lit(0)).alias("size"))
    got = mixing.mixed(sized).toPandas()
    total = {}
    for s, z in zip(got["source"], got["size"]):
        total[s] = total.get(s, 0) + z
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else unit * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in names:
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert abs(own["target"].iloc[0] - target[s]) < 1e-6 * max(1, target[s])
        assert abs((own["copies"] * own["size"]).sum() - target[s]) <= own["size"].max()
        assert own["copies"].between(0, 2).all()
    again = mixing.mixed(sized).toPandas()
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))
    assert mixing.mixed(empty.withColumn("size", F.lit(1))).count() == 0


def test_sentencepiece(docs, empty, rows):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    got = sentencepiece_bpe.encoded(docs, queries.tokenizer(), digests=True).collect()
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = ref.encode(by_id[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == ref.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    rng = random.Random(14)
    own = sentencepiece_bpe.model(queries.tokenizer())
    for _ in range(2000):
        t = "".join(rng.choice("ab ▁\n\té😀x́\x00ñaaa the ing<>s01中文字") for _ in range(rng.randrange(80)))
        assert own.encode(t) == ref.encode(t) and own.decode(ref.encode(t)) == ref.decode(ref.encode(t))
    assert sentencepiece_bpe.encoded(empty, queries.tokenizer()).count() == 0


def removed_by_brute_force(texts, length, keep_first=False):
    """Flags of the bytes to remove from each of texts; with keep_first an occurrence goes only if there
    is an earlier one, in the order of texts."""
    count, seen = {}, set()
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen if keep_first else count[w] > 1:
                gone[i : i + length] = True
            seen.add(w)
        out.append(gone)
    return out


def span_list(gone):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[0::2], edge[1::2])]


def cut_model(ids, data, gone):
    return [(i, len(t), int(g.sum()), len(span_list(g)), hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest()) for i, t, g in zip(ids, data, gone)]


@pytest.mark.parametrize("size", [1, 3000, 1 << 20])
def test_lpf(monkeypatch, docs, empty, rows, size):
    """size: bytes of a group that are sorted at once; 1 splits all groups down to single windows."""
    monkeypatch.setattr(lpf_dedup, "SORTED", size)
    data = [(r[1] or "").encode() for r in rows]
    want = cut_model([r[0] for r in rows], data, removed_by_brute_force(data, 400))
    got = lpf_dedup.cut_documents(docs, lpf_dedup.covered(docs, keep_first=False)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    if size > 1:
        assert lpf_dedup.cut_documents(empty, lpf_dedup.covered(empty)).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_lpf_keeps_the_first(monkeypatch, spark, size):
    """Rows that repeat id and text are one document, and its passages survive in it."""
    monkeypatch.setattr(lpf_dedup, "SORTED", size)
    rng = random.Random(16)
    t = prose(rng, 130)
    shared = [prose(rng, 20) for _ in range(4)]
    texts = {1: t, 2: t[: len(t) * 3 // 4] + prose(rng, 20), 3: prose(rng, 15) + t, 4: t, 5: None, 6: "", 7: "ab" * 300}
    texts |= {10 + i: "".join(rng.choices(shared, k=6)) + prose(rng, 5) for i in range(20)}
    rows = [*texts.items(), (1, t), (7, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (50, 400):
        got = {r["doc"]: [tuple(x) for x in r["spans"]] for r in lpf_dedup.covered(df, length=length).collect()}
        data = [(texts[i] or "").encode() for i in sorted(texts)]
        gone = removed_by_brute_force(data, length, keep_first=True)
        assert got == {i: span_list(g) for i, g in zip(sorted(texts), gone) if g.any()}


def test_longest_factors():
    """Suffix array, common prefixes, nearest smaller positions: against the definition."""
    rng = random.Random(17)
    for length in (16, 24, 40):
        text = bytes(rng.choices(b"ab", k=300)) * 2 + bytes(rng.choices(b"abc", k=100))
        data, starts = np.frombuffer(text, np.uint8), np.arange(len(text) - length + 1)
        previous, following = lpf_dedup.factors(lpf_dedup.Suffixes(data, starts, length))

        def common(i, j):
            n = 0
            while n < length and text[i + n] == text[j + n]:
                n += 1
            return n if n == length else n - n % lpf_dedup.WORD

        for i in starts.tolist():
            assert previous[i] == max((common(i, j) for j in range(i)), default=0)
            assert following[i] == max((common(i, j) for j in range(i + 1, len(starts))), default=0)
