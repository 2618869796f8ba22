"""Product codes, formatted conversations and runs of words, against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, language_id, periodic_runs, queries, toxicity, yinyang_codes

# ---- runs of words ----


def runs_by_brute_force(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(rng):
    n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 8, 40])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 15)
        for i in range(a + p, min(n, a + rng.randrange(1, 80))):
            w[i] = w[i - p]
    return w


def test_runs_by_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        w = some_words(rng)
        ids = periodic_runs.numbers([x.encode() for x in w])
        assert periodic_runs.runs(ids) == runs_by_brute_force(w)
        assert periodic_runs.runs(ids, 3, 3) == runs_by_brute_force(w, 3, 3)


def test_long_texts_of_one_period_are_not_slow():
    assert periodic_runs.runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    assert periodic_runs.runs(np.arange(300_000, dtype=np.int32) % 701) == [(0, 300_000, 701)]


def test_collapsed(spark):
    rng = random.Random(8)
    texts = [" ".join(some_words(rng)) for _ in range(60)] + [None, "", " \t\n", "a a " * 9, "x " * 5, "x\v" * 6, "é ü " * 3000]
    rows = [(i % 50 if i % 7 else None, t, "kept") for i, t in enumerate(texts)] + [(1, texts[1], "kept")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    want = []
    for i, t, more in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        found = runs_by_brute_force(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
        want.append((i, more, len(found), *top, 1000 * top[1] // top[2] if found else None, found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(*r[:7], [tuple(x) for x in r[7]], r[8]) for r in periodic_runs.collapsed(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    digested = [tuple(r)[-2:] for r in periodic_runs.collapsed(docs, digests=True).collect()]
    assert sorted(digested) == sorted((hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r[7]).encode()).hexdigest(), hashlib.sha256(r[8].encode()).hexdigest()) for r in want)
    assert periodic_runs.collapsed(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.collapsed(docs.withColumn("period", F.lit(1)))


# ---- conversations ----


def chats():
    rows = [(1, 0, "user", "hi <| there <\\| x"), (1, 1, "assistant", "a😀<|im_end|>"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "assistant", "<"), (1, 5, "assistant", "<|im_more|>\\|")]
    rows += [(2, 0, "us\ner<|", "|x"), (None, None, None, None), (3, 0, "assistant", "z\n\n"), (5, 1, "user", "same"), (5, 1, "user", "same"), (5, None, "assistant", "first")]
    return rows + [(4, i, "user" if i % 300 < 150 else "assistant", f"t{i}<\\\\|" * (i % 3)) for i in range(5000)]


def test_chat_format_is_read_back(spark):
    rows = chats()
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, formatted string").repartition(4)
    made = chat_format.formatted(turns)
    assert made.columns == ["conv_id", "formatted", "loss"]
    got = {r["conv_id"]: r for r in made.withColumns({"back": chat_format.read_back(F.col("formatted")), "counted": chat_format.masked(F.col("formatted"), F.col("loss"))}).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        own = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == k])
        assert [tuple(b) for b in r["back"]] == [x[1:] for x in own]
        assert r["counted"] == [x[2] for x in own if x[1] == "assistant"]
    assert got[1]["formatted"].startswith("<|im_start|>user\nhi <\\| there <\\\\| x<|im_end|>\n<|im_start|>assistant\na😀<\\|im_end|><|im_more|><|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    # adjacent turns of a role are one block, wherever slices end
    assert got[4]["formatted"].count("<|im_start|>") == -(-5000 // 150) and got[5]["formatted"].count("<|im_more|>") == 1
    assert chat_format.formatted(turns.limit(0)).collect() == []


def test_chat_format_uses_no_python(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    made = queries.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    plan = made.toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    assert made.optimizedPlan().toString().count("sort_array") == 1  # not once per use


# ---- product codes ----


def codes_by_brute_force(x, parts, entries, rounds):
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assigned():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        code = assigned()
        for p in range(parts):
            for k in np.unique(code[:, p]):
                own = x[code[:, p] == k, p]
                books[p, k] = own.sum(0) // len(own)
    code = assigned()
    return code, sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts)), books


@pytest.mark.parametrize("spread", [3, 40, 4000])
def test_codes_by_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (700, 16))
    x[100:300] = x[100]  # a third are one vector; small spreads are full of ties
    x[:20:2] = x[1]
    rows = [(i, (v / 8).tolist(), None if i % 5 == 0 else i % 3, 1) for i, v in enumerate(x.tolist() and x)]
    odd = [(5, None, 1, 1), (6, [1.0, None] * 8, 1, 1), (7, [float("nan")] * 16, 1, 1), (8, [float("inf")] * 16, 1, 1), (9, [], 1, 1), (10, [1.0] * 8, 1, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, error int").repartition(5)
    found, books = yinyang_codes.compressed(table, parts=4, entries=8, rounds=5, scale=8)
    code, error, want = codes_by_brute_force(x, 4, 8, 5)
    assert books == want.tolist()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found.collect()) == [(i, c, e) for i, (c, e) in enumerate(zip(code.tolist(), error.tolist(), strict=True))]
    total = {}
    for (_, _, label, _), e in zip(rows, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    assert {(r["label"], r["label_error"]) for r in yinyang_codes.label_errors(found).collect()} == set(total.items())


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (16, 8))
    x = middles[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    books, groups = middles + 50, yinyang_codes.grouped(middles)
    assert len(np.unique(groups)) > 1
    p = yinyang_codes.Part(books, np.zeros(16), groups)
    code, upper, lower = p.first(x)
    moved = books - 7
    q = yinyang_codes.Part(moved, np.sqrt(((moved - books) ** 2).sum(1)), groups)
    again, _, _, count = q.again(x, code, upper, lower)
    assert (again == yinyang_codes.squared(x, moved).argmin(1)).all()
    assert count < 0.25 * x.shape[0] * 16


def test_codes_of_few_and_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    found, books = yinyang_codes.compressed(spark.createDataFrame([], kind))
    assert found.collect() == [] and books == [[] for _ in range(8)]
    few = spark.createDataFrame([(None, [1.0] * 8, None), (3, [2.0] * 8, None), (3, [0.5] * 8, 1)], kind)
    found, books = yinyang_codes.compressed(few, scale=2)
    assert books == [[[1], [4], [2]]] * 8  # by id, then components; null ids last
    assert sorted((r["error"], r["code"][0]) for r in found.collect()) == [(0, 0), (0, 1), (0, 2)]
    with pytest.raises(ValueError):
        yinyang_codes.compressed(spark.createDataFrame([(1, [1.0] * 9, 1)], kind))
    with pytest.raises(ValueError):
        yinyang_codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 1)], kind))


# ---- earlier operators ----


def test_letters():
    for text, want in (("½ ² 12", False), ("Ⅷ ①", False), ("_", False), ("", False), ("٣", False), ("1 é", True), ("中", True), ("ª", True)):
        assert language_id.has_letter(text) is want, text


def test_probabilities_do_not_depend_on_neighbours(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("ab cd efg hi jkl mnop".split()) + rng.choice("xyz") for _ in range(rng.randrange(60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("abx" in t), int("efgy" in t)) for i, t in rows], "doc_id long, bad int, toxic int")
    chain = toxicity.learned(docs, labels, ["bad", "toxic"])
    found = [sorted(map(tuple, toxicity.scored(docs.repartition(n, F.xxhash64("text", F.lit(n))), chain).collect())) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 300
    with pytest.raises(ValueError):
        toxicity.scored(docs.withColumnRenamed("doc_id", "p_toxic"), chain, key="p_toxic")
