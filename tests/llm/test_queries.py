"""The registered queries on the driver's smallest tables: against SQL, brute force or the library."""

import hashlib
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
from test_llm import cut_model, hash_of, removed_by_brute_force, repeats_by_brute_force

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def result(spark, name):
    return queries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    df = result(spark, name)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(x) for x in df.select(*names).collect()))) == sorted(map(repr, r.fetchall()))


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in result(spark, "op2_language_id").collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {d["doc_id"] for d in held}
    named = [d for d in held if d["lang"] is not None and any(unicodedata.category(c)[0] == "L" for c in d["text"] or "")]
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in named]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op3(spark, documents):
    got = {r["doc_id"]: r for r in result(spark, "op3_toxicity").collect()}
    assert len(got) == len(documents)
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([got[i]["toxic"] == bool(t) for i, t in marks.items() if i in got and t is not None]) >= 0.9


def test_op4(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    place = {i: k for k, i in enumerate(ids.tolist())}
    truth = {(int(i), int(ids[j])) for a, i in enumerate(ids) if i % 20 == 0 for j in np.lexsort((ids, -s[a]))[:20]}
    got = result(spark, "op4_ann_mih").collect()
    assert len(got) == len(truth) and len({(r["query_id"], r["vec_id"]) for r in got} & truth) / len(truth) >= 0.9
    for r in got:
        assert abs(r["score"] - x[place[r["query_id"]]] @ x[place[r["vec_id"]]]) < 1e-12
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all([(s, v) for _, s, v in sorted(own)] == sorted((s, v) for _, s, v in own) and sorted(k for k, _, _ in own) == list(range(1, 21)) for own in by_query.values())


def test_op5(spark, documents):
    found = repeats_by_brute_force([(d["doc_id"], d["text"]) for d in documents])
    want = []
    for d in documents:
        spans = found.get((d["doc_id"], d["text"]), [])
        want.append((d["doc_id"], len((d["text"] or "").encode()), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans)))
    assert sorted(tuple(r) for r in result(spark, "op5_cdc").collect()) == sorted(want)
    assert found and hash_of("") == hash_of("")


def test_op7(spark, documents):
    got = {r["doc_id"]: r for r in result(spark, "op7_mixing").collect()}
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    assert {i: r["size"] for i, r in got.items()} == sizes
    for source in {d["source"] for d in documents}:
        own = [got[d["doc_id"]] for d in documents if d["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)} and len({r["target"] for r in own}) == 1
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert abs(sum({d["source"]: got[d["doc_id"]]["target"] for d in documents}.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    again = {r["doc_id"]: r for r in result(spark, "op7_mixing").collect()}
    assert again == got


def test_op8(spark, documents):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    want = []
    for d in documents:
        ids = ref.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in result(spark, "op8_sentencepiece").collect()) == sorted(want)


def test_op10(spark, documents):
    data = [(d["text"] or "").encode() for d in documents]
    want = cut_model([d["doc_id"] for d in documents], data, removed_by_brute_force(data, 400))
    assert sorted(tuple(r) for r in result(spark, "op10_lpf").collect()) == sorted(want)
