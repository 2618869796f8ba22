"""The whole chain on a small table, each stage against a brute-force version of what it was given."""

import hashlib
import math
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import components_of, prose, secrets_of, shingle_model

from gridloom.llm import common, language_id, mixing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own somewhere.
CLASH = ("target", "rate", "copies", "size", "score", "lang_pred", "label", "node", "bucket", "blob_id", "found", "h", "doc", "words", "n_tokens2", "__lang", "__words", "__size", "__source", "__part")


def table(spark):
    """Rows of the driver's table, and odd ones: nulls, empty texts, repeated rows and ids, secrets."""
    rng = random.Random(30)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()][:120]
    long = rows[3][1] + " " + prose(rng, 3000)
    odd = [
        (10**6, None, None, None, None),
        (10**6 + 1, "12 34", "en", "a", 5),
        (10**6 + 2, "password=abcdefgh is here and so are other words", "en", None, 48),
        (10**6 + 3, "", "en", "a", 0),
        (10**6 + 4, long, None, "a", len(long)),
        (10**6 + 5, long + " AKIA" + "Q" * 20, "en", "a", None),
        rows[5],
        rows[5],
        (rows[6][0], prose(rng, 50), "en", "b", 1),
        (rows[6][0], rows[6][1].upper(), "en", "b", 1),
        (None, rows[7][1], "en", "b", 1),
        (None, "token: abcdef123 " + prose(rng, 20), None, "é", 1),
        (10**6 + 6, "я ж ю " * 30, None, "b", None),
    ]
    return [*rows, *odd]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Per stage the rows it was given and those it returned."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(table(spark), DOCS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        seen[name] = (docs, after, [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()])
        docs = after
    return seen


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_language_stage(stages):
    docs, after, given, got = stages["language_id"]
    net = language_id.learned(docs)
    want = []
    for r in given:
        if r[1] is None or not re.search(r"[^\W\d_]", r[1]):
            continue
        p = net.documents([r[1].encode()])[0]
        if p.max() >= corpus_pipeline.LEAST_CHANCE / len(net.labels):
            want.append((*r[:2], r[2] or net.labels[int(p.argmax())], *r[3:]))
    same(got, want)
    assert after.columns == docs.columns and 0 < len(got) < len(given)


def test_near_duplicates_stage(stages):
    docs, after, given, got = stages["near_duplicates"]
    own = {k: r for k, r in enumerate(given) if r[0] is not None}
    root = components_of({k: shingle_model(r[1], 5) for k, r in own.items()})
    groups = {}
    for k, r in own.items():
        groups.setdefault(root[k], []).append(r)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(min(x[0] for x in g) for g in groups.values())
    left = [r for r in got if r[0] is not None]
    for g in groups.values():  # one row of each group, as it was, with its smallest id
        mine = [r for r in left if r in g]
        assert len({repr(r) for r in mine}) >= 1 and min(x[0] for x in g) in {r[0] for r in mine}
    same([r for r in got if r[0] is None], [r for r in given if r[0] is None])
    assert after.columns == docs.columns


def test_secrets_stage(stages):
    docs, after, given, got = stages["secret_scan"]

    def clean(t):
        spans, out, at = sorted(tuple(map(int, s.split(":")[1:])) for s in secrets_of(t).split(",") if s), "", 0
        for a, z in spans:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, z)
        return out + t[at:]

    want = [(r[0], clean(r[1]), *r[2:4], None if r[4] is None else len(clean(r[1]))) for r in given]
    same(got, want)
    assert sum(a[1] != b[1] for a, b in zip(sorted(given, key=repr), sorted(got, key=repr), strict=True)) >= 2
    assert after.columns == docs.columns


def test_mixing_stage(spark, stages):
    docs, after, given, got = stages["mixing"]
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in given]
    names = sorted({r[3] for r in given if r[3] is not None}, key=lambda s: s.encode()) + ([None] if any(r[3] is None for r in given) else [])
    total = {s: sum(w for r, w in zip(given, words) if r[3] == s) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(words)
    while open_:
        unit = left / sum((3, 1, 2)[names.index(s) % 3] for s in open_)
        full = {s for s in open_ if unit * (3, 1, 2)[names.index(s) % 3] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else unit * (3, 1, 2)[names.index(s) % 3]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    count = {}
    for r in got:
        count[r] = count.get(r, 0) + 1
    for s in names:
        own = sorted((w, r) for r, w in zip(given, words) if r[3] == s)
        mean = total[s] / len(own)
        low, high = -50.0, 50.0
        for _ in range(200):  # the tilt that meets the target, by halving
            lam = (low + high) / 2
            if sum(w * min(2.0, math.exp(min(lam * w / mean, 50))) for w, _ in own) > target[s]:
                high = lam
            else:
                low = lam
        rates = [min(2.0, math.exp(min(low * w / mean, 50))) for w, _ in own]
        many = {r: sum(x == r for _, x in own) for _, r in own}
        copies = sorted((w, r) for w, r in own for _ in range(1))
        taken, ran, at = 0, 0.0, 0
        while at < len(own):  # whole sizes at a time: within a size documents are interchangeable
            w = own[at][0]
            group = [i for i in range(at, len(own)) if own[i][0] == w]
            taken += sum(count.get(r, 0) for r in {own[i][1] for i in group})
            ran += sum(rates[i] for i in group)
            assert abs(taken - ran) < 1 + 1e-6 * len(own)
            at = group[-1] + 1
        assert all(count.get(r, 0) <= 2 * many[r] for _, r in copies)
    assert set(got) <= set(given) and after.columns == docs.columns
    again = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    same(got, [tuple(r) for r in again.collect()])


def test_tokens_stage(stages):
    import sentencepiece

    _, _, given, got = stages["sentencepiece"]
    ref = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer())
    want = []
    for r in given:
        ids = ref.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest()))
    same(got, want)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [r for r in table(spark) if r[1] != ""][:60]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and after.count() > 0
        assert after.select(*CLASH).distinct().collect() == [tuple(f"own {c}" for c in CLASH)]
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    with pytest.raises(ValueError):
        mixing.mixed(docs.withColumn("size", F.lit(1)))


def test_the_row_that_stays_is_defined(spark):
    """Of rows that agree in id and text, the one whose other columns come first."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", s, 5, {"k": s}) for s in ("d", "b", "c")] + [(2, text + " more", "en", "a", 5, None), (3, "", "en", "z", 0, None), (3, "", "en", "y", 0, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,string>"
    for n in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, kind).repartition(n), SF)
        assert sorted((r["doc_id"], r["source"], r["extra"]) for r in got.collect()) == [(1, "b", {"k": "b"}), (3, "y", None)]
    bare = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    assert corpus_pipeline.secrets(spark, bare, SF).collect()[0]["text"] == "[secret]"


def test_pipeline_sweeps_its_own_scratch_only(spark):
    """A result of another query can be read after the stages have run."""
    before = queries.op1_secret_scan(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[2:4]:
        stage(spark, docs, SF).count()
    assert before.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert common.word_count(F.lit(None).cast("string")) is not None
