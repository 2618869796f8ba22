"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. When a stage begins, what it is given has been written, so the
scratch folders of the stage before it are deleted, and only those.

Cases, for every stage: null texts, ids and sources, empty and very long texts, repeated rows, ids
that repeat with other texts, and empty tables go through; columns beyond those of documents are
carried along under any name that doesn't begin with __gridloom.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, language_id, minhash_dedup, mixing, queries, secret_scan, sentencepiece_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes if its best language is less probable than this many times chance: what reads like
#: no language learned. Documents in two languages stay, as each has half of their positions.
LEAST_CHANCE = 1.2

_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """stage, with the scratch folders of the stage before it deleted first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.swept_scratch(spark, _left):
            return stage(spark, docs, sf_dir)

    return run


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The network's language of every document, where lang has none. Documents go that it can't name:
    null texts, texts without a letter, and those whose best language is hardly above chance."""
    net = language_id.learned(docs)
    named = language_id.predicted(docs, net, lang="__gridloom_lang", score="__gridloom_score")
    least = min(1.0, LEAST_CHANCE / len(net.labels)) if len(net.labels) > 1 else 0.0
    sure = (F.col("__gridloom_lang") != language_id.UNKNOWN) & (F.col("__gridloom_score") >= least)
    if not net.labels:  # nothing to learn from: only what can't have a language goes
        sure = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    told = named.where(sure).withColumn("lang", F.coalesce("lang", F.nullif("__gridloom_lang", F.lit(language_id.UNKNOWN))))
    return told.select(*[F.col(f"`{c}`") for c in docs.columns])


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the document
    with the smallest id stays. Rows that agree in id and text are one document, of which one row
    stays; rows that share an id but no text are documents each. Rows without an id stay."""
    return minhash_dedup.deduplicated(docs)


@tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. n_chars follows the text, if there is one."""
    clean = secret_scan.redacted(docs, common.scratch(spark, "secret-ledger"))
    return clean if "n_chars" not in docs.columns else clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one or two rows."""
    sized = docs.withColumn("__gridloom_words", common.word_count(F.col("text")))
    mixed = mixing.mixed(sized, size="__gridloom_words", key=("doc_id", "text"), prefix="__gridloom_")
    copies = F.col("__gridloom_copies")
    repeated = mixed.where(copies > 0).withColumn("__gridloom_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, counted and digested, with the digest of the decoded text."""
    return sentencepiece_bpe.encoded(docs, queries.tokenizer(), ids=False, digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: The network and the signatures have no SQL; tests compare with a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{common.shared_folder(spark)}/gridloom-pipeline/{common.unique(name)}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
