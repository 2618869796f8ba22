"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table
with one row per blob and scan, says which rules in which version have seen a blob and what they
found. A scan reads the ledger, runs only the (blob, rule version) pairs it lacks, appends them, and
joins the findings back to all paths that ever held the blob. A blob is scanned at one path, however
many share it: which one is decided on digests alone, and a text is shuffled by digest and path, past
the table of what is wanted, without being sorted or aggregated.

Positions come from two passes of the same expression: what lies between the matches
(split) and the matches themselves (regexp_extract_all), whose lengths are summed in a window.
Matches are the leftmost non-overlapping ones of each rule; a match whose counted group is too short
is dropped after matching. A rule's pattern may leave out short matches itself where that changes no
other match: a run of hex digits is one match or none, and what follows a short AKIA in its run is
shorter still; an assignment's short value, though, uses up text. Offsets are code points, ends
exclusive. Findings that overlap, of one rule's text with another's, are all listed, ordered by start,
then rule, then end.

Cases: null text is an empty blob; empty texts and texts without secrets have no findings; rows that
repeat give repeated results, and a path may hold several texts or be null; an empty table gives an
empty result and an unchanged ledger; columns other than the path and the text are ignored, so
clashing names do no harm (redacted() takes any names that don't begin with __gridloom).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import session, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least least characters. A text
    without any of hints (plain strings) can't match."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The three kinds of secret that a scan looks for.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

FINDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob_id", T.StringType()), T.StructField("scanned", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), *FINDING.fields])))])


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(df: DataFrame, path: str) -> DataFrame | None:
    """The ledger at path, None before the first scan."""
    try:
        return session(df).read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def unseen(versions: DataFrame, path: str, text: str, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob_id, todo (keys of the rules that lack the blob) and at (a path that holds it), one row per
    blob with any."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select(blob_id(F.col(f"`{text}`")).alias("blob_id"), F.col(f"`{path}`").alias("at")).groupBy("blob_id").agg(F.min("at").alias("at"))
    if ledger is None:
        return blobs.withColumn("todo", keys)
    seen = ledger.select("blob_id", F.explode("scanned").alias("key")).groupBy("blob_id").agg(F.collect_set("key").alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob_id", "left").withColumn("todo", todo).where(F.size("todo") > 0).drop("seen")


def scan(versions: DataFrame, todo: DataFrame, path: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of the blobs in todo: what ran and what it found."""
    none = F.array().cast("array<string>")
    texts = versions.select(blob_id(F.col(f"`{text}`")).alias("blob_id"), F.col(f"`{path}`").alias("at"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = todo.withColumnsRenamed({"blob_id": "blob2", "at": "at2"}).hint("shuffle_hash")
    blobs = texts.join(wanted, (F.col("blob_id") == F.col("blob2")) & F.col("at").eqNullSafe(F.col("at2")))

    def matches(r: Rule) -> Column:
        ready = F.array_contains("todo", r.key)
        for h in r.hints:
            ready = ready & F.contains("text", F.lit(h))
        return F.when(ready, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"m{r.name}")

    one_pass = blobs.select("blob_id", "text", *[matches(r) for r in rules])
    hit = one_pass.where(" or ".join(f"size(m{r.name}) > 0" for r in rules))
    gaps = [F.when(F.size(f"m{r.name}") > 0, F.transform(F.split("text", r.pattern, -1), F.length)).alias(f"g{r.name}") for r in rules]
    gapped = hit.select("blob_id", *gaps, *[F.col(f"m{r.name}") for r in rules])

    def zipped(i: int, r: Rule) -> Column:
        good = (lambda s: F.length(F.regexp_extract(s, r.pattern, r.group)) >= r.least) if r.group else (lambda s: F.length(s) >= r.least)
        return F.transform(
            F.col(f"m{r.name}"),
            lambda s, k: F.struct(F.lit(i).alias("kind"), k.alias("pos"), F.get(F.col(f"g{r.name}"), k).alias("gap"), F.length(s).alias("len"), good(s).alias("good")),
        )

    rows = gapped.select("blob_id", F.concat(*[zipped(i, r) for i, r in enumerate(rules)]).alias("x"))
    # rows that repeat path and text have been scanned each; their results are equal, and small
    rows = rows.groupBy("blob_id").agg(F.first("x").alias("x")).select("blob_id", F.explode("x").alias("x")).select("blob_id", "x.*")
    before = Window.partitionBy("blob_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(before)
    names = F.array(*[F.lit(r.name) for r in rules])
    found = rows.select("blob_id", "kind", "len", "good", end.alias("end")).where("good")
    finding = F.struct(F.get(names, F.col("kind")).alias("rule"), (F.col("end") - F.col("len")).alias("start"), "kind", "end")
    per_blob = found.groupBy("blob_id").agg(F.collect_list(finding).alias("found"))
    nothing = F.array().cast(LEDGER["found"].dataType)
    return todo.join(per_blob, "blob_id", "left").select("blob_id", F.col("todo").alias("scanned"), F.coalesce("found", nothing).alias("found"))


def findings(versions: DataFrame, ledger_path: str, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ledger_path up to date with versions (a path and a text per row), then
    return blob_id and found for all its blobs with any: what the current rules found, in order."""
    before = read_ledger(versions, ledger_path)
    todo = stored(unseen(versions, path, text, rules, before), "secret-todo")
    scan(versions, todo, path, text, rules).write.mode("append").option("compression", "zstd").parquet(ledger_path)
    ledger = session(versions).read.schema(LEDGER).parquet(ledger_path)
    order = F.array(*[F.lit(r.name) for r in rules])
    keys = F.array(*[F.lit(r.key) for r in rules])
    # a later version of a rule replaces what an earlier one found: only rows of current keys count
    own = F.filter("found", lambda x: F.exists("scanned", lambda k: (F.split_part(k, F.lit("@"), F.lit(1)) == x["rule"]) & F.array_contains(keys, k)))
    current = ledger.where(F.size("found") > 0).select("blob_id", F.transform(own, lambda x: F.struct(x["start"].alias("start"), (F.array_position(order, x["rule"]) - 1).cast("int").alias("kind"), x["end"].alias("end"))).alias("found"))
    # stored, so that the joins with it see two plain exchanges, which adaptive execution can split
    return stored(current.where(F.size("found") > 0).groupBy("blob_id").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found")), "secret-findings")


def scanned(versions: DataFrame, ledger_path: str, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob_id and found for each row of versions, after bringing the ledger up to date."""
    per_blob = findings(versions, ledger_path, path=path, text=text, rules=rules)
    paths = versions.select(F.col(f"`{path}`").alias("path"), blob_id(F.col(f"`{text}`")).alias("blob_id"))
    return paths.join(per_blob, "blob_id", "left").select(F.col("path").alias(path), "blob_id", F.coalesce("found", F.array().cast(T.ArrayType(FINDING))).alias("found"))


def spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of every finding, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: Column, name: str, rules: tuple[Rule, ...] = RULES) -> Column:
    kind = [r.name for r in rules].index(name)
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def redacted(versions: DataFrame, ledger_path: str, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """versions with every secret replaced by mark; columns and rows stay as they are. The ledger is
    brought up to date first."""
    found = findings(versions, ledger_path, path=path, text=text, rules=rules).select(F.col("blob_id").alias("__gridloom_blob"), F.col("found").alias("__gridloom_found")).hint("shuffle_hash")
    hit = versions.join(found, blob_id(F.col(f"`{text}`")) == F.col("__gridloom_blob"), "left")
    clean = F.when(F.col("__gridloom_found").isNotNull(), cut(F.col(f"`{text}`"), F.col("__gridloom_found"), mark)).otherwise(F.col(f"`{text}`"))
    return hit.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in versions.columns])


def cut(text: Column, found: Column, mark: str) -> Column:
    """text with each span of found replaced by mark; overlapping spans become one."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"])
        return F.struct(gap.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(found, state, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
