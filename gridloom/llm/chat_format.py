r"""Conversations as one formatted text each, with the spans that a loss counts, by Spark expressions only.

The turns of a conversation are collected as structs and sorted. Adjacent turns of one role become one
block, by an aggregation over slices of the array (a block that goes on in the next slice is joined to
it when text is made, so that no array is built up turn by turn over a whole conversation):

    <|im_start|>role\ntext<|im_more|>text<|im_end|>\n

Markers are reversible: in texts and roles "<|" becomes "<\|", with one backslash more than there was
between the two, so "<|" is found in markers only; a line feed in a role is <|im_line|>. read_back()
gives the turns again from the formatted text alone.

The loss mask is the list of spans (start, end; code points, end exclusive) of assistant texts within the
formatted text. masked() cuts and restores them.

A conversation is one row of the result, so its text has to fit a row. Collecting is pre-aggregated
before the shuffle, so that a conversation with many turns comes as one array from each task.

Cases: null texts are empty; null roles are empty roles; turns that share a number are ordered by role, then
text, and null numbers come first; repeated rows are turns each; rows without a conversation id are one
conversation (id null); empty texts are turns; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, MORE, LINE = "<|im_start|>", "<|im_end|>", "<|im_more|>", "<|im_line|>"
#: Turns that are merged by one aggregation.
SLICE = 64
SPANS = "array<struct<start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def blocks(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns (role, text): adjacent turns of one role, within slices."""

    def add(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        more = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        own = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        same = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))["role"] == t["role"], F.lit(False))
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(own)))

    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    slices = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / SLICE).cast("int"))
    return F.flatten(F.transform(slices, lambda k: F.aggregate(F.slice(turns, k * SLICE + 1, SLICE), none, add)))


def pieces(merged: Column, assistant: str) -> Column:
    """The formatted text in pieces (text, loss), in order, of merged blocks."""
    plain, counted = (lambda t: F.struct(t.alias("text"), F.lit(False).alias("loss"))), (lambda t, on: F.struct(t.alias("text"), on.alias("loss")))

    def one(b: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(merged, i - 1)["role"])
        head = F.concat(F.lit(START), b["role"], F.lit("\n"))
        opening = F.when(i == 0, head).when(before == b["role"], F.lit(MORE)).otherwise(F.concat(F.lit(f"{END}\n"), head))
        texts = F.flatten(F.transform(b["texts"], lambda t, k: F.array(plain(F.when(k == 0, opening).otherwise(F.lit(MORE))), counted(t, b["role"] == assistant))))
        return F.when(i == F.size(merged) - 1, F.concat(texts, F.array(plain(F.lit(f"{END}\n"))))).otherwise(texts)

    return F.flatten(F.transform(merged, one))


def loss_spans(found: Column) -> Column:
    """Spans of the pieces that count, by slices: lengths are summed within one, then over slices."""
    lengths = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / SLICE).cast("int")), lambda k: F.slice(found, k * SLICE + 1, SLICE))

    def within(part: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            end = acc["at"] + F.length(p["text"])
            span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, first, step)

    def shifted(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPANS}>").alias("spans"))

        def step(acc: Column, p: Column) -> Column:
            moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
            return F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["spans"], F.array(moved)).alias("spans"))

        return F.flatten(F.aggregate(parts, start, step)["spans"])

    return let(F.transform(lengths, within), shifted)


def formatted(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss (array of start, end): one row per conversation."""
    clean = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    # escaped before the shuffle, where rows are spread; order is that of the texts as they were given
    order = (F.col(f"`{turn}`").alias("turn"), clean.alias("given"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("said"))
    own = turns.select(F.col(f"`{conversation}`").alias("__conv"), F.struct(*order).alias("t"))
    each = own.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def shown(t: Column) -> Column:
        return F.struct(F.replace(escaped(t["given"]), F.lit("\n"), F.lit(LINE)).alias("role"), escaped(t["said"]).alias("text"))

    made = let(F.transform("turns", shown), lambda t: let(blocks(t), lambda b: pieces(b, assistant)))
    both = let(made, lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), loss_spans(p).alias("loss")))
    return each.select(F.col("__conv").alias(conversation), both.alias("both")).select(F.col(f"`{conversation}`"), "both.formatted", "both.loss")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, from it alone."""
    parts = F.filter(F.split(formatted, re.escape(START)), lambda p, i: i > 0)

    def turns(p: Column) -> Column:
        at = F.instr(p, "\n")
        name = restored(F.replace(F.substring(p, F.lit(1), at - 1), F.lit(LINE), F.lit("\n")))
        body = F.substring(p, at + 1, F.length(p) - at - len(END) - 1)
        return let(F.struct(name.alias("role"), body.alias("body")), lambda b: F.transform(F.split(b["body"], re.escape(MORE)), lambda t: F.struct(b["role"].alias("role"), restored(t).alias("text"))))

    return F.flatten(F.transform(parts, turns))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts that the loss counts, as they were given, cut from a formatted text: what many spans
    reach over is cut first, then what some of them do, as each cut reads its text from the beginning."""

    def cut(whole: Column, start: Column, end: Column) -> Column:
        return F.substring(whole, (start + 1).cast("int"), (end - start).cast("int"))

    def cuts(text: Column, at: Column, spans: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.transform(spans, lambda s: restored(cut(text, s["start"] - at, s["end"] - at)))
        some = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / sizes[0]).cast("int"))).otherwise(F.array().cast("array<int>"))

        def within(own: Column) -> Column:
            first, last = F.get(own, F.lit(0))["start"], F.element_at(own, -1)["end"]
            near = F.struct(cut(text, first - at, last - at).alias("text"), first.alias("at"))
            return let(near, lambda n: cuts(n["text"], n["at"], own, sizes[1:]))

        return F.flatten(F.transform(some, lambda k: let(F.slice(spans, k * sizes[0] + 1, sizes[0]), within)))

    return cuts(formatted, F.lit(0).cast("bigint"), loss, (SLICE * SLICE, SLICE))
