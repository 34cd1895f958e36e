"""Chat formatting by relational means: turn structs are collected and sorted, adjacent turns of one role
are merged by an array aggregation, and the pieces are concatenated. Spark expressions only.

The template:  <|role|>ROLE<|text|>TEXT<|turn|>TEXT<|end|>  for each run of turns of one role.

Inside texts and roles every `<`, `[` and `\\` is followed by an inserted `\\`. So no control string of this
template or of others (`</s>`, `[INST]`, `<|im_end|>`, ...) can occur in what a user wrote, and taking out
the backslash after each of the three gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

ROLE, TEXT, TURN, END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"
ASSISTANT = "assistant"
#: Turns that one fold goes over.
BLOCK = 256
_STATE = "struct<role:string,pos:bigint,parts:array<string>,spans:array<struct<start:bigint,length:bigint>>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"[<\[\\]", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points of each
    text of the role `learn`, as it stands in formatted).

    Rows are ordered by turn (null first), ties by role and text. Null texts and roles count as empty.
    Rows with a null conv_id are one conversation; repeated rows are turns of their own. Extra columns are
    ignored. An empty table gives an empty result. A conversation is one row of the result and is put together
    by one task, in time that grows with its turns.
    """
    turns = F.array_sort(F.collect_list(F.struct(quoted(turn).isNotNull().alias("has"), quoted(turn).alias("turn"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))))
    # Two turns that compare equal are alike in all columns; null turns are told apart by `has`.
    told = rows.groupBy(quoted(conv_id).alias("conv_id")).agg(turns.alias("turns"))
    pieces = told.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))

    def merge(state: Column, t: Column) -> Column:
        opens = F.concat(F.lit(ROLE), escaped(t["role"]), F.lit(TEXT))
        mark = F.when(state["role"].isNull(), opens).when(state["role"] == t["role"], F.lit(TURN)).otherwise(F.concat(F.lit(END), opens))
        start = state["pos"] + F.length(mark)
        size = F.length(t["text"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            t["role"].alias("role"),
            (start + size).alias("pos"),
            F.concat(state["parts"], F.array(mark, t["text"])).alias("parts"),
            F.when(t["role"] == learn, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    # Blocks of turns are folded apart, so that arrays are copied as they grow only inside a block.
    def folded(first: Column) -> Column:
        before = F.get("turns", first - 1)["role"]
        empty = F.struct(before.alias("role"), F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")).cast(_STATE)
        state = lambda s: F.struct(s["pos"].alias("pos"), F.array_join(s["parts"], "").alias("text"), s["spans"].alias("spans"))
        return F.aggregate(F.slice("turns", first + 1, BLOCK), empty, merge, state)

    blocks = pieces.select("conv_id", F.transform(F.sequence(F.lit(0), F.size("turns") - 1, F.lit(BLOCK)), folded).alias("blocks"))
    ends = F.aggregate("blocks", F.array(F.lit(0).cast("bigint")), lambda at, b: F.concat(at, F.array(F.element_at(at, -1) + b["pos"])))
    starts = F.slice(ends, F.lit(1), F.size("blocks"))
    moved = F.zip_with("blocks", starts, lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    return blocks.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), F.flatten(moved).alias("loss_spans"))


def parse_chats(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: an array of (role, text), as they were before."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, TEXT, -1), r"<\|turn\|>"),
                lambda t: F.struct(unescaped(F.substring_index(F.substring_index(b, TEXT, 1), ROLE, -1)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between. A substring is counted off from the
    start of its string: a part is cut out for each block of spans, and spans from their part."""

    def part(first: Column) -> Column:
        some = F.slice(spans, first + 1, BLOCK)
        start, last = F.get(some, F.lit(0))["start"], F.get(some, F.size(some) - 1)
        return F.struct(some.alias("spans"), start.alias("start"), F.substring(formatted, (start + 1).cast("int"), (last["start"] + last["length"] - start).cast("int")).alias("text"))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(spans) - 1, F.lit(0)), F.lit(BLOCK)), part)
    cut = lambda p: F.transform(p["spans"], lambda s: unescaped(F.substring(p["text"], (s["start"] - p["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(F.flatten(F.transform(parts, cut)), "")


def digest(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted output: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    read = chats.withColumn("turns", parse_chats(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
