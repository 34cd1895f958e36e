"""Repair of the structure of conversations: the cheapest edits after which an optional system turn is followed
by pairs of user and assistant turns.

A conversation is a lattice: position times state (nothing yet, after system, after user, after assistant), arcs
are edits with whole-number costs. Shortest paths are found by auction: every node has a price, at most an arc's
cost plus the price where it leads. The path from the origin is extended along an arc that meets this bound; where
none does, the last node's price is raised to the least bound and the path shrinks by it. When the path arrives,
the origin's price is its distance. Arcs that meet their bound and lead on to the end are the tight ones: every
cheapest path runs along them, and the least letter at each node gives the ASCII-least of them.

A price may be raised once for each unit of cost, so long conversations are cut into blocks of 32 turns, priced
from the last to the first: the prices at which a block can be entered are the costs of leaving the block before
it. Time is linear in the turns. Blocks that look alike are priced once in a task.

Texts are numbered by ranges and edited in blocks, so one conversation may hold any share of all rows. What one
task gets of a whole conversation is a letter for each turn; its audit is as long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, materialise, numbered, quoted

#: Turns of a block.
BLOCK = 32
#: Costs of edits. A turn that stays truncated costs LEFT more.
REROLE, DELETE, INSERT, LEFT = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; the role that a user or assistant put in has.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: What a turn is: its role's initial (system, user, assistant, another) and its fault (none, blank, duplicate,
#: truncated), as one letter.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
#: White space at a text's end.
SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
_FAR = 1 << 60


def letter(initial: int, fault: int) -> str:
    return chr(ord("A") + 4 * initial + fault)


def _kept(state: int, initial: int) -> int | None:
    """The state after a turn that is kept, if it may be."""
    if initial == 0:
        return 1 if state == 0 else None
    return initial + 1 if initial < 3 and NEXT[state] == initial + 1 else None


def _edits(code: str) -> list[list[tuple[str, int, int, int]]]:
    """For each state the edits at a turn: letter, cost, turns taken, state after it; by rising letter."""
    initial, fault = divmod(ord(code) - ord("A"), 4)
    out = []
    for state in range(4):
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
        if fault not in (1, 2):
            left = LEFT if fault == 3 else 0
            kept = _kept(state, initial)
            arcs += [("K", left, 1, kept)] if kept is not None else []
            arcs += [("R", REROLE + left, 1, NEXT[state])]
        out.append(arcs)
    return out


@dataclass
class Priced:
    """A block: the cost from each state before it to the end of the conversation, the edits of the block on
    the way, and the state after it."""

    costs: tuple[int, ...]
    edits: tuple[str, ...]
    after: tuple[int, ...]


@lru_cache(maxsize=100_000)
def priced(codes: str, leave: tuple[int, ...], last: bool = False) -> Priced:
    """Auction over one block. leave: the cost from each state after it to the end. The last block has no turns,
    only turns that are put in after all others."""
    end = 4 * (len(codes) + 1)
    arcs: list[list[tuple[str, int, int]]] = []
    for k, code in enumerate(codes):
        arcs += [[(name, cost, 4 * (k + taken) + to) for name, cost, taken, to in each] for each in _edits(code)]
    for state in range(4):
        arcs.append([("", leave[state], end)] if leave[state] < _FAR else [])
        if last:
            arcs[-1].append(("I", INSERT, 4 * len(codes) + NEXT[state]))
    price = [0] * (end + 1)
    for origin in range(4):
        path = [origin]
        while (at := path[-1]) != end:
            bound, to = min((cost + price[to], to) for _, cost, to in arcs[at])
            if price[at] < bound:
                price[at] = bound
                if at != origin:
                    path.pop()
            else:
                path.append(to)
    tight = [[(name, to) for name, cost, to in each if price[at] == cost + price[to]] for at, each in enumerate(arcs)]
    leads = [False] * end + [True]
    for layer in range(end - 4, -1, -4):
        for _ in range(3):  # turns put in lead from state to state of one layer, three times at most
            for at in range(layer, layer + 4):
                leads[at] = leads[at] or any(leads[to] for _, to in tight[at])
    edits, after = [], []
    for at in range(4):
        out = []
        while at != end:
            name, to = min((name, to) for name, to in tight[at] if leads[to])
            out.append(name)
            before, at = at, to
        edits.append("".join(out))
        after.append(before % 4)
    return Priced(tuple(price[:4]), tuple(edits), tuple(after))


def cheapest(blocks: list[str]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a conversation, and for each of its blocks the state before it and its edits; turns put in
    at the end come with the last block."""
    chain = [priced("", (0, _FAR, _FAR, 0), last=True)]
    base = 0
    for codes in reversed(blocks):
        least = min(chain[-1].costs)
        base += least
        chain.append(priced(codes, tuple(c - least for c in chain[-1].costs)))
    state, out = 0, []
    for block in reversed(chain[1:]):
        out.append((state, block.edits[state]))
        state = block.after[state]
    if out:
        out[-1] = (out[-1][0], out[-1][1] + chain[0].edits[state])
    return base + chain[-1].costs[0], out


def edited(state: int, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    """What edits make of a block's rows (role, text): how many rows were read before, role, text."""
    read = 0
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            yield read, ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = _kept(state, INITIALS.index(role[0]))
            yield read, role, text
        elif edit == "R":
            state = NEXT[state]
            yield read, ROLE[state], text
        read += 1


def examine(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns with their place in the conversation (conv, a key that is never null, conv_id, turn, role, text,
    idx), and without texts, but with what is wrong with them (conv, idx, turn, code). Turns come by number (null first), those of one number by a digest of role and text.
    A turn's first fault counts: blank, duplicate (role and text seen before), truncated."""
    key = F.coalesce(F.concat(F.lit("1"), quoted(conv_id).cast("string")), F.lit("0"))
    rows = turns.select(key.alias("conv"), quoted(conv_id).alias("conv_id"), quoted(turn).alias("turn"), quoted(role).alias("role"), quoted(text).alias("text"))
    # Short, since keys of ranges are sampled; equal turns have equal ones.
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = materialise(numbered(rows.withColumn("same", same), "conv", ["turn", "same"], "idx"))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    blank, cut = bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    small = rows.select("conv", "idx", "turn", "same", initial.alias("initial"), blank.alias("blank"), cut.alias("cut"))
    seen = small.groupBy("conv", "same").agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    small = join_skewed(small, seen, ["conv", "same"], "n", rows.count(), how="left")
    fault = F.when(F.col("blank"), 1).when(F.col("idx") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    return rows, small.select("conv", "idx", "turn", F.char(F.lit(ord("A")) + 4 * F.col("initial") + fault).alias("code"))


def audits(small: DataFrame) -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, and blocks
    (block, state, edits)."""
    gaps = small.groupBy("conv").agg(F.coalesce(F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count_distinct("turn")), F.when(F.max("turn").isNull(), 0)).cast("long").alias("gaps"))
    coded = small.groupBy("conv", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda x: x["code"]), "").alias("codes"))
    dealt = coded.repartition("conv").sortWithinPartitions("conv", "block")
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    kind = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*[c.to_pylist() for c in batch.columns]))
        out = []
        for conv, group in groupby(lines, key=lambda line: line[0]):
            blocks = [codes for _, _, codes in group]
            cost, edits = cheapest(blocks)
            whole = "".join(blocks)
            fault = [sum(whole.count(letter(i, f)) for i in range(4)) for f in (1, 2, 3)]
            initials = whole.translate({ord(letter(i, f)): "suax"[i] for i in range(4) for f in range(4)})
            legal = sum(a + b in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            out.append((conv, *fault, len(whole) - 1 - legal, cost, "".join(e for _, e in edits), [{"block": k, "state": s, "edits": e} for k, (s, e) in enumerate(edits)]))
            if len(out) >= 1000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    names = ["conv", *[c.split()[0] for c in counts.split(", ")], "audit", "blocks"]
    types = [pa.string(), *[pa.int64()] * 5, pa.string(), kind]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    told = dealt.mapInArrow(run, f"conv string, {counts}, audit string, blocks array<struct<block: long, state: int, edits: string>>")
    return gaps.join(told, "conv")


def repaired(rows: DataFrame, told: DataFrame, by: tuple[str, ...] = ("conv", "block")) -> DataFrame:
    """The turns after the edits: conv, idx, sub (their order), role, text. Blocks of turns meet their edits. Dealt
    by conv alone, a conversation's turns come in order, from one task."""
    edits = told.select("conv", F.explode("blocks").alias("b")).select("conv", "b.block", F.lit(None).cast("long").alias("idx"), F.col("b.state").cast("string").alias("role"), F.col("b.edits").alias("text"))
    both = edits.unionByName(rows.select("conv", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "role", "text"))
    dealt = both.repartition(*by).sortWithinPartitions("conv", "block", F.col("idx").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*[c.to_pylist() for c in batch.columns]))
        out, size = [], 0
        for (conv, block), group in groupby(lines, key=lambda line: line[:2]):
            _, _, _, state, edits = next(group)
            for sub, (read, role, text) in enumerate(edited(int(state), edits, ((r, t) for *_, r, t in group))):
                out.append((conv, block * BLOCK + read, sub, role, text))
                size += len(text)
                if len(out) >= 1000 or size > 1 << 22:
                    yield pack(out)
                    out, size = [], 0
        if out:
            yield pack(out)

    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["conv", "idx", "sub", "role", "text"])
    return dealt.mapInArrow(run, "conv string, idx long, sub long, role string, text string")


def repair(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The audits and the repaired turns of conversations (roles and texts without nulls).

    Null ids are one conversation. A conversation may have any number of turns, and texts any length. Rows that
    repeat each other are turns of their own: all but the first are duplicates. An empty table gives empty
    results; extra columns of any name are ignored. gaps is null where the numbers of turns lie so far apart that
    a long does not hold it."""
    rows, told = _audited(turns, **columns)
    return told, repaired(rows, told)


def _audited(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    rows, small = examine(turns, **columns)
    return rows, materialise(audits(small))


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of turns that come in order: role:text, joined by line feeds. A digest runs over a
    conversation from its first to its last letter, so one task reads it, turn by turn."""
    dealt = turns.select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*[c.to_pylist() for c in batch.columns]))
        out = []
        for conv, group in groupby(lines, key=lambda line: line[0]):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(group):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            out.append((conv, digest.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["conv", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["conv", "repaired_sha256"])

    return dealt.mapInArrow(run, "conv string, repaired_sha256 string")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation of the first table, also where `turns` has nothing left of it: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    key = F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))
    edited_rows, told = _audited(turns)
    after = repaired(edited_rows, told, ("conv",))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zero: Column = F.lit(0).cast("long")
    rows = conversations.select("conv_id", key.alias("conv")).distinct().join(told.drop("blocks").withColumn("there", F.lit(True)), "conv", "left").join(digests(after), "conv", "left")
    filled = [F.when(F.col("there"), F.col(c)).otherwise(zero).alias(c) for c in counts]
    return rows.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
