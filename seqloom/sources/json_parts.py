"""Large JSON documents read by many tasks.

Spark's text reader cuts a file into splits by bytes, with } as the end of a record, and streams the records of a
split through a task. What a split begins with, inside or outside a string and at which depth, follows from the
splits before it. So the file is read twice: first each split tells what it does to either state (brackets that
it closes and leaves open), and these are put together in order, a few bytes a split; then each split lists the
objects that begin and end in it. An object that a border cuts is joined from its pieces. A task holds one object
at a time, whatever the file's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_FILE = ("path", "start")


def _records(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "}")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The records of each split, in order."""
    lines = ((path, start, value) for batch in batches for path, start, value in zip(*[c.to_pylist() for c in batch.columns]))
    for key, group in groupby(lines, key=lambda line: line[:2]):
        yield key, (value + "}" for _, _, value in group)


def effect(records: Iterator[str]) -> list[tuple[bool, int, str]]:
    """For a split that begins outside and inside a string: whether it ends inside one, how many brackets it
    closes that were open before, and those that it leaves open."""
    states = [[False, 0, []], [True, 0, []]]
    for record in records:
        tokens = _TOKEN.findall(record)
        for state in states:
            inside, closed, opened = state
            for t in tokens:
                if t == '"':
                    inside = not inside
                elif inside or t[0] == "\\":
                    continue
                elif t in "{[":
                    opened.append(t)
                elif opened:
                    opened.pop()
                else:
                    closed += 1
            state[:2] = inside, closed
    return [(inside, closed, "".join(opened)) for inside, closed, opened in states]


def begins(effects: list[tuple]) -> dict[tuple[str, int], tuple[bool, str]]:
    """What each split (path, start, effect outside, effect inside) begins with: inside a string, open brackets."""
    out = {}
    for _, parts in groupby(sorted(effects), key=lambda e: e[0]):
        inside, opened = False, ""
        for path, start, *both in parts:
            out[path, start] = inside, opened
            ends, closed, opens = both[inside]
            inside, opened = ends, opened[: max(0, len(opened) - closed)] + opens
    return out


def _holds(opened: list[str]) -> bool:
    """Whether an object that begins here is one to be listed: a value of the outermost object, or an element of
    one of its arrays or of an outermost array."""
    return opened in (["{"], ["["], ["{", "["])


def objects(records: Iterator[str], inside: bool, opened: str) -> Iterator[tuple[str | None, str, str]]:
    """(key, kind, text) of a split: whole objects, the rest of one that began before (tail), the piece of one
    that does not end here (head), or a piece with neither end (middle). The key is null if it stands before the
    split; last of all the last key seen comes, with kind `key`."""
    stack, key, seen, word = list(opened), None, False, None
    depth = next((k for k in range(1, len(stack)) if stack[k] == "{" and _holds(stack[:k])), None)
    piece: list[str] | None = [] if depth is not None else None
    first = "tail" if piece is not None else "whole"
    cut = inside  # the string that the split begins in is not known from its start
    for record in records:
        at = 0  # where the piece, or the string, goes on in this record
        for m in _TOKEN.finditer(record):
            t = m[0]
            if t == '"':
                inside = not inside
                if piece is None and len(stack) == 1:
                    if inside:
                        word, at, cut = [], m.end(), False
                    elif word is not None:
                        word = ["".join(word) + record[at : m.start()]]
            elif inside or t[0] == "\\":
                continue
            elif t in "{[":
                if piece is None:
                    if len(stack) == 1 and stack[0] == "{":
                        if word is None or cut:
                            raise ValueError("a key that holds } lies on a split's border: set spark.sql.files.maxPartitionBytes")
                        key, seen = "".join(word), True
                    if t == "{" and _holds(stack):
                        piece, depth, at = [], len(stack), m.start()
                stack.append(t)
            elif stack:
                stack.pop()
                if piece is not None and len(stack) == depth:
                    yield key if seen else None, first, "".join(piece) + record[at : m.end()]
                    piece, first, word = None, "whole", None
        if piece is not None:
            piece.append(record[at:])
        elif inside and word is not None:
            word.append(record[at:])
    if piece is not None:
        yield key if seen else None, "middle" if first == "tail" else "head", "".join(piece)
    if seen:
        yield key, "key", ""


def read_objects(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, key, object: the objects that are values of a document's outermost object or elements of its arrays,
    as text, with the key they stand under (null for those of an outermost array). Other values are passed over."""
    records = _records(spark, path, pattern)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), rows in _splits(batches):
            (e0, c0, o0), (e1, c1, o1) = effect(rows)
            yield pa.RecordBatch.from_pydict({"path": [file], "start": [start], "e0": [e0], "c0": [c0], "o0": [o0], "e1": [e1], "c1": [c1], "o1": [o1]})

    told = records.mapInArrow(first, "path string, start long, e0 boolean, c0 long, o0 string, e1 boolean, c1 long, o1 string").collect()  # a row for each split
    known = begins([(r.path, r.start, (r.e0, r.c0, r.o0), (r.e1, r.c1, r.o1)) for r in told])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), rows in _splits(batches):
            out, size = [], 0
            for n, found in enumerate(objects(rows, *known[file, start])):
                out.append((file, start, n, *found))
                size += len(found[2])
                if size > 1 << 20 or len(out) >= 1000:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    kinds = [("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("kind", pa.string()), ("object", pa.string())]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
    if not any(opened for _, opened in known.values()):  # no file has more than one split
        found = records.mapInArrow(second, "path string, start long, n long, key string, kind string, object string")
        return found.where("kind = 'whole'").select("path", "key", "object")
    found = records.mapInArrow(second, "path string, start long, n long, key string, kind string, object string")
    # Pieces and last keys: a few rows for each split.
    few = found.where("kind <> 'whole'")
    keys = few.where("kind = 'key'").select("path", "start", "key").collect()
    before, last = [], {}
    named = {(r.path, r.start): r.key for r in keys}
    for file, start in sorted(known):
        before.append((file, start, last.get(file)))
        last[file] = named.get((file, start), last.get(file))
    inherited = F.broadcast(spark.createDataFrame(before, "path string, start long, before string"))
    order = Window.partitionBy("path").orderBy("start", "n")
    pieces = few.where("kind <> 'key'").withColumn("id", F.sum(F.when(F.col("kind") == "head", 1).otherwise(0)).over(order))
    joined = pieces.join(inherited, ["path", "start"]).groupBy("path", "id").agg(F.min_by(F.coalesce("key", "before"), F.struct("start", "n")).alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "object"))), lambda x: x["object"]), "").alias("object"))
    whole = found.where("kind = 'whole'").join(inherited, ["path", "start"]).select("path", F.coalesce("key", "before").alias("key"), "object")
    return whole.unionByName(joined.select("path", "key", "object"))
