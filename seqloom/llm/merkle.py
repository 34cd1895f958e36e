"""Manifests of datasets: a hash tree over the documents of each source and over the sources.

A node is the SHA-256 of up to 16 children's digests, in hexadecimal text. While a run of children is hashed,
the parent keeps a copy of its hash state before each child. To replace a child, the state before it is resumed
with the new digest and the siblings to its right; what is to its left is not hashed again.

Trees are built in storeys of three levels: 4,096 neighbours become one node in one task. So the
number of steps grows with the logarithm of the largest source to the base 4,096, no task holds more than a
chunk of digests, and a source of any size is spread over many chunks. Going down, each chunk gets one row:
its path, the siblings left and right on each level above it, about two bytes a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, quoted

#: Children of a node.
FANOUT = 16
#: Levels that one task builds of a chunk of nodes.
STOREY = 3
#: Rows that a task hands on at a time.
ROWS = 4096


def leaf_of(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and its text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Subtree:
    """The levels above a chunk of nodes, with the states that their parents keep. A chunk that is not alone in
    its tree has all levels of its storey; one that is alone ends at its single node."""

    def __init__(self, nodes: list[str], alone: bool, storey: int = STOREY):
        self.levels, self.states = [nodes], []
        while len(self.levels[-1]) > 1 if alone else len(self.states) < storey:
            kept, parents = [], []
            for k in range(0, len(self.levels[-1]), FANOUT):
                state = hashlib.sha256()
                for child in self.levels[-1][k : k + FANOUT]:
                    kept.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
            self.states.append(kept)
            self.levels.append(parents)
        self.top = self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Digests left and right of node `at` and of its ancestors, level by level."""
        out = []
        for level in self.levels[:-1]:
            k = at - at % FANOUT
            out.append(("".join(level[k:at]), "".join(level[at + 1 : k + FANOUT])))
            at //= FANOUT
        return out

    def fold(self, at: int, digest: str) -> str:
        """The top with another digest in place of node `at`."""
        for level, states in zip(self.levels, self.states):
            state = states[at].copy()
            state.update((digest + "".join(level[at + 1 : at - at % FANOUT + FANOUT])).encode())
            digest, at = state.hexdigest(), at // FANOUT
        return digest


class Path:
    """What is above a chunk, as text: left,right;left,right upwards."""

    def __init__(self, text: str):
        self.text = text
        self.steps = [tuple(s.split(",")) for s in text.split(";") if s]
        self.states = [hashlib.sha256(left.encode()) for left, _ in self.steps]

    def fold(self, digest: str) -> str:
        for kept, (_, right) in zip(self.states, self.steps):
            state = kept.copy()
            state.update((digest + right).encode())
            digest = state.hexdigest()
        return digest


_ROWS = "tree string, chunk long, idx long, digest string, name string, altered string, path string, root string, subroot string"


def _chunks(rows: DataFrame, storey: int, each: Callable[[list[tuple], int], Iterator[tuple]], schema: str) -> DataFrame:
    """each(rows of one chunk, a path first if there is one) for all chunks, one after the other in a task. Rows
    without a chunk (nodes, not paths) get theirs by idx."""
    rows = rows.withColumn("chunk", F.coalesce("chunk", F.expr(f"idx div {FANOUT**storey}")))
    whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in _ROWS.split(", "))])
    dealt = whole.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", F.col("idx").asc_nulls_first())
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in zip(*[c.to_pylist() for c in batch.columns]))
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])
        for _, group in groupby(lines, key=lambda line: line[:2]):
            out += each(list(group), storey)
            if len(out) >= ROWS:
                yield pack()
                out = []
        if out:
            yield pack()

    return dealt.mapInArrow(run, schema)


def _built(nodes: list[tuple], storey: int) -> Subtree:
    """A chunk that is not full is alone in its tree, if it is the first."""
    return Subtree([x[3] for x in nodes], nodes[0][1] == 0 and len(nodes) < FANOUT**storey, storey)


def _up(nodes: list[tuple], storey: int) -> Iterator[tuple]:
    yield nodes[0][0], nodes[0][1], _built(nodes, storey).top


def _down(rows: list[tuple], storey: int) -> Iterator[tuple]:
    (_, _, _, _, _, _, path, root, subroot), *nodes = rows
    tree = _built(nodes, storey)
    for at, node in enumerate(nodes):
        steps = [",".join(s) for s in tree.siblings(at)]
        yield node[0], node[2], ";".join([*steps, *([path] if path else [])]), root, subroot


def _leaves(rows: list[tuple], storey: int) -> Iterator[tuple]:
    (_, _, _, _, _, _, path, root, subroot), *nodes = rows
    tree, above = _built(nodes, storey), Path(path)
    upper = "".join(left + right for left, right in above.steps).encode()
    for at, (_, _, _, leaf, name, altered, *_) in enumerate(nodes):
        proof = hashlib.sha256("".join(left + right for left, right in tree.siblings(at)).encode())
        proof.update(upper)
        folded = above.fold(tree.fold(at, leaf if altered is None else altered))
        yield name, leaf, subroot, root, proof.hexdigest(), folded, folded == root


def _climb(nodes: DataFrame, storey: int) -> list[DataFrame]:
    """The nodes (tree, idx, digest) of each storey, up to one node for each tree."""
    storeys = [nodes]
    while (storeys[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        at = storeys[-1].select("tree", F.lit(None).alias("chunk"), "idx", "digest")
        storeys.append(materialise(_chunks(at, storey, _up, "tree string, idx long, digest string")))
    return storeys


def _descend(storeys: list[DataFrame], paths: DataFrame, storey: int, each: Callable, schema: str) -> DataFrame:
    """Paths (tree, idx, path, root, subroot) of the topmost nodes, carried down through the storeys."""
    for k, nodes in enumerate(reversed(storeys)):
        rows = nodes.withColumn("chunk", F.lit(None).cast("long")).unionByName(paths.select("tree", F.col("idx").alias("chunk"), "path", "root", "subroot"), allowMissingColumns=True)
        last = k == len(storeys) - 1
        paths = _chunks(rows, storey, each if last else _down, schema if last else "tree string, idx long, path string, root string, subroot string")
    return paths


def manifest(docs: DataFrame, altered: Column | None = None, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), storey: int = STOREY) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are leaves, by rising doc_id within their source (null ids first, equal ids by their digests, so rows
    that repeat each other may change places without effect). subroot is the source's, a null source is a source
    of its own and comes first; sources follow each other by their UTF-8 bytes and make up root. proof_sha256
    digests the siblings from the leaf up to root. `altered` is the digest of what is now at a leaf's place
    (null: the leaf itself); folded_root follows from it, and verified says whether it is root. The text may have
    any length. An empty table gives an empty result; extra columns of any name are ignored.
    """
    kind = dict(docs.dtypes)[doc_id]
    tree = F.coalesce(F.concat(F.lit("1"), quoted(source).cast("string")), F.lit("0"))
    leaves = docs.select(tree.alias("tree"), quoted(doc_id).alias("key"), leaf_of(*map(quoted, fields)).alias("digest"), (F.lit(None) if altered is None else altered).cast("string").alias("altered"))
    leaves = numbered(materialise(leaves), "tree", ["key", "digest"], "idx").withColumn("name", F.col("key").cast("string")).drop("key")
    storeys = _climb(leaves, storey)
    tops = materialise(numbered(storeys[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"], "idx"))
    upper = _climb(tops, storey)
    paths = upper[-1].select("tree", "idx", F.lit("").alias("path"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    if len(upper) > 1:
        paths = _descend([x.select("tree", "idx", "digest") for x in upper[:-1]], paths, storey, _down, "tree string, idx long, path string, root string, subroot string")
    names = tops.select("idx", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
    paths = materialise(paths.select("idx", "path", "root").join(names, "idx").select("tree", F.lit(0).cast("long").alias("idx"), "path", "root", "subroot"))
    out = _descend([leaves, *[x.select("tree", "idx", "digest") for x in storeys[1:-1]]], paths, storey, _leaves, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
