"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases: each is the longest one already in the dictionary plus one character.
Each character is one step in a trie, however long its phrase, so the parse is linear in the text.
The phrases' hashes are dealt into BINS bins and each bin keeps its smallest (one-permutation minimum
hashing). The share of bins in which two fingerprints agree estimates how many phrases two texts share,
that is, how well one would help to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

BINS = 128
#: The dictionary starts anew after so many phrases, wherever in a text that is: its size is bounded (about
#: 100 MB) on texts of any length, and the parse still depends on the text only. Characters in a step.
MOST, STEP = 1 << 20, 1 << 18
EMPTY = np.iinfo(np.uint64).max
#: Rows in a range of ids, and the most ranges.
RANGE_ROWS, RANGES = 500, 10_000


class Parse:
    """The state of a parse: dictionary (a trie: node and character to node), begun phrase and its node, and
    signature. The state after some characters depends on them only, not on how they were fed."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.begun, self.node = "", 0
        self.least = np.full(BINS, EMPTY, np.uint64)

    def copy(self) -> "Parse":
        out = Parse()
        out.known, out.begun, out.node, out.least = dict(self.known), self.begun, self.node, self.least.copy()
        return out

    def feed(self, text: str) -> "Parse":
        for at in range(0, len(text), STEP):
            known, node, begun, start, found = self.known, self.node, self.begun, 0, []
            part = text[at : at + STEP]
            for i, c in enumerate(map(ord, part)):
                edge = node << 21 | c
                node = known.get(edge, 0)
                if not node:
                    known[edge] = len(known) + 1
                    found.append(begun + part[start : i + 1])
                    begun, start = "", i + 1
                    if len(known) >= MOST:
                        known.clear()
            self.begun, self.node = begun + part[start:], node
            if found:
                self._merge(found)
        return self

    def _merge(self, found: list[str]) -> None:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), ">u8").astype(np.uint64)
        np.minimum.at(self.least, (hashes % np.uint64(BINS)).astype(np.int64), hashes // np.uint64(BINS))

    def signature(self) -> np.ndarray:
        """16 bits for each bin; 0 if it is empty."""
        return np.where(self.least == EMPTY, 0, self.least % np.uint64(65535) + np.uint64(1)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of agreeing bins among those that either has filled; 1 for two empty texts."""
    used = (a != 0) | (b != 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def fingerprint(text: str | None) -> str:
    """A text's fingerprint in lowercase hex. Null counts as empty; equal texts have equal ones."""
    return Parse().feed(text or "").signature().tobytes().hex()


def _ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) with `range`, numbered by falling doc_id (null ids last), and where the first
    document of each range must also go: (first_id, to), at most RANGES rows."""
    n = docs.count()
    many = max(1, min(RANGES, n // RANGE_ROWS))
    steps = [(k + 1) / many for k in range(many - 1)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), steps, 10 * RANGES)).first()[0] if steps else []
    splits = [-float("inf"), *sorted(set(found or [])), float("inf")]
    keyed = docs.withColumn("d", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        put = Bucketizer(splits=splits, inputCol="d", outputCol="r", handleInvalid="keep").transform(keyed)
    else:
        put = keyed.withColumn("r", F.lit(0))
    put = put.withColumn("range", F.when(F.col("doc_id").isNull(), len(splits)).otherwise(F.lit(len(splits)) - F.col("r") - 1).cast("int")).drop("d", "r")
    firsts = sorted(put.groupBy("range").agg(F.max("doc_id")).collect())
    rows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    return put, docs.sparkSession.createDataFrame(rows, "first_id long, `to` int")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Documents are taken by falling doc_id (null ids last, ties by a hash of the text), the first one
    following the last. The edited text has its last floor(n_chars / 3) code points replaced by the first
    as many, or all, of the next document. doc_id has to be a whole number; texts of any length are parsed whole,
    two at a time. Null texts count as empty; one document alone is its own next;
    an empty table gives an empty result; extra columns are ignored.

    One shuffle deals ranges of ids over the tasks, with a copy of each range's first document for the
    range before it; inside a task the documents stream by, and only two are held at a time.
    """
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    put, firsts = _ranges(own)
    # At most RANGES rows: a proven bound.
    sent = put.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    both = F.when(F.col("to").isNotNull(), F.array("range", "to")).otherwise(F.array("range"))
    dealt = sent.select("doc_id", "text", F.posexplode(both).alias("extra", "range"))
    dealt = dealt.repartition("range").sortWithinPartitions("range", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = None, None, []
        for batch in batches:
            for key, body, extra, rng in zip(*batch.columns):
                rng, extra = rng.as_py(), extra.as_py()
                if rng != at:
                    held, at = None, rng
                elif held is None:
                    continue  # a further copy of the next range's first document
                body = body.as_py()
                n = len(body)
                head = Parse().feed(body[: n - n // 3])
                whole = head.copy().feed(body[n - n // 3 :]).signature()
                if held:
                    k, t, parse, sig = held
                    tail = body[: len(t) // 3]
                    edited = parse.feed(tail).signature()
                    digest = hashlib.sha256((t[: len(t) - len(t) // 3] + tail).encode()).hexdigest()
                    out.append((k, len(t), digest, sig.tobytes().hex(), edited.tobytes().hex(), likeness(sig, edited), likeness(sig, whole)))
                held = None if extra else (key.as_py(), body, head, whole)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
