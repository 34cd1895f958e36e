"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes b[0..n) have the fingerprint (sum b[i] * B^(n-1-i) mod p) for several primes p.
Fingerprints compose: of two pieces x, y that follow each other, f(xy) = f(x) * B^len(y) + f(y). So a
huge text is cut into pieces that different tasks hash, and the pieces' hashes are folded in order;
any cut gives the same value. Rows with equal fingerprints and lengths are then compared piece by
piece (each piece's smallest and largest text must agree, an aggregate that combines before the
shuffle); a class that failed would be split by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_skewed, map_arrow, materialise, quoted

#: Four primes under 2^31 with a base each: about 124 bits in all.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (911382323, 972663749, 1201456781, 1500450271)
#: Bytes in one step of the vectorised sum; also the most that a power table holds.
STEP = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    """B^(STEP-1) .. B^0 mod p."""
    if k not in _POWERS:
        p, out = PRIMES[k], np.ones(STEP, np.uint64)
        have, base = 1, BASES[k]
        while have < STEP:  # double the table: B^i for i in [have, 2 have)
            take = min(have, STEP - have)
            out[have : have + take] = out[:take] * np.uint64(pow(base, have, p)) % np.uint64(p)
            have += take
        _POWERS[k] = out[::-1].copy()
    return _POWERS[k]


def fingerprint(data: bytes) -> tuple[tuple[int, ...], int]:
    """The fingerprint of some bytes, one residue for each prime, and their number."""
    raw = np.frombuffer(data, np.uint8)
    got = [0] * len(PRIMES)
    for at in range(0, len(raw), STEP):
        piece = raw[at : at + STEP].astype(np.uint64)
        for k, p in enumerate(PRIMES):
            here = int(np.dot(piece, _powers(k)[STEP - len(piece) :]) % np.uint64(p))
            got[k] = (got[k] * pow(BASES[k], len(piece), p) + here) % p
    return tuple(got), len(raw)


def combine(x: tuple[tuple[int, ...], int], y: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int]:
    """The fingerprint of two pieces that follow each other."""
    return tuple((a * pow(b, y[1], p) + c) % p for a, b, c, p in zip(x[0], BASES, y[0], PRIMES)), x[1] + y[1]


def _as_bytes(got: tuple[tuple[int, ...], int]) -> bytes:
    return b"".join(int(v).to_bytes(4, "big") for v in got[0]) + int(got[1]).to_bytes(8, "big")


def _from_bytes(raw: bytes) -> tuple[tuple[int, ...], int]:
    return tuple(int.from_bytes(raw[4 * k : 4 * k + 4], "big") for k in range(len(PRIMES))), int.from_bytes(raw[16:], "big")


def _hashed(batches: Iterator[pa.RecordBatch], text: str, name: str) -> Iterator[pa.RecordBatch]:
    """Adds the fingerprint column name to each batch."""
    for batch in batches:
        found = [_as_bytes(fingerprint((t.as_py() or "").encode())) for t in batch.column(text)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, name])


def with_fingerprints(df: DataFrame, text: str, name: str, huge_chars: int) -> DataFrame:
    """df with the fingerprint (24 bytes: four residues and the length) of its column text.

    Texts of at most huge_chars are hashed where they are read. Longer ones are cut into pieces that
    are dealt out over the cluster, hashed there, and folded per text; only such texts are shuffled.
    """
    from pyspark.sql import types as T

    shape = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    long = F.coalesce(F.length(quoted(text)), F.lit(0)) > huge_chars
    small = map_arrow(df.where(~long), lambda it: _hashed(it, text, name), shape)

    key, no, piece, parts = fresh(df, "key", "no", "piece", "parts")
    big = df.where(long)
    texts = big.select(F.sha2(quoted(text), 256).alias(key), quoted(text).alias(piece)).dropDuplicates([key])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                k, t = k.as_py(), t.as_py()
                for i, at in enumerate(range(0, len(t), huge_chars)):
                    yield pa.RecordBatch.from_pydict({key: [k], no: pa.array([i], pa.int32()), piece: [t[at : at + huge_chars]]})

    pieces = texts.mapInArrow(cut, f"`{key}` string, `{no}` int, `{piece}` string").repartition(F.col(key), F.col(no))
    hashed = pieces.mapInArrow(lambda it: (b.drop_columns([piece]) for b in _hashed(it, piece, parts)), f"`{key}` string, `{no}` int, `{parts}` binary")

    @F.udf("binary")
    def fold(rows) -> bytes:
        """One call for each huge text, over at most 2^31 / huge_chars short hashes."""
        whole = ((0,) * len(PRIMES), 0)
        for row in rows:
            whole = combine(whole, _from_bytes(bytes(row[1])))
        return _as_bytes(whole)

    folded = hashed.groupBy(key).agg(fold(F.array_sort(F.collect_list(F.struct(no, parts)))).alias(name))
    again = big.withColumn(key, F.sha2(quoted(text), 256)).join(folded, key).select(*[quoted(c) for c in df.columns], quoted(name))
    return small.unionByName(again)


def classes(docs: DataFrame, text: str = "text", huge_chars: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """docs without its text, with class_key: equal for two rows exactly if their texts are equal.

    A null text counts as empty. Every row of docs is returned, repeated rows as often as they occur.
    class_key is the fingerprint, followed by the SHA-256 where the comparison found a collision.
    text_sha256 (lowercase hex) and n_bytes are added.
    """
    t, fp = fresh(docs, "text", "fp")
    rest = [c for c in docs.columns if c != text]
    read = docs.select(*[quoted(c) for c in rest], F.coalesce(quoted(text), F.lit("")).alias(t))
    hashed = with_fingerprints(read, t, fp, huge_chars)
    by = [F.xxhash64(F.col(t)).alias("h1"), F.hash(F.col(t)).alias("h2")]
    size = F.octet_length(F.col(t)).cast("long")
    keyed = materialise(hashed.select(*[quoted(c) for c in rest], F.sha2(F.col(t), 256).alias("text_sha256"), size.alias("n_bytes"), F.col(fp).alias("class_key"), *by))
    shared = keyed.groupBy("class_key").agg(F.count("*").alias("count")).where("count > 1").select("class_key")
    # Where the texts of those classes are is told by cheap hashes: texts that share them by chance meet other
    # classes too, which only makes those look unlike and be split by SHA-256.
    at = ["h1", "h2", "n_bytes"]
    places = keyed.groupBy(at).agg(F.count("*").alias("n"), F.collect_set("class_key").alias("keys"))
    places = materialise(places.select(*at, "n", F.explode("keys").alias("class_key")).join(shared, "class_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1)):
                k, x = k.as_py(), x.as_py()
                at = range(0, len(x), piece_chars)
                yield pa.RecordBatch.from_pydict({"class_key": pa.array([k] * len(at), pa.binary()), "no": pa.array(range(len(at)), pa.int32()), "piece": pa.array([x[i : i + piece_chars] for i in at], pa.string())})

    # A text of very many copies is one key: it meets its class by broadcast, and no copy is moved.
    again = join_skewed(read.select(F.col(t), size.alias("n_bytes"), *by), places, at, "n", keyed.count(), alike=True).select("class_key", t)
    pieces = again.mapInArrow(cut, "class_key binary, no int, piece string")
    unlike = materialise(pieces.groupBy("class_key", "no").agg((F.min("piece") != F.max("piece")).alias("unlike")).where("unlike").select("class_key").distinct())
    keyed = keyed.drop("h1", "h2")
    if unlike.isEmpty():  # no collision: no exchange by class
        return keyed
    split = F.when(F.col("unlike"), F.concat("class_key", F.unhex("text_sha256"))).otherwise(F.col("class_key"))
    return keyed.join(unlike.withColumn("unlike", F.lit(True)), "class_key", "left").withColumn("class_key", split).drop("unlike")


def _groups(docs: DataFrame, doc_id: str, text: str, **how) -> DataFrame:
    """One row per text and id: doc_id, n (rows that repeat both), keep_id, group_size, text_sha256."""
    keyed = classes(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), **how)
    per_id = materialise(keyed.groupBy("class_key", "doc_id", "text_sha256").agg(F.count("*").alias("n")))
    groups = per_id.groupBy("class_key").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("ids"))
    return join_skewed(per_id, groups, "class_key", "ids", per_id.count()).drop("class_key")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a null text counts as empty. keep_id is the largest
    doc_id of the group (null ids are smaller than any; null if there are no others). Exactly one row of
    a group is kept: of rows that repeat keep_id, an arbitrary one, as they are alike in both columns. Texts of
    any length are read whole, in pieces.
    Extra columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    each = _groups(docs, doc_id, text, **how).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest doc_id; all columns stay.

    Null texts count as empty, texts of any length are read whole; of rows that repeat text and doc_id, one stays.
    An empty table gives an empty result, and columns of docs may have any names.
    """
    sha, keep, n = fresh(docs, "sha", "keep", "n")
    groups = _groups(docs, doc_id, text, **how).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = materialise(groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("n").alias(n)))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(quoted(text), F.lit("")), 256))
    both = rows.join(kept, (rows[sha] == kept[sha]) & quoted(doc_id).eqNullSafe(F.col(keep))).drop(kept[sha])
    out = both.where(F.col(n) == 1)
    if not kept.where(F.col(n) > 1).isEmpty():  # repeated rows: the only case that needs another exchange
        out = out.unionByName(both.where(F.col(n) > 1).dropDuplicates([sha]))
    return out.select(*[quoted(c) for c in docs.columns])
