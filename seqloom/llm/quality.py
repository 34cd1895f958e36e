"""A quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words, pairs of words, and singles, pairs and triples of word shapes (runs of
upper-case, lower-case, digits and other signs; a word that repeats the one before has a shape of its own). Each
n-gram falls in one of 2^20 buckets (`BUCKETS`), which bounds whatever is broadcast.

1. Naive Bayes: documents of either class that have a bucket are counted over all labelled rows; the log-count
   ratio of a bucket scales its indicator. Vectors have length 1, so that long texts weigh no more than short ones.
2. Support vectors: a linear model with hinge loss is fitted by dual coordinate descent to a bounded sample
   (`MOST_ROWS` rows of each class and `MOST_ENTRIES` indicators); another fifth of the rows that the sample is
   drawn from turns margins into probabilities (a logistic curve fitted with each class at its share of all rows).
3. Scores: one pass over all texts with the two arrays of weights, 12 MB, as a broadcast variable.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, quoted

BUCKETS = 1 << 20
#: The sample that the linear model is fitted to: rows of each class, and indicators in all.
MOST_ROWS = 8192
MOST_ENTRIES = 1 << 25
#: Added to the counts of each bucket.
SMOOTH = 1.0
#: Bound of the dual variables, sweeps over the sample at most, and the violation at which they end.
COST, SWEEPS, CLOSE = 1.0, 40, 1e-2
#: Characters that are split at a time.
STEP = 1 << 21

#: The shape of a word that equals the one before.
AGAIN = 7

#: Runs of one kind become one letter, and of a run of signs the first three stay.
_RUNS = (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[^\x00-\x7f]+", "é"), (r"([!-/:-@\[-\x60{-~]{3})[!-/:-@\[-\x60{-~]+", r"\1"))
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(WORD)


def shapes(words: pa.Array) -> pa.Array:
    for pattern, letter in _RUNS:
        words = pc.replace_substring_regex(words, pattern, letter)
    return words


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One bucket for each combination of numbers."""
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)) % np.uint64(BUCKETS)


def _buckets(words: pa.Array, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that end at each word, and the places of these words. before: how many words of
    its text come before a word."""
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    kinds = shapes(coded.dictionary).dictionary_encode()
    numbers = lambda each: np.array([zlib.crc32(w.encode()) for w in each.to_pylist()], dtype=np.uint64)
    word = numbers(coded.dictionary)[at]
    form = numbers(kinds.dictionary)[kinds.indices.to_numpy(zero_copy_only=False)][at]
    place = np.arange(len(at))
    one, two = place[before >= 1], place[before >= 2]
    form[one[at[one] == at[one - 1]]] = AGAIN
    kind = lambda k, x: np.full(len(x), k, dtype=np.uint64)
    found = [_mixed(kind(1, place), word), _mixed(kind(2, one), word[one - 1], word[one]), _mixed(kind(3, place), form), _mixed(kind(4, one), form[one - 1], form[one]), _mixed(kind(5, two), form[two - 2], form[two - 1], form[two])]
    return np.concatenate(found), np.concatenate([place, one, place, one, two])


def _sets(texts: list[str], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and buckets, sorted, each pair once; without n-grams that end in the first `skip` words."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words, doc = split.flatten(), pc.list_parent_indices(split).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    before = np.arange(len(doc)) - np.searchsorted(doc, doc)
    bucket, place = _buckets(words, before)
    if skip:
        kept = before[place] >= skip
        bucket, place = bucket[kept], place[kept]
    keys = np.unique(doc[place].astype(np.uint64) * np.uint64(BUCKETS) + bucket)
    return (keys // np.uint64(BUCKETS)).astype(np.int64), (keys % np.uint64(BUCKETS)).astype(np.int32)


def _long(text: str) -> np.ndarray:
    """The buckets of one text of any length, STEP characters at a time; the last three words go along, since a
    triple's first shape depends on the word before it."""
    found, start, carried = np.empty(0, dtype=np.int32), 0, []
    while start < len(text):
        m = _SPACE.search(text, start + STEP)
        end = m.end() if m else len(text)
        piece = text[start:end]
        found = np.union1d(found, _sets([" ".join([*carried, piece])], len(carried))[1])
        carried = [*carried, *_WORD.findall(piece)][-3:]
        start = end
    return found


def ngram_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's buckets in rising order."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > STEP:
            yield _long(texts[k])
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and len(texts[end]) <= STEP and (size == 0 or size + len(texts[end]) <= STEP):
            size += len(texts[end])
            end += 1
        doc, bucket = _sets(texts[k:end])
        yield from np.split(bucket, np.searchsorted(doc, np.arange(1, end - k)))
        k = end


@dataclass
class Model:
    """Weights of a bucket are its ratio times its support weight; score = logistic(slope * margin + shift)."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for b in ngram_sets(texts):
            r = self.ratio[b].astype(np.float64)
            length = np.sqrt(np.dot(r, r))
            margin = self.bias + (np.dot(r, self.weight[b]) / length if length else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -700, 700)))))
        return out


def ratios(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-count ratios. The smoothing is dealt to the classes by their size, so that a bucket that was never
    seen has ratio 0."""
    s1, s0 = 2 * SMOOTH * n1 / (n1 + n0), 2 * SMOOTH * n0 / (n1 + n0)
    return (np.log((ones + s1) / n1) - np.log((zeros + s0) / n0)).astype(np.float32)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """min |w|^2 / 2 + sum of cost * max(0, 1 - y (w x + bias)), the bias being the weight of a further
    coordinate 1: weights, bias and dual variables. rows: buckets and values of x, of length 1 or empty. One
    coordinate of the dual at a time, in an order drawn anew for each sweep from a fixed seed."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    square = np.array([1.0 + np.dot(x, x) for _, x in rows])
    draw = np.random.default_rng(11)
    for _ in range(SWEEPS):
        worst = 0.0
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            slope = y[i] * (np.dot(w[at], x) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                worst = max(worst, abs(step) * square[i])
                w[at] += step * y[i] * x
                bias += step * y[i]
                alpha[i] = new
        if worst < CLOSE:
            break
    return w, bias, alpha


def logistic(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins probabilities: weighted log loss, targets drawn in from 0 and 1 by one
    pseudo-row, by Newton's method with halved steps."""
    t = np.where(label == 1, (np.sum(label) + 1) / (np.sum(label) + 2), 1 / (np.sum(1 - label) + 2))
    loss = lambda p: np.sum(weight * (np.logaddexp(0, z := p[0] * margins + p[1]) - t * z))
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -700, 700)))
        g = weight * (p - t)
        h = weight * p * (1 - p)
        gradient = np.array([np.dot(g, margins), g.sum()])
        if np.abs(gradient).max() < 1e-9 * weight.sum():
            break
        second = np.array([[np.dot(h, margins**2), np.dot(h, margins)], [np.dot(h, margins), h.sum()]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(second, gradient), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return float(at[0]), float(at[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from; never those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _maybe_told(docs: DataFrame, told: DataFrame) -> DataFrame:
    """docs without most of those that have no row in told(doc_id): each id sets one of 16 to 32 times as many bits
    as there are ids, 2^28 at most (32 MB, which bounds what is broadcast). So unlabelled texts are not moved."""
    bits = 1 << 15
    while bits < min(16 * told.count(), 1 << 28):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = told.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("long").alias("__map")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("__bits"))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.withColumn("__map", (at / 32768).cast("long")).join(F.broadcast(maps), "__map")
    return rows.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).drop("__map", "__bits")


def _taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y, draw, buckets of each document that has a label and is not held out. A document's labels count once;
    those that contradict each other, and null ones, teach nothing. Very common ids need adaptive execution, which
    splits their rows."""
    same = F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
    told = labels.where(F.col("quality").isin(0, 1)).select(same, "quality").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("__most")).where(F.col("y") == F.col("__most")).drop("__most")
    told = told.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    # Moved whatever the size of the labels, so that cost grows in proportion.
    rows = _maybe_told(docs.select("doc_id", "text"), told).join(told.hint("merge"), "doc_id").select(F.col("y").cast("int").alias("y"), F.xxhash64("doc_id", "text").alias("draw"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                y, draw, text = batch.slice(k, 500).columns
                sets = list(ngram_sets(text.to_pylist()))
                yield pa.RecordBatch.from_arrays([y, draw, pa.array(sets, pa.list_(pa.int32()))], names=["y", "draw", "buckets"])

    return rows.mapInArrow(run, "y int, draw long, buckets array<int>")


def _counts(taught: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of either class that have a bucket, and of either class: BUCKETS rows reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            sets = batch.column(1)
            owner = y[pc.list_parent_indices(sets).to_numpy()]
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            for c in (0, 1):
                n[c] += np.bincount(flat[owner == c], minlength=BUCKETS)
                rows[c] += int((y == c).sum())
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0][at], rows[0])), pa.array(np.append(n[1][at], rows[1]))], names=["bucket", "zeros", "ones"])

    got = taught.select("y", "buckets").mapInArrow(run, "bucket long, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    at, zeros, ones = (got.column(k).to_numpy() for k in range(3))
    dense = np.zeros((2, BUCKETS), dtype=np.int64)
    real = at >= 0
    dense[0][at[real]], dense[1][at[real]] = zeros[real], ones[real]
    return dense[1], dense[0], int(ones[~real].sum()), int(zeros[~real].sum())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality 0 or 1). Without labels of both classes every
    score is their share, with one pseudo-row of either class."""
    taught = materialise(_taught(docs, labels))
    ones, zeros, n1, n0 = _counts(taught)
    if not n1 or not n0:
        discard(taught)
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = ratios(ones, zeros, n1, n0)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ratio)
    rate = [min(1.0, 1.25 * MOST_ROWS / n) for n in (n0, n1)]
    chance = (F.col("draw").cast("double") + 2.0**63) / 2.0**64
    sample = taught.where(chance < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value.astype(np.float64)
        rows, held, entries, taken = [], [], 0, [0, 0]
        for batch in batches:
            for y, draw, buckets in zip(*batch.columns):
                y, at = y.as_py(), buckets.values.to_numpy(zero_copy_only=False)
                if taken[y] >= 1.25 * MOST_ROWS or entries + len(at) > MOST_ENTRIES:
                    continue
                taken[y], entries = taken[y] + 1, entries + len(at)
                x = r[at]
                length = np.sqrt(np.dot(x, x))
                (held if draw.as_py() % 5 == 0 else rows).append((y, (at, (x / length).astype(np.float32)) if length else (at[:0], x[:0].astype(np.float32))))
        w, bias, slope, shift = np.zeros(BUCKETS), 0.0, 1.0, 0.0
        if rows:
            y = np.array([c for c, _ in rows])
            n = np.bincount(y, minlength=2)
            w, bias, _ = dual_descent([x for _, x in rows], 2.0 * y - 1, COST * len(y) / (2 * np.maximum(n[y], 1)))
        held = held if len({y for y, _ in held}) == 2 else rows + held
        if held:
            y = np.array([c for c, _ in held])
            n = np.bincount(y, minlength=2)
            margins = np.array([np.dot(w[at], x) + bias for _, (at, x) in held])
            slope, shift = logistic(margins, y, np.where(y == 1, n1, n0) / (n1 + n0) / np.maximum(n[y], 1) * len(y))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), *[pa.array([float(v)]) for v in (bias, slope, shift)]], names=["w", "bias", "slope", "shift"])

    # One task, for a sample of bounded size; the others choose it.
    w, bias, slope, shift = sample.repartition(1).sortWithinPartitions("draw").mapInArrow(run, "w binary, bias double, slope double, shift double").first()
    discard(taught)
    return Model(ratio, np.frombuffer(bytes(w), dtype=np.float32), bias, slope, shift)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (how likely label 1 is) of each row of docs, judged by its text alone: equal texts
    have equal scores. A null text counts as empty; empty texts have the score of a text that says nothing. Texts
    of any length are read whole, STEP characters at a time; an empty table gives an empty result; repeated rows
    stay; extra columns of any name are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each of BUCKETS buckets
    rows = docs.select(quoted(doc_id).alias("doc_id"), held_out(quoted(doc_id)).alias("held_out"), F.coalesce(quoted(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                key, held, body = batch.slice(k, 500).columns
                yield pa.RecordBatch.from_arrays([key, held, pa.array(sent.value.scores(body.to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
