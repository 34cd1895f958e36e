"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere are removed.

Suffixes that share such a string must meet in one task, without a global sort of all suffixes:

1. Every window of LENGTH bytes has an anchor, the leftmost smallest hash among its K-byte strings. It
   depends on the window's bytes only, so equal windows have equal anchors at the same place in them.
   Windows that follow each other and have one anchor form a run: one row, about one for each 100 bytes.
2. Runs are grouped by their anchor's hash. Where a group's runs are all alike, they enter as one string
   with a count. Where they differ, each different run's bytes are sorted with the others of the group.
3. A group's strings get a suffix array by two-stage sorting: suffixes smaller than their successors are
   sorted directly, the others are induced by one scan over buckets of first bytes. Neighbours in the
   array whose common prefix has LENGTH bytes are repeats.
4. A group of more than HOT different strings is divided by longer common strings, down to whole windows,
   so that no task gets an unbounded group.
5. The repeated windows go back to their texts; only texts that hold some are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LARGE, discard, join_skewed, materialise, quoted

LENGTH, K = 400, 200
WINDOW = LENGTH - K + 1
#: Bytes hashed at a time; different strings that may meet in one group; block sizes for dividing others.
STEP, HOT, BLOCKS = 1 << 19, 2048, (64, 16, 4, 1)
#: Bits of the filter that keeps texts without repeats from being moved: at most so many, 8 MB. Beyond some 10^7
#: texts with repeats it lets more and more others through, and they drop out in the join.
MOST_BITS = 1 << 26

_ODD = np.uint64(0xD1342543DE82EF95)
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """A random word for each byte, and powers of an odd base and of its inverse modulo 2^64."""
    if not _TABLES:
        size = STEP + 4 * LENGTH
        words = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        base, back = np.full(size, _ODD), np.full(size, pow(int(_ODD), -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _TABLES.extend((words, np.cumprod(base), np.cumprod(back)))
    return _TABLES


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        words, power, self.back = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(words[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The smallest (or largest) of each `width` values that follow each other."""
    f, pad = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, pad, np.uint64)
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    heads = f.accumulate(rows, axis=1).ravel()
    tails = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(tails[:n], heads[width - 1 : width - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of several texts in one buffer; ends[i] is where the text of byte i ends.

    Returns (anchor hash, run hash, first window, last window, anchor place) for each run.
    """
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    hashes, n = Hashes(data), len(data) - LENGTH + 1
    at = np.arange(len(data) - K + 1)
    h = hashes.of(at, at + K)
    valid = at[:n] + LENGTH <= ends[:n]
    windows = at[:n][valid]
    if not len(windows):
        return none
    least = sliding(h, WINDOW, True)
    seen = least.copy()
    seen[~valid] = 0
    most = sliding(np.r_[np.zeros(WINDOW - 1, np.uint64), seen, np.zeros(WINDOW - 1, np.uint64)], WINDOW, False)[: len(h)]
    places = np.flatnonzero(h == most)
    which = np.searchsorted(places, windows)
    wrong = np.flatnonzero(h[places[which]] != least[windows])
    while len(wrong):
        which[wrong] += 1
        wrong = wrong[h[places[which[wrong]]] != least[windows[wrong]]]
    anchor = places[which]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = windows[new]
    last = np.r_[windows[np.flatnonzero(new)[1:] - 1], windows[-1:]]
    place = anchor[new]
    shape = ((place - first) * LENGTH + (last - first)).astype(np.uint64)
    return h[place], mixed(hashes.of(first, last + LENGTH) ^ (shape * _ODD)), first, last, place


def text_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, run, first, span, offset) of all runs in a column of texts, many texts at a time and
    very long ones piece by piece. Places count bytes from the text's start."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        if offsets[row + 1] - offsets[row] > STEP:
            size = int(offsets[row + 1] - offsets[row])
            for s in range(0, size, STEP):  # anchors in [s, s + STEP)
                b0, b1 = max(0, s - WINDOW + 1), min(size, s + STEP + LENGTH)
                data = values[offsets[row] + b0 : offsets[row] + b1]
                a, c, first, last, place = runs(data, np.full(len(data), len(data)))
                mine = (place + b0 >= s) & (place + b0 < s + STEP)
                yield np.full(mine.sum(), row), a[mine], c[mine], first[mine] + b0, (last - first)[mine], (place - first)[mine]
            row += 1
            continue
        stop = max(int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1, row + 1)
        starts = offsets[row : stop + 1] - offsets[row]
        data, rows = values[offsets[row] : offsets[stop]], np.repeat(np.arange(stop - row), np.diff(starts))
        a, c, first, last, place = runs(data, starts[1:][rows])
        yield rows[first] + row, a, c, first - starts[rows[first]], last - first, place - first
        row = stop


def two_stage_sort(strings: list[bytes], upto: list[int]) -> list[tuple[int, int]]:
    """(string, place) of the suffixes at places up to upto[string], in order of the suffixes.

    A suffix is S if it is smaller than the next one of its string, else L; the empty suffix counts as S.
    S suffixes are sorted directly. Scanning the buckets of first bytes in order, the L suffixes before
    the S ones, each suffix puts the one before it, if that is L, next into its bucket.
    """
    direct: dict[int, list[tuple[bytes, int, int]]] = {}
    kinds: list[bytearray] = []
    for k, s in enumerate(strings):
        n, last = len(s), upto[k]
        stop = last  # L suffixes after `upto` are needed up to the next S, which induces them
        while stop < n and not (stop + 1 < n and s[stop] < s[stop + 1]):
            stop += 1
        kind = bytearray(stop + 1)
        kind[stop] = 1
        for i in range(stop - 1, -1, -1):
            kind[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and kind[i + 1]) if i + 1 < n else 0
        for i in range(stop + 1):
            if kind[i]:
                direct.setdefault(s[i] if i < n else -1, []).append((s[i:], k, i))
        kinds.append(kind)
    induced: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int]] = []
    for c in range(-1, 256):
        here = induced.setdefault(c, [])
        for part in (here, [(k, i) for _, k, i in sorted(direct.get(c, ()))]):
            for k, i in part:  # `here` grows while it is scanned
                if i <= upto[k]:
                    out.append((k, i))
                if i and not kinds[k][i - 1]:
                    induced.setdefault(strings[k][i - 1], []).append((k, i - 1))
    return out


def common_prefix(x: bytes, i: int, y: bytes, j: int, most: int = LENGTH) -> int:
    """How many bytes x[i:] and y[j:] have in common at their start, counted up to `most`."""
    a, b = x[i : i + most], y[j : j + most]
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) >> 3)


def repeated(strings: list[bytes]) -> list[list[int]]:
    """For each string, the places of LENGTH-byte strings that also start at another place of any: those of
    neighbours in the suffix array whose common prefix is LENGTH."""
    order = two_stage_sort(strings, [len(s) - LENGTH for s in strings])
    shared = [common_prefix(strings[k], i, strings[m], j) for (k, i), (m, j) in zip(order, order[1:])]
    found: list[set[int]] = [set() for _ in strings]
    for (k, i), (m, j), n in zip(order, order[1:], shared):
        if n == LENGTH:
            found[k].add(i)
            found[m].add(j)
    return [sorted(x) for x in found]


def merged(starts: list[int]) -> tuple[list[int], list[int]]:
    """Sorted places as stretches that follow each other: firsts and lasts."""
    a = np.array(starts)
    cut = np.flatnonzero(np.diff(a) > 1)
    return a[np.r_[0, cut + 1]].tolist(), a[np.r_[cut, len(a) - 1]].tolist()


# Filters


def bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """A filter of bounded size for a column of 64-bit hashes: a clear bit means that a value is not among
    them. It grows with them up to MOST_BITS; when fuller it lets more rows through, and nothing else."""
    bits = 1 << 16
    n = hashes.count()
    while bits < min(32 * n, MOST_BITS):
        bits *= 2
    slot = F.pmod(F.col(name), F.lit(bits))
    words = hashes.groupBy((F.shiftright(slot, 5)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.int64) & np.int64(len(bits) * 32 - 1)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def text_key(text: Column) -> list[Column]:
    """Equal texts have equal keys; 96 bits and the length tell others apart."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes")]


KEY = ["k1", "k2", "n_bytes"]


def needed_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts (k1, k2, n_bytes, text), each once, of those keys; others are filtered out where they are read."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(keys, "k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column("k1").to_numpy())))

    return texts.mapInArrow(run, texts.schema).dropDuplicates(KEY)


def find_repeats(texts: DataFrame) -> DataFrame:
    """texts(k1, k2, n_bytes, text), one row per document, to the repeated windows (k1, k2, n_bytes, first,
    last: places of window starts that follow each other); a key may have several rows."""
    long = texts.where(F.col("n_bytes") >= LENGTH)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "c", *KEY, "first", "span", "off"]
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in KEY]
            for row, a, c, first, span, off in text_runs(batch.column("text")):
                cols = [a.view(np.int64), c.view(np.int64), *(k[row] for k in keys), first, span.astype(np.int32), off.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    # Texts are hashed once; the runs are written, about half as many bytes as the texts have. Anchors of
    # very many runs are few, and broadcast.
    every = materialise(long.mapInArrow(members, "a long, c long, k1 long, k2 int, n_bytes long, first long, span int, off int"))
    groups = every.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("differ")).where("n > 1")
    total = every.count()
    found = materialise(join_skewed(every, groups, "a", "n", total)).drop("n")
    discard(every)
    alike = found.where("not differ").select(*KEY, "first", (F.col("first") + F.col("span")).alias("last"))
    mixed_groups = found.where("differ")
    each = materialise(mixed_groups.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "span", "off")).alias("one")))
    wholes = each.where("n > 1").select("a", "c", F.lit(0).alias("from"), F.lit(None).cast("int").alias("to"), "n")
    strings = materialise(cut_strings(texts, each))
    pieces = materialise(sorted_repeats(strings).withColumn("n", F.lit(1).cast("long")).unionByName(wholes))
    # Nothing is known of single runs in which no window repeats: they drop out here. A passage of very many
    # documents is one string: it meets its runs by broadcast.
    told = join_skewed(mixed_groups, pieces, ["a", "c"], "n", total).select(*KEY, (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.coalesce("to", "span")).alias("last"))
    return alike.unionByName(told)


def cut_strings(texts: DataFrame, each: DataFrame) -> DataFrame:
    """One string of bytes for each different run of a group: a, c, single, off, s."""
    lists = each.select("a", "c", (F.col("n") == 1).alias("single"), "one.*").groupBy(*KEY).agg(F.collect_list(F.struct("a", "c", "single", "first", "span", "off")).alias("runs"))
    joined = needed_texts(texts, lists.select("k1")).join(lists, KEY).select("text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1)):
                data, own = text.as_py().encode(), own.as_py()
                for k in range(0, len(own), 1000):
                    part = own[k : k + 1000]
                    cols = [pa.array([r[x] for r in part], t) for x, t in (("a", pa.int64()), ("c", pa.int64()), ("single", pa.bool_()), ("off", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([data[r["first"] : r["first"] + r["span"] + LENGTH] for r in part], pa.binary())], names=["a", "c", "single", "off", "s"])

    return joined.mapInArrow(cut, "a long, c long, single boolean, off int, s binary")


def sorted_repeats(strings: DataFrame) -> DataFrame:
    """The repeated windows (a, c, from, to) of strings that occur once, group by group of a."""
    out, level = [], 0
    now = strings.select(F.col("a").alias("g"), "a", "c", "single", "off", F.lit(0).alias("from"), "s")
    while True:
        sizes = now.groupBy("g").agg(F.count("*").alias("size"))
        hot = materialise(sizes.where(F.col("size") > HOT).select("g"))
        if level == len(BLOCKS) or hot.isEmpty():
            out.append(sort_groups(now))
            break
        out.append(sort_groups(now.join(hot, "g", "left_anti")))
        now = materialise(divided(now.join(hot, "g", "left_semi"), BLOCKS[level]))
        # Equal strings enter once, with a count; those that occur more than once are told whole.
        stats = now.groupBy("g", "h").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n"), F.min(F.struct("a", "c")).alias("one"))
        now = materialise(now.join(stats, ["g", "h"]))
        out.append(now.where("single and n > 1").select("a", "c", "from", (F.col("from") + F.octet_length("s") - LENGTH).cast("int").alias("to")))
        now = now.where((F.col("one.a") == F.col("a")) & (F.col("one.c") == F.col("c"))).select("g", "a", "c", (F.col("single") & (F.col("n") == 1)).alias("single"), "off", "from", "s")
        level += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def divided(strings: DataFrame, block: int) -> DataFrame:
    """Strings cut by blocks of window places relative to the anchor. A part's group g is the hash of what
    all windows of its block have in common, and h that of its own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s, off, n = r["s"], r["off"], len(r["s"]) - LENGTH
                for b in range((-off) // block, (n - off) // block + 1):
                    lo, hi = max(0, b * block + off), min(n, b * block + block - 1 + off)
                    core = s[b * block + block - 1 + off : b * block + off + LENGTH]
                    own = s[lo : hi + LENGTH]
                    digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)
                    tag = b.to_bytes(4, "big", signed=True) + r["a"].to_bytes(8, "big", signed=True)
                    rows.append((digest(tag + core), digest((lo - off).to_bytes(4, "big", signed=True) + own), r["a"], r["c"], r["single"], off - lo, r["from"] + lo, own))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["g", "h", "a", "c", "single", "off", "from", "s"])

    return strings.select("a", "c", "single", "off", "from", "s").mapInArrow(run, "g long, h long, a long, c long, single boolean, off int, `from` int, s binary")


def sort_groups(strings: DataFrame) -> DataFrame:
    """Suffix arrays of the groups g (at most HOT strings each): a, c, from, to of repeats in single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                rows = []
                for r, starts in zip(held, repeated([r["s"] for r in held])):
                    if r["single"] and starts:
                        rows += [(r["a"], r["c"], r["from"] + x, r["from"] + y) for x, y in zip(*merged(starts))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "c", "from", "to"])
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["g"] != r["g"]:
                    yield from flush()
                held.append(r)
        yield from flush()

    dealt = strings.select("g", "a", "c", "single", "from", "s").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, c long, `from` int, `to` int")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats (and kept, the
    bytes that remain, for documents that lose some).

    Texts are UTF-8 bytes, null counts as empty; strings are judged on the input, each occurrence in the
    same or another document counts, and all of them are removed. Texts of under LENGTH bytes lose nothing.
    Repeated rows are documents of their own, so a text of LENGTH bytes that occurs twice goes as a whole.
    Extra columns are ignored; an empty table gives an empty result.
    """
    read = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    texts = read.select(*text_key(F.col("text")), "text")
    # All copies of a text have its spans: each enters a list once, whatever their number.
    spans = find_repeats(texts).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = materialise(spans)
    copies = texts.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > LARGE)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, n, body, own in zip(*(batch.column(c) for c in [*KEY, "text", "spans"])):
                data, own = body.as_py().encode(), own.as_py()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in own], 1)
                np.add.at(edge, [s["last"] + LENGTH for s in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((k1.as_py(), k2.as_py(), n.as_py(), int(gone.sum()), int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[*KEY, "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = needed_texts(texts, spans.select("k1")).join(spans, KEY).mapInArrow(apply, "k1 long, k2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    # The documents' own side holds no text: the digest of an unchanged one is made where it is read.
    own = read.select("doc_id", *text_key(F.col("text")), F.sha2("text", 256).alias("whole"))
    none = F.lit(0).cast("long")
    removed = F.coalesce("n_removed", none)
    # Texts of very many copies meet them by broadcast.
    changed = materialise(changed.join(copies, KEY, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))))
    return join_skewed(own, changed, KEY, "n", docs.count(), "left").select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), (removed > 0).alias("has_repeats"), "kept")
