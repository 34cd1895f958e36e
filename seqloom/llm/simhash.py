"""SimHash near-duplicates by segment popcounts.

Fingerprint: bit j is 1 if bit j is set in over half the hashes of the document's word shingles.

Candidates: the fingerprint is cut into segments of segment_bits bits and mapped to the vector of the
segments' bit counts. The Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints, so it is a lower bound, and near fingerprints lie near each other on the grid of counts.
The range join on that grid goes by projections: the coordinates are divided into groups, and with
`differ` differing bits at most `differ` groups have unequal counts, so two near fingerprints share a
cell of at least one projection onto all but `differ` groups. Each fingerprint is put into its cell of
every projection (pigeonhole: no near pair is lost). Inside a cell pairs are bounded by the Manhattan
distance, first of sums and then of whole vectors, and what is within it is verified exactly. Large cells
are divided by ranges of counts, then dealt into blocks that meet two by two.

The pipeline's near-dedup needs a similarity of shingle sets, 0.8, at which 39 of 256 bits differ: too many
for any projection that tells texts apart. There shingles are dealt to segments by their hashes, each segment
has a fingerprint of its own, and cells are projections onto the bit counts of one segment: the pigeonhole
goes by shingles that differ. Inside cells the Manhattan distance of the bit counts of whole fingerprints,
then their differing bits, bound what the sets then decide (the last part of this module).

Components: star contraction over links between distinct fingerprints, with written tables between
rounds. Fingerprints stay distributed throughout.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE, discard, fresh, join_skewed, map_arrow, materialise, quoted, sliced
from .suffixes import bitmap, passes

SEED = 42
#: Shingles in one step, for bounded memory on very long texts.
STEP = 1 << 15
#: Pairs compared in one step inside a cell.
BLOCK = 1 << 18
#: Fingerprints or shingle sets that meet as one block, and members of a cell that are compared all at once.
MEET, FEW = 16384, 64
#: Shingles of the sets that meet as one block, 32 MB; a block has more where one set has.
MEET_SHINGLES = 1 << 22
#: Bits of a shingle set's fingerprint, and how many may differ at a similarity of 0.8: 39 do on average, with
#: a deviation of 6; of unrelated sets 128 do, and their counts in segments of two bits are 96 apart.
PRINT, RADIUS = 256, 84
TIMES, PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 96), np.uint64, endpoint=False)
TIMES |= np.uint64(1)


def bit_sums(words: np.ndarray) -> np.ndarray:
    """For each bit of rows of big-endian words, most significant first, the number of rows that have it.

    Rows are added three at a time as one-bit full adders: sums stay at their weight, carries go to the
    next, and only the last two rows of a weight are unpacked.
    """
    total, weight = np.zeros(words.shape[1] * 64, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            m = len(words) // 3
            a, b, c, rest = words[:m], words[m : 2 * m], words[2 * m : 3 * m], words[3 * m :]
            x = a ^ b
            carries.append((a & b) | (x & c))
            words = np.concatenate((x ^ c, rest))
        for row in words:
            total += weight * np.unpackbits(row.view(np.uint8)).astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return total


def shingles_of(text: str | None, words: int) -> Iterator[bytes]:
    """The word shingles of a text, repeats included. A-Z are lower-cased; words are split at ASCII white
    space. A text of fewer words than a shingle has is one shingle; one without words has none."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return iter([b" ".join(w)] if w else [])
    return map(b" ".join, zip(*(itertools.islice(w, k, None) for k in range(words))))


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """The fingerprint of a whole text, most significant bit first; zero if it has no words.

    Of 64 bits, a hash is the shingle's XXH64 with seed 42; more bits are XXH64 with the seeds 42, 43, ...
    one after the other.
    """
    shingles = shingles_of(text, words)
    seeds, total, n = [SEED + k for k in range(bits // 64)], np.zeros(bits, np.int64), 0
    digest = xxhash.xxh64_digest
    while part := list(itertools.islice(shingles, STEP)):
        columns = [np.frombuffer(b"".join([digest(x, seed) for x in part]), np.uint64) for seed in seeds]
        total += bit_sums(np.stack(columns, axis=1))
        n += len(part)
    return np.packbits(total * 2 > n).tobytes() if n else bytes(bits // 8)


def with_fingerprints(docs: DataFrame, text: str, name: str, words: int, bits: int) -> DataFrame:
    """docs without its text, with the fingerprint (binary) as column name."""
    from pyspark.sql import types as T

    rest = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([fingerprint(t.as_py(), words, bits) for t in batch.column(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), got], names=[*(f.name for f in rest), name])

    return map_arrow(docs, run, T.StructType([*rest, T.StructField(name, T.BinaryType())]))


# Cells


class Grid:
    """The grid on vectors of segments' bit counts. Its cells are keyed by projections onto groups of
    coordinates: with at most `differ` differing bits at most `differ` groups of counts are unequal, so a near
    pair shares the cell of at least one choice of the other groups."""

    def __init__(self, bits: int = 64, segment_bits: int = 2, differ: int = 3, groups: int = 6):
        self.bits, self.segment_bits, self.differ = bits, segment_bits, differ
        n = bits // segment_bits
        cut = [list(range(k * n // groups, (k + 1) * n // groups)) for k in range(groups)]
        self.keys = [sum(chosen, []) for chosen in itertools.combinations(cut, groups - differ)]

    def counts(self, prints: np.ndarray) -> np.ndarray:
        """(n, bits / 8) bytes to (n, segments) bit counts."""
        ones = np.unpackbits(prints, axis=1)
        return ones.reshape(len(prints), -1, self.segment_bits).sum(axis=2, dtype=np.uint8)

    def cells(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        """For each projection, the key of each fingerprint's cell."""
        counts = self.counts(prints).astype(np.uint64)
        for k, chosen in enumerate(self.keys):
            key = np.full(len(prints), k + 1, np.uint64)
            for c in chosen:  # a 64-bit mix of the coordinates: cells that collide only add candidates
                key = mixed(key ^ counts[:, c])
            yield key

    def finer(self, cells: np.ndarray, prints: np.ndarray) -> Iterator[np.ndarray]:
        """Large cells divided by a range join: the counts of both halves of the bits, on a grid as wide as
        near pairs can differ. Each fingerprint goes to its own square and the three beside and above it, so a
        near pair meets in the square of its larger coordinates."""
        counts = self.counts(prints).astype(np.int64)
        half = counts.shape[1] // 2
        u, v = (x.sum(axis=1) // (self.differ + 1) for x in (counts[:, :half], counts[:, half:]))
        for du, dv in itertools.product((0, 1), repeat=2):
            yield mixed(mixed(cells ^ (u + du).astype(np.uint64)) ^ (v + dv).astype(np.uint64))


def mixed(key: np.ndarray) -> np.ndarray:
    key = key * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def forest(prints: np.ndarray, counts: np.ndarray, differ: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most `differ` bits apart, as positions, among the members of a cell.

    A range join under the Manhattan distance of bit counts, which is at most the number of differing bits:
    members are sorted by their sum of counts, and each meets those whose sum is within `differ` (the
    coarsest bound), then those whose vector is, and what is left is compared exactly. In a search each
    member meets those not reached yet: a dense cell costs about one step, and makes no more links than it
    has members.
    """
    total = counts.sum(axis=1, dtype=np.int64)
    left = np.argsort(total, kind="stable")
    out: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            low, high = np.searchsorted(total[left], (total[at] - differ, total[at] + differ + 1))
            near = np.zeros(len(left), bool)
            for i in range(low, high, BLOCK):
                some = left[i : min(i + BLOCK, high)]
                far = np.abs(counts[some].astype(np.int16) - counts[at]).sum(axis=1)
                close = np.flatnonzero(far <= differ)
                near[i + close] = np.bitwise_count(prints[some[close]] ^ prints[at]).sum(axis=1) <= differ
            for b in left[near]:
                out.append((at, int(b)))
                todo.append(int(b))
            left = left[~near]
    return out


def packed(column: pa.Array, nbytes: int) -> np.ndarray:
    """A binary column of equally long values as rows of bytes."""
    fixed = column.cast(pa.binary()).cast(pa.binary(nbytes))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * nbytes : (fixed.offset + len(fixed)) * nbytes].reshape(-1, nbytes)


def links(prints: DataFrame, name: str, grid: Grid) -> DataFrame:
    """Links (a, b) between distinct fingerprints of prints, at most grid.differ bits apart; a connected near
    group gets a connected set of links.

    Cells of up to MEET fingerprints meet in one task. Larger ones are passed on, divided by ranges of counts,
    and what is still larger is dealt into blocks that meet two by two: no task holds more than 2 * MEET of a
    cell's fingerprints, and no near pair is left out.
    """
    nbytes = grid.bits // 8
    kinds = pa.schema([("cell", pa.int64()), ("fp", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).cast(pa.binary())
                for key in grid.cells(packed(own, nbytes)):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), own], schema=kinds)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).cast(pa.binary())
            for key in grid.finer(batch.column(0).to_numpy().view(np.uint64), packed(own, nbytes)):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), own], schema=kinds)

    out = []
    now = prints.select(quoted(name)).distinct().mapInArrow(spread, "cell long, fp binary")
    for divide in (lambda rows: rows.mapInArrow(finer, "cell long, fp binary"), lambda rows: _blocks(rows, MEET)):
        met = materialise(_meet(now, grid, MEET))
        out.append(met.where("b is not null").select("a", "b"))
        large = met.where("b is null").select("cell", F.col("a").alias("fp"))
        if large.isEmpty():
            break
        now = divide(large)
    else:
        out.append(_meet(now, grid, 1 << 40).select("a", "b"))  # about 2 * MEET in each
    return functools.reduce(DataFrame.unionByName, out).distinct()


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows(cell, fp) of large cells, dealt into blocks of about `most`, any two of which meet in a cell of
    their own; the cell's number of rows decides how many."""
    sized = rows.join(rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("p")), "cell")
    own = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    paired = sized.withColumn("own", own).select("cell", "fp", F.explode(pairs).alias("x"), "p").where("x.i < x.j or p = 1")
    return paired.select(F.xxhash64("cell", "x.i", "x.j").alias("cell"), "fp")


def _meet(rows: DataFrame, grid: Grid, most: int) -> DataFrame:
    """rows(cell, fp) to the links (a, b) inside each cell of up to `most` rows, and the rows (cell, a) of
    larger ones, with b null."""
    nbytes = grid.bits // 8
    shape = pa.schema([("cell", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def found(cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """Whole cells of up to `most` rows."""
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends = np.r_[starts[1:], len(cells)]
        many = ends - starts > 1
        words, counts = rows.view(np.uint64), grid.counts(rows)
        a, b, at = [], [], []
        for s, e in zip(starts[many], ends[many]):
            for i, j in forest(words[s:e], counts[s:e], grid.differ):
                a.append(rows[s + i].tobytes())
                b.append(rows[s + j].tobytes())
                at.append(int(cells[s]))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=shape)

    def passed(cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array([r.tobytes() for r in rows], pa.binary()), pa.nulls(len(cells), pa.binary())], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted; the last one of a batch may go on in the next. At most `most` rows are held."""
        cells, rows, large = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            here, own = batch.column(0).to_numpy(), packed(batch.column(1), nbytes)
            if large is not None:  # the rest of a cell that is passed on
                n = int(np.searchsorted(here, large, "right"))
                if n:
                    yield passed(here[:n], own[:n])
                    here, own = here[n:], own[n:]
                if not len(here):
                    continue
                large = None
            cells.append(here)
            rows.append(own)
            last = here[-1]
            if cells[0][0] == last and sum(map(len, cells)) <= most:
                continue  # one cell so far: go on collecting
            whole, each = np.concatenate(cells), np.concatenate(rows)
            cut = int(np.searchsorted(whole, last))
            yield from told(whole[:cut], each[:cut])
            cells, rows = [whole[cut:]], [each[cut:]]
            if len(whole) - cut > most:
                yield passed(whole[cut:], each[cut:])
                cells, rows, large = [], [], last
        if cells:
            yield from told(np.concatenate(cells), np.concatenate(rows))

    def told(cells: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of the small cells among some whole ones, and the rows of the large."""
        if len(cells):
            _, where, sizes = np.unique(cells, return_inverse=True, return_counts=True)
            small = sizes[where.ravel()] <= most
            if not small.all():
                yield passed(cells[~small], rows[~small])
            if small.any():
                yield found(cells[small], np.ascontiguousarray(rows[small]))

    return rows.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, "cell long, a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): root is the smallest node that can be reached. Alternating large-star
    and small-star steps; each step's edges are written, so a lost executor costs a step at most, and no plan
    holds more than one step: Spark describes a whole plan to the driver's listeners after each of its stages."""
    swap = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(swap(now))
        total = 2 * now.count()
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = materialise(join_skewed(both, least, "a", "n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small_min = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = join_skewed(large, small_min, "a", "n", total)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_min.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small)
        discard(now)
        discard(large)
        now = after
        # Done when all are stars: no node has two edges down, and no root has one.
        ends = now.select("a").unionByName(now.select(F.col("b").alias("a")).distinct())
        if ends.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, bits: int = 64, grid: Grid | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (lowercase hex), component_id (the smallest doc_id
    reachable over links, the row's own included).

    A null or empty text, or one without words, has fingerprint zero and is linked like any other; a text of
    any length is read whole, by the task that holds its row. Null ids are passed over for component_id, which is null only if no row of the component has an id.
    Repeated rows stay; extra columns of docs are ignored; an empty table gives an empty result. Only
    distinct fingerprints are compared, so copies cost nothing.
    """
    grid = grid or Grid(bits)
    prints = materialise(with_fingerprints(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", "fp", words, bits))
    found = components(links(prints, "fp", grid))
    rooted = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(found, F.col("fp") == F.col("node"), "left")
    rooted = materialise(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"))
    # Neither a component of very many fingerprints nor a fingerprint of very many rows goes to one task.
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = materialise(join_skewed(rooted, ids, "root", "members", rooted.count()).select("fp", "component_id", "n"))
    return join_skewed(prints, named, "fp", "n", prints.count()).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# Near-duplicates by the similarity of shingle sets


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles_of(text, words)), np.uint64))


def set_key(own: np.ndarray) -> bytes:
    """A name for a set of shingles; empty for an empty set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b""


def levels(size: int, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(level, segments, differ) of a set of shingles. A pair is of the level of its larger set, whose size is at
    most 2 ** level and over half of that; a set belongs to the levels of all similar pairs it may be in, in
    which at most `differ` shingles belong to one of both sets only. All sets have the same segments at a level."""
    part = (1 - similarity) / (1 + similarity)
    largest = int(size / similarity + 1e-9)
    for level in range((size - 1).bit_length(), (largest - 1).bit_length() + 1):
        if differ := int((size + min(1 << level, largest)) * part + 1e-9):
            most = int((2 << level) * part + 1e-9)
            yield level, most + -(-most // 32) + 3, differ


def segment_counts(own: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit counts, in pieces of two bits, of the 64-bit fingerprint of each segment (starts[k] to starts[k] +
    sizes[k] of own): a bit is 1 if over half of the segment's shingles have it."""
    out = np.empty((len(starts), 32), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP)))
        some = own[starts[at] : starts[to - 1] + sizes[to - 1], None]
        bits = np.unpackbits(mixed(some * TIMES[:1] + PLUS[:1]).view(np.uint8), axis=1)
        ones = np.add.reduceat(bits, starts[at:to] - starts[at], axis=0, dtype=np.int32) * 2 > sizes[at:to, None]
        out[at:to] = ones[:, ::2].astype(np.uint64) + ones[:, 1::2]
        at = to
    return out


def segment_cells(own: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a set's cells: projections of its segments' bit counts onto one segment each.

    At most `differ` segments of a similar pair are unequal, so of its segments that are not empty, taken in
    any order that depends on the segment alone, the first differ + 1 of both sets have one in common: where
    the order of one ends first, one of its differ + 1 is in the other, and before the other's end. Segments
    of many shingles come first, since they tell most. Sets with no more than `differ` such segments go to
    cells for their empty ones too, where they meet their like. No similar pair is lost.
    """
    out = [np.empty(0, np.uint64)]
    for level, n, differ in levels(len(own), similarity) if len(own) else ():
        place = (own >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)  # own is sorted, so places ascend
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.r_[starts, len(own)])
        salt = mixed(np.arange(n, dtype=np.uint64) * np.uint64(64) + np.uint64(level) + PLUS[1])
        at = place[starts].astype(np.int64)
        key = mixed(mixed((segment_counts(own, starts, sizes) * TIMES[-32:]).sum(axis=1, dtype=np.uint64)) ^ salt[at])
        if len(key) > differ:
            key = key[np.lexsort((key, -sizes))[: differ + 1]]
        else:
            key = np.r_[key, mixed(np.delete(salt, at) ^ PLUS[2])]
        out.append(key)
    return np.concatenate(out).view(np.int64)


def set_print(own: np.ndarray) -> bytes:
    """The fingerprint of a set of shingles: PRINT bits, each 1 if over half of the shingles' hashes have it."""
    total = np.zeros(PRINT, np.int64)
    for k in range(0, len(own), STEP):
        total += bit_sums(mixed(own[k : k + STEP, None] * TIMES[: PRINT // 64] + PLUS[: PRINT // 64]))
    return np.packbits(total * 2 > len(own)).tobytes()


def similar_forest(sets: list[np.ndarray], prints: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is at least that, as positions.

    In a search each set meets those not reached yet. First the bounds: sizes, the Manhattan distance of the
    fingerprints' bit counts, their differing bits. What is within them is compared exactly.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, mark = ids.ravel(), np.zeros(int(ids.max()) + 1, bool)
    own = [ids[e - n : e] for e, n in zip(np.cumsum(sizes), sizes)]
    words, counts = prints.view(np.uint64), prints_grid().counts(prints).astype(np.int16)
    left, out, todo = np.arange(1, len(sets)), [], [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        at = todo.pop()
        some = left[np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at]) - 1e-9]
        some = some[np.abs(counts[some] - counts[at]).sum(axis=1) <= RADIUS]
        some = some[np.bitwise_count(words[some] ^ words[at]).sum(axis=1) <= RADIUS]
        if not len(some):
            continue
        mark[own[at]] = True
        both = np.add.reduceat(mark[np.concatenate([own[b] for b in some])], np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
        mark[own[at]] = False
        near = some[both / (sizes[at] + sizes[some] - both) >= similarity]
        out += [(at, int(b)) for b in near]
        todo += near.tolist()
        left = left[~np.isin(left, near, assume_unique=True)]
    return out


@functools.cache
def prints_grid() -> Grid:
    return Grid(PRINT, 2, RADIUS, groups=RADIUS)


def unary(words: np.ndarray) -> np.ndarray:
    """The bit counts of segments of two bits, each as that many ones: what two of these differ in is the Manhattan
    distance of the counts."""
    low, odd = np.uint64(0x5555555555555555), words >> np.uint64(1)
    return ((words | odd) & low) << np.uint64(1) | (words & odd & low)


def near_pairs(cells: np.ndarray, sizes: np.ndarray, prints: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions inside cells (which come sorted) that connect all whose sizes and fingerprints are within
    the bounds: a range join under the Manhattan distance of bit counts, then their differing bits."""
    words = prints.view(np.uint64)
    counts = unary(words)

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs."""
        left = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]) - 1e-9)
        for rows in (counts, words):
            left = left[np.bitwise_count(rows[a[left]] ^ rows[b[left]]).sum(axis=1, dtype=np.int64) <= RADIUS]
        return left

    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    ends = np.r_[starts[1:], len(cells)]
    few = ends - starts <= FEW
    end = np.repeat(np.where(few, ends, 0), ends - starts)
    out, at = [], np.flatnonzero(end)
    for step in range(1, FEW):  # each with the one so many places on
        at = at[at + step < end[at]]
        for k in range(0, len(at), BLOCK):
            a = at[k : k + BLOCK]
            a = a[within(a, a + step)]
            out.append((a, a + step))
    for s, e in zip(starts[~few], ends[~few]):  # a search: each meets those not reached yet
        left, todo = np.arange(s + 1, e), [s]
        while len(left):
            if not todo:
                todo, left = [left[0]], left[1:]
                continue
            one = todo.pop()
            near = within(np.full(len(left), one), left)
            out.append((np.full(len(near), one), left[near]))
            todo += left[near].tolist()
            left = np.delete(left, near)
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def dealt(members: DataFrame, key: str) -> DataFrame:
    """members(key, fp, size, ...) of groups, key replaced by g: a group of more than MEET members, or of more than
    MEET_SHINGLES together, is dealt into blocks, and each two blocks meet in a group of their own. No task
    holds more than about 2 * MEET sets and 2 * MEET_SHINGLES shingles (or two sets, where these are larger),
    and no pair is left out. Groups of one go."""
    p = F.greatest(F.ceil(F.col("n") / MEET), F.least("n", F.ceil(F.col("total") / MEET_SHINGLES))).cast("int")
    counts = members.groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1").select(key, p.alias("p"))
    # Block i meets block j: in group (i, j) with i < j, or in (i, i) if there is one block only.
    other = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    pairs = F.filter(other, lambda x: (x["i"] < x["j"]) | (F.col("p") == 1))
    blocks = members.join(counts, key).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")).withColumn("pair", F.explode(pairs))
    g = F.when(F.col("pair.j") == 0, F.xxhash64(key)).otherwise(F.xxhash64(key, "pair.i", "pair.j"))
    return blocks.withColumn("g", g).drop(key, "p", "block", "pair")


def similar_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between keys of shingle sets, all of them of at least that similarity; a connected group
    of similar sets gets a connected set of links.

    Only cells in which different sets meet are looked at; there sizes and fingerprints meet first, and only
    what is within their bounds is sent on as sets, once for what is connected over all cells. Large cells and
    what is connected in large numbers are dealt into blocks.
    """
    known = prints.where("fp <> X''")
    # Of sets with very many copies one row goes on.
    hot = F.broadcast(known.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > max(prints.count() // 1000, LARGE)).select("fp"))
    single = known.join(hot, "fp", "left_anti").unionByName(known.join(hot, "fp", "left_semi").dropDuplicates(["fp"]).select(*known.columns))

    def shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (cell, key), sorted, the distinct ones of cells with more than one key. The last row is held."""
        held, joined = np.empty((2, 0), np.int64), False  # joined: its cell has come before
        for batch in itertools.chain(batches, [None]):
            last = batch is None
            rows = held if last else np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]
            before = np.r_[joined, rows[0, 1:] == rows[0, :-1]]
            met = before | np.r_[before[1:], False]
            end = rows.shape[1] - (not last)
            yield pa.RecordBatch.from_arrays([pa.array(x[:end][met[:end]]) for x in rows], names=["cell", "key"])
            held, joined = rows[:, end:], bool(before[-1])

    keyed = single.select(F.explode("cells").alias("cell"), F.xxhash64("fp").alias("key"))
    several = keyed.repartition("cell").sortWithinPartitions("cell", "key").mapInArrow(shared_cells, "cell long, key long")
    info = known.dropDuplicates(["fp"]).select(F.xxhash64("fp").alias("key"), "fp", "size", "print")
    met = materialise(several.join(info, "key").drop("key"))

    def within(cells: np.ndarray, keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links from the smallest of connected members of whole cells to the others."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for a, b in zip(*(x.tolist() for x in near_pairs(cells, sizes, bits, similarity))):
            root[find(b)] = find(a)
        joined: dict[int, list[bytes]] = {}
        for x in list(root):
            joined.setdefault(find(x), []).append(keys[x].tobytes())
        star = [(min(x), y) for x in joined.values() for y in x]
        if star:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*star)], names=["a", "b"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted; the last one of a batch may go on in the next."""
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            here = [batch.column(0).to_numpy(), packed(batch.column(1), 16), batch.column(2).to_numpy(), packed(batch.column(3), PRINT // 8)]
            held = [np.concatenate(x) for x in zip(held, here)] if held else here
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield from within(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        if held:
            yield from within(*held)

    rows = dealt(met, "cell").select("g", "fp", "size", "print").repartition("g").sortWithinPartitions("g")
    found = components(rows.mapInArrow(screen, "a binary, b binary").distinct())
    found = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    members = materialise(dealt(found.join(known.select("fp", "size").dropDuplicates(["fp"]), "fp"), "root").select("g", "fp"))
    needed = members.select("fp").distinct()
    texts = prints.join(needed, "fp", "left_semi").select("h").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(texts, "h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            batch = batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))
            own = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            cols = [[set_key(x) for x in own], [set_print(x) for x in own], [x.tobytes() for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["fp", "print", "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; one may go on in the next batch."""
        group, keys, prints, sets = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                found = similar_forest(sets, np.frombuffer(b"".join(prints), np.uint8).reshape(len(sets), -1), similarity)
                yield pa.RecordBatch.from_arrays([pa.array([keys[x[k]] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
            for held in (keys, prints, sets):
                held.clear()

        for batch in batches:
            for g, fp, bits, own in zip(*(batch.column(k) for k in range(4))):
                if group != g.as_py():
                    yield from flush()
                    group = g.as_py()
                keys.append(fp.as_py())
                prints.append(bits.as_py())
                sets.append(np.frombuffer(own.as_py(), np.uint64))
        yield from flush()

    sets = docs.select("h", "text").mapInArrow(read, "fp binary, print binary, shingles binary").dropDuplicates(["fp"]).join(needed, "fp", "left_semi")
    met = members.join(sets, "fp").select("g", "fp", "print", "shingles").repartition("g").sortWithinPartitions("g")
    return met.mapInArrow(meet, "a binary, b binary").distinct()


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest doc_id; all columns stay.

    Near-duplicates are documents whose sets of distinct shingles have at least that Jaccard similarity, and
    what is connected over them. Candidates share a cell of the grid on their segments' bit counts, which loses
    no similar pair, and are within the bounds of their fingerprints; every link is decided by the sets.

    Documents without words (null and empty texts too) are no copies of each other here and all stay.
    Of a group's rows that repeat the smallest doc_id and its text one stays; of unlike texts with that doc_id
    the one of the smallest hash. Null ids come last.
    """
    h, key, other, n = fresh(docs, "h", "key", "other", "n")
    ids = docs.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            cells = pa.array([segment_cells(x, similarity) for x in own], pa.list_(pa.int64()))
            keys, bits = (pa.array([f(x) for x in own], pa.binary()) for f in (set_key, set_print))
            cols = [batch.column("doc_id"), batch.column("h"), keys, pa.array([len(x) for x in own], pa.int64()), bits, cells]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "fp", "size", "print", "cells"])

    kind = next(f.dataType for f in ids.schema.fields if f.name == "doc_id").simpleString()
    prints = materialise(ids.mapInArrow(keyed, f"doc_id {kind}, h long, fp binary, size long, print binary, cells array<long>"))
    none = F.unhex(F.lit(""))
    found = components(similar_links(ids, prints, words, similarity))
    rows = prints.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("n"))
    rooted = rows.where(F.col("fp") != none).join(found, F.col("fp") == F.col("node"), "left")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("best")
    kept = rooted.groupBy(F.coalesce("root", "fp")).agg(best).select("best.doc_id", "best.h", "best.n")
    bare = rows.where(F.col("fp") == none).select("doc_id", "h", F.lit(1).cast("long").alias("n"))
    kept = materialise(kept.unionByName(bare).select(F.col("doc_id").alias(key), F.col("h").alias(other), F.col("n").alias(n)))
    both = docs.withColumn(h, F.xxhash64(quoted(text))).join(kept, quoted(doc_id).eqNullSafe(F.col(key)) & (F.col(h) == F.col(other)))
    out = both.where(F.col(n) == 1)
    if not kept.where(F.col(n) > 1).isEmpty():  # repeated rows
        out = out.unionByName(both.where(F.col(n) > 1).dropDuplicates([key, other]))
    return out.select(*[quoted(c) for c in docs.columns])
