"""SentencePiece encoding by a max-plus scan, and decoding.

A text is cut into the pieces with the largest sum of scores. Spaces become marks, one goes before the
text, and a character (a space mark in the text itself, too) that no piece covers becomes UTF-8 byte
pieces, so that decoding gives every text back exactly.

The vocabulary file holds ranks and no probabilities; a piece of rank r scores ln 1 / (r + 3) (Zipf), in
integer steps, so that sums do not depend on their order.

No piece has a mark after another character, so a text falls into stretches (marks and what follows them)
that are cut one by one; workers remember those that recur. Of giant texts each chunk is a max-plus matrix
M[s, t]: the best score from entering it s characters in (a piece of the chunk before reaches so far) to
leaving it t characters into the next. A stretch boundary inside makes it the outer sum of a head and a
tail. Matrices combine associatively; their scan gives each chunk the scores it is entered with, and the
chunks' way-back maps, also composed by a scan, the place where each is left. Then every chunk is traced
back independently, in a task of its own.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, materialise, quoted
from .vocabulary import DEFAULT, SPACE, read_pieces

#: Stands for a space mark that the text itself has: no valid text holds a lone surrogate.
OWN_MARK = "\udc81"
SCALE = 1 << 20
NONE = -(1 << 60)
#: Words a worker remembers, and the longest that are cut in lockstep; the base of the hash for looking up
#: pieces.
REMEMBER, LOCKSTEP_CHARS = 250_000, 32
#: Words whose ids a worker keeps from task to task.
KEEP = 10_000
BASE = 0xD1342543DE82EF95
CHUNK = 1 << 15
#: Chunks whose ids a worker holds at a time.
SOME = 16


class Table:
    """Pieces by a 64-bit hash of their characters, for looking up many substrings at a time. Entries
    that share a slot move on to a further table."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.powers = np.array([pow(BASE, k, 1 << 64) for k in range(LOCKSTEP_CHARS + 2)], np.uint64)
        left = [(self.hash(piece), score, i) for piece, score, i in pieces]
        self.spread, self.shift = np.uint64(0xFF51AFD7ED558CCD), np.uint64(64 - 20)
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are ruled out by one look
        self.maybe[(np.array([h for h, _, _ in left], np.uint64) * self.spread) >> self.shift] = True
        self.levels = []
        while left:
            mult, bits = 0x9E3779B97F4A7C15 + 2 * len(self.levels), (4 * len(left)).bit_length()
            keys, scores, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int64), np.full(1 << bits, -1, np.int32)
            rest = []
            for h, score, i in left:
                slot = (h * mult % (1 << 64)) >> (64 - bits)
                if ids[slot] >= 0:
                    rest.append((h, score, i))
                else:
                    keys[slot], scores[slot], ids[slot] = h, score, i
            self.levels.append((np.uint64(mult), np.uint64(64 - bits), keys, scores, ids))
            left = rest

    @staticmethod
    def hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * BASE + ord(c)) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, score, id) of those hashes that are pieces'."""
        left = np.flatnonzero(self.maybe[(hashes * self.spread) >> self.shift])
        rest, places, scored, named = hashes[left], [], [], []
        for mult, shift, keys, scores, ids in self.levels:
            slot = (rest * mult) >> shift
            hit = keys[slot] == rest
            places.append(left[hit])
            scored.append(scores[slot[hit]])
            named.append(ids[slot[hit]])
            left, rest = left[~hit], rest[~hit]
        return np.concatenate(places), np.concatenate(scored), np.concatenate(named)


class Vocabulary:
    """Pieces in a trie of nodes [children, score, id, length]; the score of what is no piece is NONE."""

    def __init__(self, pieces: list[tuple[str, str, int]]):
        self.bytes_of: dict[int, bytes] = {}
        self.byte_ids: dict[int, int] = {}
        self.trie: dict = {}
        self.reach = 1
        self.stretches = True
        self.byte_score = self.score(max((i for _, _, i in pieces), default=0)) - 10 * SCALE
        self.scores = np.full(max((i for _, _, i in pieces), default=0) + 1, self.byte_score, np.int64)
        for piece, kind, i in pieces:
            self.bytes_of[i] = b""
            if kind == "byte":
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif kind == "piece":
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                self.reach = max(self.reach, len(piece))
                self.stretches &= SPACE not in piece.lstrip(SPACE) and "\n" not in piece
                self.scores[i] = self.score(i)
                children, node = self.trie, None
                for k, c in enumerate(piece):
                    node = children.setdefault(c, [{}, NONE, -1, k + 1])
                    children = node[0]
                node[1:3] = self.score(i), i
        self.singles = {c for c, node in self.trie.items() if node[2] >= 0}
        self.table = Table([(piece, self.score(i), i) for piece, kind, i in pieces if kind == "piece"])
        self.covered = np.zeros(0x110000, bool)  # code points that singles cover; 0 pads
        self.covered[[0, *map(ord, self.singles)]] = True
        self.recent: dict[str, bytes] = {}
        self.decoded = pa.array([self.bytes_of.get(i, b"") for i in range(len(self.scores))], pa.binary())

    @staticmethod
    def score(rank: int) -> int:
        return -round(math.log(rank + 3) * SCALE)

    def spelled(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in (SPACE if c == OWN_MARK else c).encode()]

    def lattice(self, s: str, n: int, enter: list[int]) -> tuple[list[int], list]:
        """Best scores of all places of s, and the node (or byte-spelled character) of the piece before.
        Pieces start before n; enter[k] is the score with which place k is reached from before s. Of equal
        scores the earlier start wins, so the result does not depend on where a text was cut."""
        m, reach, trie, singles = len(s), self.reach, self.trie, self.singles
        best, back = [NONE] * (m + 1), [None] * (m + 1)
        best[: len(enter)] = enter[: m + 1]
        for i in range(n):
            here = best[i]
            if here <= NONE:
                continue
            children, j = trie, i
            for c in s[i : i + reach]:
                node = children.get(c)
                if node is None:
                    break
                j += 1
                got = here + node[1]
                if got > best[j]:
                    best[j], back[j] = got, node
                children = node[0]
            c = s[i : i + 1]
            if c and c not in singles:
                got = here + self.byte_score * len((SPACE if c == OWN_MARK else c).encode())
                if got > best[i + 1]:
                    best[i + 1], back[i + 1] = got, c
        return best, back

    def trace(self, back: list, end: int) -> tuple[list[int], int]:
        """Ids of the best path to `end`, and the place where it came in."""
        out: list[int] = []
        while end > 0 and (node := back[end]) is not None:
            if type(node) is str:
                out += self.spelled(node)[::-1]
                end -= 1
            else:
                out.append(node[2])
                end -= node[3]
        return out[::-1], end

    def stretch(self, s: str) -> bytes:
        """Ids (int32) of a marked text that is cut on its own."""
        return array("i", self.trace(self.lattice(s, len(s), [0])[1], len(s))[0]).tobytes()

    def many(self, stretches: list[str]) -> tuple[list[bytes], np.ndarray]:
        """stretch() of many in lockstep, longest first, and whether it holds: it does for those that singles
        cover."""
        lengths = np.array([len(x) for x in stretches])
        n, m = len(stretches), int(lengths[0])
        codes = np.array(stretches, f"U{m}").view(np.uint32).reshape(n, m)
        ok = self.covered[codes].all(axis=1)
        upto = np.searchsorted(-lengths, -np.arange(m + 1), "right")  # how many have that many characters
        heads, best = [np.zeros(n, np.uint64)], [np.zeros(n, np.int64)]
        steps, ids = np.zeros((m + 1, n), np.int8), np.zeros((m + 1, n), np.int32)
        for j in range(1, m + 1):
            c = upto[j]
            heads.append(heads[j - 1][:c] * np.uint64(BASE) + codes[:c, j - 1])
            best.append(np.full(c, NONE, np.int64))
            for i in range(max(0, j - self.reach), j):
                at, score, found = self.table.find(heads[j] - heads[i][:c] * self.table.powers[j - i])
                score += best[i][at]
                better = score > best[j][at]
                at = at[better]
                best[j][at], steps[j, at], ids[j, at] = score[better], j - i, found[better]
        out, at, end, rows = np.zeros((n, m), np.int32), np.full(n, m), lengths.copy(), np.arange(n)
        while len(rows):
            at[rows] -= 1
            out[rows, at[rows]] = ids[end[rows], rows]
            end[rows] -= np.maximum(steps[end[rows], rows], 1)  # 0 where singles do not cover it
            rows = rows[end[rows] > 0]
        raw = out.tobytes()
        return [raw[4 * (k * m + a) : 4 * (k + 1) * m] for k, a in enumerate(at.tolist())], ok

    def split(self, s: str) -> list[str]:
        """The stretches of a marked text: marks, then what follows up to the next."""
        if not self.stretches:
            return [s]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", s)

    def learn(self, words: set[str]) -> None:
        """Have the ids of all words in self.recent; the oldest ones are let go."""
        if len(self.recent) + len(words) > REMEMBER:
            self.recent = dict(islice(self.recent.items(), REMEMBER // 2, None))
        new = list(words.difference(self.recent))
        texts = [SPACE + w if w[:1] not in "\n\0" else w if w == "\n" else w[1:] for w in new]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        fits = order[(lengths[order] <= LOCKSTEP_CHARS) & (lengths[order] > 0)]
        alone = order[(lengths[order] > LOCKSTEP_CHARS) | (lengths[order] == 0)].tolist()
        for k in range(0, len(fits), 8192):
            part = fits[k : k + 8192].tolist()
            found, ok = self.many([texts[i] for i in part])
            self.recent.update(zip([new[i] for i in part], found))
            alone += [part[i] for i in np.flatnonzero(~ok)]
        for i in alone:
            self.recent[new[i]] = self.stretch(texts[i])

    def forget(self) -> None:
        """Let go all but the first words: a worker outlives its task, and what it keeps is held through all later ones."""
        self.recent = dict(islice(self.recent.items(), KEEP))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (int32) of each text. Line ends are spelled in bytes, so words are cut there, too; a word
        after a line end, which has no mark, is noted with a null character."""
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            s = marked(text) if text else ""
            words = self.words(s)
            held.append(words)
            out.append(b"" if words else b"".join(map(self.stretch, self.split(s))))
            size += len(words or ())
            if size > REMEMBER // 4 or k == len(texts) - 1:
                self.learn(set().union(*(w for w in held if w)))
                for i, w in enumerate(held, k + 1 - len(held)):
                    if w:
                        out[i] = b"".join(map(self.recent.__getitem__, w))
                held, size = [], 0
        return out

    def words(self, s: str) -> list[str] | None:
        """The stretches of a marked text as learn() notes them; null if it has several marks in a row."""
        if not s or s[0] != SPACE or not self.stretches or "\0" in s:
            return None
        words = s[1:].replace("\n", f"{SPACE}\n{SPACE}\0").split(SPACE)
        return None if "" in words else words

    def ids_of(self, s: str) -> bytes:
        """Ids of a marked text that begins and ends at stretch boundaries."""
        words = self.words(s)
        if words is None:
            return b"".join(map(self.stretch, self.split(s)))
        self.learn(set(words))
        return b"".join(map(self.recent.__getitem__, words))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_all(self, lists: pa.ListArray) -> list[str]:
        """The text of each list of ids; empty for null."""
        taken = self.decoded.take(lists.flatten())
        data, ends = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int32)
        n = np.r_[0, np.cumsum([0 if k is None else k for k in pc.list_value_length(lists).to_pylist()])]
        at = ends[n].tolist() if len(taken) else [0] * len(n)
        view = memoryview(data) if data is not None else b""
        return [bytes(view[a + 1 : b]).decode() for a, b in zip(at, at[1:])]

    # Chunks: s is the chunk and the reach - 1 characters after it, n the length of the chunk itself.

    def bounds(self, s: str, n: int) -> tuple[int, int] | None:
        """The first and the last stretch boundary in the chunk."""
        if not self.stretches:
            return None
        first = next((i for i in range(1, n) if s[i] == SPACE and s[i - 1] != SPACE), None)
        return first and (first, next(i for i in range(n - 1, 0, -1) if s[i] == SPACE and s[i - 1] != SPACE))

    def matrix(self, s: str, n: int) -> np.ndarray:
        size = self.reach
        out = np.full((size, size), NONE, np.int64)
        found = self.bounds(s, n)
        for entry in range(min(size, n + 1)):
            enter = [NONE] * entry + [0]
            if found:
                if entry > found[0]:
                    break
                out[entry, 0] = self.lattice(s[: found[0]], found[0], enter)[0][found[0]]
            else:
                best = self.lattice(s, n, enter)[0][n : n + size]
                out[entry, : len(best)] = best
        if found:
            middle = self.scores[np.frombuffer(self.ids_of(s[found[0] : found[1]]), np.int32)].sum()
            tail = np.full(size, NONE, np.int64)
            best = self.lattice(s[found[1] :], n - found[1], [0])[0][n - found[1] :][:size]
            tail[: len(best)] = best
            out = plus(out[:, :1], plus(np.int64(middle), tail[None, :]))
        return out

    def way_back(self, s: str, n: int, enter: list[int]) -> list[int]:
        """For each place where the chunk may be left, the place where the best path to it came in. All paths
        pass a stretch boundary, if there is one."""
        if found := self.bounds(s, n):
            head = s[: found[0]]
            return [self.trace(self.lattice(head, len(head), enter)[1], len(head))[1]] * self.reach
        best, back = self.lattice(s, n, enter)
        return [self.trace(back, n + t)[1] if n + t <= len(s) and best[n + t] > NONE else 0 for t in range(self.reach)]

    def chunk_ids(self, s: str, n: int, enter: list[int], leave: int) -> bytes:
        """Ids (int32) of the chunk."""
        if not (found := self.bounds(s, n)):
            return array("i", self.trace(self.lattice(s, n, enter)[1], n + leave)[0]).tobytes()
        head, tail = s[: found[0]], s[found[1] :]
        before = self.trace(self.lattice(head, len(head), enter)[1], len(head))[0]
        after = self.trace(self.lattice(tail, n - found[1], [0])[1], n - found[1] + leave)[0]
        return array("i", before).tobytes() + self.ids_of(s[found[0] : found[1]]) + array("i", after).tobytes()


def marked(text: str) -> str:
    """The text with space marks."""
    return SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)


def plus(a, b):
    """Sum of scores, in which NONE stays NONE."""
    return np.where((np.asarray(a) <= NONE) | (np.asarray(b) <= NONE), NONE, np.asarray(a) + np.asarray(b))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: associative."""
    return reduce(np.maximum, (plus(a[:, k : k + 1], b[k : k + 1, :]) for k in range(a.shape[1])))


def prefixes(items: list, product) -> list:
    """All products of leading items, by recursive doubling: log2(n) rounds of independent products."""
    out, step = list(items), 1
    while step < len(out):
        out = [out[i] if i < step else product(out[i - step], out[i]) for i in range(len(out))]
        step *= 2
    return out


_READY: dict[str, Vocabulary] = {}


def _vocabulary(path: str, pieces) -> Vocabulary:
    """A worker's vocabulary: workers outlive tasks."""
    if path not in _READY:
        _READY[path] = Vocabulary(pieces.value)
    return _READY[path]


def _lists(parts: list[bytes]) -> pa.ListArray:
    values = np.frombuffer(b"".join(parts), np.int32)
    offsets = np.r_[0, np.cumsum([len(p) // 4 for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = DEFAULT, chunk: int = CHUNK, decoded: str | None = None) -> DataFrame:
    """docs with the column ids (array<int>) in place of its text; all other columns stay.

    A null or empty text has no ids. Rows stay as they are, repeated ones too; an empty table gives an
    empty result. Equal texts among 1,000 rows that follow each other are encoded once. Texts of
    more than `chunk` characters are encoded in chunks over the cluster; equal giant texts once. Only those are shuffled. The vocabulary (a fixed file) is broadcast. With `decoded`, a
    column of that name has the texts decoded from the ids again, by the same workers.
    """
    from pyspark.sql import types as T

    known = read_pieces(vocabulary)
    chunk = max([chunk, *(len(p) for p, _, _ in known)])  # a piece reaches into one further chunk at most
    pieces = docs.sparkSession.sparkContext.broadcast(known)
    rest = [f for f in docs.schema.fields if f.name != text]
    back = [T.StructField(decoded, T.StringType())] if decoded else []
    shape = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType())), *back])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(vocabulary, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                place: dict[str, int] = {}  # of each text among the different ones
                at_of = [place.setdefault(t.as_py() or "", len(place)) for t in part.column(text)]
                each = _lists(own.encode_all(list(place)))
                lists = each.take(pa.array(at_of, pa.int32()))
                texts = [pa.array(own.decode_all(each), pa.string()).take(pa.array(at_of, pa.int32()))] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), lists, *texts], names=shape.names)
        own.forget()

    long = F.coalesce(F.length(quoted(text)), F.lit(0)) > chunk
    small = map_arrow(docs.where(~long), plain, shape)
    big = docs.where(long)
    key, = fresh(docs, "key")
    encoded = _giant(big.select(F.sha2(quoted(text), 256).alias("key"), quoted(text).alias("text")).dropDuplicates(["key"]), vocabulary, pieces, chunk)
    encoded = encoded.select(F.col("key").alias(key), F.col("ids").alias(ids))
    whole = big.withColumn(key, F.sha2(quoted(text), 256)).drop(text).join(encoded, key)
    whole = whole.select(*[quoted(f.name) for f in rest], quoted(ids))
    if decoded:
        whole = decode(whole.withColumn(key, quoted(ids)), key, decoded, vocabulary)
    return small.unionByName(whole.select(*[quoted(n) for n in shape.names]))


def _giant(texts: DataFrame, vocabulary: str, pieces, chunk: int) -> DataFrame:
    """texts(key, text), keys distinct, to (key, ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _vocabulary(vocabulary, pieces).reach
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                body = t.as_py()
                size = len(body) + 1  # with the mark before it
                for no, at in enumerate(range(0, size, chunk)):
                    part = body[max(at - 1, 0) : at - 1 + chunk + reach - 1]
                    yield pa.RecordBatch.from_pydict({"key": [k.as_py()], "no": pa.array([no], pa.int32()), "n": pa.array([min(chunk, size - at)], pa.int32()), "part": [part]})

    def text_of(no: int, part: str) -> str:
        return marked(part) if no == 0 else marked(part)[1:]

    chunks = materialise(texts.mapInArrow(cut, "key string, no int, n int, part string").repartition("key", "no"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(vocabulary, pieces)
        for batch in batches:
            found = [own.matrix(text_of(no.as_py(), part.as_py()), n.as_py()).tobytes() for no, n, part in zip(batch.column("no"), batch.column("n"), batch.column("part"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(found, pa.binary())], names=["key", "no", "m"])
        own.forget()

    def scan(table: pa.Table) -> pa.Table:
        """Over one text's matrices: a few KB for each chunk of it, at most 2^31 / chunk of them."""
        table = table.sort_by("no")
        size = math.isqrt(len(table.column("m")[0].as_py()) // 8)
        ms = [np.frombuffer(m.as_py(), np.int64).reshape(size, size) for m in table.column("m")]
        first = np.full((1, size), NONE, np.int64)
        first[0, 0] = 0
        enters = [first[0].tolist(), *(m[0].tolist() for m in prefixes([times(first, ms[0]), *ms[1:-1]], times))] if len(ms) > 1 else [first[0].tolist()]
        return pa.table({"key": table.column("key"), "no": table.column("no"), "enter": pa.array(enters, pa.list_(pa.int64()))})

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(vocabulary, pieces)
        for batch in batches:
            found = [own.way_back(text_of(no.as_py(), p.as_py()), n.as_py(), e.as_py()) for no, n, p, e in zip(batch.column("no"), batch.column("n"), batch.column("part"), batch.column("enter"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), batch.column("enter"), pa.array(found, pa.list_(pa.int32()))], names=["key", "no", "enter", "back"])

    def leaves(table: pa.Table) -> pa.Table:
        """Way-back maps compose associatively, from the last chunk on."""
        table = table.sort_by([("no", "descending")])
        maps = [np.array(b.as_py()) for b in table.column("back")]
        after = [0, *(int(m[0]) for m in prefixes(maps, lambda a, b: b[a])[:-1])]
        return pa.table({"key": table.column("key"), "no": table.column("no"), "enter": table.column("enter"), "leave": pa.array(after, pa.int32())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few chunks at a time: their ids, in Python, are what a worker would otherwise hold most of."""
        own = _vocabulary(vocabulary, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                some = batch.slice(at, SOME)
                found = [own.chunk_ids(text_of(no.as_py(), p.as_py()), n.as_py(), e.as_py(), x.as_py()) for no, n, p, e, x in zip(*(some.column(c) for c in ("no", "n", "part", "enter", "leave")))]
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("no"), _lists(found)], names=["key", "no", "ids"])
        own.forget()

    enters = chunks.mapInArrow(matrices, "key string, no int, m binary").groupBy("key").applyInArrow(scan, "key string, no int, enter array<long>")
    backs = chunks.join(enters, ["key", "no"]).mapInArrow(ways, "key string, no int, enter array<long>, back array<int>")
    lefts = backs.groupBy("key").applyInArrow(leaves, "key string, no int, enter array<long>, leave int")
    parts = chunks.join(lefts, ["key", "no"]).mapInArrow(traced, "key string, no int, ids array<int>")
    folded = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return folded.select("key", F.flatten("parts.ids").alias("ids"))


def decode(docs: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """docs with the text that encode() had, in place of its ids; null and empty ids give an empty text."""
    from pyspark.sql import types as T

    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary))
    rest = [f for f in docs.schema.fields if f.name != ids]
    shape = T.StructType([*rest, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(vocabulary, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = own.decode_all(part.column(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(found, pa.string())], names=shape.names)

    return map_arrow(docs, run, shape)
