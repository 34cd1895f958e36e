"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest vocabulary entry that the rest of the
word starts with. The trie of the vocabulary gets a failure link for each node: if no child fits, the
longest matches inside what was read so far are popped, and the link leads to the node of what is left.
How many tokens are popped is stored with the link, so a word is counted in one pass, each character
looked at once plus popped matches, and no piece is ever built.

A character with which no entry starts counts its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted
from .vocabulary import DEFAULT, SPACE, read_pieces

#: Distinct words whose counts a worker remembers, and the longest such word in bytes.
REMEMBER, REMEMBER_BYTES = 200_000, 64


class Automaton:
    def __init__(self, entries: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends, letters, parents = {0: 0}, [""], [0]
        for entry in entries:
            v = 0
            for c in entry:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    letters.append(c)
                    parents.append(v)
                v = self.next[v][c]
            ends[v] = 1
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends or u == 0:  # an entry, or a lone character that is none
                    self.pops[v] = 1 if v in ends else len(c.encode())
                    continue
                z, n = self.fail[u], self.pops[u]
                while z and c not in self.next[z]:
                    n, z = n + self.pops[z], self.fail[z]
                if c in self.next[z]:
                    self.fail[v], self.pops[v] = self.next[z][c], n
                else:
                    self.fail[v], self.pops[v] = 0, n + len(c.encode())

    def count(self, word: str) -> int:
        """The number of tokens of greedy longest-match tokenisation."""
        v, n, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while (u := step[v].get(c)) is None and v:
                n += pops[v]
                v = fail[v]
            if u is None:
                n += len(c.encode())
            else:
                v = u
        while v:
            n += pops[v]
            v = fail[v]
        return n


class Counts(dict):
    """Token counts of words (UTF-8), computed when first asked for."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(SPACE + word.decode())
        if len(word) <= REMEMBER_BYTES:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n


#: A worker's counts, by vocabulary path: workers outlive tasks.
_READY: dict[str, Counts] = {}


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    Words are split at ASCII white space; each begins with the vocabulary's space mark. Null and empty
    texts count 0. doc_id has to be a whole number; a text of any length is read whole. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
    The vocabulary (a fixed file) is read on the driver and broadcast; nothing is shuffled.
    """
    entries = docs.sparkSession.sparkContext.broadcast([p for p, kind, _ in read_pieces(vocabulary) if kind == "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _READY:
            _READY[vocabulary] = Counts(Automaton(entries.value))
        counts = _READY[vocabulary]
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1):
                own = (t.as_py() or "").encode().split()
                words.append(len(own))
                tokens.append(sum(map(counts.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    read = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
