"""Token counts by greedy longest match, with a linear automaton that never builds the pieces.

The trie of a vocabulary gets failure links: where a node has no child for the next byte, the longest pieces that its text is sure to
yield are popped and the match goes on at the link's node.  As only counts are wanted, each link carries the number of popped tokens.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, documents, tidied


class Automaton:
    """``first`` are pieces that begin a word, ``rest`` those that go on; both are byte strings."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        #: child[node * 256 + byte], and for each node its link and how many tokens it pops
        self.child: dict[int, int] = {}
        ends: list[bool] = [False, False]
        self.begin, self.go_on = 0, 1
        for root, pieces in ((self.begin, first), (self.go_on, rest)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.child.get(node << 8 | b)
                    if to is None:
                        to = self.child[node << 8 | b] = len(ends)
                        ends.append(False)
                    node = to
                if piece:
                    ends[node] = True
        self.link: list[int] = [-1] * len(ends)
        self.popped: list[int] = [0] * len(ends)
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, to in self.child.items():
            below[key >> 8].append((key & 255, to))
        queue = deque([self.begin, self.go_on])
        while queue:
            node = queue.popleft()
            for b, to in below[node]:
                queue.append(to)
                if ends[to]:
                    self.link[to], self.popped[to] = self.go_on, 1
                    continue
                at, pops = self.link[node], self.popped[node]
                while at >= 0 and at << 8 | b not in self.child:
                    pops += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[to], self.popped[to] = self.child[at << 8 | b], pops

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1, the unknown token, if it has no such pieces; 0 for nothing."""
        if not word:
            return 0
        child, link, popped = self.child, self.link, self.popped
        node, n = self.begin, 0
        for b in word:
            to = child.get(node << 8 | b)
            while to is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                to = child.get(node << 8 | b)
            node = to
        while node != self.go_on:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return n


def byte_bpe_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """A byte-level vocabulary as word pieces: tokens with a leading space begin words, tokens without one go on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    tokens = [bytes(value[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return [t for t in tokens if t[0] == 0x20], [t for t in tokens if t[0] != 0x20]


class Counter:
    """Counts of words, with those seen lately kept (``cached`` at most)."""

    def __init__(self, path: str, cached: int = 400_000):
        self.automaton, self.cached = Automaton(*byte_bpe_pieces(path)), cached
        self.known: dict[bytes, int] = {}

    def text(self, text: bytes) -> tuple[int, int]:
        words = text.split()
        try:
            return len(words), sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        known, count = self.known, self.automaton.count
        if len(known) > self.cached:
            known.clear()
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = count(b" " + w)
                if len(w) <= 64:
                    known[w] = n
            total += n
        return len(words), total


_counters: dict[str, Counter] = {}
_ROWS = "doc_id long, n_bytes long, n_words long, n_tokens long"


def token_counts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of every row's whole text; null texts count as empty.

    Words are ``[^\\x20\\x09-\\x0D]+``, each counted as if a space stood before it.  Nothing is shuffled.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            yield batch_of([(d, len(t), *counter.text(t)) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)], _ROWS)

    return documents(df).mapInArrow(tidied(go), _ROWS)
