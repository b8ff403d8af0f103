"""Benchmark items in documents, with edits, by the pigeonhole principle.

An item with an error budget of k is cut into k + 1 pieces: text within k edits of it holds one of them unchanged, close to its place.
An Aho-Corasick automaton finds the pieces; Myers' bit-parallel algorithm then measures the distance there.  Both sides are compared
as lower-case words ``\\w+`` joined by single spaces, with a space at both ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, tidied
from .substring import keyed, without

_WORD = re.compile(r"\w+")


def canonical(text: str) -> str:
    return " " + " ".join(_WORD.findall(text.lower())) + " "


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 consecutive pieces with their offsets, as even as can be."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance between the pattern and any substring of the text, and that substring's first end; None if over ``most``."""
    m = len(pattern)
    mask: dict[str, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    ones, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = ones, 0, m, None
    for at, c in enumerate(text):
        eq = mask.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(eq | plus) & ones
        down = plus & eq
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = down | ~(vertical | up) & ones, up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Items (id, canonical text) to find in canonical texts; every ``chars`` characters allow one edit."""

    def __init__(self, items: list[tuple[int, str]], chars: int):
        import ahocorasick

        self.items = [(i, t, len(t) // chars) for i, t in items]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, budget) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                held.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of each item that the text holds: the least distance, and the first end with it."""
        if not self.items:
            return []
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                best = found.get(n)
                if best and not best[0]:
                    continue
                _, item, budget = self.items[n]
                start = end + 1 - size - offset
                if start >= 0 and text.startswith(item, start):
                    found[n] = (0, start + len(item))
                    continue
                # starts, negative ones too, are dealt into stretches; one window serves all starts of a stretch, in any order
                slack = 2 * budget + 8
                stretch = start // slack
                if (n, stretch) in tried:
                    continue
                tried.add((n, stretch))
                low = max(0, stretch * slack - budget)
                hit = myers(item, text[low : (stretch + 1) * slack + len(item) + budget], best[0] if best else budget)
                if hit and (not best or (hit[0], low + hit[1]) < best):
                    found[n] = (hit[0], low + hit[1])
        return [(self.items[n][0], d, e) for n, (d, e) in sorted(found.items())]


_ROWS = "doc_id long, rk long, item_id long, distance int, budget int, end long"


def leaks(df: DataFrame, benchmark: DataFrame, chars: int = 16, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance, budget, end of each benchmark item in each document: no row, no leak.

    ``end`` is a place in the document's canonical text.  An item of n canonical characters may have n // ``chars`` edits.  Items
    without words and null texts match nothing.  The items are a stated set of queries: they go to the tasks in blocks of at most
    ``block_bytes`` characters, each block over all documents, whatever the number of items.  Rows that repeat are judged one by one, texts of any length as a whole; a null doc_id is an identifier
    like others; extra columns are left out.
    """
    return _found(df, benchmark, chars, block_bytes).drop("rk")


def _found(df: DataFrame, benchmark: DataFrame, chars: int = 16, block_bytes: int = 8 << 20) -> DataFrame:
    """``leaks`` with the row key rk."""
    docs = keyed(df)
    items = benchmark.select("item_id", F.col("text").alias("item")).where("item is not null and item_id is not null")
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    n_blocks = int(total // (block_bytes // 2)) + 1
    out = None
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        wanted = sorted((r.item_id, c) for r in block.collect() if (c := canonical(r.item)).strip())

        def go(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(wanted, chars) if wanted else None
            budgets = {i: len(t) // chars for i, t in wanted}
            for batch in batches:
                rows = []
                for doc_id, rk, text in zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), batch.column("text"), strict=True):
                    if matcher:
                        rows += [(doc_id, rk, i, d, budgets[i], e) for i, d, e in matcher.find(canonical(text.as_py()))]
                if rows:
                    yield batch_of(rows, _ROWS)

        part = docs.mapInArrow(tidied(go), _ROWS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, chars: int = 16) -> DataFrame:
    """``df`` without the rows whose own text has a leak; columns as they are."""
    return without(df, _found(df, benchmark, chars))
