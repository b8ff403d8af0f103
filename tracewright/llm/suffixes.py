"""Repeated byte strings by a sparse, distributed suffix array.

Every window of ``width`` bytes has one anchor: the place of the smallest hash among the ``gram``-byte strings in it, the leftmost of
equal ones.  Equal windows have equal anchors, so only suffixes that begin at anchors need sorting, one in about eighteen.

1. Anchors' hashes are dealt in packed, sorted pieces; those that occur in one document only are left out from here on.
2. Suffixes at the other anchors, with the text to both sides that their windows reach, are range-partitioned by their leading bytes
   between sampled splitters, which are as long as it takes to tell them from the sample's key before (``width`` at most).  A task
   sends equal stretches of text once, compared as bytes, and settles the others itself.
3. Each range sorts its suffixes by multikey sort over eight-byte digits (where multikey quicksort parts by one character and pivot, the
   runs that are equal so far are ordered by the next digit at once) and reads the common prefixes of neighbours.  Windows are compared
   as bytes.
4. A group of equal windows continues beyond a range where all of its bytes from the anchor on are also a splitter's.  These windows
   are compared across the boundary: each goes, alone, to a bucket of its own bytes instead of the range.  So a common prefix, however
   long, is split among ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, _BYTE, covered, mix, partitions, powers, rolling, sliding_max, sliding_min, tidied
from .substring import keyed, ordered_id, text_blocks

_BASE, _SPAN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_NOBODY = np.uint32(0xFFFFFFFF)


def dealt(rows: DataFrame, n: int, number: str) -> DataFrame:
    """Rows in n partitions by a number in turn: a few numbers a partition would be dealt unevenly by their hashes."""
    return rows.repartitionById(n, F.pmod(number, F.lit(n)).cast("int"))


class Bytes:
    """Bytes of some documents, the hash of each gram, and for each window the smallest hash in it and its document (-1: none)."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.width, self.inside = width, width - gram + 1
        n = max(0, len(self.data) - width + 1)
        self.valid = self.doc[:n] == self.doc[width - 1 :] if n else np.zeros(0, bool)
        self.grams = rolling(_BYTE[self.data], gram, _BASE) >> np.uint64(64 - 8 * _HASH) | np.uint64(1)
        self.least = sliding_min(self.grams, self.inside) if n else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Places whose hash is the least of a window around them."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        reach = np.zeros(len(self.valid) + 2 * (self.inside - 1), np.uint64)
        reach[self.inside - 1 : len(reach) - self.inside + 1] = np.where(self.valid, self.least, np.uint64(0))
        return np.flatnonzero(sliding_max(reach, self.inside) == self.grams)

    def anchor_of(self, windows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """The leftmost place with the least hash of each window."""
        at = np.searchsorted(anchors, windows)
        wrong = np.flatnonzero(self.grams[anchors[at]] != self.least[windows])
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.grams[anchors[at[wrong]]] != self.least[windows[wrong]]]
        return anchors[at]


def planes(x: np.ndarray, kept: int) -> bytes:
    """The ``kept`` low bytes of integers, all lowest bytes first: sorted or small numbers then compress well."""
    return x.astype(f"<u{x.itemsize}").view(np.uint8).reshape(len(x), x.itemsize)[:, :kept].T.tobytes()


def from_planes(data: bytes, kept: int, kind: type) -> np.ndarray:
    out = np.zeros((len(data) // kept, np.dtype(kind).itemsize), np.uint8)
    out[:, :kept] = np.frombuffer(data, np.uint8).reshape(kept, -1).T
    return out.view(kind).ravel()


#: Bytes of an anchor's hash that are compared, and of a document's place in its chunk.
_HASH, _PLACE = 7, 4
_PIECES = "route long, kind int, chunk long, hashes binary, owners binary"


def _anchor_pieces(docs: DataFrame, width: int, gram: int, buckets: int, chunk_entries: int = 4_000_000) -> DataFrame:
    """Sorted pieces (kind 1) of each task's anchor hashes with the documents that have them, as places in the chunk's sorted table of
    row keys (kind 0).  Hashes that several documents of the chunk have are known to repeat: these documents are told at once (kind
    2), and the hash goes out twice without an owner."""

    def pieces(part: int, seq: int, v: np.ndarray, o: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        chunk = part << 20 | seq
        table, place = np.unique(keys, return_inverse=True)
        o = place[o].astype(np.uint32)
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])][: len(v)]
        v, o = v[new], o[new]
        same = v[1:] == v[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        rows = [(chunk, 0, chunk, table.astype(np.int64).tobytes(), None), (chunk, 2, chunk, planes(v[shared], _HASH), planes(o[shared], _PLACE))]
        twice = np.repeat(np.unique(v[shared]), 2)
        v, o = np.concatenate([v[~shared], twice]), np.concatenate([o[~shared], np.full(len(twice), _NOBODY, np.uint32)])
        bucket = (v >> np.uint64(33)) % np.uint64(buckets)
        order = np.lexsort((v, bucket))
        v, o, bucket = v[order], o[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(v)])
        for a, b in zip(cut, np.r_[cut[1:], len(v)], strict=True):
            rows.append((int(bucket[a]), 1, chunk, planes(v[a:b], _HASH), planes(o[a:b], _PLACE)))
        return batch_of(rows, _PIECES)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        vs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        n_docs = n = 0
        for batch in batches:
            rk = batch.column("rk").to_numpy()
            for at, texts in text_blocks(batch):
                block = Bytes(texts, width, gram)
                places = block.anchors()
                vs.append(block.grams[places])
                owners.append(block.doc[places].astype(np.int64) + n_docs)
                keys.append(rk[at : at + len(texts)])
                n_docs, n = n_docs + len(texts), n + len(places)
                if n > chunk_entries:
                    yield pieces(part, seq, np.concatenate(vs), np.concatenate(owners), np.concatenate(keys))
                    vs, owners, keys, n_docs, n, seq = [], [], [], 0, 0, seq + 1
        if n:
            yield pieces(part, seq, np.concatenate(vs), np.concatenate(owners), np.concatenate(keys))

    return docs.select("rk", "text").mapInArrow(tidied(go), _PIECES)


def _repeated(pieces: DataFrame) -> DataFrame:
    """Pieces for the chunks (kinds 0 and 2): which hashes of which documents occur in more than one document."""

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        often = np.sort(np.concatenate([from_planes(r[3], _HASH, np.uint64) for r in rows]))
        often = np.unique(often[1:][often[1:] == often[:-1]])
        for _, _, chunk, hashes, owners in rows:
            mine, o = from_planes(hashes, _HASH, np.uint64), from_planes(owners, _PLACE, np.uint32)
            at = np.searchsorted(often, mine)
            at[at == len(often)] = 0
            keep = (often[at] == mine) & (o != _NOBODY) if len(often) else np.zeros(len(mine), bool)
            if keep.any():
                yield chunk, 2, chunk, planes(mine[keep], _HASH), planes(o[keep], _PLACE)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                if row[1] == 1:
                    held.append(row)
                else:
                    out.append(row)
            if out:
                yield batch_of(out, _PIECES)
        if held and (out := list(settle(held))):
            yield batch_of(out, _PIECES)

    n = partitions(pieces.sparkSession)
    return dealt(pieces, n, "route").sortWithinPartitions("route").mapInArrow(tidied(go), _PIECES)


def _by_document(pieces: DataFrame) -> DataFrame:
    """rk, vs: the repeated hashes of each document that has any."""

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(rows[0][3], np.int64)
        v = np.concatenate([from_planes(r[3], _HASH, np.uint64) for r in rows[1:]])
        o = np.concatenate([from_planes(r[4], _PLACE, np.uint32) for r in rows[1:]])
        order = np.lexsort((v, o))
        v, o = v[order], o[order]
        new = np.flatnonzero(np.r_[True, o[1:] != o[:-1]][: len(o)])
        for a in range(0, len(new), 2000):
            some = new[a : a + 2000]
            end = new[a + 2000] if a + 2000 < len(new) else len(v)
            yield pa.RecordBatch.from_arrays([pa.array(table[o[some]]), _binaries(v[some[0] : end].tobytes(), 8 * (np.r_[some, end] - some[0]))], ["rk", "vs"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][2] != row[2]:
                    if len(held) > 1:
                        yield from finish(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield from finish(held)

    return pieces.repartition(partitions(pieces.sparkSession), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(tidied(go), "rk long, vs binary")


def _binaries(data: bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column from its concatenated values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated slices of an array."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _leading(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place, filled with zeros, as strings that compare byte by byte."""
    padded = np.concatenate([data, np.zeros(n, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, n)[at].view(f"S{n}").ravel()


def _rows(strings: np.ndarray) -> np.ndarray:
    """Strings of one size as a matrix of bytes."""
    return np.frombuffer(strings.tobytes(), np.uint8).reshape(len(strings), strings.itemsize)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading bytes that two strings share, for each pair."""
    differ = _rows(a) != _rows(b)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.itemsize)


def _reach(keys: np.ndarray, route: np.ndarray, splitters: np.ndarray, gram: int) -> np.ndarray:
    """The most leading bytes that each key shares with a splitter, 0 for fewer than ``gram``; those beside its range share the most."""
    out = np.zeros(len(keys), np.int64)
    short, short_keys = splitters.astype(f"S{gram}"), keys.astype(f"S{gram}")
    for beside in (route - 1, route):
        some = np.flatnonzero((beside >= 0) & (beside < len(splitters)))
        some = some[short[beside[some]] == short_keys[some]]
        if len(some):
            out[some] = np.maximum(out[some], _shared(keys[some], splitters[beside[some]]))
    return out


_SUFFIXES = "route long, kind int, rk long, head binary, body binary"
_HEAD = np.dtype([("rk", "<i8"), ("d", "<i8"), ("left", "<u2"), ("size", "<u2"), ("places", "<u4")])


class FirstSeen:
    """The smallest document of each stretch of text that a task has met, with its bytes; the task meets documents in ascending order.

    Hashes find a stretch, bytes decide: one whose bytes are not those that were met counts as new.  Beyond ``most`` stretches all are
    forgotten, which only makes the task send more.
    """

    def __init__(self, most: int = 500_000):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.d, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store: list[np.ndarray] = []
        self.length = 0

    def smaller(self, keys: np.ndarray, d: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """True where a stretch data[start : start + size] was met in a document with a smaller identifier."""
        unique, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        out = np.zeros(len(keys), bool)
        mine = known[inverse]
        if mine.any():
            place = at[inverse[mine]]
            out[mine] = (self.d[place] < d[mine]) & self._equal(self._stored(), self.at[place], self.size[place], data, start[mine], size[mine])
        first = index[inverse]
        later = np.flatnonzero(~mine & (first != np.arange(len(keys))))
        out[later] = (d[first[later]] < d[later]) & self._equal(data, start[first[later]], size[first[later]], data, start[later], size[later])
        fresh = index[~known]
        if len(self.keys) + len(fresh) > self.most:
            self._forget()
        else:
            self.store.append(gather(data, start[fresh], size[fresh]))
            merged = np.concatenate([self.keys, keys[fresh]])
            order = np.argsort(merged, kind="stable")
            ends = np.cumsum(size[fresh]) + self.length
            self.keys, self.d = merged[order], np.concatenate([self.d, d[fresh]])[order]
            self.at, self.size = np.concatenate([self.at, ends - size[fresh]])[order], np.concatenate([self.size, size[fresh]])[order]
            self.length += int(size[fresh].sum())
        return out

    def _stored(self) -> np.ndarray:
        if len(self.store) > 1:
            self.store = [np.concatenate(self.store)]
        return self.store[0]

    @staticmethod
    def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
        """Whether slices of a equal slices of b, some thousands at a time."""
        out = a_size == b_size
        same = np.flatnonzero(out)
        for i in range(0, len(same), 8192):
            some = same[i : i + 8192]
            size = b_size[some]
            differ = gather(a, a_at[some], size) != gather(b, b_at[some], size)
            out[some] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
        return out


def _suffixes(docs: DataFrame, width: int, gram: int, splitters: np.ndarray, at_once: int = 16 << 20) -> DataFrame:
    """Kind 0: for each range a packed list of suffixes; kind 1: windows of one document (head) that are settled already."""

    def send(parts: list[tuple]) -> pa.RecordBatch:
        route, head, size, where, places, text = (np.concatenate(c) for c in zip(*parts, strict=True))
        at, first_place = np.cumsum(size) - size, np.cumsum(places) - places
        by = np.argsort(route, kind="stable")
        ends = np.flatnonzero(np.r_[route[by][1:] != route[by][:-1], True]) + 1
        pack = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
            mine = by[a:b]
            front = len(mine).to_bytes(4, "little") + head[mine].tobytes() + gather(where, first_place[mine], places[mine]).tobytes()
            rows.append((int(route[mine[0]]), 0, None, pack(front), pack(gather(text, at[mine], size[mine]).tobytes())))
        return batch_of(rows, _SUFFIXES)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = FirstSeen()
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            rks, ds, vs = batch.column("rk").to_numpy(), batch.column("d").to_numpy(), batch.column("vs")
            for at, texts in text_blocks(batch):
                block = Bytes(texts, width, gram)
                wanted = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in vs.slice(at, len(texts))]))
                anchors = block.anchors()
                if not len(anchors):
                    continue
                j = np.flatnonzero(block.valid & np.isin(block.least, wanted))
                if not len(j):
                    continue
                p = block.anchor_of(j, anchors)
                cut = np.flatnonzero(np.r_[True, (j[1:] != j[:-1] + 1) | (p[1:] != p[:-1]) | (block.doc[j[1:]] != block.doc[j[:-1]])])
                start, count, p = j[cut], np.diff(np.r_[cut, len(j)]), p[cut]
                size, doc = count + width - 1, block.doc[j[cut]]
                power, inverse = powers(_SPAN_BASE, len(block.data))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[block.data] * power)])
                key = mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64) * np.uint64(1_000_003) + (p - start).astype(np.uint64)) ^ mix(block.grams[p])
                d, rk = ds[at + doc], rks[at + doc]
                known = seen.smaller(key, d, block.data, start, size)
                if known.any():
                    yield _told(rk[known], d[known], (start - block.first[doc])[known], (np.uint64(1) << count[known].astype(np.uint64)) - np.uint64(1))
                # equal stretches of one document go out once, with all their places
                keep = np.flatnonzero(~known)
                order = keep[np.lexsort((start[keep], key[keep], doc[keep]))]
                if not len(order):
                    continue
                lead = np.flatnonzero(np.r_[True, (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])])
                places = np.diff(np.r_[lead, len(order)])
                one = order[lead]
                lead_bytes = _leading(block.data, p[one], width)
                route = np.searchsorted(splitters, lead_bytes, "right")
                # the first windows of a stretch, with the fewest bytes from the anchor on, may continue beyond the range
                apart = np.clip((p - start)[one] - width + _reach(lead_bytes, route, splitters, gram) + 1, 0, count[one])
                inner = np.flatnonzero(apart < count[one])
                of = np.concatenate([inner, np.repeat(np.arange(len(one)), apart)])
                shift = np.concatenate([apart[inner], np.arange(apart.sum()) - np.repeat(np.cumsum(apart) - apart, apart)])
                length = np.concatenate([(size[one] - apart)[inner], np.full(len(of) - len(inner), width)])
                begin, n_places = start[one][of] + shift, places[of]
                alone = begin[len(inner) :]
                window = mix((sums[alone + width] - sums[alone]) * inverse[alone])
                route = np.concatenate([route[inner], len(splitters) + 1 + (window % np.uint64(len(splitters) + 1)).astype(np.int64)])
                where = gather((start - block.first[doc])[order], lead[of], n_places) + np.repeat(shift, n_places)
                head = np.empty(len(of), _HEAD)
                head["rk"], head["d"], head["left"], head["size"], head["places"] = rk[one][of], d[one][of], (p[one][of] - begin), length, n_places
                text = gather(block.data, begin, length)
                parts.append((route, head, length, where.astype("<u4"), n_places, text))
                held += len(text)
                if held > at_once:
                    yield send(parts)
                    parts, held = [], 0
        if parts:
            yield send(parts)

    return docs.mapInArrow(tidied(go), _SUFFIXES)


_ENTRY = np.dtype([("start", "<u4"), ("mask", "<u8")])


def _told(rk: np.ndarray, d: np.ndarray, start: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 1: for each document its identifier (8 bytes) and entries (start, windows from there that repeat)."""
    order = np.lexsort((start, d, rk))
    rk, d = rk[order], d[order]
    entries = np.empty(len(rk), _ENTRY)
    entries["start"], entries["mask"] = start[order], mask[order]
    new = np.flatnonzero(np.r_[True, (rk[1:] != rk[:-1]) | (d[1:] != d[:-1])])
    raw, size = entries.tobytes(), _ENTRY.itemsize
    heads = [int(d[a]).to_bytes(8, "little", signed=True) + raw[a * size : b * size] for a, b in zip(new, np.r_[new[1:], len(rk)], strict=True)]
    keys = rk[new]
    return batch_of([(k, 1, k, h, None) for k, h in zip(keys.tolist(), heads, strict=True)], _SUFFIXES)


def multikey_order(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of big-endian digits by multikey quicksort: equal runs of one digit are sorted by the next.

    Returns the order and for each place the number of leading digits shared with the row before.
    """
    n, depth = digits.shape
    order = np.argsort(digits[:, 0], kind="stable")
    shared = np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)
    open_ = np.arange(n)
    for level in range(depth):
        x = digits[order[open_], level]
        if level:
            inner = np.lexsort((x, run[open_]))
            order[open_] = order[open_][inner]
            x = x[inner]
        same = np.zeros(len(open_), bool)
        same[1:] = (x[1:] == x[:-1]) & (run[open_][1:] == run[open_][:-1]) & (open_[1:] == open_[:-1] + 1)
        shared[open_[same]] = level + 1
        run[open_] = open_[np.maximum.accumulate(np.where(same, 0, np.arange(len(open_))))]
        open_ = open_[same | np.r_[same[1:], False]]
        if not len(open_):
            break
    return order, shared


def _settle(rows: list[tuple], width: int, gram: int) -> np.ndarray:
    """Windows of one range's suffixes that also begin in a document with a smaller identifier."""
    heads, places, bodies = [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for head, body in rows:
        head, body = unpack(head), unpack(body)
        n = int.from_bytes(head[:4], "little")
        h = np.frombuffer(head, _HEAD, n, 4)
        heads.append(h)
        places.append(np.frombuffer(head, "<u4", offset=4 + n * _HEAD.itemsize))
        bodies.append(np.frombuffer(body, np.uint8))
    h, where, text = np.concatenate(heads), np.concatenate(places), np.concatenate(bodies)
    n, reach = len(h), width - gram
    left, size = h["left"].astype(np.int64), h["size"].astype(np.int64)
    wide = np.zeros((n, reach + (width + 7) // 8 * 8), np.uint8)
    at = np.cumsum(size) - size
    column = np.arange(len(text)) - np.repeat(at, size) + np.repeat(reach - left, size)
    wide[np.repeat(np.arange(n), size), column] = text
    digits = wide[:, reach:].copy().view(">u8").astype(np.uint64)
    order, shared = multikey_order(digits)
    # bytes shared with the suffix before in order
    before = np.r_[order[:1], order[:-1]]
    differ = wide[order, reach : reach + width] != wide[before, reach : reach + width]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[:1] = 0
    assert (lcp >= np.minimum(shared * 8, width)).all()
    low, high = left - (size - width), left  # offsets of the anchor in the windows of each suffix
    d = h["d"]
    mask = np.zeros(n, np.uint64)
    hashed = np.zeros(n, np.uint64)
    power = np.uint64(1)
    for o in range(reach + 1):
        own = (low[order] <= o) & (o <= high[order])
        if own.any():
            group = np.cumsum(lcp < width - o)
            some = order[own]
            key = mix(hashed[some] + group[own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            by = np.lexsort((d[some], key))
            some, key = some[by], key[by]
            new = np.r_[True, key[1:] != key[:-1]]
            lead = some[np.flatnonzero(new)][np.cumsum(new) - 1]
            smaller = d[lead] < d[some]
            a, b = some[smaller], lead[smaller]
            window = slice(reach - o, reach - o + width)
            if len(a) and not (wide[a, window] == wide[b, window]).all():
                smaller = _exactly(wide[some, window], d[some])  # two hashes met
            mask[some[smaller]] |= np.uint64(1) << (high[some[smaller]] - o).astype(np.uint64)
        if o < reach:
            hashed += _BYTE[wide[:, reach - 1 - o]] * power
            power = np.uint64(int(power) * _BASE & (1 << 64) - 1)
    hit = np.repeat(mask != 0, h["places"])
    out = np.empty(int(hit.sum()), _ANSWER)
    out["rk"], out["d"], out["mask"] = (np.repeat(x, h["places"])[hit] for x in (h["rk"], d, mask))
    out["start"] = where[hit]
    return out


def _exactly(windows: np.ndarray, d: np.ndarray) -> np.ndarray:
    least: dict[bytes, int] = {}
    keys = [w.tobytes() for w in windows]
    for k, x in zip(keys, d.tolist(), strict=True):
        least[k] = min(x, least.get(k, x))
    return np.array([least[k] < x for k, x in zip(keys, d.tolist(), strict=True)])


_ANSWER = np.dtype([("rk", "<i8"), ("d", "<i8"), ("start", "<u4"), ("mask", "<u8")])


def _settled(suffixes: DataFrame, width: int, gram: int) -> DataFrame:
    """rk, found (one value for each identifier: its 8 bytes and entries) of all windows to remove, one row for each row key.

    A range's answers go out in one packed row for each bucket of row keys, and are unpacked where all of a bucket's meet.
    """
    n_buckets = partitions(suffixes.sparkSession)

    def pack(found: list[np.ndarray]) -> pa.RecordBatch:
        answers = np.concatenate(found)
        bucket = (answers["rk"].view(np.uint64) >> np.uint64(20)) % np.uint64(n_buckets)
        order = np.lexsort((answers["start"], answers["rk"], bucket))
        answers, bucket = answers[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = []
        for a, b in zip(cut, np.r_[cut[1:], len(answers)], strict=True):
            some = answers[a:b]
            rows.append((int(bucket[a]), squeeze(b"".join(np.ascontiguousarray(some[c]).tobytes() for c in _ANSWER.names))))
        return batch_of(rows, "bucket int, answers binary")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[np.ndarray] = []
        last, n = None, 0
        for batch in batches:
            for route, kind, rk, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    if held and route != last:
                        found.append(_settle(held, width, gram))
                        held, n = [], n + len(found[-1])
                    held.append((head, body))
                    last = route
                else:
                    entries = np.frombuffer(head, _ENTRY, offset=8)
                    told = np.empty(len(entries), _ANSWER)
                    told["rk"], told["d"], told["start"], told["mask"] = rk, int.from_bytes(head[:8], "little", signed=True), entries["start"], entries["mask"]
                    found.append(told)
                    n += len(told)
                if n > 1_000_000:
                    yield pack(found)
                    found, n = [], 0
        if held:
            found.append(_settle(held, width, gram))
            n += len(found[-1])
        if n:
            yield pack(found)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor().decompress
        parts = []
        for batch in batches:
            for blob in batch.column("answers"):
                raw = loose(blob.as_py())
                m, at = len(raw) // _ANSWER.itemsize, 0
                part = np.empty(m, _ANSWER)
                for c in _ANSWER.names:
                    part[c] = np.frombuffer(raw, _ANSWER[c], m, at)
                    at += m * _ANSWER[c].itemsize
                parts.append(part)
        if not parts:
            return
        x = np.concatenate(parts)
        x = x[np.lexsort((x["start"], x["d"], x["rk"]))]
        entries = np.empty(len(x), _ENTRY)
        entries["start"], entries["mask"] = x["start"], x["mask"]
        raw, size = entries.tobytes(), _ENTRY.itemsize
        lead = np.flatnonzero(np.r_[True, (x["rk"][1:] != x["rk"][:-1]) | (x["d"][1:] != x["d"][:-1])])
        values = [int(x["d"][a]).to_bytes(8, "little", signed=True) + raw[a * size : b * size] for a, b in zip(lead, np.r_[lead[1:], len(x)], strict=True)]
        keys = x["rk"][lead]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a in range(0, len(first), 2000):
            some = np.r_[first[a : a + 2000], first[a + 2000] if a + 2000 < len(first) else len(keys)]
            found = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(values[some[0] : some[-1]], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[some[:-1]]), found], ["rk", "found"])

    packed = dealt(suffixes, n_buckets, "route").sortWithinPartitions("route").mapInArrow(tidied(go), "bucket int, answers binary")
    return dealt(packed, n_buckets, "bucket").select("answers").mapInArrow(tidied(unpack), "rk long, found array<binary>")


def splitters_of(docs: DataFrame, width: int, gram: int, ranges: int, sample: int = 2000) -> np.ndarray:
    """Leading bytes that cut anchors into equal ranges, from about 20 keys a range of about ``sample`` documents.

    The rate of keys follows the bytes of the documents drawn, so what reaches the driver is bounded by ``ranges`` however long they are.
    """
    n = docs.count()
    drawn = docs.select("rk", "text").where(F.shiftrightunsigned(F.xxhash64("rk", F.lit(5)), 32) < int(min(1.0, sample / max(n, 1)) * (1 << 32)))
    size = drawn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    step = max(1, size // (18 * max(2000, 20 * ranges)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch):
                block = Bytes(texts, width, gram)
                keys = _leading(block.data, block.anchors()[::step], width)
                yield pa.RecordBatch.from_arrays([_binaries(keys.tobytes(), np.arange(len(keys) + 1) * width)], ["k"])

    rows = drawn.select("text").mapInArrow(tidied(go), "k binary").toArrow()
    return cut_keys(np.frombuffer(b"".join(rows["k"].to_pylist()), f"S{width}"), ranges)


def cut_keys(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Quantiles of the keys, each cut behind the first byte in which it differs from the next smaller key."""
    keys, counts = np.unique(keys, return_counts=True)
    if not len(keys):
        return keys
    ends = np.cumsum(counts)
    at = np.unique(np.searchsorted(ends, np.arange(1, ranges) * ends[-1] // ranges, "right"))
    at = at[at > 0]
    bytes_ = _rows(keys[at]).copy()
    bytes_[np.arange(keys.itemsize) > _shared(keys[at], keys[at - 1])[:, None]] = 0
    return np.unique(bytes_.view(keys.dtype).ravel())


_ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def remove_repeats(df: DataFrame, width: int = 50, gram: int = 18, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) of every row: without bytes of strings of ``width`` bytes
    that also begin in a document with a smaller doc_id.

    Null texts are empty.  Strings are judged on the input.  Rows with the same doc_id remove nothing from each other, repeated rows
    included; a null doc_id is smaller than all others.  Extra columns are left out; an empty table has no rows.  A window's anchors
    are told in 64 bits, so ``width - gram`` is below 63, and ``gram`` is at least 8.
    """
    if not 8 <= gram <= width or width - gram > 62:
        raise ValueError("gram must be 8 or more and width at most gram + 62")
    spark = df.sparkSession
    docs = keyed(df)
    n = partitions(spark)
    told = _by_document(_repeated(_anchor_pieces(docs, width, gram, 4 * n)))
    splitters = splitters_of(docs, width, gram, 4 * n)
    candidates = docs.join(told, "rk").select("rk", ordered_id(), "text", "vs").sortWithinPartitions("d")
    found = _settled(_suffixes(candidates, width, gram, splitters), width, gram)
    joined = docs.join(found, "rk", "left").select("doc_id", ordered_id(), "text", "found")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(64, dtype=np.uint64)
        for batch in batches:
            out = []
            for doc_id, d, text, told in zip(batch.column("doc_id").to_pylist(), batch.column("d").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                own = [np.frombuffer(f, _ENTRY, offset=8) for f in told or [] if int.from_bytes(f[:8], "little", signed=True) == d]
                removed = spans = 0
                if own:
                    entries = np.concatenate(own)
                    row, bit = np.nonzero(entries["mask"][:, None] >> bits & np.uint64(1))
                    gone = covered(entries["start"][row].astype(np.int64) + bit, width, len(data))
                    removed, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(data) + removed, removed, spans, hashlib.sha256(data).hexdigest(), data if kept else None))
            yield batch_of(out, _ROWS)

    result = joined.mapInArrow(tidied(go), _ROWS)
    return result if kept else result.drop("kept_bytes")
