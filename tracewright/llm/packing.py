"""Best-fit packing of tokenised documents into fixed sequences, by bin completion over the histogram of lengths.

Lengths are integers from 1 to ``capacity``, so the whole problem is a histogram of at most ``capacity`` counts, however many
documents there are: the search for a plan sees only it, and the plan's rows then find their pieces by rank within a length.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import encoder
from .common import documents, materialise, tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def tokenised_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids; the first piece of a longer document takes what full pieces leave.

    ``part`` and ``k`` number the pieces of each length within the task that made them.  Null texts count as empty: one end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array(end_id, enc.dtype).tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, enc.dtype).astype("<u4")
                at, to = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while at < len(ids):
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[at:to]), part, int(seen[to - at])))
                    seen[to - at] += 1
                    at, to, piece = to, to + capacity, piece + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return documents(df).mapInArrow(tidied(cut), PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs: by volume, and by items over a half with those that fit beside none of them (Martello and Toth's L2)."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        big = int(counts[capacity - k + 1 :].sum())
        half = counts[capacity // 2 + 1 : capacity - k + 1]
        middle = int(half.sum())
        room = middle * capacity - int((half * sizes[capacity // 2 + 1 : capacity - k + 1]).sum())
        small = int((counts[k : capacity // 2 + 1] * sizes[k : capacity // 2 + 1]).sum())
        best = max(best, big + middle + max(0, -(-(small - room) // capacity)))
    return best


Filling = tuple[tuple[int, int], ...]  # (length, copies) of one bin, longest first
Plan = list[tuple[Filling, int]]  # fillings and how many bins have them


def best_fit(counts: np.ndarray, times_at_once: bool = True) -> Plan:
    """Best-fit decreasing on the histogram: each bin takes its largest remaining length, then again the largest that fits."""
    left, plan = counts.astype(np.int64).copy(), []
    for top in range(len(left) - 1, 0, -1):
        while left[top]:
            room, filling = len(left) - 1, {}
            size = top
            while room and size:
                n = min(room // size, int(left[size]) - filling.get(size, 0))
                if n > 0:
                    filling[size] = filling.get(size, 0) + n
                    room -= n * size
                size = min(room, size - 1)
                while size and left[size] - filling.get(size, 0) <= 0:
                    size -= 1
            times = min(int(left[s]) // c for s, c in filling.items()) if times_at_once else 1
            for s, c in filling.items():
                left[s] -= c * times
            plan.append((tuple(sorted(filling.items(), reverse=True)), times))
    return plan


def reachable(sizes: list[int], capacity: int) -> list[int]:
    """For each of ascending sizes the sums up to ``capacity`` that it and smaller ones can make in any number, as bits."""
    full, sums, out = (1 << capacity + 1) - 1, 1, []
    for s in sizes:
        step = s
        while step <= capacity:
            sums |= sums << step & full
            step *= 2
        out.append(sums)
    return out


class Stock:
    """Lengths left to pack, and the undominated fillings of a bin around one of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.sizes, self.sums, self.unused = [], [], 0
        self.refresh()

    def refresh(self) -> None:
        """To be called when lengths have run out or come back."""
        self.sizes = [s for s in sorted(self.left) if self.left[s]]
        self.sums = reachable(self.sizes, self.capacity)
        self.unused = sum(1 << s for s in self.sizes)

    def take(self, filling: Filling, times: int = 1) -> None:
        for s, k in filling:
            self.left[s] -= k * times

    def fillings(self, top: int, most_waste: int, most: int, steps: int) -> list[tuple[int, Filling]]:
        """(waste, filling) of up to ``most`` undominated bins that hold ``top``, fullest first; of equal waste the longest lengths first.

        Every length is tried only where the rest of the room is a sum that shorter ones can make, and no longer unused length could take
        the place of it or of it and another chosen one without overflowing (Martello and Toth).  After ``steps`` lengths the search ends
        with what it has.
        """
        left, sizes, sums = self.left, self.sizes, self.sums
        found: list[tuple[int, Filling]] = []
        chosen: list[tuple[int, int]] = []
        left[top] -= 1

        def go(to: int, rest: int, waste: int, unused: int) -> bool:
            """``unused``: lengths of which there are more than chosen, as bits."""
            nonlocal steps
            if not rest:
                held = {top: 1}
                for s, k in chosen:
                    held[s] = held.get(s, 0) + k
                found.append((waste, tuple(sorted(held.items(), reverse=True))))
                return len(found) >= most
            some = (1 << waste + 1) - 1
            for i in range(bisect_right(sizes, rest, 0, to) - 1, -1, -1):
                if not sums[i] >> rest & 1:
                    return False
                s = sizes[i]
                steps -= 1
                if steps < 0:
                    return True
                if waste and unused >> s + 1 & some >> 1 or any(unused >> s + a & some for a, _ in chosen):
                    continue
                for k in range(min(rest // s, left[s], 1 if unused >> 2 * s & some else rest), 0, -1):
                    chosen.append((s, k))
                    stop = go(i, rest - k * s, waste, unused if k < left[s] else unused & ~(1 << s))
                    chosen.pop()
                    if stop:
                        return True
            return False

        room = self.capacity - top
        unused = self.unused if left[top] else self.unused & ~(1 << top)
        for waste in range(min(most_waste, room) + 1):
            if go(len(sizes), room - waste, waste, unused):
                break
        left[top] += 1
        return found


def fullest_first(counts: dict[int, int], capacity: int, steps: int = 3000) -> Plan:
    """Each bin takes the longest length left with its fullest filling, as many times as counts allow; best fit where none is found."""
    stock, plan = Stock(counts, capacity), []
    while stock.sizes:
        top = stock.sizes[-1]
        found = stock.fillings(top, capacity, 1, steps)
        if found:
            filling = found[0][1]
        else:
            room, held = capacity, {}
            for s in reversed(stock.sizes):
                if n := min(room // s, stock.left[s]):
                    held[s] = n
                    room -= n * s
            filling = tuple(held.items())
        times = min(stock.left[s] // k for s, k in filling)
        stock.take(filling, times)
        plan.append((filling, times))
        if any(not stock.left[s] for s, _ in filling):
            stock.refresh()
    return plan


def complete(counts: dict[int, int], bins: int, capacity: int, nodes: int, rng: random.Random, most: int = 6, look: int = 8) -> Plan | None:
    """Branch and bound for a packing into ``bins`` bins; None if ``nodes`` nodes and ``most`` fillings a branch do not find it.

    A branch completes the bin of that of the ``look`` longest lengths which has the fewest fillings within the waste that is left to
    spend; it ends where one of them has none.  It takes a filling as many times as counts and waste allow, then half as often and so on,
    so a plan is as deep as it has fillings, not bins, and the search is the same for few documents and many.  Fillings with fewer pieces
    come first, ties in random order.
    """
    stock, plan = Stock(counts, capacity), []
    spare = bins * capacity - sum(s * k for s, k in counts.items())
    if spare < 0:
        return None

    def branch() -> list[tuple[int, Filling, int]]:
        """(waste, filling, times) in the order to be tried."""
        options: list[tuple[int, Filling]] | None = None
        for top in stock.sizes[: -look - 1 : -1]:
            found = stock.fillings(top, spare, len(options) if options else most, 400)
            if not found:
                return []
            if options is None or len(found) < len(options):
                options = found
            if len(options) == 1:
                break
        rng.shuffle(options)
        options.sort(key=lambda o: (o[0], sum(k for _, k in o[1])))
        often = [min(spare // w if w else stock.left[f[0][0]], *(stock.left[s] // k for s, k in f)) for w, f in options]
        return [(w, f, n >> i) for i in range(max(often).bit_length()) for (w, f), n in zip(options, often, strict=True) if n >> i]

    branches: list[Iterator[tuple[int, Filling, int]]] = []
    while stock.sizes:
        nodes -= 1
        if nodes < 0:
            return None
        branches.append(iter(branch()))
        while (step := next(branches[-1], None)) is None:
            branches.pop()
            if not branches:
                return None
            waste, filling, times = plan.pop()
            stock.take(filling, -times)
            stock.refresh()
            spare += waste * times
        waste, filling, times = step
        stock.take(filling, times)
        if not all(stock.left[s] for s, _ in filling):
            stock.refresh()
        spare -= waste * times
        plan.append(step)
    return [(filling, times) for _, filling, times in plan]


def tighten(counts: dict[int, int], bins: int, waste: int, capacity: int, nodes: int, rng: random.Random) -> list[Filling] | None:
    """The same pieces as ``bins`` - 1 bins with at most ``waste`` in all and the rest in one open bin, which comes last and may be empty."""
    volume = sum(s * k for s, k in counts.items())
    stock, plan, aside = Stock(counts, capacity), [], []

    def go(spare: int, room: int) -> bool:
        """``room``: what of the open bin's share is not set aside yet."""
        nonlocal nodes
        if len(plan) == bins - 1:
            return True
        stock.refresh()
        nodes -= 1
        if not stock.sizes or nodes < 0:
            return False
        top = stock.sizes[-1]
        options: list[tuple[int, Filling | None]] = list(stock.fillings(top, spare, 6, 200))
        rng.shuffle(options)
        options.sort(key=lambda o: o[0])
        if top <= room:
            options.insert(0 if rng.random() < 0.3 else len(options), (0, None))
        for loss, filling in options:
            stock.take(filling or ((top, 1),))
            (aside if filling is None else plan).append(top if filling is None else filling)
            if go(spare - loss, room - top if filling is None else room):
                return True
            (aside if filling is None else plan).pop()
            stock.take(filling or ((top, 1),), -1)
            if nodes < 0:
                return False
        return False

    open_room = volume - ((bins - 1) * capacity - waste)
    if open_room > capacity or not go(waste, open_room):
        return None
    rest = {s: k for s, k in stock.left.items() if k}
    for s in aside:
        rest[s] = rest.get(s, 0) + 1
    return [*plan, tuple(sorted(rest.items(), reverse=True))]


def walk(plan: Plan, bound: int, capacity: int, steps: int, rng: random.Random) -> Plan:
    """Repack a few bins at a time so that the waste moves into one open bin, until it is empty; then into the next."""
    bins: Counter[Filling] = Counter()
    for filling, times in plan:
        bins[filling] += times
    room = {f: capacity - sum(s * k for s, k in f) for f in bins}
    loose = {f for f in bins if room[f]}
    every = list(bins)
    spare = sum(room[f] * bins[f] for f in loose)
    while steps and spare >= capacity and bins.total() > bound:
        steps -= 1
        open_ = max(loose, key=lambda f: (room[f], f))
        n = rng.choice((2, 2, 3, 3, 4))
        others = sorted(f for f in loose if f != open_ or bins[f] > 1)
        some = rng.sample(others, min(len(others), rng.randint(1, n - 1)))
        while len(some) < n - 1:
            f = rng.choice(every)
            if (f == open_) + some.count(f) < bins[f]:
                some.append(f)
            elif bins.total() < n:
                break
        pieces: Counter[int] = Counter()
        for f in (open_, *some):
            pieces.update(dict(f))
        now = sum(room[f] for f in some)
        got = (tighten(pieces, len(some) + 1, now - 1, capacity, 30, rng) if now else None) or tighten(pieces, len(some) + 1, now, capacity, 30, rng)
        if not got:
            continue
        for f in (open_, *some):
            bins[f] -= 1
            if not bins[f]:
                loose.discard(f)
        for f in got:
            if f:
                if f not in room:
                    room[f] = capacity - sum(s * k for s, k in f)
                    every.append(f)
                bins[f] += 1
                if room[f]:
                    loose.add(f)
            else:
                spare -= capacity
    return [(f, n) for f, n in bins.items() if n]


def bin_completion(counts: np.ndarray, nodes: int = 10_000, steps: int = 3000) -> Plan:
    """A plan of as few bins as bin completion finds; best fit is the first incumbent, the fullest fillings the second.

    Of any number of bins, all of the problem is searched for one bin less, in dives of up to four nodes a row of the plan with other
    random ties each, and again after a success, for ``nodes`` nodes altogether.  Then a walk of ``steps`` steps solves residual
    problems of two to four bins by the same fillings.  The search ends at once when the lower bound is met.  It is bounded by nodes,
    not by time, so a plan is always the same; beyond these bounds a plan with fewer bins may exist.
    """
    bound, capacity = lower_bound(counts), len(counts) - 1
    whole = int(counts[capacity])
    known = {int(s): int(counts[s]) for s in np.flatnonzero(counts[:-1])}
    best = min(best_fit(np.r_[counts[:-1], 0]), fullest_first(known, capacity), key=bins_of)
    bound -= whole
    rng = random.Random(7)
    while nodes > 0 and bound < bins_of(best):
        dive = min(nodes, 4 * len(best))
        nodes -= dive
        best = complete(known, bins_of(best) - 1, capacity, dive, rng) or best
    if bins_of(best) > bound:
        best = walk(best, bound, capacity, steps, rng)
    return [*best, *([(((capacity, 1),), whole)] if whole else [])]


def bins_of(plan: Plan) -> int:
    return sum(t for _, t in plan)


def placements(plan: Plan, capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first bin, copies in a bin, offset of the first copy), ascending by rank."""
    at: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for filling, times in plan:
        offset = 0
        for s, c in filling:
            out.setdefault(s, []).append((at.get(s, 0), first, c, offset))
            at[s] = at.get(s, 0) + c * times
            offset += s * c
        first += times
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    ``bin_completion`` says how far the search for few sequences goes; it always places every piece.  Null texts count as empty: one
    end id; a null doc_id is an identifier like others.  The tokenised pieces are written once.  Only counts by length (at most ``capacity`` rows) reach the driver, which searches the
    plan; counts by task and length stay distributed and turn each piece's number in its task into a rank within its length.  An
    empty table has no rows; repeated rows are packed as often as they occur; extra columns are left out.
    """
    pieces = materialise(tokenised_pieces(df, tokenizer, end_id, capacity), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    placed = placements(bin_completion(counts), capacity)
    before = by_task.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("r").to_numpy()
            bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                own = np.flatnonzero(length == s)
                t = placed[int(s)]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                within = rank[own] - row[:, 0]
                bins[own] = row[:, 1] + within // row[:, 2]
                offset[own] = row[:, 3] + within % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
