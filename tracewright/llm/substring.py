"""Repeated runs of words, found with a log-structured index of window fingerprints.

A window is ``width`` words.  Its fingerprint is the smallest hash of the ``gram``-word runs inside it, so equal windows have equal
fingerprints and neighbouring windows mostly share theirs: a document has about one for every fourteen words.

The index holds sorted immutable runs, one for each batch: ``keys`` (fingerprint, how often) and ``places`` (fingerprint, row key), both
in the same fixed buckets.  A new batch becomes a run; then each bucket's file of it is merge-joined with the same bucket's files of
the runs from before, which are read in order and never exchanged.  Only fingerprints that the batch has too are looked up in the
places of old runs.  More than ``fan_in`` runs are compacted into one, bucket by bucket, again without an exchange.

Windows whose fingerprint occurs more than once are then verified: their words go to one task by fingerprint and are compared as bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batch_of, BLOCK_BYTES, blocks, covered, documents, filesystem, materialise, mix, partitions, rolling, scratch, sliding_max, sliding_min, tidied, word_hashes, word_spans

_GRAM_BASE, _WINDOW_BASE, _CHECK_BASE = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Block:
    """Words of some documents, and for each window its fingerprint, its hash and the document that holds it (-1: none)."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, ends = word_spans(data)
        self.data, self.starts, self.ends = data, starts, ends
        self.words = word_hashes(data, starts, ends)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        limits = np.cumsum(lengths)
        self.doc = np.searchsorted(limits, starts, "right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))
        n = len(self.words) - width + 1
        self.gram, self.inside = gram, width - gram + 1
        if n <= 0:
            self.owner = np.zeros(0, np.int64)
            self.grams = self.fingerprints = np.zeros(0, np.uint64)
            return
        self.owner = np.where(self.doc[:n] == self.doc[width - 1 :], self.doc[:n], -1)
        self.grams = rolling(self.words, gram, _GRAM_BASE) | np.uint64(1)
        self.fingerprints = sliding_min(self.grams, self.inside)

    def anchors(self) -> np.ndarray:
        """Places whose gram is the fingerprint of a window around it; ties are all there."""
        if not len(self.owner):
            return np.zeros(0, np.int64)
        valid = np.zeros(len(self.owner) + 2 * (self.inside - 1), np.uint64)
        valid[self.inside - 1 : len(valid) - self.inside + 1] = np.where(self.owner >= 0, self.fingerprints, np.uint64(0))
        return np.flatnonzero(sliding_max(valid, self.inside) == self.grams)


def text_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """First row and UTF-8 texts of blocks of about BLOCK_BYTES."""
    column = batch.column("text")
    texts = [t.as_buffer().to_pybytes() for t in column]
    for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK_BYTES):
        yield a, texts[a:b]


def fingerprints(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """v, rk, n: each document's distinct fingerprints and how often each one's gram occurs there."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("rk").to_numpy()
            for at, texts in text_blocks(batch):
                block = Block(texts, width, gram)
                places = block.anchors()
                doc, v = block.doc[places], block.grams[places]
                order = np.lexsort((v, doc))
                doc, v = doc[order], v[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])][: len(v)])
                n = np.diff(np.r_[new, len(v)])
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(v[new].view(np.int64)), pa.array(keys[at + doc[new]]), pa.array(np.minimum(n, 2).astype(np.int32))], ["v", "rk", "n"])

    return docs.select("rk", "text").mapInArrow(tidied(go), "v long, rk long, n int")


_KEYS, _PLACES = "v long, docs long, n long, slices int", "v long, rk long, n int"
_HITS = "v long, run int, slices int, hot boolean"


class Run:
    """Files of one bucket of a run, read in order: ``upto`` gives the rows that are left with v at most a bound."""

    def __init__(self, files: list[str]):
        self.streams = [iter(self._batches(f)) for f in files]
        self.held: list[dict[str, np.ndarray] | None] = [next(s, None) for s in self.streams]

    @staticmethod
    def _batches(uri: str) -> Iterator[dict[str, np.ndarray]]:
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1 << 16):
                if batch.num_rows:
                    yield {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}

    def last(self) -> int | None:
        """A bound up to which all rows are in memory; None at the end."""
        return min((int(h["v"][-1]) for h in self.held if h is not None), default=None)

    def upto(self, bound: int) -> list[dict[str, np.ndarray]]:
        out = []
        for i, stream in enumerate(self.streams):
            while (h := self.held[i]) is not None:
                n = int(np.searchsorted(h["v"], bound, "right"))
                if n:
                    out.append({c: x[:n] for c, x in h.items()})
                if n < len(h["v"]):
                    self.held[i] = {c: x[n:] for c, x in h.items()}
                    break
                self.held[i] = next(stream, None)
        return out


def _merged(runs: list[Run]) -> Iterator[list[list[dict[str, np.ndarray]]]]:
    """Rows of sorted runs, run by run, in steps of common ranges of v: the merge of a merge join."""
    while (bound := min((b for r in runs if (b := r.last()) is not None), default=None)) is not None:
        yield [r.upto(bound) for r in runs]


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


class FingerprintIndex:
    """Sorted immutable runs in ``folder``: ``add`` merge-joins a batch with all runs and adds its run, ``compact`` merges all into one.

    ``_runs.json`` in the folder lists the runs with their files; an index opened on the folder goes on from there.  A run is listed
    only when its files are complete, so what lost executors or failed batches leave behind is never read.  One writer at a time.
    A fingerprint that more than ``hot`` documents of a batch have is cut into slices by row key, each in a bucket of its own.
    """

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 8, hot: int = 1000, buckets: int | None = None):
        self.spark, self.folder, self.fan_in = spark, folder.rstrip("/"), fan_in
        fs, at = filesystem(f"{self.folder}/_runs.json")
        if fs.get_file_info(at).is_file:
            with fs.open_input_stream(at) as f:
                held = json.loads(f.read())
            self.runs, self.buckets, self.hot = held["runs"], held["buckets"], held["hot"]
        else:
            self.runs, self.buckets, self.hot = [], buckets or partitions(spark), hot

    def _save(self, runs: list[dict]) -> None:
        self.runs = runs
        fs, at = filesystem(f"{self.folder}/_runs.json")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at + ".new") as f:
            f.write(json.dumps({"buckets": self.buckets, "hot": self.hot, "runs": runs}).encode())
        fs.move(at + ".new", at)

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, path: str, schema: str) -> dict[str, list[str]]:
        """Sorted files of each bucket."""
        order = [f.split()[0] for f in schema.split(", ")][:2]
        rows.repartition(partitions(self.spark), "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        out: dict[str, list[str]] = {}
        for uri in self.spark.read.schema(schema).parquet(path).inputFiles():
            out.setdefault(re.search(r"/bucket=(\d+)/", uri)[1], []).append(uri)
        return out

    def add(self, rows: DataFrame) -> DataFrame:
        """v, rk, hot: which documents, of the batch and of old runs, have a fingerprint of the batch that occurs more than once.

        ``rows`` is a written table of v, rk, n.  Old documents that share fingerprints only among themselves were told before.
        """
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        keys = rows.groupBy("v").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("n")).withColumn("slices", F.ceil(F.col("docs") / self.hot).cast("int"))
        new = {"name": path, "keys": self._write(keys.select("*", self._bucket("v")), f"{path}/keys", _KEYS)}
        often = self.spark.read.schema(_KEYS).parquet(f"{path}/keys").where("slices > 1").select("v", "slices")
        places = rows.join(often, "v", "left").withColumn("j", F.pmod(F.xxhash64("rk"), F.coalesce("slices", F.lit(1))).cast("int"))
        new["places"] = self._write(places.select("v", "rk", "n", self._bucket("v", "j")), f"{path}/places", _PLACES)
        told = materialise(self._look_up([*self.runs, new]), "told")
        self._save([*self.runs, new])
        if len(self.runs) > self.fan_in:
            self.compact()
        return told

    def _tasks(self) -> DataFrame:
        """One row for each bucket, dealt evenly."""
        return self.spark.range(0, self.buckets, 1, min(self.buckets, partitions(self.spark)))

    def _hits(self, runs: list[dict]) -> DataFrame:
        """Merge join of the last run's keys with those of all others: a row for each run that has a repeated fingerprint of the last."""
        files, hot = [r["keys"] for r in runs], self.hot

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column("id").to_pylist():
                    for step in _merged([Run(f.get(str(bucket), [])) for f in files]):
                        if not step[-1]:
                            continue
                        new = _joined(step[-1])
                        v, n, docs = new["v"], new["n"].copy(), new["docs"].copy()
                        found = [(len(files) - 1, np.arange(len(v)), new["slices"])]
                        for run, parts in enumerate(step[:-1]):
                            if parts:
                                old = _joined(parts)
                                _, mine, his = np.intersect1d(v, old["v"], assume_unique=True, return_indices=True)
                                n[mine] += old["n"][his]
                                docs[mine] += old["docs"][his]
                                found.append((run, mine, old["slices"][his]))
                        for run, mine, slices in found:
                            twice = n[mine] > 1
                            own = mine[twice]
                            yield pa.RecordBatch.from_arrays([pa.array(v[own]), pa.array(np.full(len(own), run, np.int32)), pa.array(slices[twice].astype(np.int32)), pa.array(docs[own] > hot)], ["v", "run", "slices", "hot"])

        return self._tasks().mapInArrow(tidied(go), _HITS)

    def _look_up(self, runs: list[dict]) -> DataFrame:
        """v, rk, hot of the hits' places; hits go to the buckets' files, which are read in order."""
        files = [r["places"] for r in runs]
        sliced = self._hits(runs).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        asked = sliced.select("run", "v", "hot", self._bucket("v", "j")).distinct()
        asked = asked.repartition(partitions(self.spark), "bucket").sortWithinPartitions("run", "bucket", "v")

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, reader = None, None
            left: dict[str, np.ndarray] | None = None
            for batch in batches:
                run, bucket, v, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "bucket", "v", "hot"))
                cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])])
                for a, b in zip(cut, np.r_[cut[1:], len(v)], strict=True):
                    if here != (run[a], bucket[a]):
                        here, reader = (run[a], bucket[a]), Run(files[run[a]].get(str(bucket[a]), []))
                    wanted = v[a:b]
                    while (bound := reader.last()) is not None and len(wanted):
                        for left in reader.upto(min(bound, int(wanted[-1]))):
                            at = np.searchsorted(wanted, left["v"])
                            at[at == len(wanted)] = 0
                            hit = wanted[at] == left["v"]
                            if hit.any():
                                yield pa.RecordBatch.from_arrays([pa.array(left["v"][hit]), pa.array(left["rk"][hit]), pa.array(hot[a:b][at[hit]])], ["v", "rk", "hot"])
                        if bound >= wanted[-1]:
                            break

        return asked.mapInArrow(tidied(go), "v long, rk long, hot boolean")

    def compact(self) -> None:
        """One run in place of all, merged bucket by bucket; readers of the old runs must be done."""
        old, path = self.runs, f"{self.folder}/run-{uuid.uuid4().hex}"

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column("id").to_pylist():
                    for kind in ("keys", "places"):
                        writer = None
                        uri = f"{path}/{kind}/bucket={bucket}/{uuid.uuid4().hex}.parquet"
                        for step in _merged([Run(r[kind].get(str(bucket), [])) for r in old]):
                            rows = _joined([p for parts in step for p in parts])
                            order = np.lexsort((rows["rk"], rows["v"])) if kind == "places" else np.argsort(rows["v"], kind="stable")
                            rows = {c: x[order] for c, x in rows.items()}
                            same = (rows["v"][1:] == rows["v"][:-1]) & ((rows["rk"][1:] == rows["rk"][:-1]) if kind == "places" else True)
                            first = np.flatnonzero(np.r_[True, ~same])
                            how = {"docs": np.add, "n": np.add, "slices": np.maximum}
                            table = pa.table({c: how[c].reduceat(x, first).astype(x.dtype) if c in how else x[first] for c, x in rows.items()})
                            if writer is None:
                                fs, at = filesystem(uri)
                                fs.create_dir(at.rpartition("/")[0], recursive=True)
                                writer = pq.ParquetWriter(fs.open_output_stream(at), table.schema, compression="snappy")
                            writer.write_table(table)
                        if writer is not None:
                            writer.close()
                            writer.file_handle and writer.file_handle.close()
                            yield batch_of([(kind, int(bucket), uri)], "kind string, bucket int, file string")

        new: dict = {"name": path, "keys": {}, "places": {}}
        for r in self._tasks().mapInArrow(tidied(go), "kind string, bucket int, file string").collect():
            new[r.kind].setdefault(str(r.bucket), []).append(r.file)
        self._save([new])
        for r in old:
            fs, at = filesystem(r["name"])
            fs.delete_dir(at)


class SentTwice:
    """Which keys a task has sent, up to two times each; forgetting (beyond ``most`` keys) only makes it send more.

    Keys are 128 bits: where the second halves differ the key counts as new and is sent.
    """

    def __init__(self, most: int = 1_000_000):
        self.keys, self.checks, self.times, self.most = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), most

    def admit(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """True where a key comes for the first or second time."""
        unique, index, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), np.int64)
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == unique[inside]
        known[inside] = self.times[at[inside]]
        check = checks[index]
        check[inside] = self.checks[at[inside]]
        order = np.argsort(inverse, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        other = checks != check[inverse]
        ok = (rank + known[inverse] < 2) | other
        if other.any():  # sent ones that are not of the held key do not count for it
            clean = np.flatnonzero(~other)
            by = clean[np.argsort(inverse[clean], kind="stable")]
            counts = np.bincount(inverse[clean], minlength=len(unique))
            rank[by] = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
            ok = (rank + known[inverse] < 2) | other
        self.times[at[inside]] = np.minimum(2, known[inside] + counts[inside])
        fresh = ~inside
        if len(self.keys) + int(fresh.sum()) > self.most:
            self.keys, self.checks, self.times = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        else:
            merged = np.concatenate([self.keys, unique[fresh]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.checks = np.concatenate([self.checks, check[fresh]])[order]
            self.times = np.concatenate([self.times, np.minimum(2, counts[fresh]).astype(np.int8)])[order]
        return ok


#: Bytes of a window's hash by which equal windows are brought together; what counts is the comparison of their words.
HASH_BYTES = 8
_ROUTED = "route long, rk long, d long, places binary, words binary"


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.r_[0, cut], np.r_[cut, len(x)]


def _cut(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 8 * HASH_BYTES) - 1)


def candidates(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Windows (of docs: rk, d, text, vs, hot) whose fingerprint is repeated, to be settled by fingerprint.

    Neighbouring windows of a fingerprint go as one row with their words, joined by single spaces.  Windows of a hot fingerprint, such
    as those around a line that very many documents have, are dealt by their own hashes instead.

    Of equal windows a task sends the first two, enough to settle them; all later ones (equal in 128 bits) are settled at once: their
    rows have no words and are dealt by document.  So a passage that a third of all documents hold is sent twice by each task.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SentTwice()
        for batch in batches:
            rk, d, vs, hots = batch.column("rk").to_numpy(), batch.column("d").to_numpy(), batch.column("vs"), batch.column("hot")
            for at, texts in text_blocks(batch):
                block = Block(texts, width, gram)
                wanted = np.unique(vs.slice(at, len(texts)).flatten().to_numpy().view(np.uint64))
                j = np.flatnonzero((block.owner >= 0) & np.isin(block.fingerprints, wanted))
                if not len(j):
                    continue
                h, v = _cut(rolling(block.words, width, _WINDOW_BASE)[j]), block.fingerprints[j]
                check = rolling(word_hashes(block.data, block.starts, block.ends, _CHECK_BASE), width, _CHECK_BASE)[j]
                ok = sent.admit(h ^ (v * np.uint64(0x9E3779B97F4A7C15)), check)
                frequent = np.isin(v, np.unique(hots.slice(at, len(texts)).flatten().to_numpy().view(np.uint64)))
                route = np.where(frequent, mix(v ^ h), v)
                rows: list[tuple] = []
                words: list[bytes] = []
                split = -1
                for some, settle in ((j[ok], True), (j[~ok], False)):
                    if not len(some):
                        continue
                    doc = block.owner[some]
                    f = route[ok if settle else ~ok]
                    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (some[1:] != some[:-1] + 1) | (settle & (f[1:] != f[:-1]))) + 1
                    starts, ends = np.r_[0, cut], np.r_[cut, len(some)]
                    if settle:
                        for a, b, i, place, to in zip(starts.tolist(), ends.tolist(), doc[starts].tolist(), (some[starts] - block.first[doc[starts]]).tolist(), f[starts].view(np.int64).tolist(), strict=True):
                            if i != split:
                                split, words = i, texts[i].split()
                            rows.append((to, int(rk[at + i]), int(d[at + i]), place.to_bytes(4, "little"), b" ".join(words[place : place + b - a + width - 1])))
                        continue
                    runs = np.stack([some[starts] - block.first[doc[starts]], ends - starts], 1).astype("<u4")
                    owner = doc[starts]
                    for a, b in zip(*_groups(owner), strict=True):
                        i = at + owner[a]
                        rows.append((int(rk[i]), int(rk[i]), int(d[i]), runs[a:b].tobytes(), None))
                yield batch_of(rows, _ROUTED)

    return docs.mapInArrow(tidied(go), _ROUTED)


def _twice(route: np.ndarray, h: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows data[start:end] occur more than once in their route; hashes bring them together, bytes are compared."""
    order = np.lexsort((h, route))
    same = (h[order][1:] == h[order][:-1]) & (route[order][1:] == route[order][:-1])
    a, b = order[1:][same], order[:-1][same]
    equal = np.fromiter((data[i:j] == data[k:m] for i, j, k, m in zip(start[a].tolist(), end[a].tolist(), start[b].tolist(), end[b].tolist(), strict=True)), bool, len(a))
    twice = np.zeros(len(order), bool)
    twice[a[equal]] = True
    twice[b[equal]] = True
    if not equal.all():  # hashes of different windows met: all of such a class are counted by their words
        group = np.cumsum(np.r_[0, ~same])
        met = np.isin(group, group[1:][same][~equal])
        mine = order[met]
        words = [(g, data[start[i] : end[i]]) for g, i in zip(group[met].tolist(), mine.tolist(), strict=True)]
        n = Counter(words)
        twice[mine] = [n[w] > 1 for w in words]
    return twice


def settle(routed: DataFrame, width: int, at_once: int = 4 << 20) -> DataFrame:
    """rk, found: windows that occur more than once; ``found`` is d (8 bytes) and runs of them (first place, how many).

    Rows come sorted by fingerprint, and whole fingerprints are settled together, about ``at_once`` bytes of words.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        data = b"\n".join(r[4] for r in rows)
        block = np.frombuffer(data, np.uint8)
        starts, ends = word_spans(block)
        h = _cut(rolling(word_hashes(block, starts, ends), width, _WINDOW_BASE))
        row = np.searchsorted(np.cumsum([len(r[4]) + 1 for r in rows]), starts, "right")
        j = np.flatnonzero(row[: len(h)] == row[width - 1 :])
        first = np.searchsorted(row, np.arange(len(rows)))
        place = j - first[row[j]] + np.array([int.from_bytes(r[3], "little") for r in rows], np.int64)[row[j]]
        route = np.array([r[0] for r in rows], np.int64)[row[j]]
        hit = np.flatnonzero(_twice(route, h[j], data, starts[j], ends[j + width - 1]))
        if not len(hit):
            return batch_of([], "rk long, found binary")
        row = row[j]
        start = np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])]
        lead = hit[start]
        runs = np.stack([place[lead], np.diff(np.r_[np.flatnonzero(start), len(hit)])], 1).astype("<u4")
        by: dict[tuple[int, int], list[bytes]] = {}
        for i, r in zip(row[lead].tolist(), runs, strict=True):
            by.setdefault((rows[i][1], rows[i][2]), []).append(r.tobytes())
        out = [(rk, d.to_bytes(8, "little", signed=True) + b"".join(found)) for (rk, d), found in by.items()]
        return batch_of(out, "rk long, found binary")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[4] is None:
                    done.append((row[1], row[2].to_bytes(8, "little", signed=True) + row[3]))
                    continue
                if size > at_once and row[0] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
            if done:
                yield batch_of(done, "rk long, found binary")
        if held:
            yield flush(held)

    return routed.repartition(partitions(routed.sparkSession), "route").sortWithinPartitions("route").mapInArrow(tidied(go), "rk long, found binary")


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and rk, a key of the whole row.  Joins on rk that use just these columns share one exchange of the texts."""
    return documents(df).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def without(df: DataFrame, lost: DataFrame) -> DataFrame:
    """``df`` without the rows whose doc_id and text are those of a row of ``lost`` (doc_id and rk of ``keyed``); columns as they are.

    Other rows with the same doc_id stay, and so do other rows whose doc_id is null.
    """
    lost = lost.select(F.col("doc_id").alias("_lost"), F.col("rk").alias("_lost_rk")).distinct()
    own = df.withColumn("_rk", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return own.join(lost, own["doc_id"].eqNullSafe(lost["_lost"]) & (own["_rk"] == lost["_lost_rk"]), "left_anti").drop("_rk")


def ordered_id() -> Column:
    """doc_id, null: the smallest long."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d")


def places_of(found: list[bytes] | None, d: int) -> np.ndarray:
    """Places of one document among what its row key was told."""
    own = [np.frombuffer(f, "<u4", offset=8).reshape(-1, 2) for f in found or [] if int.from_bytes(f[:8], "little", signed=True) == d]
    if not own:
        return np.zeros(0, np.int64)
    start, count = np.concatenate(own).astype(np.int64).T
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(df: DataFrame, width: int = 35, gram: int = 8, batches: int = 3, fan_in: int = 2, texts: bool = True, folder: str | None = None, hot: int = 1000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row, without words of windows that start anywhere else too.

    Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none.  Windows are judged on the input.  Rows that repeat, doc_id and all,
    count as different places; a null doc_id is an identifier like others.  Extra columns are left out; an empty table has no rows.

    The index grows by ``batches`` batches, dealt by row key: each is merge-joined with the runs before it, and more than ``fan_in``
    runs are compacted.  The texts' fingerprints are taken once.
    """
    spark = df.sparkSession
    docs = keyed(df)
    index = FingerprintIndex(spark, folder or scratch(spark, "fingerprints"), fan_in, hot)
    dealt = scratch(spark, "batches")
    fingerprints(docs, width, gram).withColumn("batch", F.pmod(F.xxhash64("rk"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(dealt)
    rows = spark.read.schema(f"{_PLACES}, batch int").parquet(dealt)
    told = [index.add(rows.where(F.col("batch") == b).drop("batch")) for b in range(batches)]
    return _removed(docs, _settled(docs, told, width, gram), width, texts)


def add_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, width: int = 35, gram: int = 8, texts: bool = True) -> DataFrame:
    """The rows of ``remove_repeats`` for ``batch``, judged against the batch and all batches that ``index`` has, which gets this one.

    ``history`` has the texts of the batches before; of it only rows are read further that share a fingerprint with the batch.
    """
    docs = keyed(batch)
    told = index.add(materialise(fingerprints(docs, width, gram), "fingerprints"))
    both = docs.unionByName(keyed(history).join(told.select("rk").distinct(), "rk", "left_semi").select(docs.columns))
    return _removed(docs, _settled(both, [told], width, gram), width, texts)


def _settled(docs: DataFrame, told: list[DataFrame], width: int, gram: int) -> DataFrame:
    """rk, found of ``docs``' windows that occur more than once."""
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    asked = every.groupBy("rk").agg(F.collect_set("v").alias("vs"), F.collect_set(F.when(F.col("hot"), F.col("v"))).alias("hot"))
    return settle(candidates(docs.join(asked, "rk").select("rk", ordered_id(), "text", "vs", "hot"), width, gram), width)


def _removed(docs: DataFrame, found: DataFrame, width: int, texts: bool) -> DataFrame:
    told = found.groupBy("rk").agg(F.collect_list("found").alias("found"))
    joined = docs.join(told, "rk", "left").select("doc_id", ordered_id(), "text", "found")

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for doc_id, d, text, told in zip(batch.column("doc_id").to_pylist(), batch.column("d").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                at = places_of(told, d)
                kept = compress(words, (~covered(at, width, len(words))).tolist()) if len(at) else words
                rest = b" ".join(kept)
                left = len(words) - (int(covered(at, width, len(words)).sum()) if len(at) else 0)
                out.append((doc_id, len(words), len(words) - left, hashlib.sha256(rest).hexdigest(), rest.decode() if texts else None))
            yield batch_of(out, _REMOVED)

    result = joined.mapInArrow(tidied(go), _REMOVED)
    return result if texts else result.drop("kept_text")
