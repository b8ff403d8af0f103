"""Similarity join on sets of word n-grams, by chosen paths.

Documents with equal sets are one node from the start.  A node's set is embedded as 64 tokens (position, minimum hash), of which two
sets share a fraction equal to their Jaccard similarity.  From the root of each run a node walks to the children of those tokens
whose hash under the present path is small: two on average, so similar nodes share many paths and others few.  Buckets of at most
``small`` nodes are compared pairwise by 128-bit sketches; larger ones are split by another step; buckets that no step splits are
compared block by block.  Runs are repeated until the target recall.

Sketches only propose groups.  Within a group of nodes that proposals connect all sets are rebuilt from the texts and all pairs are
compared exactly; only exact links count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, materialise, mix, partitions, rolling, tidied, word_hashes, word_spans
from .components import components
from .substring import keyed, ordered_id, text_blocks, without

COORDINATES, CHILDREN, FIRST_STEPS = 64, 2.0, 2
_NGRAM_BASE = 0xC2B2AE3D27D4EB4F
_SALTS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_CHOSEN = np.uint64(int(CHILDREN / COORDINATES * 2**64))


def ngram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-grams, concatenated, and the texts they belong to.  A text with fewer than n words has
    one n-gram, all its words; one without words has none."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = np.searchsorted(limits, starts, "right")
    h = rolling(words, n, _NGRAM_BASE)
    whole = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    short = [(mix(words[a:b] + np.arange(b - a, dtype=np.uint64) * np.uint64(7919)).sum(dtype=np.uint64), i) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if 0 < b - a < n]
    h = np.concatenate([h[whole], np.array([s for s, _ in short], np.uint64)])
    owner = np.concatenate([doc[: len(whole)][whole], np.array([i for _, i in short], np.int64)])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
    return h[new], owner[new]


_SETS = "doc_id long, d long, rk long, node long, check long, size long, signature binary"


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Per document: two 64-bit hashes of its set (node and check), its size and its minimum hashes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_blocks(batch):
                h, owner = ngram_sets(texts, n)
                k = len(texts)
                size = np.bincount(owner, minlength=k)
                sums = [np.zeros(k, np.uint64), np.zeros(k, np.uint64)]
                signature = np.full((k, COORDINATES), 0xFFFFFFFF, np.uint32)
                full = np.flatnonzero(size)
                cut = np.searchsorted(owner, full)
                if len(full):
                    for s, salt in zip(sums, (1, 0x5BD1E995), strict=True):
                        s[full] = np.add.reduceat(mix(h + np.uint64(salt)), cut)
                    for c, salt in enumerate(_SALTS):
                        signature[full, c] = np.minimum.reduceat(((h ^ (h >> np.uint64(31))) * salt >> np.uint64(32)).astype(np.uint32), cut)
                node, check = (mix(s + size.astype(np.uint64)).view(np.int64) for s in sums)
                ids, ds, rks = (batch.column(c).slice(at, k) for c in ("doc_id", "d", "rk"))
                yield pa.RecordBatch.from_arrays([ids, ds, rks, pa.array(node), pa.array(check), pa.array(size.astype(np.int64)), pa.array([r.tobytes() for r in signature], pa.binary())], [x.split()[0] for x in _SETS.split(", ")])

    return docs.select("doc_id", ordered_id(), "rk", "text").mapInArrow(tidied(go), _SETS)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a node's 64 tokens, and its sketch: two bits of each."""
    signature = np.frombuffer(b"".join(x.as_buffer() for x in column), "<u4").reshape(len(column), COORDINATES).astype(np.uint64)
    tokens = mix(signature + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))
    place = np.arange(COORDINATES, dtype=np.uint64)
    low = np.bitwise_or.reduce((tokens & np.uint64(1)) << place, axis=1)
    high = np.bitwise_or.reduce((tokens >> np.uint64(1) & np.uint64(1)) << place, axis=1)
    return tokens, low, high


def _step(tokens: np.ndarray, row: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (row, path): tokens whose hash under the path is small."""
    rows, paths = [], []
    for a in range(0, len(row), 20_000):
        h = mix(tokens[row[a : a + 20_000]] ^ path[a : a + 20_000, None])
        i, c = np.nonzero(h < _CHOSEN)
        rows.append(row[a : a + 20_000][i])
        paths.append(mix(h[i, c] + np.uint64(1)))
    return (np.concatenate(rows), np.concatenate(paths)) if rows else (row, path)


_PATHS = "path long, node long, low long, high long"


def _walk(nodes: DataFrame, runs: int | None) -> DataFrame:
    """First steps of all runs from the roots, or one step on from the paths that the rows have."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                tokens, low, high = _tokens(batch.column("signature"))
                n = batch.num_rows
                if runs:
                    row = np.tile(np.arange(n), runs)
                    path = np.repeat(mix(np.arange(runs, dtype=np.uint64) + np.uint64(0x1234567)), n)
                    for _ in range(FIRST_STEPS):
                        row, path = _step(tokens, row, path)
                else:
                    row, path = _step(tokens, np.arange(n), batch.column("path").to_numpy().view(np.uint64))
                node = batch.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row]), pa.array(low.view(np.int64)[row]), pa.array(high.view(np.int64)[row])], ["path", "node", "low", "high"])

    return nodes.mapInArrow(tidied(go), _PATHS)


def _stars(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index connected to each of n by pairs (a, b)."""
    root = np.arange(n) if root is None else root
    while len(a):
        m = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b):
            np.minimum.at(root, root[x], m)
            np.minimum.at(root, x, m)
        root = root[root]
        if (root == before).all():
            break
    return root


def _close(low: np.ndarray, high: np.ndarray, most: int, rows: int = 256) -> np.ndarray:
    """Roots of the groups that pairs of sketches within ``most`` bits make of one bucket, block by block of rows."""
    n = len(low)
    root = np.arange(n)
    for a in range(0, n, rows):
        apart = np.bitwise_count(low[a : a + rows, None] ^ low[None, a:]) + np.bitwise_count(high[a : a + rows, None] ^ high[None, a:])
        i, j = np.nonzero(apart <= most)
        up = j > i
        root = _stars(n, i[up] + a, j[up] + a, root)
    return root


_EDGES = "a long, b long"


def _compare(sorted_rows: DataFrame, most: int) -> DataFrame:
    """Proposed edges of buckets whose rows come together, as stars."""

    def flush(path: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        size = np.diff(np.r_[cut, len(path)])
        spread = np.repeat(size, size)
        a, b = [], []
        for o in range(1, min(24, int(size.max()))):
            i = np.flatnonzero((path[o:] == path[:-o]) & (spread[o:] <= 24))
            close = np.bitwise_count(low[i] ^ low[i + o]) + np.bitwise_count(high[i] ^ high[i + o]) <= most
            a.append(node[i[close]])
            b.append(node[i[close] + o])
        for start, n in zip(cut[size > 24], size[size > 24], strict=True):
            root = _close(low[start : start + n], high[start : start + n], most)
            i = np.flatnonzero(root != np.arange(n))
            a.append(node[start + i])
            b.append(node[start + root[i]])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1) if a else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("path", "node", "low", "high")]
            columns[2:] = [c.view(np.uint64) for c in columns[2:]]
            held.append(columns)
            n += batch.num_rows
            if n > 200_000:
                path, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
                end = int(np.searchsorted(path == path[-1], True)) if path[0] != path[-1] else 0
                if end:
                    yield flush(path[:end], *(c[:end] for c in rest))
                held, n = [[path[end:], *(c[end:] for c in rest)]], len(path) - end
        if n:
            yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return sorted_rows.select("path", "node", "low", "high").mapInArrow(tidied(go), _EDGES)


def proposals(nodes: DataFrame, threshold: float, runs: int, small: int = 4096, steps: int = 6) -> DataFrame:
    """Edges (a, b) between nodes that share a bucket and have close sketches; ``nodes`` has node and signature."""
    spark = nodes.sparkSession
    most = most_bits(threshold)
    rows, out = _walk(nodes.select("node", "signature"), runs), None
    for depth in range(steps):
        counts = materialise(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        low = rows.join(counts.where(F.col("n") <= small).select("path"), "path").repartition(partitions(spark), "path").sortWithinPartitions("path")
        found = _compare(low, most)
        out = found if out is None else out.unionByName(found)
        heavy = counts.where(F.col("n") > small)
        if heavy.isEmpty():
            return out
        left = rows.join(heavy, "path").select("path", "node", "low", "high", "n")
        if depth == steps - 1:
            return out.unionByName(_blocks(left, most, small))
        rows = _walk(left.select("path", "node").join(nodes.select("node", "signature"), "node").select("path", "node", "signature"), None)
    return out


def _blocks(rows: DataFrame, most: int, small: int) -> DataFrame:
    """Buckets that no step splits, compared block against block: each of k blocks meets every other."""
    k = F.ceil(F.col("n") * 2 / small).cast("int")
    own = rows.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    met = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select(F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("path"), "node", "low", "high").repartition(partitions(rows.sparkSession), "path").sortWithinPartitions("path")
    return _compare(met, most)


_LINKS = "node long, links long, root long"


def _exact_links(members: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Links of each node and stars of exact links; ``members`` (comp, size, node, text) of groups that proposals connect.

    A group of more than ``block`` nodes is cut into blocks and each pair of blocks is one unit of work, so no task holds more than
    two blocks of texts; counts and stars of the pairs are added up later.  Similarities are compared as integers: with p/q as the
    threshold, c common of a + b in all are enough if c (p + q) >= p (a + b).
    """
    part = Fraction(str(threshold))
    k = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = members.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    met = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("comp", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "text")
    met = met.repartition(partitions(members.sparkSession), "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "node")

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        h, owner = ngram_sets([r[5] for r in rows], n)
        m = len(rows)
        size = np.bincount(owner, minlength=m)
        _, token, df = np.unique(h, return_inverse=True, return_counts=True)
        often = df[token] > 1
        token, owner = token[often], owner[often]
        kept, token = np.unique(token, return_inverse=True)
        common = np.zeros((m, m), np.int64)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        width = max(64, min(4096, 8_000_000 // m))
        for a in range(0, len(kept), width):
            some = slice(*np.searchsorted(token, (a, a + width)))
            x = np.zeros((m, width), np.float32)
            x[owner[some], token[some] - a] = 1
            common += (x @ x.T).astype(np.int64)
        both = size[:, None] + size[None, :]
        linked = common * (part.numerator + part.denominator) >= part.numerator * both
        side = np.array([r[3] for r in rows])
        if rows[0][1] != rows[0][2]:
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        i, j = np.nonzero(np.triu(linked))
        root = _stars(m, i, j)
        for r, links, to in zip(rows, linked.sum(axis=1).tolist(), root.tolist(), strict=True):
            if links:
                yield r[4], links, rows[to][4]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for *row, text in zip(*columns, batch.column("text"), strict=True):
                row = (*row, text.as_buffer().to_pybytes())
                if held and held[0][:3] != row[:3]:
                    out += compare(held)
                    held = []
                    if len(out) > 5000:
                        yield batch_of(out, _LINKS)
                        out = []
                held.append(row)
        out += compare(held)
        if out:
            yield batch_of(out, _LINKS)

    return met.mapInArrow(tidied(go), _LINKS)


def most_bits(threshold: float) -> int:
    """Differing bits of sketches at the threshold, five deviations above the mean: two bits of each of 64 tokens, of which a token
    that differs has 0, 1 or 2."""
    apart = 1 - threshold
    return int(COORDINATES * apart + 5 * math.sqrt(COORDINATES * apart * (1.5 - apart)))


def missed(threshold: float, runs: int, depth: int, most: int) -> float:
    """Probability that a pair at the threshold shares no path of ``depth`` steps in any run, or has more than ``most`` bits apart.

    The number of equal tokens is binomial and the same for all runs; given it, the children that a shared path has are binomial too,
    and the chance to be parted by the last step of a run follows from their generating function.
    """
    total = 0.0
    for equal in range(COORDINATES + 1):
        share = math.comb(COORDINATES, equal) * threshold**equal * (1 - threshold) ** (COORDINATES - equal)
        parted = 0.0
        for _ in range(depth):
            parted = (1 - CHILDREN / COORDINATES * (1 - parted)) ** equal
        bits = 2 * (COORDINATES - equal)
        near = sum(math.comb(bits, b) for b in range(min(bits, most) + 1)) / 2**bits
        total += share * (1 - (1 - parted**runs) * near)
    return total


def runs_for(threshold: float, recall: float, steps: int = 6) -> int:
    """Runs after which a pair at the threshold is proposed with probability ``recall``, even if all its buckets are split by each of
    the ``steps`` of ``proposals``."""
    depth, most = FIRST_STEPS + steps - 1, most_bits(threshold)
    runs = 1
    while missed(threshold, runs, depth, most) > 1 - recall:
        runs += 1
        if runs > 1000:
            raise ValueError("sketches alone lose more pairs than that recall allows")
    return runs


def apart(sets: DataFrame) -> DataFrame:
    """``sets`` with a node of its own for each (node, check): different sets whose first hashes meet get new ones from both hashes."""
    met = sets.select("node", "check").distinct().groupBy("node").agg(F.min("check").alias("stays"), F.count("*").alias("n")).where("n > 1").select("node", "stays")
    met = materialise(met, "met")
    if met.isEmpty():
        return sets
    new = F.when(F.col("check") != F.col("stays"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return sets.join(met, "node", "left").withColumn("node", new).drop("stays")


def similarity_classes(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 4096, block: int = 1024) -> DataFrame:
    """doc_id, class_id, n_links, copies, n_grams of every row.

    ``copies`` counts rows with the same set of n-grams, the row itself included; ``n_links`` counts the other, different sets with a
    Jaccard similarity of ``threshold`` or more, each once however many copies it has; ``class_id`` is the smallest doc_id that links
    and copies connect.  Words are ``[^\\x20\\x09-\\x0D]+``.  A text of fewer than n words has one n-gram; texts without words, null
    ones too, are copies of each other and link to nothing.  A null doc_id is smaller than others: its class has a null class_id.
    """
    return _classes(df, n, threshold, recall, small, block).drop("rk")


def _classes(df: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 4096, block: int = 1024) -> DataFrame:
    """``similarity_classes`` with the row key rk."""
    docs = keyed(df)
    sets = apart(materialise(_sets(docs, n), "sets"))
    nodes = sets.groupBy("node", "check").agg(F.min("d").alias("d"), F.count("*").alias("copies"), F.min(F.struct("rk", "d")).alias("row"), F.max("size").alias("size"))
    # one node of each set, with the signature of any of its rows: equal sets have equal signatures
    one = sets.where("size > 0").select("node", "signature").dropDuplicates(["node"])
    edges = materialise(proposals(one, threshold, runs_for(threshold, recall), small).distinct(), "proposals")
    groups = components(edges)
    groups = materialise(groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root").select(F.col("id").alias("node"), F.col("root").alias("comp"), F.col("n").alias("size")), "groups")
    chosen = groups.join(nodes.select("node", F.col("row.rk").alias("rk"), F.col("row.d").alias("own")), "node")
    members = docs.select(ordered_id(), "rk", "text").join(chosen, "rk").where("d = own").dropDuplicates(["node"]).select("comp", "size", "node", "text")
    links = materialise(_exact_links(members, n, threshold, block), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    if groups.where(F.col("size") > block).isEmpty():
        roots = links.select("node", "root")
    else:
        roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), "root")
    held = nodes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = held.where("n_links is not null").groupBy("root").agg(F.min("d").alias("least"))
    known = held.join(least, "root", "left").where("copies > 1 or n_links is not null").select("node", "check", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "d").alias("class_id"))
    joined = sets.select("doc_id", "rk", "d", "node", "check", F.col("size").alias("n_grams")).join(known, ["node", "check"], "left")
    class_id = F.coalesce("class_id", "d")
    return joined.select("doc_id", "rk", F.when(class_id > -(1 << 63), class_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n_grams")


def drop_similar(df: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``df`` with each class's rows of its smallest doc_id (null is smallest); columns as they are.  Rows without words all stay.

    Rows to drop are found by doc_id and text, so a repeated doc_id can stay in one class and go from another.
    """
    return without(df, _classes(df, n, threshold).where(~F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("n_grams") > 0)))
