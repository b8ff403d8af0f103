"""Exact duplicates by Patricia tries.

Every distinct text reaches one trie, chosen by its length and content hash; equality is equality of whole byte strings along a
path, the hash only chooses the partition.  Terminal nodes hold the smallest identifier and the number of rows.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filesystem, partitions, scratch, tidied
from .substring import keyed, without


def normalised(text: bytes) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; runs at the ends too."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    space = b" \t\n\x0b\x0c\r"
    return (b" " if text[0] in space else b"") + out + (b" " if text[-1] in space else b"")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving of compared slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(low + step, n)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class Node:
    __slots__ = ("label", "children", "owner", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.rows = label, {}, None, 0


class Patricia:
    """A compressed radix trie from byte strings to (smallest identifier, rows).  ``size`` is about its bytes, ``strings`` how many it has."""

    def __init__(self):
        self.root, self.size, self.strings = Node(b""), 0, 0

    def insert(self, text: bytes, owner: int, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(child.label) + 200
                node = child
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _common(label, text[at : at + len(label)])
            upper = Node(label[:n])
            child.label = label[n:]
            upper.children[child.label[0]] = child
            node.children[text[at]] = upper
            self.size += 200
            node, at = upper, at + n
        self.strings += not node.rows
        node.owner = owner if not node.rows else min(node.owner, owner)
        node.rows += rows

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.rows:
                yield prefix, node.owner, node.rows
            stack += [(c, prefix) for c in node.children.values()]

    def heaviest(self) -> tuple[bytes, Node]:
        """The largest subtree with a prefix of its own: the root's children, or below where one holds nearly all."""
        node, prefix = self.root, b""
        while True:
            sizes = {b: self.weight(c) for b, c in node.children.items()}
            b = max(sizes, key=lambda b: sizes[b][0])
            child = node.children[b]
            if sizes[b][0] < 0.9 * sum(w for w, _ in sizes.values()) or not child.children:
                del node.children[b]
                self.size -= sizes[b][0]
                self.strings -= sizes[b][1]
                return prefix + child.label[:1], _under(child)
            node, prefix = child, prefix + child.label

    @staticmethod
    def weight(node: Node) -> tuple[int, int]:
        """Bytes and strings of a subtree."""
        total, strings, stack = 0, 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            strings += node.rows > 0
            stack += node.children.values()
        return total, strings


def _under(child: Node) -> Node:
    """The subtree without the first byte of its label, which the spilled prefix holds."""
    child.label = child.label[1:]
    return child


class SpillingTrie:
    """A trie that moves its heaviest subtrees to files of the shared folder when it grows beyond ``limit`` bytes.

    Later strings with a spilled prefix go to that prefix's file at once; in the end each file is read into a trie of its own, which
    may spill deeper subtrees in turn.  A single string is never spilled, however long: a subtree leaves only a trie that keeps another
    string, so files get fewer strings at each depth.
    """

    def __init__(self, limit: int, folder: str):
        self.limit, self.folder, self.trie = limit, folder, Patricia()
        self.files: dict[bytes, tuple[str, pa.NativeFile]] = {}

    def insert(self, text: bytes, owner: int, rows: int) -> None:
        for prefix, (_, out) in self.files.items():
            if text.startswith(prefix):
                self._append(out, text, owner, rows)
                return
        self.trie.insert(text, owner, rows)
        while self.trie.size > self.limit and self.trie.strings > 1:
            prefix, node = self.trie.heaviest()
            fs, folder = filesystem(self.folder)
            fs.create_dir(folder, recursive=True)
            path = f"{folder}/{uuid.uuid4().hex}"
            out = fs.open_output_stream(path)
            for t, o, r in self.trie.items(node, prefix):
                self._append(out, t, o, r)
            self.files[prefix] = (path, out)

    @staticmethod
    def _append(out: pa.NativeFile, text: bytes, owner: int, rows: int) -> None:
        out.write(len(text).to_bytes(8, "little") + owner.to_bytes(8, "little", signed=True) + rows.to_bytes(8, "little") + text)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        yield from self.trie.items()
        self.trie = Patricia()
        fs, _ = filesystem(self.folder)
        for path, out in self.files.values():
            out.close()
            deeper = SpillingTrie(self.limit, self.folder)
            with fs.open_input_stream(path) as f:
                f = io.BufferedReader(f, 1 << 20)
                while head := f.read(24):
                    n = int.from_bytes(head[:8], "little")
                    deeper.insert(f.read(n), int.from_bytes(head[8:16], "little", signed=True), int.from_bytes(head[16:], "little"))
            fs.delete_file(path)
            yield from deeper.items()


_OWNERS = "text_sha256 string, keep_id long, group_size long"


def owners(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """text_sha256, keep_id, group_size of each distinct normalised text of (doc_id not null, text).

    Each input task combines its copies in a trie of at most ``limit`` bytes before the shuffle, so a text that a third of all rows
    have is sent once by each task.
    """
    spill = scratch(df.sparkSession, "tries")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(trie: Patricia) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for text, owner, n in trie.items():
                digest = hashlib.sha256(text)
                rows.append((text, len(text), int.from_bytes(digest.digest()[:8], "little", signed=True), digest.hexdigest(), owner, n))
                size += len(text)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["text", "bytes", "h", "text_sha256", "owner", "n"])

        trie = Patricia()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                trie.insert(normalised(text.as_buffer().to_pybytes()), doc_id)
                if trie.size > limit:
                    yield from out(trie)
                    trie = Patricia()
        yield from out(trie)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = SpillingTrie(limit, spill)
        for batch in batches:
            for text, owner, n in zip(batch.column("text"), batch.column("owner").to_pylist(), batch.column("n").to_pylist(), strict=True):
                trie.insert(text.as_buffer().to_pybytes(), owner, n)
        rows: list[tuple] = []
        for text, owner, n in trie.items():
            rows.append((hashlib.sha256(text).hexdigest(), owner, n))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(("text_sha256", "keep_id", "group_size"), r, strict=True)) for r in rows])
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("text_sha256", "keep_id", "group_size"), r, strict=True)) for r in rows])

    sent = df.mapInArrow(tidied(combine), "text binary, bytes long, h long, text_sha256 string, owner long, n long").drop("text_sha256")
    return sent.repartition(partitions(df.sparkSession), "bytes", "h").select("text", "owner", "n").mapInArrow(tidied(own), _OWNERS)


def digest() -> F.Column:
    """SHA-256 of the normalised text, as the tries' rows have it."""
    return F.sha2(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "), 256)


def exact_groups(df: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Null texts count as empty.  Of rows that repeat the smallest doc_id itself all are kept; rows whose doc_id is null count in
    their group's size and are never kept unless the whole group has none, when keep_id is null and all of it stays.
    """
    return _groups(df).drop("rk")


def _groups(df: DataFrame) -> DataFrame:
    """``exact_groups`` with the row key rk."""
    docs = keyed(df)
    known = docs.select(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("doc_id"), "text")
    found = owners(known).where("group_size > 1").withColumn("keep_id", F.when(F.col("keep_id") != (1 << 63) - 1, F.col("keep_id")))
    rows = docs.select("doc_id", "rk", digest().alias("text_sha256"))
    joined = rows.join(found, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", "rk", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame) -> DataFrame:
    """``df`` with exactly the rows that ``exact_groups`` keeps; columns as they are.

    Rows to drop are found by doc_id and text, so each row is judged by its own text even if its doc_id is repeated or null.
    """
    return without(df, _groups(df).where(~F.col("kept")))
