"""Token-ID output as sorted-string-table shards.

A shard file holds documents in ascending order of a 13-byte key (one byte for null, the sign-flipped big-endian identifier, and the
entry's number among repeated identifiers).  Layout::

    block*          zlib( entry* restart_offset:u4* n_restarts:u4 )
    index           per block: last_key_length:u2 last_key offset:u8 length:u4 entries:u4 tokens:u8
    bloom           bits of a Bloom filter over the keys' identifiers
    footer (72 B)   index offset, bloom offset, bloom bits, bloom hashes, blocks, entries, tokens, id width, crc32 of index and bloom, magic

An entry is varint(shared) varint(rest) varint(value) rest value: the key's prefix that it shares with the entry before is left out,
but for every 16th entry (a restart), where a binary search can begin.  A value is the document's ids, little-endian, ``id width``
bytes each.  A long document makes its block longer; nothing is cut.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder
from .common import documents, filesystem, partitions, scratch, tidied

MAGIC = b"TWSST\x00\x00\x01"
_FOOTER = struct.Struct("<QQQIIQQIIxxxxxxxx8s")
RESTART = 16


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """Keys sort as (null first, doc_id, repeat)."""
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(doc_key: bytes, bits: int, hashes: int) -> Iterator[int]:
    a = zlib.crc32(doc_key)
    b = zlib.adler32(doc_key[::-1]) * 2654435761 | 1
    return ((a + i * b) % bits for i in range(hashes))


class ShardWriter:
    """Writes entries that come in key order; ``finish`` moves the file to its name, so a task that is run again replaces it whole."""

    def __init__(self, uri: str, width: int, block_bytes: int = 1 << 16, bits_per_key: int = 10, level: int = 1):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.width, self.block_bytes, self.bits_per_key, self.level = width, block_bytes, bits_per_key, level
        self.offset = self.entries = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.last = b""
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.in_block, self.block_tokens = bytearray(), [], 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        assert key > self.last, "keys must ascend"
        shared = 0
        if self.in_block % RESTART:
            while key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        rest = key[shared:]
        self.block += _varint(shared) + _varint(len(rest)) + _varint(len(value)) + rest + value
        self.in_block += 1
        self.block_tokens += len(value) // self.width
        self.last = key
        self.keys.append(key[:9])
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        packed = zlib.compress(raw, self.level)
        self.out.write(packed)
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QIIQ", self.offset, len(packed), self.in_block, self.block_tokens))
        self.offset += len(packed)
        self.entries += self.in_block
        self.tokens += self.block_tokens
        self._fresh()

    def finish(self) -> None:
        self._flush()
        bits = max(64, (len(self.keys) * self.bits_per_key + 7) // 8 * 8)
        hashes = max(1, round(self.bits_per_key * 0.69))
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for b in _bloom_bits(k, bits, hashes):
                bloom[b >> 3] |= 1 << (b & 7)
        index = b"".join(self.index)
        self.out.write(index + bloom)
        self.out.write(_FOOTER.pack(self.offset, self.offset + len(index), bits, hashes, len(self.index), self.entries, self.tokens, self.width, zlib.crc32(index + bloom), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


class ShardReader:
    """Scans a shard in order or finds one document by Bloom filter, block index and restarts."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        at, bloom_at, self.bits, self.hashes, n, self.entries, self.tokens, self.width, crc, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        tail = self.file.read_at(size - _FOOTER.size - at, at)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        self.bloom = tail[bloom_at - at :]
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        p = 0
        for _ in range(n):
            (k,) = struct.unpack_from("<H", tail, p)
            self.last_keys.append(tail[p + 2 : p + 2 + k])
            self.blocks.append(struct.unpack_from("<QIIQ", tail, p + 2 + k))
            p += 2 + k + 24

    def _block(self, i: int) -> tuple[bytes, int]:
        offset, length, _, _ = self.blocks[i]
        raw = zlib.decompress(self.file.read_at(length, offset))
        return raw, len(raw) - 4 * (struct.unpack_from("<I", raw, len(raw) - 4)[0] + 1)

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            raw, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry of an identifier (more than one if it is repeated, none if it is absent)."""
        import bisect

        first = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(first[:9], self.bits, self.hashes)):
            return []
        found = []
        for i in range(bisect.bisect_left(self.last_keys, first), len(self.blocks)):
            raw, end = self._block(i)
            n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
            restarts = struct.unpack_from(f"<{n}I", raw, end)
            low, high = 0, n
            while high - low > 1:
                middle = (low + high) // 2
                key, _ = next(self._entries(raw, restarts[middle], end))
                low, high = (middle, high) if key <= first else (low, middle)
            for key, value in self._entries(raw, restarts[low], end):
                if key[:9] > first[:9]:
                    return found
                if key[:9] == first[:9]:
                    found.append(np.frombuffer(value, self.dtype))
        return found


def write_shards(df: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode all texts and write them to ``folder``; returns the manifest: shard, path, n_docs, n_tokens, in ascending order.

    Range-partitions by doc_id (and the text's hash, which spreads repeated identifiers), sorts each range and writes one file for it.
    Null texts count as empty, a null doc_id comes first, repeated rows are all kept, an empty table has an empty manifest.  The
    manifest has one row a shard; running totals over it are all that reaches the driver.
    """
    spark = df.sparkSession
    n = shards or max(partitions(spark), 1)
    docs = documents(df).withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array(end_id, enc.dtype).tobytes()
        uri, out, n_docs = f"{folder}/shard-{part:06d}.sst", None, 0
        before, repeat = object(), 0
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    out = out or ShardWriter(uri, enc.dtype.itemsize)
                    repeat = repeat + 1 if doc_id == before else 0
                    before = doc_id
                    out.add(key_of(doc_id, repeat), enc.encode(text.as_py()) + end)
                    n_docs += 1
        except BaseException:
            if out:
                out.abandon()
            raise
        if out:
            out.finish()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [out.tokens]})

    rows = docs.select("doc_id", "text").mapInArrow(tidied(write), "shard int, path string, n_docs long, n_tokens long").collect()
    return spark.createDataFrame(sorted(rows), "shard int, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, read from the files; start counts the ids of all entries before it.

    A repeated doc_id's entries may meet in more than one shard; their order among themselves is by text hash.
    """
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r.path, start))
        start += r.n_tokens
    plan = spark.createDataFrame(rows, "path string, start long").repartition(max(1, min(len(rows), partitions(spark))), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out: list[tuple[int | None, int, int, int]] = []
                shard = ShardReader(path)
                for key, value in shard.scan():
                    ids = np.frombuffer(value, shard.dtype)
                    out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4"))))
                    at += len(ids)
                doc_id, first, n, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(df: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write shards and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(df, folder or scratch(df.sparkSession, "sst"), tokenizer, end_id))
