"""Token-id output as sorted-string-table shards.

A shard is one file: prefix-compressed blocks of (key, ids) in ascending key
order, a sparse index with the first key of each block, a Bloom filter over the
keys, and a footer of fixed length at the end.  A lookup reads the footer, the
filter and the index, finds the block by binary search and decodes it alone.

Layout (integers little-endian, v: LEB128 varint)::

    block   (v shared, v unshared, v value bytes, key suffix, value)*
    index   (v key bytes, key, u64 offset, u32 bytes, u64 first token, u32 docs)*
    bloom   bit array
    footer  u64 index offset, u64 index bytes, u64 bloom offset, u64 bloom bytes,
            u64 docs, u64 tokens, u32 id bytes, u32 crc32 of index and bloom, magic

A key is one byte 0 for a null identifier, or byte 1 and the identifier as
big-endian with its sign bit flipped, so that byte order is numeric order.
Values are ids of 2 or 4 bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.common import ROWS
from skysift.llm.tokens import encoder

MAGIC = b"SKYSST01"
FOOTER = struct.Struct("<QQQQQQII8s")
ENTRY = struct.Struct("<QIQI")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Bytes of text that a shard is made for, at most on average.
SHARD_BYTES = 256 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id & (1 << 64) - 1) ^ 1 << 63)


def id_of(key: bytes) -> int | None:
    if key == b"\x00":
        return None
    x = struct.unpack(">Q", key[1:])[0] ^ 1 << 63
    return x - (1 << 64) if x >> 63 else x


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _digest(key: bytes) -> bytes:
    """Start and step of a key's probes."""
    return xxhash.xxh3_128_digest(key)


def _probes(digests: bytes | bytearray, bits: int) -> np.ndarray:
    """(probe, key) places of keys in a filter of so many bits."""
    pair = np.frombuffer(digests, ">u8").reshape(-1, 2)
    start, step = (pair[:, 1] % bits).astype(np.int64), ((pair[:, 0] | np.uint64(1)) % np.uint64(bits)).astype(np.int64)
    return np.array([(start + i * step) % bits for i in range(BLOOM_PROBES)])


class ShardWriter:
    """Writes entries, given in ascending key order, to an open binary file."""

    def __init__(self, out, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.block, self.in_block, self.last, self.first = bytearray(), 0, b"", b""
        self.index, self.offset, self.docs, self.tokens, self.block_token = bytearray(), 0, 0, 0, 0
        self.digests = bytearray()  # 16 bytes for each key

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: as little-endian unsigned 32-bit bytes."""
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        value = ids
        if self.id_bytes == 2:
            wide = np.frombuffer(ids, "<u4")
            if len(wide) and wide.max() > 0xFFFF:
                raise ValueError("an id does not fit in two bytes")
            value = wide.astype("<u2").tobytes()
        shared = 0
        if self.in_block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.block_token = key, self.tokens
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.docs += 1
        self.tokens += len(ids) // 4
        self.digests += _digest(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            self.index += _varint(len(self.first)) + self.first + ENTRY.pack(self.offset, len(self.block), self.block_token, self.in_block)
            self.out.write(bytes(self.block))
            self.offset += len(self.block)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-BLOOM_BITS * self.docs // 8) * 8)
        on = np.zeros(bits, bool)
        for places in _probes(self.digests, bits):
            on[places] = True
        bloom = np.packbits(on, bitorder="little").tobytes()
        index = bytes(self.index)
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), self.docs, self.tokens, self.id_bytes, zlib.crc32(index + bloom), MAGIC))


class Shard:
    """An open shard, for lookups and for reading it all."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(FOOTER.size, size - FOOTER.size)
        i_at, i_len, b_at, b_len, self.docs, self.tokens, self.id_bytes, crc, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index, self.bloom = file.read_at(i_len, i_at), file.read_at(b_len, b_at)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError("the index is damaged")
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.keys.append(index[at : at + n])
            self.blocks.append(ENTRY.unpack_from(index, at + n))
            at += n + ENTRY.size

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, first token in the shard, and ids as little-endian unsigned 32-bit bytes."""
        offset, size, token, docs = self.blocks[block]
        buf, at, key = self.file.read_at(size, offset), 0, b""
        for _ in range(docs):
            shared, at = _read_varint(buf, at)
            own, at = _read_varint(buf, at)
            n, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + own]
            value = buf[at + own : at + own + n]
            at += own + n
            ids = value if self.id_bytes == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            yield key, token, ids
            token += len(ids) // 4

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for b in range(len(self.blocks)):
            yield from self._entries(b)

    def may_have(self, key: bytes) -> bool:
        bits = 8 * len(self.bloom)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(_digest(key), bits).ravel().tolist())

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with the key, in file order."""
        if not self.may_have(key):
            return []
        found = []
        for b in range(max(0, bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[b] > key:
                break
            found += [ids for k, _, ids in self._entries(b) if k == key]
        return found


def open_shard(uri: str) -> Shard:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Shard(fs.open_input_file(path))


def write_shards(docs: DataFrame, out_uri: str, vocab: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encodes documents' whole texts and writes them as shards in ascending doc_id order.

    Texts are dealt by ranges of (doc_id, hash of text) before they are encoded,
    so each is encoded once, by the task that writes its shard; a key that holds
    many rows is split between shards.  Their number is that of the shuffle's
    partitions, or more if they would hold over ``SHARD_BYTES`` of text each.  A
    shard gets its name only when it is
    complete, so tasks may be repeated.  Ids take two bytes if all of the
    vocabulary's fit, else four.  Null doc_ids come first; a null text is
    empty; repeated doc_ids are kept, by hash of text.  Other columns don't
    matter.  An empty table gives no shard.

    Returns one row per shard: path, docs, tokens, start (tokens in the shards before it).
    """
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    n = shards
    dealt = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").repartitionByRange(n, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, name = task.partitionId(), None
        fs, root = pafs.FileSystem.from_uri(out_uri)
        enc = encoder(vocab)
        id_bytes = 2 if max(len(enc.edge), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                if name is None:
                    name = f"{root}/.part-{part:06d}.{task.taskAttemptId()}"
                    out = fs.open_output_stream(name)
                    shard = ShardWriter(out, id_bytes)
                rows = batch.slice(at, ROWS)
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), enc.encode(rows.column("text").to_pylist()), strict=True):
                    shard.add(key_of(doc_id), ids + end)
        if name is not None:
            shard.close()
            out.close()
            fs.move(name, f"{root}/part-{part:06d}.sst")
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{out_uri}/part-{part:06d}.sst", "docs": shard.docs, "tokens": shard.tokens}], schema=schema)

    # One row per shard comes to the driver, never one per document.
    rows, start, out = sorted(dealt.mapInArrow(run, "part int, path string, docs long, tokens long").collect()), 0, []
    for r in rows:
        out.append((r.path, r.docs, r.tokens, start))
        start += r.tokens
    return spark.createDataFrame(spark.sparkContext.parallelize(out, max(1, len(out))), "path string, docs long, tokens long, start long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents read back from the shards of write_shards(): doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                for key, token, ids in open_shard(r["path"]):
                    rows.append((id_of(key), r["start"] + token, len(ids) // 4, ids))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_shards(spark: SparkSession, docs: DataFrame, out_uri: str, vocab: str, end_id: int) -> DataFrame:
    """Writes documents as shards and reads them back."""
    return read_shards(write_shards(docs, out_uri, vocab, end_id))
