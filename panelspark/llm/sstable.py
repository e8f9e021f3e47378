"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of ids. Its file is, in this order:

- data blocks of about ``BLOCK_BYTES``, each compressed by zstd: entries of shared prefix
  with the key before (1 byte), length of the rest of the key (1 byte), bytes of an id in
  the value (1 byte: 2, or 4 where an id needs them), bytes of the value (4), the rest of
  the key, the value; a block's first key is whole; the CRC-32 of the entries ends the block;
- the Bloom filter: bits of all keys;
- the sparse index: for each block its first key, place, bytes, entries, and bytes before
  compression;
- the footer of fixed length: places and bytes of filter and index, entries, ids, magic.

A key is 9 bytes that sort as the ids do (null first); a value is the document's ids as
little-endian unsigned integers. A lookup reads the footer, the filter, the index
(binary search) and the blocks that can hold the key.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import map_batches, materialise, scratch_path, text_or_empty
from panelspark.llm.tokens import encoder, text_batches, vocabulary_path

BLOCK_BYTES = 64 * 1024
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"SSTIDS01"
_ENTRY, _BLOCK, _FOOTER = struct.Struct("<BBBI"), struct.Struct("<9sQIII"), struct.Struct("<QQQQQQ8s")
_MANIFEST = "part int, path string, first_id long, last_id long, rows long, tokens long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _place(path: str):
    """The file system and the path in it of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def bloom_probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x9E3779B9) | 1
    return ((a + i * b) % bits for i in range(PROBES))


class Writer:
    """Writes the entries of one shard, which come in the order of their keys."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.tokens = out, 0, 0, 0
        self.block, self.first, self.last, self.in_block = bytearray(), b"", b"", 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids`` as little-endian unsigned 32-bit integers."""
        import numpy as np

        wide = np.frombuffer(ids, "<u4")
        width = 4 if len(wide) and wide.max() > 0xFFFF else 2
        value = ids if width == 4 else wide.astype("<u2").tobytes()
        if self.in_block and len(self.block) + len(value) > BLOCK_BYTES:
            self._end_block()
        shared = 0
        if self.in_block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _ENTRY.pack(shared, 9 - shared, width, len(value)) + key[shared:] + value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.tokens += len(wide)
        self.keys.append(key)

    def _end_block(self) -> None:
        import pyarrow as pa

        packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
        at, size = self._write(packed + struct.pack("<I", zlib.crc32(self.block)))
        self.index.append(_BLOCK.pack(self.first, at, size, self.in_block, len(self.block)))
        self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        if self.in_block:
            self._end_block()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in bloom_probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, bloom_size = self._write(bytes(bloom))
        index_at, index_size = self._write(b"".join(self.index))
        self._write(_FOOTER.pack(bloom_at, bloom_size, index_at, index_size, self.entries, self.tokens, MAGIC))
        self.out.close()


class Reader:
    """One shard's file: all its entries in order, or the values of one key."""

    def __init__(self, path: str):
        files, inner = _place(path)
        self.file = files.open_input_file(inner)
        self.size = self.file.size()
        footer = self._read(self.size - _FOOTER.size, _FOOTER.size)
        self.bloom_at, self.bloom_size, at, size, self.entries, self.tokens, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard of token ids")
        self.blocks = [*_BLOCK.iter_unpack(self._read(at, size))]

    def _read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        import numpy as np
        import pyarrow as pa

        _, at, size, entries, length = block
        stored = self._read(at, size)
        data = pa.decompress(stored[:-4], length, codec="zstd", asbytes=True)
        if zlib.crc32(data) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("a block of token ids doesn't match its checksum")
        key, p = b"", 0
        for _ in range(entries):
            shared, rest, width, length = _ENTRY.unpack_from(data, p)
            p += _ENTRY.size
            key = key[:shared] + data[p : p + rest]
            p += rest
            value = data[p : p + length]
            yield key, value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            p += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in self.blocks:
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values under one id: none, one, or more where ids repeat."""
        key = key_of(doc_id)
        bloom = self._read(self.bloom_at, self.bloom_size)
        if not all(bloom[p >> 3] & 1 << (p & 7) for p in bloom_probes(key, len(bloom) * 8)):
            return []
        firsts = [b[0] for b in self.blocks]
        at, found = bisect_right(firsts, key) - 1, []
        while at >= 0:
            found = [v for k, v in self._entries(self.blocks[at]) if k == key] + found
            if firsts[at] < key:
                break
            at -= 1
        return found


def write_shards(
    docs: DataFrame,
    vocabulary_file: str = "byte_bpe_50k.json",
    end_id: int = 0,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write every document's ids in the order of doc_id; return the manifest, a row per shard.

    A document is its text's ids and then ``end_id``; a null or empty text is that one id.
    Rows with a null id come first; rows that repeat an id are all written. Other columns
    are ignored; an empty table writes no shard. Each attempt of a task writes a file of its
    own name, and the manifest, written once, names those that count, so a task that runs
    again does no harm.
    """
    vocabulary = vocabulary_path(vocabulary_file)
    root = path or scratch_path(docs.sparkSession, "token-shards")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        writer = where = None
        end, first, last = end_id.to_bytes(4, "little"), None, None
        for doc_ids, texts in text_batches(batches, ["doc_id", "text"]):
            if writer is None and doc_ids:
                files, inner = _place(root)
                files.create_dir(inner, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                where, writer = f"{root}/{name}", Writer(files.open_output_stream(f"{inner}/{name}"))
                first = doc_ids[0]
            for doc_id, ids in zip(doc_ids, encoder(vocabulary).encode(texts), strict=True):
                writer.add(key_of(doc_id), ids + end)
                last = doc_id
        if writer is not None:
            writer.close()
            row = (TaskContext.get().partitionId(), where, first, last, writer.entries, writer.tokens, writer.at)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["part", "path", "first_id", "last_id", "rows", "tokens", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialise(map_batches(ordered, run, _MANIFEST, encodes=True), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids.

    Each shard is read by one task, block by block.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows, size = [], 0
                for key, ids in Reader(path):
                    rows.append((id_of(key), start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    shards = max(1, manifest.count())
    return map_batches(placed.repartition(shards), run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the keys that the shards hold, by filter and binary search.

    Keys meet the shards whose range holds them; the manifest, a row per shard, is what is
    broadcast. Null keys find nothing.
    """
    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    inside = F.col("doc_id").between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id"))
    routed = wanted.join(F.broadcast(manifest.select("path", "first_id", "last_id")), inside).select("doc_id", "path")

    def run(batches):
        import pyarrow as pa

        reader, opened = None, None
        for batch in batches:
            rows = []
            for doc_id, path in zip(batch.column("doc_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if path != opened:
                    reader, opened = Reader(path), path
                rows += [(doc_id, ids) for ids in reader.get(doc_id)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "ids"],
            )

    spread = routed.repartition("path", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("path", "doc_id")
    return map_batches(spread, run, "doc_id long, ids binary")
