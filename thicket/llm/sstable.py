"""Token-ID output: sorted-string-table shards, written and read back on the executors.

File layout: data blocks, index, Bloom filter, footer. A block holds entries in key order; an entry is ``shared`` and ``unshared``
key lengths (varints), the unshared key bytes, the value's length (varint) and the value. The first key of a block is whole. The
index has for each block its last key, offset, length, ids and documents before it. All integers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal, slices
from .encoder import encoder

MAGIC = b"THKSST01"
_FOOTER = struct.Struct("<QQQQQQBB6xI8s")
BLOCK = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Characters of a text that may part rows of one id.
PREFIX = 64


def key_bytes(doc_id: int | None) -> bytes:
    """Orders as the ids do: null first, then ascending, negative ids included."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    step = (h >> 32) | 1
    return [((h & 0xFFFFFFFF) + i * step) % bits for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one shard; keys must come in ascending order (equal keys are kept, in the order given)."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.ids = self.docs = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self._reset()

    def _reset(self) -> None:
        self.block, self.size, self.last, self.block_ids, self.block_docs = [], 0, b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        limit = min(len(key), len(self.last))
        while shared < limit and key[shared] == self.last[shared]:
            shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = b"".join((_varint(shared), _varint(len(key) - shared), key[shared:], _varint(len(value)), value))
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.block_ids += len(ids)
        self.block_docs += 1
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(b"".join(self.block))
            self.index.append((self.last, self.at, self.size, self.ids, self.docs))
            self.at += self.size
            self.ids += self.block_ids
            self.docs += self.block_docs
            self._reset()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        filled = np.zeros(bits, dtype=np.uint8)
        for k in self.keys:
            filled[_probes(k, bits)] = 1
        bloom = np.packbits(filled).tobytes()
        tail = index + bloom
        self.out.write(tail)
        self.out.write(_FOOTER.pack(self.at, len(index), len(self.index), bits, self.docs, self.ids, self.width, BLOOM_HASHES, zlib.crc32(tail), MAGIC))


class TableReader:
    """Reads one shard from a seekable file: look-ups by binary search of the sparse index, or all entries in order."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - _FOOTER.size)
        at, n, blocks, self.bits, self.docs, self.ids, self.width, self.hashes, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        file.seek(at)
        tail = file.read(end - _FOOTER.size - at)
        if zlib.crc32(tail) != crc:
            raise ValueError("the table's index is damaged")
        self.bloom, self.index, p = tail[n:], [], 0
        for _ in range(blocks):
            size, p = _read_varint(tail, p)
            self.index.append((tail[p : p + size], *struct.unpack_from("<QQQQ", tail, p + size)))
            p += size + 32

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _, _ = self.index[i]
        self.file.seek(at)
        data, p, key = self.file.read(size), 0, b""
        while p < size:
            shared, p = _read_varint(data, p)
            unshared, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + unshared]
            n, p = _read_varint(data, p + unshared)
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=n // self.width, offset=p)
            p += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (of the first, if the id repeats), or None."""
        key = key_bytes(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.index[mid][0] >= key else (mid + 1, hi)
        if lo < len(self.index):
            return next((ids for k, ids in self.block(lo) if k == key), None)
        return None


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder as Spark names it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (pafs.LocalFileSystem(), uri)


def write_tables(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, appends ``end_id`` and writes shards in ascending id order below ``folder``, a shared folder.

    Returns the manifest, one row a shard: ``shard`` (in key order), ``path``, ``docs``, ``ids``. Null texts count as empty; null
    ids come first; rows with equal ids follow each other, ordered by text, and may go on in the next shard. ``width`` is the bytes of a stored id. A shard is
    written under a name of its own attempt and then renamed, so that a task may run twice.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sstable")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer_path)
        fs, base = open_fs(folder)
        end = np.array([end_id], dtype="<u4")
        name = f"{base}/shard-{task.partitionId():06d}.sst"
        part, out = f"{name}.{task.taskAttemptId()}", None
        for b in batches:
            docs = b.column(0).to_pylist()
            for first, rows in slices(b.column(1)):
                if out is None:
                    out = fs.open_output_stream(part)
                    table = TableWriter(out, width)
                flat, edges = enc.encode_array(b.column(1).slice(first, rows))
                if width < 4 and max(int(flat.max(initial=0)), end_id) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                for i, doc in enumerate(docs[first : first + rows]):
                    table.add(key_bytes(doc), np.append(flat[edges[i] : edges[i + 1]], end))
        if out is not None:
            table.close()
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "docs": pa.array([table.docs], pa.int64()), "ids": pa.array([table.ids], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The beginning of the text parts rows that share an id, should these be too many for one shard.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return scratch.keep(ordered.mapInArrow(frugal(write), "shard int, path string, docs long, ids long"), "manifest")


def read_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads shards back: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (unsigned 32-bit bytes)."""
    # One row a shard, numbered over the whole set; the shards themselves are read by as many tasks.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    shards = manifest.select("path", before, "shard")
    tasks = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    start, table = base, TableReader(f)
                    for i in range(len(table.index)):
                        keys, starts, counts, data = [], [], [], []
                        for key, ids in table.block(i):
                            keys.append(key_id(key))
                            starts.append(start)
                            counts.append(len(ids))
                            data.append(ids.astype("<u4").tobytes())
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.repartition(tasks, "shard").mapInArrow(frugal(read), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents as tables in the shared folder and reads them back; see ``write_tables`` and ``read_tables``.

    Without rows there are no shards and the result is empty; columns other than the two named are ignored.
    """
    folder = Scratch(docs.sparkSession, "sstable").path("shards")
    return read_tables(write_tables(docs, folder, tokenizer_path, end_id, 2, id_col, text_col), folder)
