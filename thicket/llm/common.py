"""Helpers shared by the training-data operators: texts in slices, caches of words, scratch tables, gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_folder

#: Bytes of text that are worked on together, and bytes that one generation of a cache of words may hold.
SLICE, CACHE = 3_000_000, 10_000_000


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Start and number of the rows of runs of texts of about ``size`` bytes, one row at least."""
    length = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(length, length[at] + size, side="right")) - 1)
        yield at, end - at
        at = end


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + int(sizes.max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The session's limit of a batch's bytes, and what it is set to where the session does not say.
_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def frugal(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that hands unused memory back after each batch: workers outlive their stage.

    Batches are bounded by their bytes, too, for both sides hold them whole: a session that has no such limit gets one.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark._jsparkSession.sessionState().conf().contains(_LIMIT):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        _trim()

    return wrapped


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do so themselves
        pass


def word_hash(word: str) -> int:
    """A word's 64-bit hash, as a signed number."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class WordCache:
    """Values of words, remembered in two generations of bounded bytes: when the younger is full it replaces the older."""

    def __init__(self, value: Callable, limit: int = CACHE):
        self.value, self.limit, self.held = value, limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list) -> list:
        young, old = self.young, self.old
        out = list(map(young.get, words))
        for i, got in enumerate(out):
            if got is None:
                w = words[i]
                got = old.get(w)
                if got is None:
                    got = self.value(w)
                self.held += 150 + len(w) + (len(got) if isinstance(got, bytes) else 0)
                out[i] = young[w] = got
        if self.held > self.limit:
            self.old, self.young, self.held = young, {}, 0
        return out


def distinct_words(texts: pa.Array, cut: Callable = pc.utf8_split_whitespace) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct words of some texts (null as empty), the place among them of each word in turn, and each text's number of words."""
    lists = cut(pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else ""))
    coded = lists.values.dictionary_encode()
    words, at, edges = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    empty = b"" if pa.types.is_binary(texts.type) else ""
    if empty in words:  # beside blanks at the ends
        none = words.index(empty)
        keep = at != none
        edges = np.append(0, np.cumsum(keep))[edges]
        at = at[keep]
        at = at - (at > none)
        del words[none]
    return words, at, np.diff(edges).astype(np.int64)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than a reread.

    The folder is deleted when the application ends; ``only`` deletes what a result does not read once it is known.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_folder(spark, name)
        self._n = 0
        self._kept: list[str] = []

    def _at(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns a frame that reads what was written."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._thicket_path = path
        self._kept.append(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that ``keep`` wrote and that no returned frame reads."""
        self._delete(df._thicket_path)

    def only(self, *frames: DataFrame) -> None:
        """Deletes all tables that ``keep`` wrote but those of the frames named."""
        read = {f._thicket_path for f in frames}
        for path in [p for p in self._kept if p not in read]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
        if path in self._kept:
            self._kept.remove(path)

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs whose frames are no longer referenced."""
        for _ in range(2):  # the first lets go of the frames, the second of what they alone held
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)


def number_within(scratch: Scratch, df: DataFrame, key: str, out: str, name: str = "numbered") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within each value of the integer column ``key``.

    Each partition numbers its own rows of a key, and the partitions' counts are summed up in a table of one row for each key and
    partition, with which the rows are joined. A key that holds most rows is therefore no heavier than any other.
    """
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = LocalNumbers()
        for b in batches:
            yield numbers.add(b, schema.names.index(key))

    return numbered(scratch.keep(df.mapInArrow(local, f"{fields}, {LocalNumbers.FIELDS}"), name), key, out)


class LocalNumbers:
    """The numbers that a partition gives its rows within each value of a key."""

    FIELDS = "__pid int, __local long"

    def __init__(self):
        self.pid, self.seen = TaskContext.get().partitionId(), {}

    def add(self, b: pa.RecordBatch, column: int) -> pa.RecordBatch:
        """A batch with the partition and the numbers by a column, which must not be null."""
        keys = b.column(column).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[first, len(ranked)])
        base = np.array([self.seen.get(k, 0) for k in ranked[first].tolist()], dtype=np.int64)
        for k, n in zip(ranked[first].tolist(), size.tolist()):
            self.seen[k] = self.seen.get(k, 0) + n
        number = np.empty(len(keys), dtype=np.int64)
        number[order] = np.repeat(base - first, size) + np.arange(len(keys))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(keys), self.pid, dtype=np.int32)), pa.array(number)], names=[*b.schema.names, "__pid", "__local"])


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Replaces the numbers within partitions of a kept table by numbers within the whole."""
    names = [c for c in rows.columns if c not in ("__pid", "__local")]
    before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "__pid").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = rows.join(offsets.select(key, "__pid", "__before"), [key, "__pid"])
    return joined.select(*names, (F.col("__before") + F.col("__local")).alias(out))
