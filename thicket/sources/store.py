"""A store of paths: an append-only operation log as Parquet, read through snapshots."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_column, key_text, split_text, without_prefix
from ..operators import objects, scans, versions

#: Operations as they come in, by a stream for one.
OPS = "path array<string>, value string, txn long, seq int, is_delete boolean"
#: The log: ``key`` orders as ``path`` does, ``data`` has the bytes of the value, ``is_text`` whether it came as text.
LOG = "key string, path array<string>, data binary, is_text boolean, txn long, seq int, is_delete boolean"
#: Fixed value: operations of one batch.
BATCH_LIMIT = 10_000


class BatchError(ValueError):
    pass


class ConflictError(RuntimeError):
    """Another writer has changed a path that a transaction read or wrote."""


def value_bytes(value: Any) -> tuple[bytes, bool]:
    """The bytes of a value, and whether it is text; numbers and the like are stored as their text."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value), False
    return str(value).encode(), True


def _value(row: Row) -> str | bytes:
    return row.value if row.value is not None else bytes(row.data)


class Batch:
    """Puts and deletes that take effect together; a later one of the same path wins. A key is a path, or text to be split."""

    def __init__(self, limit: int = BATCH_LIMIT, delimiter: str = "/"):
        self.ops: list[tuple[list[str], bytes | None, bool, bool]] = []
        self.limit, self.delimiter, self.submitted = limit, delimiter, False

    @classmethod
    def of(cls, ops: list[dict[str, Any]], delimiter: str = "/") -> Batch:
        """From raw operations: ``{"type": "put" | "del", "key": ..., "value": ...}``."""
        out = cls(max(1, len(ops)), delimiter)
        for op in ops:
            if op.get("type") not in ("put", "del"):
                raise BatchError(f"unknown type of operation: {op.get('type')!r}")
            missing = [k for k in ("key", "value")[: 2 if op["type"] == "put" else 1] if op.get(k) is None]
            if missing:
                raise BatchError(f"missing required '{missing[0]}'")
            out.put(op["key"], op["value"]) if op["type"] == "put" else out.delete(op["key"])
        return out

    def _add(self, key: str | list[str], value: bytes | None, text: bool, delete: bool) -> Batch:
        if len(self.ops) >= self.limit:
            raise BatchError("the batch is full")
        path = split_text(key, self.delimiter) if isinstance(key, str) else list(key)
        if not path:
            raise BatchError("the key has no component")
        self.ops.append((path, value, text, delete))
        return self

    def put(self, key: str | list[str], value: Any) -> Batch:
        return self._add(key, *value_bytes(value), False)

    def delete(self, key: str | list[str]) -> Batch:
        return self._add(key, None, True, True)

    def size(self) -> int:
        """Bytes of keys and values."""
        return sum(sum(len(p.encode()) for p in path) + len(value or b"") for path, value, _, _ in self.ops)


class Store:
    """Paths to values below a folder; any number of readers and writers.

    A write reserves the next number by a file that is created only if there is none, writes a Parquet folder and becomes visible by
    a file in ``_commits``: it is there as a whole or not at all, and of two writers one waits and takes the number after. Every read
    lists the commits, so no reader works on an old state without asking for it. ``vacuum`` commits a folder in place of all earlier
    ones; these are deleted by a later one, once no reader is open. Values are bytes; those that came as text are given back as text.
    """

    def __init__(self, spark: SparkSession, location: str, delimiter: str = "/", pool: int = 4):
        self.spark, self.location, self.delimiter = spark, location.rstrip("/"), delimiter
        self._pool = ThreadPoolExecutor(1)  # asynchronous calls of one store take their turn
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.location).getFileSystem(spark._jsc.hadoopConfiguration())

    # Files

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.location}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _create(self, name: str) -> bool:
        """Creates an empty file; whether there was none. Hadoop's local file system looks and creates in two steps, others in one."""
        path = self._path(f"{self.location}/{name}")
        try:
            if self._fs.getScheme() == "file":
                os.makedirs(path.getParent().toUri().getPath(), exist_ok=True)
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            else:
                self._fs.create(path, False).close()
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.location}/{name}"), True)

    # State

    def _state(self) -> tuple[int, list[str], list[str]]:
        """The newest transaction, the folders that hold the log, and those that a vacuum has replaced."""
        commits = self._names("_commits")
        vacuums = [n.removesuffix("-vacuum") for n in commits if n.endswith("-vacuum")]
        upto = int(vacuums[-1][:19]) if vacuums else 0
        numbers = [int(n) for n in commits if not n.endswith("-vacuum")]
        folders = {n: f"log/{n:019d}" for n in numbers}
        live = [f"generations/{v}" for v in vacuums[-1:]] + [folders[n] for n in numbers if n > upto]
        return max([upto, *numbers]), live, [f"generations/{v}" for v in vacuums[:-1]] + [folders[n] for n in numbers if n <= upto]

    @property
    def last_txn(self) -> int:
        return self._state()[0]

    @property
    def generation(self) -> int:
        """The number of vacuums so far."""
        return sum(n.endswith("-vacuum") for n in self._names("_commits"))

    def log(self) -> DataFrame:
        """The whole log, as stored."""
        folders = self._state()[1]
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*(f"{self.location}/{f}" for f in folders))

    def ops(self) -> DataFrame:
        """The log with ``value``: the text of values that came as text, null for others and for deletions."""
        return self.log().withColumn("value", F.when(F.col("is_text"), F.col("data").cast("string")))

    def kv(self, as_of: int | None = None) -> DataFrame:
        """``key``, ``path``, ``value`` (text), ``data`` (bytes) as of a transaction."""
        return versions.snapshot(self.ops(), as_of).select("key", "path", "value", "data")

    def key(self, key: str | list[str]) -> list[str]:
        return split_text(key, self.delimiter) if isinstance(key, str) else list(key)

    # Writes

    def append(self, rows: DataFrame, allowed: Callable[[], bool] | None = None) -> int:
        """Appends a frame of ``path``, ``value`` (text or bytes), ``seq``, ``is_delete`` as one transaction; returns its number.

        ``allowed`` is asked when all earlier transactions are there and no later one can be; if it says no, nothing is written.
        """
        if "data" not in rows.columns:
            text = rows.schema["value"].dataType.typeName() != "binary"
            rows = rows.withColumn("data", F.col("value").cast("string").cast("binary") if text else F.col("value")).withColumn("is_text", F.lit(text))
        rows = rows.select(key_column("path").alias("key"), "path", "data", "is_text", F.col("seq").cast("int").alias("seq"), "is_delete")
        while True:
            txn = self.last_txn + 1
            if self._create(f"_reserved/{txn:019d}"):
                break
            self._await(txn)
        done = allowed is None or allowed()
        try:
            kept = rows if done else rows.limit(0)
            kept.select("key", "path", "data", "is_text", F.lit(txn).cast("long").alias("txn"), "seq", "is_delete").write.parquet(f"{self.location}/log/{txn:019d}")
        except Exception:
            self._abandon(txn)
            raise
        if not self._create(f"_commits/{txn:019d}"):
            raise ConflictError("the write took so long that others went on without it")
        if not done:
            raise ConflictError("a path has changed since the transaction began")
        return txn

    def _await(self, txn: int, seconds: float = 600.0) -> None:
        """Waits for the writer that has reserved a number; if it is gone, the number stays empty."""
        until = time.time() + seconds
        while time.time() < until:
            if f"{txn:019d}" in self._names("_commits"):
                return
            time.sleep(0.05)
        self._abandon(txn)

    def _abandon(self, txn: int) -> None:
        if self._create(f"_commits/{txn:019d}"):
            self.spark.createDataFrame([], LOG).write.mode("overwrite").parquet(f"{self.location}/log/{txn:019d}")

    def write_batch(self, batch: Batch, allowed: Callable[[], bool] | None = None) -> int:
        if batch.submitted:
            raise BatchError("the batch has been written")
        if not batch.ops:
            raise BatchError("the batch is empty")
        rows = [(path, None if value is None else bytearray(value), text, i, delete) for i, (path, value, text, delete) in enumerate(batch.ops)]
        txn = self.append(self.spark.createDataFrame(rows, "path array<string>, data binary, is_text boolean, seq int, is_delete boolean").coalesce(1), allowed)
        batch.submitted = True
        return txn

    def batch(self, ops: list[dict[str, Any]]) -> int | None:
        """Raw operations as one transaction; none is written if one is wrong, and nothing for an empty list."""
        return self.write_batch(Batch.of(ops, self.delimiter)) if ops else None

    def put(self, key: str | list[str], value: Any) -> int:
        return self.write_batch(Batch(delimiter=self.delimiter).put(key, value))

    def delete(self, key: str | list[str]) -> int:
        return self.write_batch(Batch(delimiter=self.delimiter).delete(key))

    def put_many(self, items: dict[str, Any]) -> int:
        batch = Batch(max(1, len(items)), self.delimiter)
        for k, v in items.items():
            batch.put(self.key(k), v)
        return self.write_batch(batch)

    def delete_many(self, keys: list[str]) -> int:
        batch = Batch(max(1, len(keys)), self.delimiter)
        for k in keys:
            batch.delete(k)
        return self.write_batch(batch)

    def put_rows(self, kv: DataFrame) -> int:
        """A frame of ``path``, ``value`` (text or bytes) as one transaction: the bulk way in."""
        columns = ["path", "data", "is_text"] if "is_text" in kv.columns else ["path", "value"]
        return self.append(kv.select(*columns, F.lit(0).alias("seq"), F.lit(False).alias("is_delete")))

    def increment(self, key: str | list[str], delta: int = 1) -> int:
        """Adds to a counter; a value that isn't a number counts as 0. Counts no one else's increment out."""
        path = self.key(key)
        added = self.spark.createDataFrame([(path, delta)], "path array<string>, delta long")
        while True:
            txn = self.last_txn
            value = versions.increments(added, scans.get(self.kv(txn), path).select("path", "value")).first().value
            try:
                self.write_batch(Batch().put(path, value), lambda txn=txn: not self._changed([path], txn))
                return int(value)
            except ConflictError:
                continue

    def _changed(self, paths: list[list[str]], after: int) -> bool:
        newer = self.log().where((F.col("txn") > after) & F.col("key").isin([key_text(p) for p in paths]))
        return bool(paths) and bool(newer.take(1))

    def delete_prefix(self, prefix: str | list[str]) -> int:
        """Deletes all that lies at or below a prefix, and nothing beside it."""
        gone = scans.below(self.kv(), self.key(prefix))
        return self.append(gone.select("path", F.lit(None).cast("string").alias("value"), F.lit(0).alias("seq"), F.lit(True).alias("is_delete")))

    def put_object(self, key: str | list[str], value: Any) -> int:
        leaves = objects.flatten(value)
        batch = Batch(max(1, len(leaves)), self.delimiter)
        for path, leaf in leaves:
            batch.put(self.key(key) + path, leaf)
        return self.write_batch(batch)

    def transaction(self) -> Transaction:
        """Reads as of now, writes at the end: see ``Transaction``."""
        return Transaction(self)

    # Reads

    def get(self, key: str | list[str], as_of: int | None = None) -> str | bytes | None:
        row = scans.get(self.kv(as_of), self.key(key)).first()
        return None if row is None else _value(row)

    def get_many(self, keys: list[str]) -> list[str | bytes | None]:
        return [None if r.data is None else _value(r) for r in scans.get_many(self.kv(), [self.key(k) for k in keys]).collect()]

    def get_object(self, key: str | list[str]) -> Any:
        path = self.key(key)
        rows = scans.below(self.kv(), path).select(without_prefix("path", len(path)).alias("path"), "value", "data").collect()
        return objects.reconstruct([(r.path, _value(r)) for r in rows]) if rows else None

    def scan(self, start: str | None = None, end: str | None = None, reverse: bool = False, limit: int | None = None, as_of: int | None = None) -> DataFrame:
        return scans.scan(self.kv(as_of), None if start is None else self.key(start), None if end is None else self.key(end), reverse, limit)

    def prefix_scan(self, prefix: str, reverse: bool = False, limit: int | None = None) -> DataFrame:
        return scans.prefix_scan(self.kv(), self.key(prefix), reverse, limit)

    def read_stream(self, start: str | None = None, end: str | None = None, **options) -> DataFrame:
        bounds = [None if b is None else self.key(b) for b in (start, end)]
        return scans.read_stream(self.kv(), *bounds, delimiter=self.delimiter, **options)

    def iterate(self, start: str | None = None, end: str | None = None, reverse: bool = False) -> Iterator[Row]:
        """A cursor: rows come a partition at a time, all of one snapshot, which is held until the cursor ends or is closed."""
        with self.reader() as txn:
            yield from self.scan(start, end, reverse, as_of=txn).toLocalIterator()

    def cursor(self, start: str | None = None, end: str | None = None) -> Cursor:
        return Cursor(self, start, end)

    def count(self) -> int:
        """Live paths, exactly."""
        return self.kv().count()

    # Maintenance

    def begin(self) -> int:
        """The number of the newest transaction: pass it as ``as_of``. What it sees is kept while ``reader`` holds it."""
        return self.last_txn

    def reader(self, txn: int | None = None) -> Reader:
        """Holds what a transaction sees (the newest, if None) until it is closed."""
        return Reader(self, self.last_txn if txn is None else txn)

    def snapshot(self, folder: str) -> None:
        """Writes the current state as Parquet, in key order."""
        state = versions.snapshot(self.log()).orderBy("key").select("path", "data", "is_text")
        state.write.mode("overwrite").parquet(folder)

    def import_snapshot(self, folder: str) -> int:
        return self.put_rows(self.spark.read.parquet(folder))

    def vacuum(self, oldest_reader: int | None = None) -> None:
        """Rewrites the log without versions that no open reader, nor one at ``oldest_reader``, can see.

        The folders in use before are deleted by the next vacuum, or by ``purge``, when no reader is open.
        """
        self.purge()
        last = self.last_txn
        oldest = min([last if oldest_reader is None else oldest_reader, *(int(n[:19]) for n in self._names("_readers"))])
        kept = versions.collect_versions(self.log().where(F.col("txn") <= last), oldest, in_order=True)
        name = f"{last:019d}-{time.time_ns():019d}-{uuid.uuid4().hex}"
        kept.sortWithinPartitions("key", "txn", "seq").write.parquet(f"{self.location}/generations/{name}")
        self._create(f"_commits/{name}-vacuum")

    def purge(self) -> int:
        """Deletes folders that a vacuum has replaced, unless a reader is open; returns how many."""
        if self._names("_readers"):
            return 0
        gone = [f for f in self._state()[2] if self._fs.exists(self._path(f"{self.location}/{f}"))]
        for folder in gone:
            self._remove(folder)
        return len(gone)

    def vacuum_auto(self, least_stale: float = 0.5) -> bool:
        """Vacuums if at least that share of the versions is stale; returns whether it did."""
        status = self.vacuum_status()
        if status["versions"] and status["stale"] >= least_stale * status["versions"]:
            self.vacuum()
            return True
        return False

    def vacuum_status(self) -> dict[str, int]:
        total, live = self.log().count(), self.count()
        return {"versions": total, "live": live, "stale": total - live, "generation": self.generation, "readers": len(self._names("_readers"))}

    def subtree(self, prefix: str | list[str]) -> Subtree:
        return Subtree(self, self.key(prefix))

    # Asynchronous forms

    def submit(self, method: str, *args, **kwargs) -> Future:
        """Runs a method on the store's own thread: ``submit("put", key, value)``."""
        return self._pool.submit(getattr(self, method), *args, **kwargs)

    def put_cb(self, key, value, done) -> Future:
        return self._with_callback(self.submit("put", key, value), done)

    def get_cb(self, key, done) -> Future:
        return self._with_callback(self.submit("get", key), done)

    def delete_cb(self, key, done) -> Future:
        return self._with_callback(self.submit("delete", key), done)

    def batch_cb(self, batch, done) -> Future:
        return self._with_callback(self.submit("write_batch", batch), done)

    @staticmethod
    def _with_callback(future: Future, done: Callable) -> Future:
        future.add_done_callback(lambda f: done(f.exception(), None if f.exception() else f.result()))
        return future


class Reader:
    """An open read transaction: ``txn`` is its number."""

    def __init__(self, store: Store, txn: int):
        self.store, self.txn, self._lease = store, txn, f"_readers/{txn:019d}-{uuid.uuid4().hex}"
        store._create(self._lease)

    def close(self) -> None:
        self.store._remove(self._lease)

    def __enter__(self) -> int:
        return self.txn

    def __exit__(self, *_) -> None:
        self.close()


class Transaction:
    """Reads of one snapshot, its own writes included; ``commit`` writes them as one batch, ``abort`` drops them.

    A commit fails with ``ConflictError``, and writes nothing, if a path that it writes or has read was changed after the snapshot.
    """

    def __init__(self, store: Store):
        self.store, self._reader = store, store.reader()
        self.txn = self._reader.txn
        self.writes: dict[tuple[str, ...], Any] = {}
        self.seen: set[tuple[str, ...]] = set()

    def get(self, key: str | list[str]) -> Any:
        path = tuple(self.store.key(key))
        if path in self.writes:
            return self.writes[path]
        self.seen.add(path)
        return self.store.get(list(path), as_of=self.txn)

    def put(self, key: str | list[str], value: Any) -> None:
        self.writes[tuple(self.store.key(key))] = value if isinstance(value, bytes) else str(value)

    def delete(self, key: str | list[str]) -> None:
        self.writes[tuple(self.store.key(key))] = None

    def commit(self) -> int | None:
        """The number of the transaction, or None if it has no writes."""
        touched, batch = [list(p) for p in self.seen | self.writes.keys()], Batch(max(1, len(self.writes)))
        for path, value in self.writes.items():
            batch.delete(list(path)) if value is None else batch.put(list(path), value)
        try:
            return self.store.write_batch(batch, lambda: not self.store._changed(touched, self.txn)) if batch.ops else None
        finally:
            self.abort()

    def abort(self) -> None:
        self.writes = {}
        self._reader.close()

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abort() if kind else self.commit()


class Cursor:
    """A place in a range of one snapshot, from which to go on in either direction; each step reads a bounded run of rows."""

    def __init__(self, store: Store, start: str | None = None, end: str | None = None, ahead: int = 256):
        self.ahead, self._reader, self._split = ahead, store.reader(), store.key
        self._range = store.scan(start, end, as_of=self._reader.txn)
        self._at: tuple[str, bool] | None = None  # a key, and whether it has been given
        self._runs: dict[bool, list[Row]] = {True: [], False: []}

    def seek(self, key: str | list[str]) -> Cursor:
        """Stands before the first path that isn't less than ``key``."""
        self._at, self._runs = (key_text(self._split(key)), False), {True: [], False: []}
        return self

    def _step(self, forward: bool) -> Row | None:
        if not self._runs[forward]:
            rows = self._range
            if self._at is not None:
                key, given = self._at
                column = F.col("key")
                rows = rows.where((column > key if given else column >= key) if forward else column < key)
            self._runs[forward] = rows.orderBy(F.asc("key") if forward else F.desc("key")).limit(self.ahead).collect()[::-1]
        self._runs[not forward] = []
        if not self._runs[forward]:
            return None
        row = self._runs[forward].pop()
        self._at = (row.key, True)
        return row

    def next(self) -> Row | None:
        return self._step(True)

    def prev(self) -> Row | None:
        return self._step(False)

    def close(self) -> None:
        self._reader.close()


class Subtree(Store):
    """The store below a prefix: same operations, paths without the prefix, never anything outside it."""

    def __init__(self, store: Store, prefix: list[str]):
        self.store, self.prefix = store, list(prefix)
        self.spark, self.delimiter, self._pool = store.spark, store.delimiter, store._pool

    last_txn = property(lambda self: self.store.last_txn)
    generation = property(lambda self: self.store.generation)

    def prepend(self, key: str | list[str]) -> list[str]:
        return self.prefix + self.key(key)

    def _names(self, folder: str) -> list[str]:
        return self.store._names(folder)

    def _create(self, name: str) -> bool:
        return self.store._create(name)

    def _remove(self, name: str) -> None:
        self.store._remove(name)

    def log(self) -> DataFrame:
        n = len(self.prefix)
        inside = scans.below(self.store.log(), self.prefix).where(F.size("path") > n).withColumn("path", without_prefix("path", n))
        return inside.withColumn("key", F.substring("key", len(key_text(self.prefix)) + 1, 2**31 - 1))

    def append(self, rows: DataFrame, allowed: Callable[[], bool] | None = None) -> int:
        return self.store.append(rows.withColumn("path", F.concat(F.array(*map(F.lit, self.prefix)), F.col("path"))), allowed)

    def vacuum(self, oldest_reader: int | None = None) -> None:
        self.store.vacuum(oldest_reader)

    def purge(self) -> int:
        return self.store.purge()

    def subtree(self, prefix: str | list[str]) -> Subtree:
        return Subtree(self.store, self.prepend(prefix))

    def claim(self, layer: str) -> None:
        """Marks the namespace as a layer's own; another layer can't claim it."""
        owner = self.get(["__meta", "layer"])
        if owner not in (None, layer):
            raise PermissionError(f"the namespace belongs to layer {owner}")
        if owner is None:
            self.put(["__meta", "layer"], layer)


__all__ = ["Batch", "BatchError", "ConflictError", "Cursor", "Reader", "Store", "Subtree", "Transaction"]
