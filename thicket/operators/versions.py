"""Snapshots of an append-only operation log: ``path``, ``value``, ``txn``, ``seq``, ``is_delete``; a store's log has ``key``, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shares


def _by(ops: DataFrame) -> str:
    return "key" if "key" in ops.columns else "path"


def _newest(ops: DataFrame) -> DataFrame:
    """The newest version of each path; within a transaction the later operation wins. Combined before the shuffle."""
    carried = [c for c in ops.columns if c not in (_by(ops), "seq")]
    last = F.max_by(F.struct(*carried), F.struct("txn", "seq")).alias("last")
    return ops.groupBy(_by(ops)).agg(last).select(_by(ops), *(f"last.{c}" for c in carried))


def snapshot(ops: DataFrame, as_of: int | None = None) -> DataFrame:
    """``path``, ``value`` (and the log's other columns) as of a transaction, the newest if None; deleted paths are absent."""
    seen = ops if as_of is None else ops.where(F.col("txn") <= as_of)
    return _newest(seen).where(~F.col("is_delete")).drop("is_delete", "txn")


def collect_versions(ops: DataFrame, oldest_reader: int, in_order: bool = False) -> DataFrame:
    """Drops versions that no reader at ``oldest_reader`` or later can see.

    Kept are versions after that transaction and, of the others, the newest of each path unless it is a deletion. The log is dealt
    once, to tasks whose number grows with it (``in_order``: by ranges of paths), and sorted once, by path, transaction and place.
    """
    by = _by(ops)
    dealt = (ops.repartitionByRange if in_order else ops.repartition)(shares(ops), by)
    after = F.lead("txn").over(Window.partitionBy(by).orderBy("txn", "seq"))
    newest = F.col("__after").isNull() | (F.col("__after") > oldest_reader)
    return dealt.withColumn("__after", after).where((F.col("txn") > oldest_reader) | (newest & ~F.col("is_delete"))).drop("__after")


def increments(ops: DataFrame, kv: DataFrame) -> DataFrame:
    """Counters after adding all ``delta`` of ``ops`` (``path``, ``delta``); missing or non-numeric values count as 0."""
    added = ops.groupBy("path").agg(F.sum("delta").alias("delta"))
    base = F.coalesce(F.col("value").cast("string").try_cast("bigint"), F.lit(0))
    return added.join(kv, "path", "left").select("path", (base + F.col("delta")).cast("string").alias("value"))
