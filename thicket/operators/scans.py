"""Scans of a ``kv`` frame (``path``, ``value``): lazy, bounded, in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key_text, path_literal, starts_with, within, without_prefix


def _at(kv: DataFrame, path: list[str]) -> Column:
    """Frames of a store have ``key``, which orders as the path does: conditions on it reach the files' statistics."""
    return F.col("key") == key_text(path) if "key" in kv.columns else F.col("path") == path_literal(path)


def get(kv: DataFrame, path: list[str]) -> DataFrame:
    return kv.where(_at(kv, path))


def get_many(kv: DataFrame, paths: list[list[str]]) -> DataFrame:
    """``pos``, ``path``, ``value`` aligned with the paths asked for; ``value`` is null where there is none."""
    asked = kv.sparkSession.createDataFrame([(i, list(p)) for i, p in enumerate(paths)], "pos int, path array<string>")
    if "key" in kv.columns:
        kv = kv.where(F.col("key").isin([key_text(p) for p in paths]))
    return asked.join(kv, "path", "left").select("pos", "path", *(c for c in kv.columns if c not in ("key", "path"))).orderBy("pos")


def scan(kv: DataFrame, start: list[str] | None = None, end: list[str] | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Half-open range in ascending or descending key order; a limit becomes a top-n without a full sort."""
    by = "key" if "key" in kv.columns else "path"
    if by == "path":
        kv = kv.where(within("path", start, end))
    else:
        kv = kv if start is None else kv.where(F.col("key") >= key_text(start))
        kv = kv if end is None else kv.where(F.col("key") < key_text(end))
    out = kv.orderBy(F.desc(by) if reverse else F.asc(by))
    return out if limit is None else out.limit(limit)


def below(kv: DataFrame, prefix: list[str]) -> DataFrame:
    """What lies at a prefix and below it."""
    return kv.where(F.col("key").startswith(key_text(prefix)) if "key" in kv.columns else starts_with("path", prefix))


def prefix_scan(kv: DataFrame, prefix: list[str], reverse: bool = False, limit: int | None = None) -> DataFrame:
    return scan(below(kv, prefix), reverse=reverse, limit=limit)


def subtree(kv: DataFrame, prefix: list[str]) -> DataFrame:
    """The view below a prefix, with the prefix taken off the paths."""
    inside = below(kv, prefix).where(F.size("path") > len(prefix))
    return inside.select(without_prefix("path", len(prefix)).alias("path"), *(c for c in kv.columns if c not in ("key", "path")))


def read_stream(kv: DataFrame, start: list[str] | None = None, end: list[str] | None = None, reverse: bool = False, keys: bool = True, values: bool = True, key_as_array: bool = False, delimiter: str = "/", limit: int | None = None) -> DataFrame:
    """A scan with the columns of a read stream: ``key`` (joined, or the array), ``value``."""
    rows = scan(kv, start, end, reverse, limit)
    key = F.col("path") if key_as_array else F.array_join("path", delimiter)
    return rows.select(*([key.alias("key")] if keys else []), *([F.col("value")] if values else []))
