"""Nested objects and flattened paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What stands for an object or a list without entries; bytes, so that no text is taken for one.
EMPTY_OBJECT, EMPTY_LIST = b"\0{}", b"\0[]"


def flatten(value: Any, path: tuple[str, ...] = ()) -> list[tuple[list[str], str | bytes]]:
    """Leaves of a nested value; dict keys and list positions become components, leaves text, None an empty text; bytes stay bytes."""
    if isinstance(value, (dict, list, tuple)) and not value:
        return [(list(path), EMPTY_OBJECT if isinstance(value, dict) else EMPTY_LIST)]
    if isinstance(value, dict):
        return [leaf for k, v in value.items() for leaf in flatten(v, (*path, str(k)))]
    if isinstance(value, (list, tuple)):
        return [leaf for i, v in enumerate(value) for leaf in flatten(v, (*path, str(i)))]
    if isinstance(value, (bytes, bytearray)):
        return [(list(path), bytes(value))]
    if isinstance(value, bool):
        return [(list(path), "true" if value else "false")]
    return [(list(path), "" if value is None else str(value))]


def reconstruct(leaves: list[tuple[list[str], Any]]) -> Any:
    """The nested value of leaves; components 0 .. n-1 without a gap make a list. A leaf that is also an inner node loses."""
    tree: dict = {}
    for path, value in sorted(leaves, key=lambda x: len(x[0]), reverse=True):
        if not path:
            return value if len(leaves) == 1 else _shape(tree)
        at = tree
        for part in path[:-1]:
            at = at.setdefault(part, {})
        at.setdefault(path[-1], value)
    return _shape(tree)


def _shape(node: Any) -> Any:
    if not isinstance(node, dict):
        return {EMPTY_OBJECT: {}, EMPTY_LIST: []}.get(node, node) if isinstance(node, bytes) else node
    out = {k: _shape(v) for k, v in node.items()}
    if out and set(out) == {str(i) for i in range(len(out))}:
        return [out[str(i)] for i in range(len(out))]
    return out


def flatten_rows(df: DataFrame, prefix: list[Column], fields: list[str]) -> DataFrame:
    """``kv`` rows of flat records in one pass: path = prefix + field name; null fields give none."""
    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("e")
    return df.select(F.array(*prefix).alias("prefix"), entries).where(F.col("e.value").isNotNull()).select(F.concat("prefix", F.array("e.field")).alias("path"), F.col("e.value").alias("value"))


def reconstruct_rows(kv: DataFrame, depth: int, fields: list[str]) -> DataFrame:
    """``key`` (the first ``depth`` components) and one column a field, in one aggregation."""
    field = F.get(F.col("path"), F.lit(depth))
    values = [F.max(F.when(field == f, F.col("value"))).alias(f) for f in fields]
    return kv.where((F.size("path") == depth + 1) & field.isin(fields)).groupBy(F.slice("path", 1, depth).alias("key")).agg(*values)


def reconstruct_maps(kv: DataFrame, depth: int) -> DataFrame:
    """``key`` and ``object``: a map of the field names that there are."""
    field = F.get(F.col("path"), F.lit(depth))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(field.alias("key"), F.col("value").alias("value")))))
    return kv.where(F.size("path") == depth + 1).groupBy(F.slice("path", 1, depth).alias("key")).agg(entries.alias("object"))
