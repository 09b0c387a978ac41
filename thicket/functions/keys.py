"""Hierarchical keys: a path is ``array<string>``, ordered component by component, shorter first on a tie."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_key(key: Column | str, delimiter: str = "/") -> Column:
    """The components of a raw key; empty segments are dropped."""
    key = F.col(key) if isinstance(key, str) else key
    return F.filter(F.split(key, re.escape(delimiter)), lambda part: part != "")


def split_text(key: str, delimiter: str = "/") -> list[str]:
    return [part for part in key.split(delimiter) if part]


def path_literal(parts: list[str]) -> Column:
    return F.array(*(F.lit(p) for p in parts)) if parts else F.array().cast("array<string>")


def starts_with(path: Column | str, prefix: list[str]) -> Column:
    """True prefix test: every leading component is equal (a sibling that merely begins alike does not count)."""
    path = F.col(path) if isinstance(path, str) else path
    test = F.lit(True)
    for i, part in enumerate(prefix):
        test = test & (F.get(path, F.lit(i)) == F.lit(part))
    return test & (F.size(path) >= len(prefix))


def without_prefix(path: Column | str, n: int) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.slice(path, n + 1, F.greatest(F.size(path) - n, F.lit(0)))


def key_text(parts: list[str]) -> str:
    """A path as one string that orders as the path does: each component ends with U+0000, which no escaped component holds."""
    return "".join(p.replace("\1", "\1\2").replace("\0", "\1\1") + "\0" for p in parts)


def key_column(path: Column | str) -> Column:
    """``key_text`` of a column of paths."""
    path = F.col(path) if isinstance(path, str) else path
    escape = lambda c: F.concat(F.replace(F.replace(c, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1")), F.lit("\0"))
    return F.array_join(F.transform(path, escape), "")


def within(path: Column | str, start: list[str] | None, end: list[str] | None) -> Column:
    """Half-open interval [start, end); None leaves a side open."""
    path = F.col(path) if isinstance(path, str) else path
    test = F.lit(True)
    if start is not None:
        test = test & (path >= path_literal(start))
    if end is not None:
        test = test & (path < path_literal(end))
    return test
