"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_within

#: Bits of a group's key that one refinement step resolves; a step brings at most 2**12 sums for each part that may hold a cut.
_STEP = 12


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which ``sizes``, taken in order, fill at most ``shards`` shards; found by binary search."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if not len(ends):
        return 0
    total, largest = int(ends[-1]), int(max(sizes))
    lo, hi = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(greedy_cuts(ends, mid)) <= shards else (mid + 1, hi)
    return lo


def greedy_cuts(ends: np.ndarray, capacity: int, most: float = float("inf")) -> list[int]:
    """Fills shards in order, each as far as ``capacity`` allows; returns for each shard the number of groups up to its end.

    A group larger than the capacity is a shard by itself. With more than ``most`` shards the rest is left out.
    """
    cuts, at, filled = [], 0, 0
    while at < len(ends) and len(cuts) <= most:
        at = max(at + 1, int(np.searchsorted(ends, filled + capacity, side="right")))
        filled = int(ends[at - 1])
        cuts.append(at)
    return cuts


def _least(lo: int, hi: int, enough) -> int:
    """The smallest number from ``lo`` to ``hi`` that is enough, if ``hi`` is."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if enough(mid) else (mid + 1, hi)
    return lo


def _divisible_cuts(ends: np.ndarray, atomic: np.ndarray, capacity: int, most: int) -> list[int]:
    """Sizes up to the end of each shard if runs that aren't ``atomic`` could be cut anywhere."""
    cuts, filled, total = [], 0, int(ends[-1])
    while filled < total and len(cuts) <= most:
        at = int(np.searchsorted(ends, filled + capacity, side="right"))
        if at == len(ends):
            filled = total
        elif atomic[at]:
            begin = int(ends[at - 1]) if at else 0
            filled = begin if begin > filled else int(ends[at])
        else:
            filled += capacity
        cuts.append(filled)
    return cuts


def minimax_key_bounds(sums, shards: int, bits: int = 64) -> tuple[list[int], int]:
    """First keys of the second and later shards, and the largest shard, for groups ordered by an unsigned ``bits``-bit key.

    The shards are runs of the order. The largest is as small as can be; where that is one group alone, it is a shard by itself in
    its place, and the largest of the others is as small as can be: the smallest capacity is searched with which the order fills
    at most ``shards`` shards, a larger group being a shard by itself.

    ``sums(parts, width)`` returns ``{start: size}``: for each ``(start, bits)`` in ``parts``, whose keys share all but the low
    ``bits`` bits, the total size of each run of 2**width keys. The search starts with coarse runs and refines only those in which
    a cut of the best partition can lie, until each of these is a single key. What is held at once is bounded by the number of
    shards, not by the number of groups.
    """
    width = max(0, bits - 2 * _STEP + 8)
    parts = sorted((k, width, n) for k, n in sums([(0, bits)], width).items())
    while True:
        sizes = [n for _, _, n in parts]
        if not sizes:
            return [], 0
        ends, atomic = np.cumsum(np.asarray(sizes, dtype=np.int64)), np.array([w == 0 for _, w, _ in parts])
        total, coarse = int(ends[-1]), max((n for _, w, n in parts if w), default=1)
        best = _least(max(1, coarse), max(1, total), lambda c: len(greedy_cuts(ends, c, shards)) <= shards)
        low = _least(1, best, lambda c: len(_divisible_cuts(ends, atomic, c, shards)) <= shards)
        if coarse > low:  # may hold a group that is a shard by itself
            open_parts = {j for j, (_, w, n) in enumerate(parts) if w and n > low}
        else:
            open_parts, early = set(), 0
            for late in _divisible_cuts(ends, atomic, best, shards)[: shards - 1]:
                # A cut lies between what is surely reached with the lowest capacity and what could be with the best one known.
                at = int(np.searchsorted(ends, early + low, side="right"))
                begin = int(ends[at - 1]) if at else 0
                early = begin if begin > early else early + (sizes[at] if at < len(ends) else 0)
                last = int(np.searchsorted(ends, late, side="left"))
                open_parts.update(j for j in range(min(at, last), min(last, len(ends) - 1) + 1) if parts[j][1])
        if best == low or not open_parts:
            cuts = greedy_cuts(ends, best)[:-1]
            return [parts[j][0] for j in cuts], max(int(x) for x in np.diff(np.append(0, ends[np.append(cuts, len(ends)).astype(int) - 1])))
        fine = []
        for w in {parts[j][1] for j in open_parts}:
            asked = [(parts[j][0], w) for j in sorted(open_parts) if parts[j][1] == w]
            fine += [(k, max(0, w - _STEP), n) for k, n in sums(asked, max(0, w - _STEP)).items()]
        parts = sorted([p for j, p in enumerate(parts) if j not in open_parts] + fine)


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows into shards 0 .. ``n_shards`` - 1 so that the largest shard is as small as can be.

    Rows of equal text form a group that is never parted; groups are ordered by a hash of the text, and the shards are runs of
    that order, all of them: a group larger than an even share is a shard by itself in its place, and the others are as even as can
    be (``minimax_key_bounds``). Law: ``bytes``. Returns one row a row: id, ``size`` (UTF-8 bytes of the text plus 8; a null text has
    none), ``text_crc32`` (of the UTF-8 bytes, null text as empty), ``law``, ``shard``, ``slot`` (0, 1, ... within the shard),
    ``grown_shard`` (null). Null texts form one group; null or repeated ids are rows like any other; other columns are ignored;
    without rows there are none in the result. Texts are read once; only 40-byte rows are written, and nothing is grouped by key
    but for sums of runs of keys.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text_col).cast("string"))).alias("key"),
    )
    rows = scratch.keep(rows, "rows")

    def sums(parts: list[tuple[int, int]], width: int) -> dict[int, int]:
        # Keys are compared as unsigned: Spark's longs are moved by 2**63.
        run = F.shiftright("key", width).alias("run")
        asked = rows
        if parts[0][1] < 64:
            high = sorted({(start - (1 << 63)) >> w for start, w in parts})
            asked = rows.where(F.shiftright("key", parts[0][1]).isin(high))
        return {(r.run << width) + (1 << 63): r.n for r in asked.groupBy(run).agg(F.sum("size").alias("n")).collect()}

    starts, _ = minimax_key_bounds(sums, n_shards)
    shard = sum([F.when(F.col("key") >= F.lit(s - (1 << 63)), 1).otherwise(0) for s in starts], F.lit(0))
    shard = shard.cast("int")
    out = number_within(scratch, rows.select("doc_id", "size", "text_crc32", shard.alias("shard")), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_of(key: int, starts: list[int]) -> int:
    """The shard of one key, for readers that look a document up."""
    return bisect_right(starts, key)
