"""Best-fit packing: best-two-fit over the counts of each length."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LocalNumbers, Scratch, frugal, numbered, slices
from .encoder import encoder


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packs ``counts[length]`` pieces of each length into bins; returns ``(number of bins, lengths in each)``.

    A bin is filled greedily, each time with the longest piece that fits. Then its shortest piece is taken out if two unpacked
    pieces fill the widened gap more tightly. A pattern is used as often as the counts allow, so the work and the result depend on
    the number of lengths, at most ``capacity``, and not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[int, list[int]]] = []
    while lengths:
        used: Counter = Counter()

        def longest(limit: int, used: Counter = used) -> int:
            i = bisect_right(lengths, limit)
            while i and left[lengths[i - 1]] <= used[lengths[i - 1]]:
                i -= 1
            return lengths[i - 1] if i else 0

        bin_, gap = [], capacity
        while n := longest(gap):
            bin_.append(n)
            used[n] += 1
            gap -= n
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            used[smallest] -= 1
            wide, best = gap + smallest, (smallest, 0)
            for a in lengths[: bisect_right(lengths, wide - 1)][::-1]:
                if 2 * a <= sum(best):  # the second is no longer than the first
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = longest(min(a, wide - a))
                used[a] -= 1
                if b and a + b > sum(best):
                    best = (a, b)
                    if a + b == wide:
                        break
            bin_[-1:] = [n for n in best if n]
        used = Counter(bin_)
        times = min(left[n] // u for n, u in used.items())
        plan.append((times, bin_))
        for n, u in used.items():
            left[n] -= times * u
            if not left[n]:
                del left[n]
                del lengths[bisect_right(lengths, n) - 1]
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank that a slot of the plan takes, the bin of that rank, and the slot's offset."""
    taken: Counter = Counter()
    slots: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for times, bin_ in plan:
        at = 0
        for n in bin_:
            slots.setdefault(n, []).append((taken[n], first, at))
            taken[n] += times
            at += n
        first += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*s)) for n, s in slots.items()}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, numbers: bool = False) -> DataFrame:
    """Tokenizes whole texts, appends ``end_id`` and cuts what is longer than ``capacity``; only the first piece may be shorter.

    Null texts count as empty. ``with_ids`` adds the ids themselves (little-endian unsigned 32-bit), ``numbers`` the numbers of the
    pieces of each length within their partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, local = encoder(tokenizer_path), np.array([end_id], dtype="<u4"), LocalNumbers() if numbers else None
        for b in batches:
            for first, rows in slices(b.column(1)):
                flat, edges = enc.encode_array(b.column(1).slice(first, rows))
                total = np.diff(edges) + 1
                count = -(-total // capacity)
                of = np.repeat(np.arange(rows), count)
                piece = np.arange(len(of)) - (np.cumsum(count) - count)[of]
                # Only the first piece may be shorter; all others end a whole number of capacities before the document's end.
                stop = total[of] - (count[of] - 1 - piece) * capacity
                start = np.maximum(0, stop - capacity)
                ids = [np.append(flat[a:z], end) if last else flat[a:z] for a, z, last in zip((edges[of] + start).tolist(), (edges[of] + np.minimum(stop, total[of] - 1)).tolist(), (stop == total[of]).tolist())]
                ids = [x.astype("<u4", copy=False).tobytes() for x in ids]
                columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + of)), *columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=names)
                yield local.add(out, 3) if numbers else out

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + f", {LocalNumbers.FIELDS}" * numbers
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(cut), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens by best-two-fit.

    Returns one row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).
    Every row gives at least one piece, as the end id counts; repeated or null ids are rows like any other; other columns are
    ignored; without rows there are none in the result. The plan is made from the number of pieces of each length, at most
    ``capacity`` numbers whatever the size of the corpus; pieces are numbered within their length where they are, and then joined
    with the counts of their partition. Texts and ids are not shuffled unless ``with_ids`` asks for them.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.keep(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids, numbers=True), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(best_two_fit(counts, capacity))
    ranked = numbered(rows, "length", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            seq, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else []
            for a, z in zip(edges, edges[1:]):
                at = order[a:z]
                start, bin_, off = slots[int(length[at[0]])]
                i = np.searchsorted(start, rank[at], side="right") - 1
                seq[at], offset[at] = bin_[i] + rank[at] - start[i], off[i]
            kept = [i for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(seq), pa.array(offset)], names=[*(names[i] for i in kept), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(frugal(place), f"{fields}, sequence_id long, offset long")
