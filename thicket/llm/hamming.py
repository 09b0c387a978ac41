"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEGMENT = 16
BLOCK, QUERY_BLOCK = 65_536, 16_384
_FLIPS = np.arange(1 << SEGMENT, dtype=np.uint32)
_WEIGHT = np.bitwise_count(_FLIPS)
#: All ways to flip r bits of a segment, for each r.
FLIPS = [_FLIPS[_WEIGHT == r].astype(np.uint16) for r in range(SEGMENT + 1)]


class MultiIndex:
    """Codes (rows of 16-bit segments) with one index a segment; equal codes are one entry with all their ids, in order."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, *codes.T[::-1]))
        codes, self.ids = codes[order], ids[order]
        new = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)] if len(codes) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.codes, self.heads = codes[heads], np.r_[heads, len(codes)]
        self.order, self.offsets = [], []
        for s in range(codes.shape[1]):
            self.order.append(np.argsort(self.codes[:, s], kind="stable"))
            self.offsets.append(np.r_[0, np.cumsum(np.bincount(self.codes[:, s], minlength=1 << SEGMENT))])
        self.seen = np.zeros(len(self.codes), dtype=np.int64)
        self.turn = 0

    def search(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k nearest ``(distance, id)``, ties by id, without the id ``skip``; and the number of codes compared.

        Segments are probed with radius 0, 1, 2, ...; once the segments up to s are done with radius r, a code not yet met
        differs by at least (s + 1)(r + 1) + (m - s - 1) r bits. The search ends when the kth distance is less than that.
        """
        m, best, compared = self.codes.shape[1], [], 0
        self.turn += 1
        for r in range(SEGMENT + 1):
            for s in range(m):
                values = (query[s] ^ FLIPS[r]).astype(np.int64)
                begin, size = self.offsets[s][values], self.offsets[s][values + 1] - self.offsets[s][values]
                total = int(size.sum())
                if total:
                    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)
                    entry = self.order[s][at]
                    entry = entry[self.seen[entry] != self.turn]
                    if len(entry):
                        self.seen[entry] = self.turn
                        compared += len(entry)
                        distance = np.bitwise_count(self.codes[entry] ^ query).sum(axis=1, dtype=np.int64)
                        if len(best) >= k:
                            close = distance <= best[-1][0]
                            entry, distance = entry[close], distance[close]
                        for e, d in zip(entry.tolist(), distance.tolist()):
                            # k + 1 ids of a code are enough: one of them may be left out.
                            best += [(d, i) for i in self.ids[self.heads[e] : min(self.heads[e + 1], self.heads[e] + k + 1)].tolist() if i != skip]
                        best = sorted(best)[:k]
                if len(best) == k and best[-1][0] < (s + 1) * (r + 1) + (m - s - 1) * r:
                    return best, compared
        return best, compared


def sign_codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``code``: one bit a component, set if it is above zero, filled up with zero bits to whole segments.

    Rows without an id, and null or empty vectors or such with null or NaN components, have no code and are left out; an infinite
    component counts by its sign. A repeated id has a code for each of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for v in b.column(1).to_pylist():
                bits = np.packbits(np.array(v) > 0)
                codes.append(bits.tobytes() + b"\0" * (-len(bits) % 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    vec = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    return table.where(good).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).mapInArrow(run, "vec_id long, code binary")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` codes nearest to each query by Hamming distance: ``query_id``, ``rank`` (from 1), ``vec_id``, ``distance``.

    Both frames have ``vec_id`` and ``code``. Ties go to the smaller id; a query's own id is not among its results; codes of
    another length are not compared; fewer codes than ``k`` give fewer rows; a repeated query id is one query for each of its
    distinct codes. Codes are dealt to blocks and queries to runs; a task has one block, builds its index once and asks it one run
    of queries. Runs are shorter than ``query_block`` where there are fewer blocks than tasks. Each block gives at most ``k`` rows a
    query, of which the ``k`` best are kept before and after they meet, so the merge is exact.
    """
    spark = codes.sparkSession
    scratch = Scratch(spark, "hamming")
    sized = lambda df: df.withColumn("bytes", F.length("code"))
    codes, queries = scratch.keep(sized(codes), "codes"), scratch.keep(sized(queries.distinct()), "queries")
    n_blocks, n_runs = (max(1, -(-df.count() // size)) for df, size in ((codes, block), (queries, query_block)))
    n_runs = max(n_runs, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.select("bytes", "vec_id", "code", F.pmod(F.xxhash64("vec_id", "code"), F.lit(parts)).alias(own), each.alias(other))

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and asked.num_rows:
            unpack = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint16).reshape(t.num_rows, -1)
            index = MultiIndex(unpack(data), data.column("vec_id").to_numpy())
            for q, code in zip(asked.column("vec_id").to_pylist(), unpack(asked)):
                out += [(q, code.tobytes(), d, i) for d, i in index.search(code, k, q)[0]]
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "q_code": pa.array(cols[1], pa.binary()), "distance": pa.array(cols[2], pa.int32()), "vec_id": pa.array(cols[3], pa.int64())})

    keys = ["bytes", "part", "run"]
    data, asked = dealt(codes, "part", n_blocks, "run", n_runs), dealt(queries, "run", n_runs, "part", n_blocks)
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, q_code binary, distance int, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_code").orderBy("distance", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "distance").where(F.col("rank") <= k)
