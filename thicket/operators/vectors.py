"""Vector indexes over ``id``, ``embedding`` (and ``metadata``): exact, inverted-file and locality-sensitive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS, inner
from . import scans

#: Queries that one pass over the vectors takes along: the bound of what is sent to every task.
QUERY_BLOCK = 1024
#: Vectors, and queries, that a task of a join holds.
VECTOR_BLOCK = 32_768
#: Distances that a task of a join has at once, in any number of queries: 16 MB.
PRODUCT = 1 << 21


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def flat_search(vectors: DataFrame, query, k: int, metric: str = "l2") -> DataFrame:
    """The exact ``k`` nearest: all columns and ``distance``; ties by id. One pass, a top-k a partition and their merge."""
    return vectors.withColumn("distance", METRICS[metric](F.col("embedding"), vector_literal(query))).orderBy("distance", "id").limit(k)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, without a Python object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False)) if not column.null_count else ()
    if len(lengths) != 1:
        return np.array(column.to_pylist(), dtype=np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(lengths[0]))


def distances(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distances of queries (rows) to vectors (columns), in double precision."""
    block, queries = block.astype(np.float64, copy=False), queries.astype(np.float64, copy=False)
    if metric == "dot":
        return -(queries @ block.T)
    if metric == "cosine":
        norms = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((block**2).sum(1))[None, :]
        return np.where(norms == 0, 1.0, 1 - queries @ block.T / np.where(norms == 0, 1.0, norms))
    return np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (block**2).sum(1)[None, :] - 2 * queries @ block.T, 0))


def pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances row by row, without the cancellation of products: equal vectors have equal distances."""
    if metric == "l2":
        return np.sqrt(((x - y) ** 2).sum(1))
    dot = (x * y).sum(1)
    if metric == "dot":
        return -dot
    norms = np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1))
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1.0, norms))


def _nearest(x: np.ndarray, queries: np.ndarray, d: np.ndarray, k: int, metric: str, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of the k nearest of each query among ``x``, given rough distances; ties by ``place``, infinite left out."""
    limit = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else d.max(axis=1)
    reach = np.sqrt((queries**2).sum(1)) + np.sqrt((x**2).sum(1).max())
    near = (d <= (limit + 1e-6 * {"l2": reach, "dot": reach**2, "cosine": 1.0}[metric])[:, None]) & np.isfinite(d)
    q, at = np.nonzero(near)  # the k nearest and all that rounding could put among them
    exact = pair_distances(x[at], queries[q], metric)
    order = np.lexsort((place[at], exact, q))
    q, at, exact = q[order], at[order], exact[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], at[first], exact[first]


def batch_search(vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int, metric: str = "l2", probes: np.ndarray | None = None) -> DataFrame:
    """``query_id``, ``id``, ``distance``, ``rank`` of the exact ``k`` nearest of each of many queries: products by blocks.

    At most ``QUERY_BLOCK`` queries go along with one pass; more are searched in several. ``probes`` (queries by clusters) limits
    each query to the vectors whose ``cid`` it may see.
    """
    spark, out = vectors.sparkSession, None
    kind = vectors.schema["id"].dataType.simpleString()
    for a in range(0, max(1, len(queries)), QUERY_BLOCK):
        part = queries[a : a + QUERY_BLOCK]
        seen = None if probes is None else probes[a : a + QUERY_BLOCK]
        shared = spark.sparkContext.broadcast(([q for q, _ in part], np.array([v for _, v in part], dtype=np.float64), seen))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted, seen = shared.value
            for b in batches:
                if not b.num_rows or not names:
                    continue
                x = matrix(b.column(1))
                d = distances(x, wanted, metric)
                if seen is not None:
                    d[~seen[:, b.column(2).to_numpy(zero_copy_only=False)]] = np.inf
                place = np.argsort(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable"))
                q, at, exact = _nearest(x, wanted, d, k, metric, place)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.string()), b.column(0).take(pa.array(at)), pa.array(exact)], names=["query_id", "id", "distance"])

        found = vectors.select("id", "embedding", *(["cid"] if probes is not None else [])).mapInArrow(search, f"query_id string, id {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).alias("rank")
    return out.select("*", rank).where(F.col("rank") <= k)


def _block_search(left: pa.Table, right: pa.Table, k: int, metric: str) -> pa.Table:
    """The ``k`` nearest in a block of vectors (left) of each of a run of queries (right)."""
    probed = "cid" in left.column_names
    ids, names = left.column("id").combine_chunks(), right.column("query_id").combine_chunks()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if left.num_rows and right.num_rows:
        x, wanted = matrix(left.column("embedding")), matrix(right.column("embedding"))
        step = max(1, PRODUCT // len(x))
        place = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
        for a in range(0, len(wanted), step):
            d = distances(x, wanted[a : a + step], metric)
            if probed:
                cid = left.column("cid").to_numpy()
                for row, seen in zip(d, right.column("cids").slice(a, step).to_pylist()):
                    row[~np.isin(cid, seen)] = np.inf
            q, at, exact = _nearest(x, wanted[a : a + step], d, k, metric, place)
            found.append((q + a, at, exact))
    q, at, exact = (np.concatenate(c) for c in zip(*found))
    return pa.table({"query_id": names.take(pa.array(q)), "id": ids.take(pa.array(at)), "distance": exact})


def join_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """``batch_search`` for any number of queries, which stay a frame: ``query_id``, ``embedding`` and, if the vectors have ``cid``, ``cids``.

    Vectors and queries are dealt to blocks of bounded size, and each block of vectors meets each block of queries in a task of its
    own, which gives at most ``k`` rows a query. ``cids`` lists the clusters that a query may see.
    """
    spark, kind, probed = vectors.sparkSession, vectors.schema["id"].dataType.simpleString(), "cids" in queries.columns
    blocks, runs = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, VECTOR_BLOCK)))
    runs = max(runs, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = vectors.select("id", "embedding", *["cid"] * probed, F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(runs).alias("run"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), *["cids"] * probed, F.pmod(F.xxhash64("query_id"), F.lit(runs)).alias("run"), each(blocks).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_search(left, right, k, metric)

    keys = ["block", "run"]
    out = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, f"query_id string, id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).alias("rank")
    return out.select("*", rank).where(F.col("rank") <= k)


def batch_neighbours(vectors: DataFrame, queries: list[tuple[str, list[float]]] | DataFrame, k: int, metric: str = "l2", probes: np.ndarray | None = None) -> DataFrame:
    """``batch_search`` (``join_search`` for a frame) of rows of the table itself: all are searched, only a query's own id is left out."""
    found = join_search(vectors, queries, k + 1, metric) if isinstance(queries, DataFrame) else batch_search(vectors, queries, k + 1, metric, probes)
    found = found.where(F.col("id").cast("string") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# Inverted file


def probes_column(centroids: list[tuple[int, list[float]]], nprobe: int, metric: str = "l2") -> Column:
    """The ``nprobe`` clusters nearest to ``embedding``, the choice of ``ivf_search``, as a column."""
    named = F.array(*(F.struct(F.lit(c).alias("cid"), vector_literal(v).alias("v")) for c, v in centroids))
    scored = F.array_sort(F.transform(named, lambda c: F.struct(METRICS[metric](F.col("embedding"), c["v"]).alias("d"), c["cid"].alias("cid"))))
    return F.transform(F.slice(scored, 1, nprobe), lambda c: c["cid"])


def assign(vectors: DataFrame, centroids: list[tuple[int, list[float]]], metric: str = "l2") -> DataFrame:
    """Adds ``cid``, the nearest centroid, the lowest of equals. Centroids are a setting's worth, not data."""
    if not centroids:
        return vectors.withColumn("cid", F.lit(0))
    named = F.array(*(F.struct(F.lit(c).alias("cid"), vector_literal(v).alias("v")) for c, v in centroids))
    scored = F.transform(named, lambda c: F.struct(METRICS[metric](F.col("embedding"), c["v"]).alias("d"), c["cid"].alias("cid")))
    return vectors.withColumn("cid", F.array_min(scored)["cid"])


def nearest_centroids(centroids: list[tuple[int, list[float]]], query, nprobe: int, metric: str) -> list[int]:
    d = distances(np.array([v for _, v in centroids]), np.array([query]), metric)[0]
    return [c for _, c in sorted((x, c) for x, (c, _) in zip(d.tolist(), centroids))[:nprobe]]


def ivf_search(assigned: DataFrame, centroids: list[tuple[int, list[float]]], query, k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Exact search of the ``nprobe`` nearest clusters; with a layout partitioned by ``cid`` only those are read."""
    return flat_search(assigned.where(F.col("cid").isin(nearest_centroids(centroids, query, nprobe, metric))), query, k, metric)


def probe_table(centroids: list[tuple[int, list[float]]], queries: list[tuple[str, list[float]]], nprobe: int, metric: str = "l2") -> np.ndarray:
    """Whether a query (row) sees a cluster (column): the choice of ``ivf_search`` for many queries."""
    seen = np.zeros((len(queries), len(centroids)), dtype=bool)
    for row, (_, q) in zip(seen, queries):
        row[nearest_centroids(centroids, q, nprobe, metric)] = True
    return seen


def train_centroids(vectors: DataFrame, k: int, metric: str = "l2", rounds: int = 10, sample: int = 10_000) -> list[tuple[int, list[float]]]:
    """k-means: seeds drawn by squared distance from a bounded sample, then passes over all vectors; means even for other metrics.

    A pass sends one sum a cluster and task; an empty cluster keeps its centre.
    """
    rows = vectors.select("embedding").orderBy(F.xxhash64("id")).limit(sample).collect()
    if not rows:
        return []
    pool = np.array([r.embedding for r in rows], dtype=np.float64)
    rng, centres = np.random.default_rng(len(pool)), [pool[0]]
    gap = distances(pool, pool[:1], "l2")[0] ** 2
    while len(centres) < min(k, len(pool)) and gap.sum() > 0:
        centres.append(pool[rng.choice(len(pool), p=gap / gap.sum())])
        gap = np.minimum(gap, distances(pool, centres[-1][None], "l2")[0] ** 2)
    centres = np.array(centres)
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centres)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(shared.value), np.zeros(len(shared.value))
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    near = distances(shared.value, x, metric).argmin(axis=1)
                    np.add.at(sums, near, x)
                    counts += np.bincount(near, minlength=len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["cid", "n", "total"])

        parts = vectors.select("embedding").mapInArrow(add, "cid long, n double, total array<double>")
        dims = [F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(centres.shape[1])]
        new = centres.copy()
        for r in parts.groupBy("cid").agg(F.sum("n").alias("n"), *dims).collect():
            if r.n:
                new[r.cid] = np.array(r[2:]) / r.n
        if np.allclose(new, centres):
            break
        centres = new
    return list(enumerate(centres.tolist()))


# Locality-sensitive


def slsh_key(vectors: DataFrame, projections: list[list[float]], width: float) -> DataFrame:
    """Adds ``lsh``: floor(v . projection / width) of each projection, an array that sorts as the projections do."""
    keys = [F.floor(inner(F.col("embedding"), vector_literal(p)) / width).cast("int") for p in projections]
    return vectors.withColumn("lsh", F.array(*keys))


def scan_radius(count: int, least: int = 200) -> int:
    """Rows on each side of the key: a thirtieth of the table, ``least`` at least."""
    return max(least, count // 30)


def slsh_search(keyed: DataFrame, projections: list[list[float]], width: float, query, k: int, radius: int, metric: str = "l2") -> DataFrame:
    """Exact re-ranking of the ``radius`` rows at or after the query's key and the ``radius`` before it."""
    key = F.array(*(F.lit(int(np.floor(np.dot(query, p) / width))) for p in projections))
    after = keyed.where(F.col("lsh") >= key).orderBy("lsh", "id").limit(radius)
    before = keyed.where(F.col("lsh") < key).orderBy(F.desc("lsh"), F.desc("id")).limit(radius)
    return flat_search(after.unionByName(before), query, k, metric)


# The defaults of an index's format and of its searches.


@dataclass(frozen=True)
class Format:
    """What stays as it is but for ``migrate``; ``bits`` is kept for files that name it, keys here are whole numbers."""

    dim: int
    index: str = "flat"
    metric: str = "l2"
    clusters: int = 50
    tables: int = 4
    bits: int = 16
    width: float = 2.0


@dataclass(frozen=True)
class Runtime:
    """What may change between searches."""

    nprobe: int = 8
    flat_until: int = 1000
    radius: int = 200
    top_k: int = 10


class VectorIndex:
    """Upserts, deletions and searches over a frame of vectors; an id has one vector, one cluster (``cid``) and one key (``lsh``).

    Cluster and key are columns that are made when a vector comes in or the clusters are trained, and stored with it.
    """

    def __init__(self, spark, fmt: Format, runtime: Runtime | None = None, vectors: DataFrame | None = None):
        if fmt.dim <= 0 or fmt.index not in ("flat", "ivf", "slsh") or fmt.metric not in METRICS:
            raise ValueError("bad format")
        self.spark, self.format, self.runtime = spark, fmt, runtime or Runtime()
        self.centroids: list[tuple[int, list[float]]] = []
        rng = np.random.default_rng(42)
        self.projections = rng.uniform(0, 1, (fmt.tables, fmt.dim)).tolist()
        self._count: int | None = None
        self._pool: ThreadPoolExecutor | None = None
        self.vectors = self._placed(vectors if vectors is not None else spark.createDataFrame([], "id string, embedding array<float>, metadata binary"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With the cluster or key that the index searches by."""
        rows = rows.select("id", "embedding", "metadata")
        if self.format.index == "ivf":
            return assign(rows, self.centroids, self.format.metric)
        return slsh_key(rows, self.projections, self.format.width) if self.format.index == "slsh" else rows

    def insert_frame(self, new: DataFrame) -> VectorIndex:
        """One append; an id that is there is replaced, and of rows of one id in ``new`` the one with the greatest vector counts."""
        one = new.groupBy("id").agg(F.max_by(F.struct("embedding", "metadata"), "embedding").alias("row")).select("id", "row.*")
        self.vectors = self.vectors.join(one.select("id"), "id", "left_anti").unionByName(self._placed(one))
        self._count = None
        return self

    def insert(self, rows: list[tuple[str, list[float], bytes | None]]) -> VectorIndex:
        if any(len(v) != self.format.dim for _, v, _ in rows):
            raise ValueError("wrong number of dimensions")
        last = {i: (i, [float(x) for x in v], m) for i, v, m in rows}
        return self.insert_frame(self.spark.createDataFrame(list(last.values()), "id string, embedding array<float>, metadata binary"))

    def delete(self, ids: list[str]) -> VectorIndex:
        self.vectors, self._count = self.vectors.where(~F.col("id").isin(ids)), None
        return self

    def count(self) -> int:
        """The number of vectors; counted once until something changes."""
        if self._count is None:
            self._count = self.vectors.count()
        return self._count

    def train(self, progress: Callable[[str, int, int], None] | None = None) -> VectorIndex:
        """Makes the clusters anew and places all vectors; ``progress`` hears of each step, its number and how many there are."""
        tell = progress or (lambda *_: None)
        if self.format.index == "ivf":
            tell("train", 0, 2)
            self.centroids = train_centroids(self.vectors, self.format.clusters, self.format.metric)
            tell("place", 1, 2)
        self.vectors = self._placed(self.vectors)
        tell("done", 2, 2)
        return self

    def rebuild(self, progress: Callable[[str, int, int], None] | None = None) -> VectorIndex:
        """Places all vectors anew by the clusters that there are; without clusters these are made first."""
        if self.format.index == "ivf" and not self.centroids:
            return self.train(progress)
        self.vectors = self._placed(self.vectors)
        (progress or (lambda *_: None))("done", 1, 1)
        return self

    def submit(self, method: str, *args, **kwargs) -> Future:
        """Runs a method on a thread of the index's own: ``submit("insert", rows)``, ``submit("search", query)``."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1)
        return self._pool.submit(getattr(self, method), *args, **kwargs)

    def reconfigure(self, **changes) -> VectorIndex:
        self.runtime = replace(self.runtime, **changes)
        return self

    def migrate(self, **changes) -> VectorIndex:
        """Another index, metric or setting over the same vectors; the number of dimensions stays."""
        if changes.get("dim", self.format.dim) != self.format.dim:
            raise ValueError("the number of dimensions can't change")
        fresh = VectorIndex(self.spark, replace(self.format, **changes), self.runtime, self.vectors)
        self.format, self.projections, self.centroids, self.vectors = fresh.format, fresh.projections, [], fresh.vectors
        return self.train()

    def save(self, folder: str) -> None:
        """The vectors with their clusters or keys, and the settings.

        An inverted file is partitioned by cluster, so that a search reads those it probes; keys are stored in order.
        """
        rows, index = self.vectors, self.format.index
        if index == "ivf":
            rows.repartition("cid", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cid").mode("overwrite").parquet(f"{folder}/vectors")
        else:
            (rows.repartitionByRange("lsh", "id").sortWithinPartitions("lsh", "id") if index == "slsh" else rows).write.mode("overwrite").parquet(f"{folder}/vectors")
        settings = json.dumps({"layer": "vector", "format": asdict(self.format), "runtime": asdict(self.runtime), "centroids": self.centroids, "count": self.count()})
        self.spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")

    @classmethod
    def load(cls, spark, folder: str) -> VectorIndex:
        found = json.loads(spark.read.parquet(f"{folder}/settings").first().settings)
        if found.get("layer") != "vector":
            raise PermissionError("the folder belongs to another layer")
        out = cls(spark, Format(**found["format"]), Runtime(**found["runtime"]))
        out.vectors, out._count = spark.read.parquet(f"{folder}/vectors"), found["count"]
        out.centroids = [(c, v) for c, v in found["centroids"]]
        return out

    def keep(self, subtree) -> int:
        """Writes vectors, their places and the settings below a subtree of a store, as one transaction; it belongs to this layer then."""
        subtree.claim("vector")
        columns = [F.struct(F.lit(c).alias("f"), (F.col(c) if c == "metadata" else F.to_json(c) if c in ("embedding", "lsh") else F.col(c).cast("string")).cast("binary").alias("v")) for c in self.vectors.columns if c != "id"]
        rows = self.vectors.select("id", F.explode(F.array(*columns)).alias("e")).where(F.col("e.v").isNotNull())
        rows = rows.select(F.array(F.lit("vectors"), F.col("id"), F.col("e.f")).alias("path"), F.col("e.v").alias("value"))
        settings = json.dumps({"format": asdict(self.format), "runtime": asdict(self.runtime), "centroids": self.centroids}).encode()
        return subtree.put_rows(rows.unionAll(self.spark.createDataFrame([(["settings"], bytearray(settings))], "path array<string>, value binary")))

    @classmethod
    def open(cls, subtree) -> VectorIndex:
        """The index that ``keep`` wrote."""
        subtree.claim("vector")
        found = json.loads(subtree.get(["settings"]))
        out = cls(subtree.spark, Format(**found["format"]), Runtime(**found["runtime"]))
        part = lambda i: F.get(F.col("path"), F.lit(i))
        value = lambda c: F.max(F.when(part(2) == c, F.col("data")))
        kinds = {"metadata": "binary", "embedding": "array<float>", "lsh": "array<int>", "cid": "int"}
        raw = scans.below(subtree.kv(), ["vectors"]).groupBy(part(1).alias("id")).agg(*(value(c).alias(c) for c in kinds if c in ("embedding", "metadata", *out.vectors.columns)))
        text = lambda c: F.col(c).cast("string")
        out.vectors = raw.select("id", *((F.col(c) if c == "metadata" else F.from_json(text(c), kinds[c]) if "array" in kinds[c] else text(c).cast("int")).alias(c) for c in raw.columns if c != "id"))
        out.centroids = [(c, v) for c, v in found["centroids"]]
        return out

    def search(self, query: list[float], k: int = 0) -> DataFrame:
        """``id``, ``distance``, ``metadata`` of the nearest ``k`` (the runtime's ``top_k`` if not positive)."""
        f, r, k = self.format, self.runtime, k if k > 0 else self.runtime.top_k
        if f.index == "ivf" and self.centroids and self.count() >= r.flat_until:
            out = ivf_search(self.vectors, self.centroids, query, k, r.nprobe, f.metric)
        elif f.index == "slsh":
            radius = scan_radius(self.count(), r.radius)
            out = slsh_search(self.vectors, self.projections, f.width, query, k, radius, f.metric)
        else:
            out = flat_search(self.vectors, query, k, f.metric)
        return out.select("id", "distance", "metadata")
