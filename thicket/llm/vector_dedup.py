"""Embedding near-dedup: int8 tile products with error bounds, exact recomputation of the pairs they leave open."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_within
from .components import components, forest

#: Vectors of a tile, and rows of a product held at once.
TILE, STRIP = 4096, 1024


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id``, ``dim``, ``cls`` (128-bit hash of the values) and ``vec`` (doubles) of vectors that have a direction.

    Null, empty or zero vectors and those with null or non-finite components have null ``cls`` and ``vec``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values = pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False) + 0.0
            edges, missing = lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
            cls, vec, dim = [], [], []
            for i in range(b.num_rows):
                x = values[:0] if missing[i] else values[edges[i] : edges[i + 1]]
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(np.any(x))
                dim.append(len(x))
                cls.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                vec.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim, pa.int32()), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "dim", "cls", "vec"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, "vec_id long, dim int, cls binary, vec binary")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one: squares can't overflow, and no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Codes:
    """Int8 codes of unit vectors; for each its own step, the length of its error and the length of its code times the step."""

    q: np.ndarray
    step: np.ndarray
    error: np.ndarray
    length: np.ndarray

    def open(self, other: Codes, threshold: float, top: int, rows: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """For some rows against all of ``other``: which pairs surely reach the threshold, and which may or may not.

        With unit x = p + e and y = q + f, where p, q are codes times steps, x.y differs from p.q by at most |p||f| + |q||e| + |e||f|,
        a bound of this pair's own. Products of codes are exact: their sums stay below 2**24 in single precision up to 1040
        dimensions, and double precision is used beyond. Of one tile with itself only pairs of ascending rows count.
        """
        at, kind = slice(top, top + rows), np.float32 if self.q.shape[1] <= 1040 else np.float64
        product = (self.q[at].astype(kind) @ other.q.T.astype(kind)).astype(np.float64)
        product *= self.step[at, None]
        product *= other.step
        bound = self.length[at, None] * other.error
        bound += self.error[at, None] * (other.length + other.error)
        bound += _SLACK
        sure = product - bound >= threshold
        maybe = (product + bound >= threshold) & ~sure
        if same:
            later = np.arange(len(other.q)) > np.arange(top, top + len(product))[:, None]
            sure &= later
            maybe &= later
        return sure, maybe


#: What the rounding of products and bounds may add up to.
_SLACK = 1e-9


def quantised(u: np.ndarray) -> Codes:
    """Codes of unit rows; the figures of a row depend on that row alone."""
    step = np.abs(u).max(axis=1) / 127
    q = np.rint(u / step[:, None]).astype(np.int8)
    back = q.astype(np.float64) * step[:, None]
    return Codes(q, step, np.sqrt(((u - back) ** 2).sum(axis=1)) * (1 + _SLACK), np.sqrt((back**2).sum(axis=1)) * (1 + _SLACK))


def recomputed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs of rows those whose cosine, in double precision, reaches the threshold."""
    a, b = scaled(a), scaled(b)
    ra, rb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for k in range(0, len(i), 65_536):
        x, y = i[k : k + 65_536], j[k : k + 65_536]
        reach = np.einsum("ij,ij->i", a[x], b[y]) / (ra[x] * rb[y]) >= threshold
        yield x[reach], y[reach]


def open_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that the codes leave open and whose recomputed cosine reaches the threshold."""
    ca, cb = quantised(unit(a)), quantised(unit(b))
    for top in range(0, len(a), STRIP):
        i, j = np.nonzero(ca.open(cb, threshold, top, STRIP, same)[1])
        yield from recomputed(a, b, i + top, j, threshold)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of rows of ``a`` and ``b`` whose cosine is at least ``threshold``; of one tile with itself, each pair once."""
    ca, cb = quantised(unit(a)), quantised(unit(b))
    for top in range(0, len(a), STRIP):
        i, j = np.nonzero(ca.open(cb, threshold, top, STRIP, same)[0])
        yield i + top, j
    yield from open_pairs(a, b, threshold, same)


class Links:
    """Sums of links for each node of two tiles and a forest of the links, gathered strip by strip."""

    def __init__(self, nodes: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray]):
        self.nodes, self.sizes = nodes, sizes
        self.found = [np.zeros(len(n), np.int64) for n in nodes]
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for side, own, other in ((0, i, j), (1, j, i)):
            self.found[side] += np.bincount(own, self.sizes[1 - side][other], len(self.found[side])).astype(np.int64)
        if len(i):
            x, y = forest(self.nodes[0][i], self.nodes[1][j])
            self.ends.append((x[x != y], y[x != y]))

    def rows(self) -> dict[str, np.ndarray]:
        """``node`` and ``links`` of nodes that have some, then ``node`` and ``other`` of the forest (no node: -1)."""
        x, y = forest(*(np.concatenate(e) for e in zip(*self.ends))) if self.ends else (np.zeros(0, np.int64),) * 2
        x, y = x[x != y], y[x != y]
        at = [np.flatnonzero(f) for f in self.found]
        node = np.concatenate([self.nodes[0][at[0]], self.nodes[1][at[1]], x])
        links = np.concatenate([self.found[0][at[0]], self.found[1][at[1]], np.zeros(len(x), np.int64)])
        return {"node": node, "other": np.concatenate([np.full(len(node) - len(x), -1), y]), "links": links}


def near_duplicates(table: DataFrame, threshold: float = 0.95, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links all vectors whose cosine, in double precision, is at least ``threshold``.

    Returns one row a row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable) and
    ``kept`` (id = component_id). Equal vectors are one class with a weight. Classes are dealt to tiles by the nearest of a few
    pivots; a pair of tiles whose centres are further apart than their radii and the threshold's angle allow is left out, for all
    others the tiles' int8 codes are multiplied. Pairs whose bound decides are counted at once; of those that it leaves open only the
    rows concerned are named, whose doubles are then fetched and compared, so no link is lost and none is added. Either step gives
    sums of links for each class and a forest of its links, never the pairs. Vectors without a direction or of another length link
    with nothing, very large and very small components count like any other; a row without an id has no component, no links and
    is kept; repeated ids are vectors of their own with one component; an empty table gives an empty result.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.keep(vectors(table, id_col, vec_col), "rows")
    known = rows.where("cls is not null and vec_id is not null")
    # The id is a tie-break only: equal hashes have equal values.
    grouped = known.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("dim").alias("dim"), F.min("vec").alias("vec"))
    classes = scratch.keep(grouped.select(F.monotonically_increasing_id().alias("node"), "cls", "rep", "n", "dim", "vec"), "classes")
    total = classes.count()
    pivots_of: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy(F.xxhash64("cls")).select("vec").limit(min(256, -(-2 * total // tile))).collect() if total else []:
        x = np.frombuffer(bytes(r.vec))
        pivots_of.setdefault(len(x), []).append(x)
    pivots_of = {d: unit(np.array(p)) for d, p in pivots_of.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for dim, vec in zip(b.column(2).to_pylist(), b.column(3)):
                cell = 0
                if dim in pivots_of:
                    cell = int((pivots_of[dim] @ np.frombuffer(vec.as_py())).argmax())
                found.append(dim << 16 | cell)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "cell"])

    placed = number_within(scratch, classes.select("node", "n", "dim", "vec").mapInArrow(cells, "node long, n long, dim int, vec binary, cell long"), "cell", "rank")

    def build(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(t.num_rows, -1)
        u = unit(x)
        centre = u.sum(axis=0)
        length = np.sqrt((centre**2).sum())
        centre = centre / length if length > 1e-9 else u[0]
        radius = float(np.arccos(np.clip((u @ centre).min(), -1, 1))) + 1e-6
        c = quantised(u)
        columns = {"nodes": t.column("node").to_numpy(), "sizes": t.column("n").to_numpy(), "q": c.q, "steps": c.step, "errors": c.error, "lengths": c.length}
        return pa.table({"tile": pa.array([t.column("tile")[0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}})

    numbered = placed.select("node", "n", "vec", (F.col("cell") * (1 << 24) + F.floor(F.col("rank") / tile)).cast("long").alias("tile"))
    packed = ["nodes", "sizes", "q", "steps", "errors", "lengths"]
    tiles = scratch.keep(numbered.groupBy("tile").applyInArrow(build, "tile long, dim int, centre array<double>, radius double, " + ", ".join(f"{c} binary" for c in packed)), "tiles")
    meta = tiles.select("tile", "dim", "centre", "radius")
    # Tiles meet tiles in as many parts as there are runs of 64 of them: one side is dealt out, the other goes to each part.
    parts = max(1, -(-tiles.count() // 64))
    left = meta.select(*(F.col(c).alias(f"l_{c}") for c in meta.columns), F.pmod(F.xxhash64("tile"), F.lit(parts)).alias("part"))
    right = meta.select(*(F.col(c).alias(f"r_{c}") for c in meta.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    cosine = F.aggregate(F.zip_with("l_centre", "r_centre", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) - F.col("l_radius") - F.col("r_radius")
    pairs = left.join(right, (F.col("l_dim") == F.col("r_dim")) & (left["part"] == right["part"]) & (F.col("l_tile") <= F.col("r_tile"))).where((F.col("l_tile") == F.col("r_tile")) | (apart <= float(np.arccos(threshold)) + 1e-6))
    pairs = scratch.keep(pairs.select(F.col("l_tile").alias("l"), F.col("r_tile").alias("r")), "pairs")
    sides = pairs.select("l", "r", F.explode(F.array_distinct(F.array("l", "r"))).alias("tile"))
    delivered = sides.join(tiles.select("tile", "dim", *packed), "tile")

    def multiply(t: pa.Table) -> pa.Table:
        by = {x["tile"]: x for x in t.to_pylist()}
        l, r = t.column("l")[0].as_py(), t.column("r")[0].as_py()
        codes, nodes, sizes = [], [], []
        for x in (by[l], by[r]):
            codes.append(Codes(np.frombuffer(x["q"], np.int8).reshape(-1, x["dim"]), *(np.frombuffer(x[c]) for c in ("steps", "errors", "lengths"))))
            nodes.append(np.frombuffer(x["nodes"], np.int64))
            sizes.append(np.frombuffer(x["sizes"], np.int64))
        links, undecided = Links(tuple(nodes), tuple(sizes)), [np.zeros(len(n), bool) for n in nodes]
        for top in range(0, len(nodes[0]), STRIP):
            sure, maybe = codes[0].open(codes[1], threshold, top, STRIP, l == r)
            i, j = np.nonzero(sure)
            links.add(i + top, j)
            undecided[0][top : top + STRIP] |= maybe.any(axis=1)
            undecided[1] |= maybe.any(axis=0)
        if l == r:
            undecided = [undecided[0] | undecided[1], undecided[0][:0]]
        out = links.rows()
        node = np.concatenate([out["node"], *(n[u] if len(u) else n[:0] for n, u in zip(nodes, undecided))])
        side = np.concatenate([np.full(len(out["node"]), -1), *(np.full(u.sum(), k) for k, u in enumerate(undecided))])
        rest = len(node) - len(out["node"])
        return pa.table({"l": np.full(len(node), l), "r": np.full(len(node), r), "side": pa.array(side, pa.int32()), "node": node, "other": np.append(out["other"], np.full(rest, -1)), "links": np.append(out["links"], np.zeros(rest, np.int64))})

    def compare(t: pa.Table) -> pa.Table:
        side, node, size = (t.column(c).to_numpy() for c in ("side", "node", "n"))
        x = np.frombuffer(b"".join(t.column("vec").to_pylist())).reshape(t.num_rows, -1)
        a = np.flatnonzero(side == 0)
        same = t.column("l")[0] == t.column("r")[0]
        b = a if same else np.flatnonzero(side == 1)
        links = Links((node[a], node[b]), (size[a], size[b]))
        for i, j in open_pairs(x[a], x[b], threshold, same):
            links.add(i, j)
        return pa.table(links.rows())

    first = scratch.keep(delivered.groupBy("l", "r").applyInArrow(multiply, "l long, r long, side int, node long, other long, links long"), "products")
    asked = first.where("side >= 0").select("l", "r", "side", "node").join(classes.select("node", "n", "vec"), "node")
    exact = asked.groupBy("l", "r").applyInArrow(compare, "node long, other long, links long")
    found = scratch.keep(first.where("side < 0").select("node", "other", "links").unionAll(exact), "found")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(scratch, found.where("other >= 0").unionAll(_shared_ids(known, classes)), "node", "other")
    scratch.only(rows, classes, found, groups)
    group = classes.join(groups, "node", "left").join(degree, "node", "left").select("cls", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group"))
    smallest = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = group.join(smallest, "group").select("cls", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(of_class, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share an id: a component is one of ids."""
    shared = known.groupBy("vec_id").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2")).where("c1 != c2").select("vec_id")
    same = known.join(shared, "vec_id").select("vec_id", "cls").join(classes.select("cls", "node"), "cls")
    return same.join(same.groupBy("vec_id").agg(F.min("node").alias("other")), "vec_id").select("node", "other", F.lit(0).cast("long").alias("links"))
