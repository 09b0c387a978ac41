"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of the component of each, for edges held in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a batch by stars: as many edges as nodes at most, with the same components."""
    for b in batches:
        if b.num_rows:
            node, root = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["a", "b"])


#: Edges that one task may hold; a smaller graph needs no rounds.
LOCAL = 1_000_000


def _all_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` (long) and ``component``, the smallest node that it is joined with, for all nodes of ``edges``.

    Alternates large-star and small-star steps until nothing changes: each node's neighbours move to its smallest one. Minima are
    added up before the shuffle and joined back, so that a node with very many neighbours is no group in memory; every round is
    written to the shared folder. A graph of at most ``LOCAL`` edges is solved in one task instead. Loops and repeated edges do no
    harm; null ends are left out.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ends = scratch.keep(ends, "edges")
    if ends.count() <= LOCAL:
        return scratch.keep(ends.coalesce(1).mapInArrow(_all_at_once, "node long, component long"), "components")
    nodes = scratch.keep(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    links = ends.where("a != b").mapInArrow(_contract, "a long, b long").distinct()
    links = scratch.keep(links, "links")
    before = None
    while True:
        # Large star: all larger neighbours of a node, and of its smallest neighbour, hang on the smallest one.
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.distinct(), "large")
        # Small star: a node's smaller neighbours, and itself, hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        new = scratch.keep(small.distinct(), "links")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        for old in (links, large):
            scratch.drop(old)
        links = new
        if state == before:
            break
        before = state
    roots = links.groupBy("a").agg(F.min("b").alias("component"))
    return scratch.keep(nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("component", "node").alias("component")), "components")
