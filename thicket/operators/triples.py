"""Triples (``s``, ``p``, ``o``) as one table with set semantics; permutations are layouts, not copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shares

SCHEMA = "s string, p string, o string"
INDEXES = ("spo", "pos", "osp", "pso")


def insert(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Appends what is not there yet: the table is looked through once for the new triples, which are few, and never regrouped."""
    new, triples = new.select("s", "p", "o").distinct(), triples.select("s", "p", "o")
    there = triples.join(new, ["s", "p", "o"], "left_semi")
    return triples.unionByName(new.join(there, ["s", "p", "o"], "left_anti"))


def delete(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def expand(triples: DataFrame, indexes_of=None) -> DataFrame:
    """Index rows of each triple: ``idx`` and the components in that index's order, ``c1``, ``c2``, ``c3``.

    ``indexes_of`` maps a predicate to the indexes kept for it (a ``Schema.indexes`` result); without it all four are.
    """
    order = {i: [F.col(c) for c in i] for i in INDEXES}
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), a.alias("c1"), b.alias("c2"), c.alias("c3")) for i, (a, b, c) in order.items()))
    out = triples.select("p", F.explode(rows).alias("e"))
    if indexes_of:
        for predicate, kept in indexes_of.items():
            out = out.where((F.col("p") != predicate) | F.col("e.idx").isin(list(kept)))
    return out.select("e.*")


def collapse(keys: DataFrame) -> DataFrame:
    """Triples from index keys (``path``: the index's name and the components in its order), whichever indexes they have."""
    part = lambda i: F.get(F.col("path"), F.lit(i))
    columns = [F.coalesce(*(F.when(part(0) == i, part(i.index(c) + 1)) for i in INDEXES)).alias(c) for c in "spo"]
    return keys.where(part(0).isin(list(INDEXES)) & (F.size("path") == 4)).select(*columns).distinct()


def out_step(vertices: DataFrame, triples: DataFrame, predicate: str) -> DataFrame:
    edges = triples.where(F.col("p") == predicate).select(F.col("s").alias("v"), "o")
    return vertices.join(edges, "v").select(F.col("o").alias("v")).distinct()


def in_step(vertices: DataFrame, triples: DataFrame, predicate: str) -> DataFrame:
    edges = triples.where(F.col("p") == predicate).select(F.col("o").alias("v"), "s")
    return vertices.join(edges, "v").select(F.col("s").alias("v")).distinct()


COMPARE = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def having(triples: DataFrame, predicate: str, op: str, value: str) -> DataFrame:
    """Subjects with a matching object; objects are compared as text, byte by byte."""
    return triples.where((F.col("p") == predicate) & COMPARE[op](F.col("o"), F.lit(value))).select(F.col("s").alias("v")).distinct()


def predicates_to(vertices: DataFrame, triples: DataFrame, target: str) -> DataFrame:
    """Predicates that link a vertex to ``target``."""
    return triples.where(F.col("o") == target).select(F.col("s").alias("v"), "p").join(vertices, "v", "left_semi").select(F.col("p").alias("v")).distinct()


def subjects_of(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("v")).distinct()


def predicate_stats(triples: DataFrame) -> DataFrame:
    """Subjects are counted apart first, in tasks whose number grows with the triples."""
    of_subject = triples.repartition(shares(triples), "p", "s").groupBy("p", "s").agg(F.count("*").alias("n"))
    return of_subject.groupBy("p").agg(F.sum("n").alias("triple_count"), F.count("s").alias("distinct_subjects"))


def write(triples: DataFrame, folder: str) -> None:
    """Partitioned by predicate and sorted by subject: a step reads one partition and skips row groups."""
    triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("p", "s", "o").write.partitionBy("p").mode("overwrite").parquet(folder)
