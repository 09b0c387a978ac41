"""Shuffles of a table's rows have tasks whose number grows with its files, each of a bounded number of rows."""

import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from thicket import catalogue, session
from thicket.operators import triples as T
from thicket.operators import vectors, versions
from thicket.plans.traversal import Stats
from thicket.sources import views
from thicket.sources.store import Store

SHARE = 1 << 16


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(session, "SHARE", SHARE, raising=False)


def tasks(spark, run):
    """What ``run`` returns, and the tasks of each stage that it took."""
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "")
    try:
        result = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return result, [info.numTasks for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]


def written(df, folder):
    """The frame from files, and how many shares these have."""
    df.coalesce(2).write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder)), sum(f.stat().st_size for f in folder.glob("*.parquet")) // SHARE


def test_statistics_of_a_graph_deal_subjects_to_more_tasks_as_it_grows(spark, small, tmp_path):
    rows = spark.range(150_000).select(F.concat(F.lit("n"), F.col("id") % 50_000).alias("s"), F.when(F.col("id") % 3 == 0, "knows").otherwise("likes").alias("p"), F.sha1(F.col("id").cast("string")).alias("o"))
    triples, shares = written(rows, tmp_path / "triples")
    stats, counts = tasks(spark, lambda: Stats.of(triples))
    assert stats.counts == {"knows": (50_000, 50_000), "likes": (100_000, 50_000)}
    assert shares > 20 and max(counts) >= shares


def test_statistics_count_rows_without_a_subject(spark):
    df = spark.createDataFrame([("a", "p", "1"), ("a", "p", "2"), (None, "p", "1"), (None, "q", "1")], T.SCHEMA)
    assert {tuple(r) for r in T.predicate_stats(df).collect()} == {("p", 3, 1), ("q", 1, 0)}


def test_pairs_of_the_items_are_made_distinct_in_more_tasks_as_these_grow(spark, small, tmp_path):
    sf = "/root/testdata/sf0.01"
    for name in ("customer", "supplier", "nation", "orders", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    _, shares = written(spark.read.parquet(f"{sf}/lineitem.parquet"), tmp_path / "lineitem.parquet")
    pairs, counts = tasks(spark, views.triples(spark, str(tmp_path)).where("p = 'contains'").count)
    assert pairs == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    assert shares > 10 and max(counts) >= shares
    got, counts = tasks(spark, catalogue.queries()["graph_pred_stats"](spark, str(tmp_path)).collect)
    assert max(counts) >= 2 * shares and {r.p: r.triple_count for r in got}["contains"] == pairs


def test_a_vacuum_deals_versions_to_more_tasks_as_the_log_grows_and_keeps_their_order(spark, small, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(40_000).select(F.array(F.lit("k"), F.col("id").cast("string")).alias("path"), F.sha1(F.col("id").cast("string")).alias("value"))
    store.put_rows(rows.coalesce(2))
    store.put_rows(rows.where("path[1] % 4 = 0").withColumn("value", F.lit("new")))
    oldest = store.last_txn
    store.delete_prefix("k/7")
    store.put_rows(rows.where("path[1] % 8 = 0").withColumn("value", F.lit("newer")))
    shares = sum(f.stat().st_size for f in (tmp_path / "store" / "log").rglob("*.parquet")) // SHARE
    _, counts = tasks(spark, lambda: store.vacuum(oldest))
    assert shares > 20 and max(counts) >= shares
    want = {(str(i), 2 if i % 4 == 0 else 1, False) for i in range(40_000)} | {("7", 3, True)} | {(str(i), 4, False) for i in range(0, 40_000, 8)}
    kept = [(r.path[1], r.txn, r.is_delete) for r in store.log().collect()]
    assert len(kept) == len(want) and set(kept) == want
    files = [pq.read_table(f, columns=["key", "txn"]).to_pylist() for f in sorted((tmp_path / "store" / "generations").rglob("part-*.parquet"))]
    assert [(r["key"], r["txn"]) for rows in files for r in rows] == sorted((r["key"], r["txn"]) for rows in files for r in rows)


def test_versions_of_a_transaction_are_collected_by_their_place(spark):
    ops = [(["a"], "1", 1, 0, False), (["a"], "2", 1, 1, False), (["b"], "1", 1, 1, False), (["b"], None, 1, 2, True), (["c"], None, 2, 0, True), (["c"], "3", 3, 0, False), (["c"], "4", 3, 1, False)]
    frame = spark.createDataFrame(ops, "path array<string>, value string, txn long, seq int, is_delete boolean")
    for in_order in (False, True):
        got = sorted((r.path, r.value) for r in versions.collect_versions(frame, 2, in_order).collect())
        assert got == [(["a"], "2"), (["c"], "3"), (["c"], "4")]


def test_a_join_of_vectors_has_bounded_memory():
    rng, n, dims = np.random.default_rng(3), vectors.VECTOR_BLOCK, 64
    x, q = rng.normal(size=(n, dims)).astype(np.float32), rng.normal(size=(300, dims))
    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, dims), pa.int32()), pa.array(a.ravel()))
    left, right = pa.table({"id": np.arange(n), "embedding": lists(x)}), pa.table({"query_id": [str(i) for i in range(len(q))], "embedding": lists(q)})
    tracemalloc.start()
    try:
        found = vectors._block_search(left, right, 5, "l2").to_pydict()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 130
    for i in (0, 63, 64, 299):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        assert [a for a, name in zip(found["id"], found["query_id"]) if name == str(i)] == np.lexsort((np.arange(n), d))[:5].tolist()


def test_vectors_with_nulls_are_read_as_before():
    assert vectors.matrix(pa.array([[1.0, 2.0], [3.0, None]]))[0].tolist() == [1.0, 2.0] and np.isnan(vectors.matrix(pa.array([[1.0, None]]))[0, 1])
    assert vectors.matrix(pa.chunked_array([pa.array([[0.0], [1.0], [2.0]])[1:], pa.array([[5.0]])])).tolist() == [[1.0], [2.0], [5.0]]
    for ragged in ([[1.0, 2.0], None, [3.0, 4.0]], [[1.0, 2.0, 3.0], [4.0]]):
        with pytest.raises(ValueError):
            vectors.matrix(pa.array(ragged))
