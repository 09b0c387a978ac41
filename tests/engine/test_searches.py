"""The registered searches, held against all rows of the table."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from thicket import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    order = np.argsort(t["vec_id"].to_numpy())
    return t["vec_id"].to_numpy()[order], np.array(t["embedding"].to_pylist(), dtype=np.float64)[order]


def nearest(ids, x, q, k, rows=None):
    """Ids and distances of the k nearest of row q among ``rows`` (all of them), without q itself; ties by id."""
    rows = np.arange(len(ids)) if rows is None else rows
    rows = rows[rows != q]
    d = np.sqrt(((x[rows] - x[q]) ** 2).sum(1))
    best = np.lexsort((ids[rows], d))[:k]
    return [(int(i), round(float(e), 4)) for i, e in zip(ids[rows][best], d[best])]


def test_batch_search_asks_all_its_queries_of_all_rows(spark, table):
    ids, x = table
    got = {}
    for r in catalogue.queries()["vec_batch_l2"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.distance, abs=1e-4)))
    assert got == {str(ids[q]): nearest(ids, x, q, 5) for q in np.flatnonzero(ids % 20 == 0)}


def test_copies_rank_by_id(spark):
    from thicket.operators import vectors as V

    row = np.random.default_rng(1).normal(size=64).tolist()
    df = spark.createDataFrame([(i, row) for i in range(200)], "id long, embedding array<double>")
    got = V.batch_neighbours(df, [("150", row)], 5).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(i, 0.0) for i in range(5)]


def test_recall_is_of_all_queries_with_the_settings_of_an_index(spark, table):
    from thicket.operators import vectors as V

    ids, x = table
    centres = np.array([c for _, c in V.train_centroids(catalogue.views.vectors(spark, SF), V.Format(64).clusters)])
    apart = lambda rows: np.sqrt(((rows[:, None] - centres[None]) ** 2).sum(2))
    cluster, want = apart(x).argmin(1), {}
    for q in np.flatnonzero(ids % 20 == 0):
        probed = np.argsort(apart(x[[q]])[0], kind="stable")[: V.Runtime().nprobe]
        exact, found = ({i for i, _ in nearest(ids, x, q, V.Runtime().top_k, rows)} for rows in (None, np.flatnonzero(np.isin(cluster, probed))))
        want[int(ids[q])] = len(exact & found) / len(exact)
    assert len(centres) == 50
    assert {r.query_id: r.recall for r in catalogue.queries()["vec_ivf_train_recall"](spark, SF).collect()} == pytest.approx(want)


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/check_s"])
def test_slsh_reads_a_thirtieth_of_the_table_on_each_side(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=np.float64)
    keys = np.floor(x @ np.array(catalogue.projections()).T / 0.25).astype(int)
    order, q = np.lexsort((ids, *keys.T[::-1])), int(np.flatnonzero(ids == 0)[0])
    start = next(n for n, i in enumerate(order) if tuple(keys[i]) >= tuple(keys[q]))
    radius = max(200, len(ids) // 30)
    rows = order[max(0, start - radius) : start + radius]
    want = [(0, 0.0), *nearest(ids, x, q, 9, rows)]
    got = [(r.id, r.distance) for r in catalogue.queries()["vec_slsh_search"](spark, sf_dir).orderBy("distance", "id").collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [d for _, d in got] == pytest.approx([d for _, d in want], abs=1e-4)


def test_read_stream_returns_every_key_in_order(spark):
    fields = ("custkey", "priority", "status")
    orders = pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey"])["o_orderkey"].to_pylist()
    got = [r.key for r in catalogue.queries()["kv_read_stream"](spark, SF).collect()]
    assert got == ["/".join(p) for p in sorted(("orders", str(k), f) for k in orders for f in fields)]
