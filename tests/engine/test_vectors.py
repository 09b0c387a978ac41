import numpy as np
import pytest

from thicket.operators import vectors as V


def frame(spark, x):
    return spark.createDataFrame([(f"v{i:04d}", v, b"m") for i, v in enumerate(x.tolist())], "id string, embedding array<double>, metadata binary")


def test_unit_axes_and_deletion(spark):
    index = V.VectorIndex(spark, V.Format(4)).insert([(f"e{i}", [float(j == i) for j in range(4)], bytes([i])) for i in range(4)] + [("all", [1.0] * 4, None)])
    hits = index.search([0, 0, 0, 1], 2).collect()
    assert hits[0].id == "e3" and hits[0].distance == 0 and bytes(hits[0].metadata) == b"\x03" and len(hits) == 2
    index.insert([("e3", [9.0, 9, 9, 9], None)]).delete(["e0"])
    assert index.count() == 4 and [r.id for r in index.search([0, 0, 0, 1], 4).collect()] == ["e1", "e2", "all", "e3"]
    with pytest.raises(ValueError):
        index.insert([("bad", [1.0], None)])
    with pytest.raises(ValueError):
        index.migrate(dim=5)


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_flat_and_batch_are_exact(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[7] = 0
    d = V.distances(x, x[:5], metric)
    want = [[f"v{i:04d}" for i in sorted(range(60), key=lambda i, r=row: (round(r[i], 9), i))[:6]] for row in d]
    df = frame(spark, x)
    assert [r.id for r in V.flat_search(df, x[2], 6, metric).collect()] == want[2]
    got = {}
    for r in V.batch_search(df, [(str(q), x[q].tolist()) for q in range(5)], 6, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert [got[str(q)] for q in range(5)] == want


def test_recall_of_the_indexes(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 10
    x = centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 16)) * 0.1
    df = frame(spark, x).cache()
    index = V.VectorIndex(spark, V.Format(16, "ivf", clusters=20), V.Runtime(nprobe=4, flat_until=100), df).train()
    queries = rng.integers(0, 600, 4)
    exact = {q: {r.id for r in V.flat_search(df, x[q], 10).collect()} for q in queries}
    recall = np.mean([len(exact[q] & {r.id for r in index.search(x[q].tolist(), 10).collect()}) / 10 for q in queries])
    assert recall >= 0.9
    index.save(f"file://{tmp_path}/index")
    again = V.VectorIndex.load(spark, f"file://{tmp_path}/index")
    assert {r.id for r in again.search(x[3].tolist(), 5).collect()} == {r.id for r in index.search(x[3].tolist(), 5).collect()}
    index.migrate(index="slsh", tables=2, width=0.5).reconfigure(radius=100)
    recall = np.mean([len(exact[q] & {r.id for r in index.search(x[q].tolist(), 10).collect()}) / 10 for q in queries])
    assert recall >= 0.9


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_queries_as_a_frame_are_exact(spark, metric, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 6))
    x[40:50] = x[3]
    monkeypatch.setattr(V, "VECTOR_BLOCK", 16)
    df = frame(spark, x)
    asked = df.where("id < 'v0020'").selectExpr("id AS query_id", "embedding")
    got = {}
    for r in V.join_search(df, asked, 5, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(20):
        d = V.pair_distances(x, np.repeat(x[q][None], 70, 0), metric)
        assert got[f"v{q:04d}"] == [f"v{i:04d}" for i in np.lexsort((np.arange(70), np.round(d, 12)))[:5]]
    probed = asked.selectExpr("*", "array(1) AS cids")
    only = V.join_search(df.selectExpr("*", "cast(substr(id, 5) as int) % 2 AS cid"), probed, 3, metric)
    assert {int(r.id[1:]) % 2 for r in only.collect()} == {1} and only.count() == 60
    assert V.join_search(df.limit(0), asked, 3, metric).count() == V.join_search(df, asked.limit(0), 3, metric).count() == 0


def test_repeated_new_ids_give_one_vector(spark):
    new = spark.createDataFrame([("a", [1.0, 0.0], b"1"), ("a", [2.0, 0.0], b"2"), ("b", [0.0, 1.0], None)], "id string, embedding array<float>, metadata binary")
    index = V.VectorIndex(spark, V.Format(2)).insert_frame(new).insert_frame(new)
    assert index.count() == 2 and [(r.id, bytes(r.metadata)) for r in index.search([2.0, 0.0], 1).collect()] == [("a", b"2")]


@pytest.mark.parametrize("fmt", [V.Format(8, "ivf", clusters=4), V.Format(8, "slsh", tables=3), V.Format(8, "flat", "cosine")])
def test_places_are_kept_in_folders_and_stores(spark, tmp_path, fmt):
    from thicket.sources.store import Store

    x, heard = np.random.default_rng(6).normal(size=(90, 8)), []
    index = V.VectorIndex(spark, fmt, V.Runtime(nprobe=2, flat_until=10, radius=20), frame(spark, x)).train(lambda *step: heard.append(step))
    assert heard[-1][0] == "done"
    index.insert([("late", [0.1] * 8, None)])
    want = [r.id for r in index.submit("search", x[5].tolist(), 6).result().collect()]
    index.save(f"file://{tmp_path}/index")
    store = Store(spark, f"file://{tmp_path}/db")
    index.keep(store.subtree("vec"))
    place = {"ivf": "cid", "slsh": "lsh"}.get(fmt.index)
    for again in (V.VectorIndex.load(spark, f"file://{tmp_path}/index"), V.VectorIndex.open(store.subtree("vec"))):
        assert [r.id for r in again.search(x[5].tolist(), 6).collect()] == want and again.count() == 91
        if place:
            assert {(r.id, str(r[place])) for r in again.vectors.collect()} == {(r.id, str(r[place])) for r in index.vectors.collect()}
            plan = again.search(x[5].tolist(), 6)._jdf.queryExecution().optimizedPlan().toString()
            assert "transform" not in plan.lower() or place == "lsh"  # no vector is placed anew
    with pytest.raises(PermissionError):
        store.subtree("vec").claim("graph")
