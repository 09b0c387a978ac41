"""The store, held against a dictionary of paths."""

import numpy as np
import pytest

from thicket.functions.keys import key_column, key_text, split_text
from thicket.operators import objects
from thicket.sources.page import to_html
from thicket.sources.store import Batch, BatchError, ConflictError, Store
from thicket.streaming import oplog


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def keys(df):
    return ["/".join(r.path) for r in df.collect()]


def listed(paths):
    """Paths in key order: by components, not by the joined text."""
    return ["/".join(p) for p in sorted(map(split_text, paths))]


def test_random_batches_match_a_dictionary(store):
    rng, model, states = np.random.default_rng(17), {}, []
    parts = ["a", "a!", "a-b", "ab", "b", "é", "zz"]
    for _ in range(4):
        ops = []
        for _ in range(30):
            key = "/".join(rng.choice(parts, rng.integers(1, 4)))
            if rng.random() < 0.7:
                value = str(rng.integers(1000)) if rng.random() < 0.5 else rng.bytes(5)
                ops.append({"type": "put", "key": key, "value": value})
                model[key] = value
            else:
                ops.append({"type": "del", "key": key})
                model.pop(key, None)
        states.append((store.batch(ops), dict(model)))
    asked = [*model, "never/there"]
    assert store.get_many(asked) == [model.get(k) for k in asked]
    for txn, state in states[::3]:
        got = {"/".join(r.path): r.value if r.value is not None else bytes(r.data) for r in store.kv(txn).collect()}
        assert got == state
    assert keys(store.scan()) == listed(model) and keys(store.scan(reverse=True)) == listed(model)[::-1]
    inside = [k for k in model if ["a"] <= split_text(k) < ["b"]]
    assert keys(store.scan("a", "b")) == listed(inside) and keys(store.scan("a", "b", reverse=True, limit=3)) == listed(inside)[::-1][:3]
    assert keys(store.prefix_scan("a")) == listed(k for k in model if split_text(k)[0] == "a")
    assert store.count() == len(model)


def test_keys_order_as_paths_do(spark):
    rng = np.random.default_rng(3)
    paths = [[("".join(rng.choice(list("\0\1\2ab￿\U0001f600"), rng.integers(0, 4)))) for _ in range(rng.integers(0, 4))] for _ in range(300)]
    as_bytes = lambda p: [c.encode() for c in p]
    assert sorted(paths, key=lambda p: key_text(p).encode()) == sorted(paths, key=as_bytes)
    assert len({key_text(p) for p in paths}) == len({tuple(p) for p in paths})
    df = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    assert [r.k for r in df.select(key_column("path").alias("k")).collect()] == [key_text(p) for p in paths]


def test_conditions_on_keys_reach_the_files(store):
    store.put_many({f"k/{i:03d}": i for i in range(50)})
    for df in (store.scan("k/010", "k/020"), store.prefix_scan("k/01")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and ("GreaterThanOrEqual(key" in plan or "StringStartsWith(key" in plan)


def test_values_are_bytes_and_text_comes_back_as_text(store):
    store.put("raw", b"\xff\x00\xfe")
    store.put("text", "naïve")
    store.put("number", 7)
    assert (store.get("raw"), store.get("text"), store.get("number")) == (b"\xff\x00\xfe", "naïve", "7")
    assert {r.path[0]: bytes(r.data) for r in store.kv().collect()} == {"raw": b"\xff\x00\xfe", "text": "naïve".encode(), "number": b"7"}
    store.put_object("o", {"blob": b"\xfe", "none": {}, "empty": [], "deep": [{"x": []}]})
    assert store.get_object("o") == {"blob": b"\xfe", "none": {}, "empty": [], "deep": [{"x": []}]}


def test_counters_and_callbacks(store):
    assert store.increment("hits", 5) == 5 and store.increment("hits", -2) == 3
    store.put("word", "seven")
    assert store.increment("word", 1) == 1
    seen = []
    store.put_cb("later", "v", lambda error, txn: seen.append(error)).result()
    store.get_cb("later", lambda error, value: seen.append(value)).result()
    store.delete_cb("later", lambda error, txn: seen.append(error)).result()
    assert seen == [None, "v", None] and store.submit("get", "later").result() is None


def test_batches(store):
    batch = Batch(3).put("ab/c", "1").put(["ab", "c"], b"22").delete("gone")
    assert [op[0] for op in batch.ops] == [["ab", "c"], ["ab", "c"], ["gone"]] and batch.size() == 3 + 1 + 3 + 2 + 4
    with pytest.raises(BatchError):
        batch.put("more", "1")
    store.write_batch(batch)
    assert store.get("ab/c") == b"22"
    for wrong in (batch, Batch()):
        with pytest.raises(BatchError):
            store.write_batch(wrong)
    before = store.last_txn
    for op in ({"type": "swap", "key": "x"}, {"type": "put", "value": "1"}, {"type": "put", "key": "x"}, {"type": "put", "key": "//", "value": "1"}):
        with pytest.raises(ValueError):
            store.batch([{"type": "put", "key": "fine", "value": "1"}, op])
    assert store.batch([]) is None and store.last_txn == before and store.get("fine") is None


def test_two_stores_on_one_folder_see_and_respect_each_other(spark, store):
    other = Store(spark, store.location)
    first = store.put("k", "one")
    second = other.put("k", "two")
    assert (first, second) == (1, 2) and store.get("k") == other.get("k") == "two"
    other.vacuum()
    other.vacuum()
    assert store.get("k") == "two" and store.put("k", "three") == 3 and other.get("k") == "three"
    stores = [store, other, Store(spark, store.location), Store(spark, store.location)]
    calls = [s.submit("increment", "n") for s in stores]  # each on a thread of its own
    assert sorted(c.result() for c in calls) == [1, 2, 3, 4] and store.get("n") == "4"


def test_transactions(store):
    store.put_many({"a": "1", "b": "2"})
    with store.transaction() as t:
        t.put("a", "10")
        t.delete("b")
        assert t.get("a") == "10" and t.get("b") is None and store.get("a") == "1"
    assert store.get("a") == "10" and store.get("b") is None
    dropped = store.transaction()
    dropped.put("a", "no")
    dropped.abort()
    late = store.transaction()
    assert late.get("a") == "10"
    store.put("a", "11")
    assert late.get("a") == "10"  # still its snapshot
    late.put("c", "x")
    with pytest.raises(ConflictError):
        late.commit()
    assert store.get("a") == "11" and store.get("c") is None
    assert store.transaction().commit() is None


def test_vacuum_keeps_what_readers_see(spark, store, tmp_path):
    for i in range(3):
        store.put("k", str(i))
    store.put("gone", "x")
    held = store.reader()
    store.delete("gone")
    store.put("k", "new")
    frame = store.kv(held.txn)
    assert store.vacuum_status() == {"versions": 6, "live": 1, "stale": 5, "generation": 0, "readers": 1}
    store.vacuum()
    assert store.get("k") == "new" and store.get("gone") is None and store.get("gone", as_of=held.txn) == "x"
    assert frame.count() == 2 and store.purge() == 0  # files that an open reader may need stay
    held.close()
    assert store.purge() == 6 and store.get("k") == "new"
    store.vacuum(oldest_reader=store.begin())
    assert store.ops().count() == 1 and not store.vacuum_auto() and store.generation == 2
    store.snapshot(f"file://{tmp_path}/snap")
    other = Store(spark, f"file://{tmp_path}/other")
    other.import_snapshot(f"file://{tmp_path}/snap")
    assert other.get("k") == "new"


def test_cursors_go_both_ways(store):
    store.put_many({f"row/{i:02d}": i for i in range(12)})
    cursor = store.cursor("row/02", "row/10")
    cursor.ahead = 3
    store.put("row/055", "later")
    assert [cursor.next().path[1] for _ in range(4)] == ["02", "03", "04", "05"]
    assert [cursor.prev().path[1], cursor.prev().path[1], cursor.next().path[1]] == ["04", "03", "04"]
    assert cursor.seek("row/08").next().path[1] == "08" and cursor.next().path[1] == "09" and cursor.next() is None
    assert cursor.seek("row/03").prev().path[1] == "02" and cursor.prev() is None
    cursor.close()
    rows = store.iterate("row/09")
    assert next(rows).path[1] == "09" and store.vacuum_status()["readers"] == 1
    rows.close()
    assert store.vacuum_status()["readers"] == 0


def test_prefixes_and_subtrees_stay_inside(store):
    store.put_many({"lab/x/1": "p", "lab/x/2": "q", "lab": "r", "lab2/x": "s", "lab-old/y": "t"})
    assert keys(store.prefix_scan("lab")) == ["lab", "lab/x/1", "lab/x/2"]
    lab = store.subtree("lab")
    assert keys(lab.scan()) == ["x/1", "x/2"] and lab.count() == 2 and lab.get("x/1") == "p" and keys(lab.scan("x/2")) == ["x/2"]
    lab.batch([{"type": "put", "key": "y", "value": b"\x01"}, {"type": "del", "key": "x/1"}])
    assert store.get("lab/y") == b"\x01" and lab.prepend("y") == ["lab", "y"]
    assert lab.subtree("x").increment("n", 4) == 4 and [r.key for r in lab.read_stream(values=False).collect()] == ["x/2", "x/n", "y"]
    assert [r.path for r in lab.cursor().seek("x/n")._range.collect()][0] == ["x", "2"]
    lab.delete_prefix("x")
    assert keys(store.scan()) == listed(["lab", "lab/y", "lab-old/y", "lab2/x"])
    store.delete_prefix("lab")
    assert keys(store.scan()) == listed(["lab-old/y", "lab2/x"])
    area = store.subtree("area")
    area.claim("graph")
    area.claim("graph")
    with pytest.raises(PermissionError):
        area.claim("vector")


def test_objects(store):
    made = {"title": "Atlas", "pages": 212, "maker": {"town": "Delft", "since": "1671"}, "parts": ["north", "south"], "bound": False, "note": None}
    store.put_object("books/atlas", made)
    assert store.get("books/atlas/maker/town") == "Delft"
    assert store.get_object("books/atlas") == {**made, "pages": "212", "bound": "false", "note": ""}
    assert store.get_object("books/none") is None
    assert objects.reconstruct([(["m", "0"], 1), (["m", "2"], 2)]) == {"m": {"0": 1, "2": 2}}


def test_stream_of_operations(spark, store, tmp_path):
    rows = [(["a"], "1", 1, 0, False), (["b"], "2", 1, 1, False)]
    schema = "path array<string>, value string, txn long, seq int, is_delete boolean"
    source, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    for part in (rows, [(["a"], None, 2, 0, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        oplog.ingest(oplog.read(spark, source), store, mark).awaitTermination()
    assert store.get("a") is None and store.get("b") == "2"


def test_a_page_shows_the_tree(store):
    store.put_many({"a/b/c": "1 < 2", "a/b/d": b"\xff", "a/e": "x", "f": "y"})
    assert to_html(store.kv()) == "<ul><li>a<ul><li>b<ul><li>c: <code>1 &lt; 2</code></li><li>d: <code>0xff</code></li></ul></li><li>e: <code>x</code></li></ul></li><li>f: <code>y</code></li></ul>"
    assert to_html(store.kv(), 1).endswith("<p>more</p>") and to_html(store.kv(0)) == "<ul></ul>"
