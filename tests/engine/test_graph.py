"""Traversals of a random graph, held against sets."""

import operator

import numpy as np
import pytest

from thicket.operators import triples as T
from thicket.plans.traversal import Graph, IndexSchema, Query, Stats, TraversalError, optimise, parse
from thicket.sources.store import Store

COMPARE = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def edges():
    rng = np.random.default_rng(31)
    found = {(f"n{rng.integers(25)}", str(rng.choice(["rail", "ferry", "re-route"])), f"n{rng.integers(25)}") for _ in range(160)}
    found |= {(f"n{i}", "height", f"{rng.integers(100):03d}") for i in range(25)}
    return sorted(found | {(f"n{i}", "zone", "NSEW"[rng.integers(4)]) for i in range(20)})


EDGES = edges()


def out(of, p):
    return {o for s, q, o in EDGES if q == p and s in of}


def into(of, p):
    return {s for s, q, o in EDGES if q == p and o in of}


def has(p, op, x):
    return {s for s, q, o in EDGES if q == p and COMPARE[op](o, x)}


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(EDGES, T.SCHEMA))


def found(graph, query):
    rows = [r.v for r in graph.query(query).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


CASES = [
    ('g.V("n3").Out("rail").All()', lambda: out({"n3"}, "rail")),
    ('g.V("n4").In("ferry")', lambda: into({"n4"}, "ferry")),
    ('g.V("n3").Out("rail").Out("ferry").In("rail")', lambda: into(out(out({"n3"}, "rail"), "ferry"), "rail")),
    ('g.V("n5").Out("re-route")', lambda: out({"n5"}, "re-route")),
    ('g.Has("zone", "N")', lambda: has("zone", "=", "N")),
    *((f'g.Has("height", {op}, "050")', lambda op=op: has("height", op, "050")) for op in (">", ">=", "<", "<=")),
    ('g.Has("height", >, "020").Has("height", <=, "080").Has("zone", "S")', lambda: has("height", ">", "020") & has("height", "<=", "080") & has("zone", "=", "S")),
    ('g.Has("zone", "E").Out("rail")', lambda: out(has("zone", "=", "E"), "rail")),
    ('g.Has("zone", "W").In("ferry")', lambda: into(has("zone", "=", "W"), "ferry")),
    ('g.V("n3").Out("rail").Has("height", >=, "040")', lambda: out({"n3"}, "rail") & has("height", ">=", "040")),
    ('g.Has("zone", "N").And(g.Has("height", >, "030"), g.V("n3").Out("rail"))', lambda: has("zone", "=", "N") & has("height", ">", "030") & out({"n3"}, "rail")),
    ('g.V("n1").Out("rail").Or(g.Has("zone", "W"))', lambda: out({"n1"}, "rail") | has("zone", "=", "W")),
    ('g.Has("height", <, "070").Not(g.Has("zone", "N"), g.Has("zone", "S"))', lambda: has("height", "<", "070") - has("zone", "=", "N") - has("zone", "=", "S")),
    ('g.Difference(g.Has("zone", "E"), g.V("n3").Out("rail"))', lambda: has("zone", "=", "E") - out({"n3"}, "rail")),
    ('g.Not(g.Has("zone", "E"))', set),
    ('g.And(g.Has("zone", "E"))', lambda: has("zone", "=", "E")),
    ('g.V("nowhere").Out("rail").And(g.Has("zone", "E"))', set),
    ('g.V("nowhere").Has("zone", "E")', set),
    ('g.Has("zone", "N").Limit(2)', lambda: set(sorted(has("zone", "=", "N"))[:2])),
]


@pytest.mark.parametrize(("query", "want"), CASES, ids=[q for q, _ in CASES])
def test_traversals_match_sets(graph, query, want):
    assert found(graph, query) == want()


def test_statistics_change_no_result(graph):
    planned = Graph(graph.triples, stats=Stats.of(graph.triples))
    for query, want in CASES:
        assert found(planned, query) == want()
        named = Graph(graph.triples).analyse(query).stats.counts
        assert all(planned.stats.counts[p] == n for p, n in named.items())
        assert planned.estimates(query) >= 1


def test_count_builder_and_morphisms(graph):
    assert graph.count('g.Has("zone", "N").Count()').first().n == len(has("zone", "=", "N"))
    graph.define_morphism("trip", 'g.Morphism("trip").Out("rail").Out("ferry")')
    graph.define_morphism("trip", 'g.Morphism("trip").Out("zone")')  # the first one stands
    want = out(out({"n3"}, "rail"), "ferry")
    assert found(graph, 'g.V("n3").Follow("trip")') == want == found(graph, Query().V("n3").Follow("trip"))
    assert found(graph, Query().HasGt("height", "020").Not(Query().HasGte("height", "060"))) == has("height", ">", "020") - has("height", ">=", "060")
    assert graph.submit("count", 'g.Has("zone", "N")').result().first().n == len(has("zone", "=", "N"))


def test_estimates_follow_the_counts():
    stats = Stats({"p": (40, 10), "q": (9, 2), "one": (3, 3)})
    assert (stats.has("p", "="), stats.has("q", "="), stats.has("q", ">"), stats.has("one", ">"), stats.has("unknown", "=")) == (4, 5, 1, 1, 10)
    assert (stats.hop("p", 3), stats.hop("unknown", 3)) == (12, 15)
    assert stats.chain(parse('g.V("a").Out("p").In("q")')) == 20
    assert [s.args[0] for s in optimise(parse('g.Has("q", "x").Has("one", "y").Has("p", "z")'), stats)] == ["one", "p", "q"]
    assert [s.kind for s in optimise(parse('g.V("a").And(g.Has("p", "x").Has("q", "y"))'))] == ["vertex", "has", "has"]


@pytest.mark.parametrize(
    ("query", "message"),
    [('g.Has("zone', "Unterminated string literal"), ('g.Fly("n1")', "Unknown method 'Fly'"), ('g.V("n1")In("rail")', "Unexpected input"), ("", "Empty query"), ('g.V("n1").Follow("lost")', "Unknown morphism 'lost'"), ('g.In("rail").V("n1")', "V must come first")],
)
def test_errors(query, message):
    with pytest.raises(TraversalError, match=message):
        parse(query)


SCHEMA = """
type Stop @index(pos, pso) { rail: [Stop]; zone: Zone @index(pos); height: Int!; }  # a comment
type Zone { label: String }
"""


def test_schema_picks_indexes(spark):
    schema = IndexSchema(SCHEMA)
    assert schema.indexes == {"rail": ("pos", "pso"), "zone": ("pos",), "height": ("pos", "pso"), "label": ("spo", "pos")}
    assert schema.needs("unheard", "osp") and not schema.needs("zone", "spo")
    for broken in ("type Stop @index(abc) { rail: Stop; }", "type Stop { rail: Stop;", "type Stop { rail: Stop; } and more", "type Stop { rail Stop }", "stops"):
        with pytest.raises(TraversalError):
            IndexSchema(broken)
    g = Graph(spark.createDataFrame([("a", "zone", "N"), ("a", "ferry", "b")], T.SCHEMA), SCHEMA)
    assert sorted(map(tuple, g.expand().collect())) == [("osp", "b", "a", "ferry"), ("pos", "ferry", "b", "a"), ("pos", "zone", "N", "a"), ("pso", "ferry", "a", "b"), ("spo", "a", "ferry", "b")]


def test_insert_and_delete_are_sets(spark):
    g = Graph(spark.createDataFrame(EDGES, T.SCHEMA))
    g.insert([EDGES[0], ("new", "rail", "n1"), ("new", "rail", "n1")]).delete([EDGES[1], ("not", "rail", "there")])
    rows = [tuple(r) for r in g.triples.collect()]
    assert sorted(rows) == sorted({*EDGES, ("new", "rail", "n1")} - {EDGES[1]})


def test_save_and_load(spark, graph, tmp_path):
    Graph(graph.triples, SCHEMA).save(f"{tmp_path}/g")
    again = Graph.load(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, again.triples.collect())) == EDGES and again.schema.indexes == IndexSchema(SCHEMA).indexes
    assert again.stats.counts == Stats.of(graph.triples).counts


def test_a_graph_is_a_layer_of_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    g = Graph.open(store.subtree("routes"), SCHEMA)
    before = store.last_txn
    g.write(insert=[("a", "zone", "N"), ("a", "ferry", "b"), ("b", "rail", "a")])
    assert store.last_txn == before + 1  # all index keys of all triples at once
    assert found(g, 'g.V("a").In("rail")') == {"b"} and found(g, 'g.Has("zone", "N")') == {"a"}
    assert store.get("routes/pos/zone/N/a") == "" and store.get("routes/spo/a/zone/N") is None
    g.write(insert=[("c", "zone", "N")], delete=[("a", "zone", "N")])
    again = Graph.open(store.subtree("routes"))
    assert sorted(map(tuple, again.triples.collect())) == [("a", "ferry", "b"), ("b", "rail", "a"), ("c", "zone", "N")]
    assert again.schema.indexes == g.schema.indexes
    with pytest.raises(PermissionError):
        store.subtree("routes").claim("vector")
