import json

import pytest
from pyspark.sql import functions as F

from thicket.plans.graphql import GraphQL
from thicket.sources.store import Store

SDL = """
type Star { label: String! mag: Float planets: Int visible: Boolean code: ID near: [Star] host: Cluster colours: [String] class: Class }  # bodies
type Cluster @plural(name: "Clusters") { id: ID! title: String stars: [Star] heart: Star }
extend type Cluster { survey: String title: Int }
enum Class { DWARF GIANT }
type Query { brightest: Star }
schema { query: Query }
"""


@pytest.fixture
def layer(spark, tmp_path):
    return GraphQL(SDL, store=Store(spark, f"file://{tmp_path}/sky"))


def data(result):
    assert "errors" not in result, result
    return result["data"]


def test_create_read_update_delete(layer):
    made = data(layer.execute('mutation { createStar(label: "Vega", mag: 0.03, planets: 2, visible: true, code: "a0", class: DWARF) { label mag } }'))
    assert made == {"Star": {"id": "1", "label": "Vega", "mag": 0.03}}
    before = layer.store.last_txn
    assert data(layer.execute('mutation { second: createStar(label: "Mira", colours: ["red", "dim"]) { label } }')) == {"second": {"id": "2", "label": "Mira"}}
    assert layer.store.last_txn == before + 1  # the counter and all fields at once
    assert data(layer.execute("{ Star { label mag planets visible code class colours } }"))["Star"] == [
        {"id": "1", "label": "Vega", "mag": 0.03, "planets": 2, "visible": True, "code": "a0", "class": "DWARF", "colours": []},
        {"id": "2", "label": "Mira", "mag": None, "planets": None, "visible": None, "code": None, "class": None, "colours": ["red", "dim"]},
    ]
    data(layer.execute('mutation { createCluster(id: "c9", title: 3, heart: "1", stars: ["2", "1", "none"]) { id } updateStar(id: "2", host: "c9", mag: 2.0) { mag } }'))
    got = data(layer.execute('{ Clusters(id: "c9") { id title heart { label } stars { label __typename host { title heart { planets } } } } }'))["Clusters"]
    assert got == {"id": "c9", "title": "3", "heart": {"id": "1", "label": "Vega"}, "stars": [{"id": "2", "label": "Mira", "__typename": "Star", "host": {"id": "c9", "title": "3", "heart": {"id": "1", "planets": 2}}}, {"id": "1", "label": "Vega", "__typename": "Star", "host": None}]}
    assert data(layer.execute('{ brightest(id: "1") { label } }'))["brightest"] == {"id": "1", "label": "Vega"}
    assert data(layer.execute('mutation { deleteStar(id: "1") { id } }')) == {"Star": {"id": "1"}}
    assert [s["id"] for s in data(layer.execute("{ Stars { id } }"))["Stars"]] == ["2"] and len(data(layer.execute("{ Clusters { id } }"))["Clusters"]) == 1
    assert json.loads(layer.to_json('{ Stars(id: "1") { label } }'))["data"]["Stars"] == {"id": "1", "label": None}
    assert data(layer.submit("execute", "{ Stars { mag } }").result())["Stars"] == [{"id": "2", "mag": 2.0}]


@pytest.mark.parametrize(
    ("query", "message", "place"),
    [
        ("mutation { createStar(mag: 1.0) { id } }", "Missing required fields: label", (1, 12)),
        ("mutation { updateStar(mag: 1.0) { id } }", "Missing id", (1, 12)),
        ('mutation { createStar(label: "x", wings: 2) { id } }', "Unknown field 'wings' on type 'Star'", (1, 12)),
        ('mutation { paintStar(id: "1") { id } }', "Unknown mutation 'paintStar'", (1, 12)),
        ("{\n  Star {\n    nope\n  }\n}", "Unknown field 'nope' on type 'Star'", (3, 5)),
        ("{ Star { host } }", "Field 'host' needs a selection", (1, 10)),
        ("{ Star { mag { x } } }", "Field 'mag' has no fields", (1, 10)),
        ("{ Star { ...lost } }", "Unknown fragment 'lost'", (1, 10)),
        ("{ moons { x } }", "Unknown field 'moons'", (1, 3)),
        ("subscription { Star }", "Unexpected 'subscription'", (1, 1)),
        ("{ Star { label ", "Expected name at 15, got ''", (1, 16)),
        ("{ Star ? }", "Unexpected character '?' at 7", (1, 8)),
    ],
)
def test_errors_tell_where(layer, query, message, place):
    error = layer.execute(query)["errors"][0]
    assert error["message"] == message and error["locations"] == [{"line": place[0], "column": place[1]}]


def test_one_bad_field_leaves_the_others(layer):
    layer.execute('mutation { createStar(label: "Deneb") { id } }')
    got = layer.execute("{ Star { label } bad: Star { wings } again: Stars { id } }")
    assert got["data"] == {"Star": [{"id": "1", "label": "Deneb"}], "bad": None, "again": [{"id": "1"}]}
    assert [e["path"] for e in got["errors"]] == [["bad"]]


def test_fragments_directives_and_aliases(layer):
    layer.execute('mutation { createStar(id: "s", label: "Sirius", planets: "many", host: "c") { id } createCluster(id: "c", title: "Moving", heart: "s") { id } }')
    got = data(layer.execute('query Q { Star(id: "s") { ...f label @skip(if: true) name: label ... on Star { code @include(if: false) planets } } } fragment f on Star { label ...f }'))
    assert got["Star"] == {"id": "s", "label": "Sirius", "name": "Sirius", "planets": None}
    # A fragment used twice, once merged with further selections of the same field, is itself unchanged.
    got = data(layer.execute('{ wide: Star(id: "s") { ...g host { heart { label } } } plain: Star(id: "s") { ...g } } fragment g on Star { host { title } }'))
    assert got == {"wide": {"id": "s", "host": {"id": "c", "title": "Moving", "heart": {"id": "s", "label": "Sirius"}}}, "plain": {"id": "s", "host": {"id": "c", "title": "Moving"}}}


def test_a_root_field_without_a_type_reads_a_path(layer):
    layer.store.put("notes/first", "look up")
    assert data(layer.execute('{ hint: notes(path: "notes/first") }')) == {"hint": "look up"}
    layer.store.put("motd", "clear skies")
    assert data(layer.execute("{ motd }")) == {"motd": "clear skies"}
    assert layer.execute("{ absent }")["errors"][0]["message"] == "Unknown field 'absent'"
    assert layer.explain("{ motd Star { label } }") == ["GET motd", "SCAN Star"]


def test_introspection_custom_fields_and_plans(layer):
    layer.execute('mutation { createStar(id: "s", label: "Spica") { id } }')
    types = {t["name"]: t for t in data(layer.execute("{ __schema { types { name } } }"))["__schema"]["types"]}
    assert types["Class"]["enumValues"] == ["DWARF", "GIANT"] and {"name": "title", "type": "String"} in types["Cluster"]["fields"] and {"name": "survey", "type": "String"} in types["Cluster"]["fields"]
    assert data(layer.execute('{ __type(name: "Star") { name } }'))["__type"]["kind"] == "OBJECT"
    layer.register("Star", "call", lambda key, args: F.concat(F.lit(args["greeting"]), key))
    assert data(layer.execute('{ Star { call(greeting: "hi ") } }'))["Star"] == [{"id": "s", "call": "hi s"}]
    assert layer.plan_text('{ Star(id: "s") { title: label host { stars { mag } } call(greeting: "") } }').split("\n") == ["BATCH_GET Star id=s", "  RESOLVE_FIELD label -> String! as title", "  RESOLVE_REF host -> Cluster", "    RESOLVE_REF stars -> [Star]", "      RESOLVE_FIELD mag -> Float", "  CUSTOM call"]


def test_references_are_fetched_for_the_ids_asked(layer):
    layer.execute('mutation { createStar(id: "s", label: "Spica", host: "c") { id } createCluster(id: "c", title: "x") { id } }')
    plan = layer.frame('{ Star(id: "s") { host { title } } }')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_schema_is_kept(layer):
    layer.save()
    again = GraphQL.load(layer.store)
    shape = lambda g: {n: (t.kind, t.plural, {k: str(r) for k, r in t.fields.items()}, t.values) for n, t in g.types.items()}
    assert shape(again) == shape(layer) and again.roots == layer.roots
