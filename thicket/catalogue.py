"""The registered queries of the engine's own operators, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import METRICS
from .operators import objects, scans, triples, vectors, versions
from .plans.graphql import GraphQL
from .plans.traversal import Graph, Query
from .sources import views
from .stored import QUERIES as STORED
from .stored import VECTORS_SQL as _VECTORS_SQL
from .stored import label_centroids
from .stored import query_vector as _query_vector

Made = tuple[Callable[[SparkSession, str], DataFrame], str | None]
QUERIES: dict[str, Made] = dict(STORED)

# Traversals


def _graph(name: str, dsl: str | Query, sql: str, count: bool = False, prepare: Callable[[Graph], None] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = Graph(views.triples(spark, sf_dir))
        if prepare:
            prepare(g)
        return g.count(dsl) if count else g.query(dsl)

    QUERIES[name] = (run, f"WITH {views.TRIPLES_SQL} {sql}")


_STEP = "SELECT DISTINCT o AS v FROM triples WHERE p = '{p}' AND s IN ({q})"
_BACK = "SELECT DISTINCT s AS v FROM triples WHERE p = '{p}' AND o IN ({q})"
_HAS = "SELECT DISTINCT s AS v FROM triples WHERE p = '{p}' AND o {op} '{x}'"
_ORDERS_OF_NATION = _BACK.format(p="placed_by", q=_BACK.format(p="in_nation", q="'nation:7'"))
_CUSTOMERS = _BACK.format(p="in_nation", q="'nation:7'")

_graph("graph_out", 'g.V("order:1").Out("contains").All()', _STEP.format(p="contains", q="'order:1'"))
_graph("graph_in", 'g.V("nation:7").In("in_nation").All()', _CUSTOMERS)
_graph("graph_two_hop", 'g.V("nation:7").In("in_nation").In("placed_by").All()', _ORDERS_OF_NATION)
_graph("graph_three_hop", 'g.V("nation:7").In("in_nation").In("placed_by").Out("contains").All()', _STEP.format(p="contains", q=_ORDERS_OF_NATION))
_graph("graph_has_eq", 'g.Has("priority", "1-URGENT").All()', _HAS.format(p="priority", op="=", x="1-URGENT"))
for _name, _op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _graph(f"graph_has_{_name}", f'g.Has("size", {_op}, "010").All()', _HAS.format(p="size", op=_op, x="010"))
_graph("graph_has_after_out", 'g.V("nation:7").In("in_nation").In("placed_by").Has("status", "F")', f"SELECT v FROM ({_ORDERS_OF_NATION}) WHERE v IN ({_HAS.format(p='status', op='=', x='F')})")
_CHAIN = 'g.Has("size", >, "010").Has("size", <=, "030").Has("brand", >=, "Brand#2")'
_graph("graph_has_chain", _CHAIN, f"{_HAS.format(p='size', op='>', x='010')} INTERSECT {_HAS.format(p='size', op='<=', x='030')} INTERSECT {_HAS.format(p='brand', op='>=', x='Brand#2')}", prepare=lambda g: g.analyse(_CHAIN))
_graph("graph_and", 'g.V("nation:7").In("in_nation").In("placed_by").And(g.Has("status", "O"), g.Has("priority", "1-URGENT"))', f"{_ORDERS_OF_NATION} INTERSECT {_HAS.format(p='status', op='=', x='O')} INTERSECT {_HAS.format(p='priority', op='=', x='1-URGENT')}")
_graph("graph_or", 'g.V("nation:7").In("in_nation").Or(g.V("nation:3").In("in_nation"))', f"{_CUSTOMERS} UNION {_BACK.format(p='in_nation', q=repr('nation:3'))}")
_graph("graph_not", 'g.V("nation:7").In("in_nation").Not(g.Has("segment", "BUILDING"))', f"{_CUSTOMERS} EXCEPT {_HAS.format(p='segment', op='=', x='BUILDING')}")
_graph("graph_limit", 'g.V("nation:7").In("in_nation").In("placed_by").Limit(10)', f"SELECT v FROM ({_ORDERS_OF_NATION}) ORDER BY v LIMIT 10")
_graph("graph_count", 'g.V("nation:7").In("in_nation").In("placed_by").Count()', f"SELECT count(*) AS n FROM ({_ORDERS_OF_NATION})", count=True)
_graph("graph_morphism", 'g.V("nation:7").Follow("orders").Out("contains")', _STEP.format(p="contains", q=_ORDERS_OF_NATION), prepare=lambda g: g.define_morphism("orders", 'g.Morphism("orders").In("in_nation").In("placed_by")'))
_graph("graph_has_then_out", 'g.Has("segment", "BUILDING").Out("in_nation")', _STEP.format(p="in_nation", q=_HAS.format(p="segment", op="=", x="BUILDING")))
_graph("graph_has_then_in", 'g.Has("size", >=, "045").In("contains")', _BACK.format(p="contains", q=_HAS.format(p="size", op=">=", x="045")))
_graph("graph_builder", Query().V("nation:7").In("in_nation").HasGte("segment", "F"), f"SELECT v FROM ({_CUSTOMERS}) WHERE v IN ({_HAS.format(p='segment', op='>=', x='F')})")


def _plain(name: str, sql: str | None, ctes: str = ""):
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = (run, None if sql is None else (f"WITH {ctes} {sql}" if ctes else sql))
        return run

    return keep


@_plain("graph_osp_probe", "SELECT DISTINCT p AS v FROM triples WHERE o = 'nation:7' AND s IN (SELECT s FROM triples WHERE p = 'segment' AND o = 'BUILDING')", views.TRIPLES_SQL)
def _osp(spark, sf_dir):
    t = views.triples(spark, sf_dir)
    return triples.predicates_to(triples.having(t, "segment", "=", "BUILDING"), t, "nation:7")


@_plain("graph_pso_probe", "SELECT DISTINCT s AS v FROM triples WHERE p = 'supplied_by'", views.TRIPLES_SQL)
def _pso(spark, sf_dir):
    return triples.subjects_of(views.triples(spark, sf_dir), "supplied_by")


@_plain("graph_pred_stats", "SELECT p, count(*) AS triple_count, count(DISTINCT s) AS distinct_subjects FROM triples GROUP BY p", views.TRIPLES_SQL)
def _stats(spark, sf_dir):
    return triples.predicate_stats(views.triples(spark, sf_dir))


@_plain("graph_expand_triples", "SELECT 'spo' AS idx, s AS c1, p AS c2, o AS c3 FROM triples UNION ALL SELECT 'pos', p, o, s FROM triples UNION ALL SELECT 'osp', o, s, p FROM triples WHERE p <> 'segment' UNION ALL SELECT 'pso', p, s, o FROM triples WHERE p <> 'segment'", views.TRIPLES_SQL)
def _expand(spark, sf_dir):
    return Graph(views.triples(spark, sf_dir), "type Customer @index(spo, pos) { segment: String; }").expand()


@_plain("graph_insert_delete", "SELECT s, p, o FROM triples WHERE p = 'in_region' AND NOT (s = 'nation:0' AND o = 'region:0') UNION SELECT 'nation:99', 'in_region', 'region:1'", views.TRIPLES_SQL)
def _insert_delete(spark, sf_dir):
    g = Graph(views.triples(spark, sf_dir).where("p = 'in_region'"))
    return g.insert([("nation:99", "in_region", "region:1"), ("nation:1", "in_region", "region:1")]).delete([("nation:0", "in_region", "region:0")]).triples


# Paths and values

_KEY = "array_to_string(path, '/') AS key, value"


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("path", "/").alias("key"), "value")


@_plain("kv_get", f"SELECT {_KEY} FROM kv WHERE path = ['orders', '7', 'status']", views.KV_SQL)
def _get(spark, sf_dir):
    return _keyed(scans.get(views.order_kv(spark, sf_dir), ["orders", "7", "status"]))


@_plain("kv_get_many", "SELECT q.pos, kv.value FROM (VALUES (0, ['orders', '3', 'priority']), (1, ['orders', 'none', 'x']), (2, ['orders', '1', 'status'])) q(pos, path) LEFT JOIN kv ON kv.path = q.path", views.KV_SQL)
def _get_many(spark, sf_dir):
    return scans.get_many(views.order_kv(spark, sf_dir), [["orders", "3", "priority"], ["orders", "none", "x"], ["orders", "1", "status"]]).select("pos", "value")


@_plain("kv_count", "SELECT count(*) AS n FROM kv", views.KV_SQL)
def _count(spark, sf_dir):
    return views.order_kv(spark, sf_dir).agg(F.count("*").alias("n"))


_RANGE = "(CASE WHEN path >= ['orders', '1', 'priority'] THEN 1 ELSE 0 END) = 1 AND (CASE WHEN path < ['orders', '2'] THEN 1 ELSE 0 END) = 1"


@_plain("kv_range_scan", f"SELECT {_KEY} FROM kv WHERE {_RANGE}", views.KV_SQL)
def _range(spark, sf_dir):
    return _keyed(scans.scan(views.order_kv(spark, sf_dir), ["orders", "1", "priority"], ["orders", "2"]))


@_plain("kv_reverse_scan_limit", f"SELECT {_KEY} FROM kv WHERE {_RANGE} ORDER BY path DESC LIMIT 20", views.KV_SQL)
def _reverse(spark, sf_dir):
    return _keyed(scans.scan(views.order_kv(spark, sf_dir), ["orders", "1", "priority"], ["orders", "2"], reverse=True, limit=20))


@_plain("kv_full_scan", f"SELECT {_KEY} FROM kv", views.KV_SQL)
def _full(spark, sf_dir):
    return _keyed(scans.scan(views.order_kv(spark, sf_dir)))


@_plain("kv_prefix_scan", f"SELECT {_KEY} FROM kv WHERE path[1] = 'orders' AND path[2] = '12'", views.KV_SQL)
def _prefix(spark, sf_dir):
    return _keyed(scans.prefix_scan(views.order_kv(spark, sf_dir), ["orders", "12"]))


@_plain("kv_read_stream", "SELECT array_to_string(path, '/') AS key FROM kv ORDER BY path", views.KV_SQL)
def _stream(spark, sf_dir):
    return scans.read_stream(views.order_kv(spark, sf_dir), values=False)


@_plain("kv_subtree_scan", "SELECT path[3] AS key, value FROM kv WHERE path[1] = 'orders' AND path[2] = '5'", views.KV_SQL)
def _subtree(spark, sf_dir):
    return _keyed(scans.scan(scans.subtree(views.order_kv(spark, sf_dir), ["orders", "5"])))


@_plain("kv_subtree_count", "SELECT count(*) AS n FROM kv WHERE path[1] = 'orders'", views.KV_SQL)
def _subtree_count(spark, sf_dir):
    return scans.subtree(views.order_kv(spark, sf_dir), ["orders"]).agg(F.count("*").alias("n"))


@_plain("kv_delete_prefix", f"SELECT {_KEY} FROM kv WHERE NOT (path[1] = 'orders' AND path[2] = '1')", views.KV_SQL)
def _delete_prefix(spark, sf_dir):
    kv = views.order_kv(spark, sf_dir)
    ops = kv.select("path", "value", F.lit(1).alias("txn"), F.lit(0).alias("seq"), F.lit(False).alias("is_delete"))
    gone = scans.prefix_scan(kv, ["orders", "1"]).select("path", F.lit(None).cast("string").alias("value"), F.lit(2).alias("txn"), F.lit(0).alias("seq"), F.lit(True).alias("is_delete"))
    return _keyed(versions.snapshot(ops.unionByName(gone)))


_LATEST = "SELECT {key} FROM (SELECT path, arg_max(value, txn) AS value, arg_max(is_delete, txn) AS gone FROM ops {where} GROUP BY path) WHERE NOT gone"


@_plain("kv_snapshot_latest", _LATEST.format(key=_KEY, where=""), views.OPS_SQL)
def _latest(spark, sf_dir):
    return _keyed(versions.snapshot(views.event_ops(spark, sf_dir)))


@_plain("kv_snapshot_asof", _LATEST.format(key=_KEY, where="WHERE txn <= 500"), views.OPS_SQL)
def _asof(spark, sf_dir):
    return _keyed(versions.snapshot(views.event_ops(spark, sf_dir), 500))


@_plain("kv_batch_last_wins", _LATEST.format(key=_KEY, where="").replace(", txn)", ", (txn // 100) * 1000 + txn % 100)"), views.OPS_SQL)
def _batches(spark, sf_dir):
    ops = views.event_ops(spark, sf_dir)
    return _keyed(versions.snapshot(ops.withColumn("seq", (F.col("txn") % 100).cast("int")).withColumn("txn", F.floor(F.col("txn") / 100))))


@_plain("kv_version_gc", f"SELECT {_KEY}, txn FROM (SELECT *, row_number() OVER (PARTITION BY path, txn <= 700 ORDER BY txn DESC) AS r FROM ops) WHERE txn > 700 OR (r = 1 AND NOT is_delete)", views.OPS_SQL)
def _gc(spark, sf_dir):
    kept = versions.collect_versions(views.event_ops(spark, sf_dir), 700)
    return kept.select(F.array_join("path", "/").alias("key"), "value", "txn")


@_plain("kv_increment", "SELECT 'users/' || user_id || '/count' AS key, (count(*) + CASE WHEN user_id % 2 = 0 THEN 10 ELSE 0 END)::VARCHAR AS value FROM events GROUP BY user_id")
def _increment(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    path = F.array(F.lit("users"), F.col("user_id").cast("string"), F.lit("count")).alias("path")
    start = e.select("user_id").distinct().select(path, F.when(F.col("user_id") % 2 == 0, "10").otherwise("none").alias("value"))
    return _keyed(versions.increments(e.select(path, F.lit(1).alias("delta")), start))


@_plain("obj_flatten", f"SELECT {_KEY} FROM kv", views.KV_SQL)
def _flatten(spark, sf_dir):
    return _keyed(views.order_kv(spark, sf_dir))


@_plain("obj_reconstruct", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey::VARCHAR AS custkey FROM orders")
def _reconstruct(spark, sf_dir):
    rows = objects.reconstruct_rows(views.order_kv(spark, sf_dir), 2, list(views.ORDER_FIELDS))
    return rows.select(F.element_at("key", 2).alias("id"), *views.ORDER_FIELDS)


# GraphQL


def _gql(name: str, query: str, sql: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, prepare: Callable[[GraphQL], None] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = GraphQL(views.ENTITY_SDL, views.entities(spark, sf_dir))
        if prepare:
            prepare(g)
        return shape(g.frame(query))

    QUERIES[name] = (run, sql)


_gql("gql_scan", "{ Customer { name segment } }", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
_gql("gql_batch_get", '{ Orders(id: "3", id: "none", id: "1") { status priority } }', "SELECT q.pos, q.id, o_orderstatus AS status, o_orderpriority AS priority FROM (VALUES (0, '3'), (1, 'none'), (2, '1')) q(pos, id) LEFT JOIN orders ON o_orderkey::VARCHAR = q.id")
_gql("gql_scalar_types", "{ Order { custkey status } }", "SELECT o_orderkey::VARCHAR AS id, o_custkey AS custkey, o_orderstatus AS status FROM orders")
_gql("gql_ref", "{ Nation { name region { name } } }", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", lambda df: df.select("id", "name", F.col("region.name").alias("region")))
_gql("gql_ref_chain", "{ Order { customer { name nation { region { name } } } } }", "SELECT o_orderkey::VARCHAR AS id, c_name AS customer, r_name AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey", lambda df: df.select("id", F.col("customer.name").alias("customer"), F.col("customer.nation.region.name").alias("region")))
_gql("gql_list_ref", "{ Region { name nations { name } } }", "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name", lambda df: df.select("name", F.array_join(F.transform("nations", lambda n: n["name"]), ",").alias("nations")))
_gql("gql_alias_typename", "{ Nation { kind: __typename label: name } }", "SELECT n_nationkey::VARCHAR AS id, 'Nation' AS kind, n_name AS label FROM nation")
_gql("gql_skip_include", "{ Customer { name @skip(if: true) segment @include(if: true) nation @include(if: false) { name } } }", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS segment FROM customer")
_gql("gql_fragment", "query { Nation { ...named ... on Nation { region { ...named } } } } fragment named on Nation { name }", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", lambda df: df.select("id", "name", F.col("region.name").alias("region")))
_gql("gql_custom_resolver", '{ Region { name shout(mark: "!") } }', "SELECT r_regionkey::VARCHAR AS id, r_name AS name, 'region ' || r_regionkey || '!' AS shout FROM region", prepare=lambda g: g.register("Region", "shout", lambda key, args: F.concat(F.lit("region "), key, F.lit(args["mark"]))))


@_plain("gql_introspect", "SELECT * FROM (VALUES ('Region', 'OBJECT', 'name', 'String!'), ('Region', 'OBJECT', 'nations', '[Nation]'), ('Nation', 'OBJECT', 'name', 'String!'), ('Nation', 'OBJECT', 'region', 'Region'), ('Customer', 'OBJECT', 'name', 'String!'), ('Customer', 'OBJECT', 'segment', 'String'), ('Customer', 'OBJECT', 'nation', 'Nation'), ('Order', 'OBJECT', 'status', 'String'), ('Order', 'OBJECT', 'priority', 'String'), ('Order', 'OBJECT', 'custkey', 'Int'), ('Order', 'OBJECT', 'customer', 'Customer'), ('Priority', 'ENUM', 'LOW', ''), ('Priority', 'ENUM', 'HIGH', '')) t(type_name, kind, field, field_type)")
def _introspect(spark, sf_dir):
    return GraphQL(views.ENTITY_SDL, views.entities(spark, sf_dir)).introspect_frame(spark)


_gql("gql_fragment_shared", "{ b: Nation { ...named region { label: name } } a: Region { name } } fragment named on Nation { name region { name } }", "SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS region, r_name AS label FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", lambda df: df.select("id", "name", F.col("region.name").alias("region"), F.col("region.label").alias("label")))

# Vectors

_DISTANCE_SQL = {"l2": "list_distance(a.e, b.e)", "cosine": "list_cosine_distance(a.e, b.e)", "dot": "list_negative_inner_product(a.e, b.e)"}


def _asked(v: DataFrame) -> DataFrame:
    """The queries of the searches of many: every row with ``id % 20 = 0``."""
    return v.where("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "embedding")


for _metric in METRICS:

    @_plain(f"vec_flat_{_metric}", f"SELECT b.id, round({_DISTANCE_SQL[_metric]}, 4) AS distance FROM v a JOIN v b ON a.id = 0 ORDER BY {_DISTANCE_SQL[_metric]}, b.id LIMIT 10", _VECTORS_SQL)
    def _flat(spark, sf_dir, metric=_metric):
        v = views.vectors(spark, sf_dir)
        return vectors.flat_search(v, _query_vector(v), 10, metric).select("id", F.round("distance", 4).alias("distance"))


@_plain("vec_batch_l2", "SELECT query_id, id, rank, round(d, 4) AS distance FROM (SELECT a.id::VARCHAR AS query_id, b.id, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id)::INT AS rank FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id) WHERE rank <= 5", _VECTORS_SQL)
def _batch(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vectors.batch_neighbours(v, _asked(v), 5).select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("distance", 4).alias("distance"))


@_plain("vec_ivf_assign", "SELECT id, arg_min(cid, (d, cid)) AS cid FROM (SELECT v.id, c.cid, list_distance(v.e, c.e) AS d FROM v, centroids c) GROUP BY id", _VECTORS_SQL)
def _assign(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vectors.assign(v, label_centroids(v)).select("id", F.col("cid").cast("int").alias("cid"))


@_plain("vec_ivf_search", "SELECT b.id, round(list_distance(a.e, b.e), 4) AS distance FROM v a JOIN v b ON a.id = 0 WHERE (SELECT arg_min(cid, (list_distance(b.e, c.e), cid)) FROM centroids c) IN (SELECT c.cid FROM centroids c, v q WHERE q.id = 0 ORDER BY list_distance(q.e, c.e), c.cid LIMIT 3) ORDER BY list_distance(a.e, b.e), b.id LIMIT 10", _VECTORS_SQL)
def _ivf(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    c = label_centroids(v)
    return vectors.ivf_search(vectors.assign(v, c), c, _query_vector(v), 10, 3).select("id", F.round("distance", 4).alias("distance"))


#: Projections that SQL can state: component i of projection t.
def projections(tables: int = 4, dim: int = 64) -> list[list[float]]:
    return [[((i * 7 + t * 13) % 11 + 1) / 11.0 for i in range(dim)] for t in range(tables)]


_SLSH_SQL = _VECTORS_SQL + ", k AS (SELECT id, e, [floor(list_inner_product(e, [(((i * 7 + t * 13) % 11 + 1) / 11.0)::DOUBLE for i in range(64)]) / 0.25)::INT for t in range(4)] AS lsh FROM v)"


@_plain("vec_slsh_key", "SELECT id, array_to_string(lsh, ',') AS lsh FROM k", _SLSH_SQL)
def _slsh_key(spark, sf_dir):
    return vectors.slsh_key(views.vectors(spark, sf_dir), projections(), 0.25).select("id", F.array_join(F.col("lsh").cast("array<string>"), ",").alias("lsh"))


@_plain("vec_slsh_search", "SELECT b.id, round(list_distance(a.e, b.e), 4) AS distance FROM k a JOIN (SELECT * FROM (SELECT k.* FROM k, (SELECT lsh AS q FROM k WHERE id = 0) WHERE (CASE WHEN lsh >= q THEN 1 ELSE 0 END) = 1 ORDER BY lsh, id LIMIT (SELECT greatest(200, count(*) // 30) FROM v)) UNION ALL SELECT * FROM (SELECT k.* FROM k, (SELECT lsh AS q FROM k WHERE id = 0) WHERE (CASE WHEN lsh < q THEN 1 ELSE 0 END) = 1 ORDER BY lsh DESC, id DESC LIMIT (SELECT greatest(200, count(*) // 30) FROM v))) b ON a.id = 0 ORDER BY list_distance(a.e, b.e), b.id LIMIT 10", _SLSH_SQL)
def _slsh(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vectors.slsh_search(vectors.slsh_key(v, projections(), 0.25), projections(), 0.25, _query_vector(v), 10, vectors.scan_radius(v.count())).select("id", F.round("distance", 4).alias("distance"))


@_plain("vec_ivf_train_recall", None)
def _recall(spark, sf_dir):
    """Recall of trained clusters with the settings of an index against the exact search, a row a query."""
    v, form, run = views.vectors(spark, sf_dir).select("id", "embedding"), vectors.Format(64, "ivf"), vectors.Runtime()
    centroids, asked = vectors.train_centroids(v, form.clusters), _asked(v)
    exact = vectors.batch_neighbours(v, asked, run.top_k).select("query_id", "id")
    probing = asked.withColumn("cids", vectors.probes_column(centroids, run.nprobe))
    found = vectors.batch_neighbours(vectors.assign(v, centroids), probing, run.top_k).select("query_id", "id", F.lit(1).alias("hit"))
    recall = (F.count("hit") / F.count("*")).alias("recall")
    return exact.join(found, ["query_id", "id"], "left").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(recall)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
