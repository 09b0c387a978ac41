"""Registered queries of what is written first: stores, layers of a store, mutations and saved vector indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import vectors
from .plans.graphql import GraphQL
from .plans.traversal import Graph, parse
from .session import scratch_folder
from .sources import views
from .sources.store import Store

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
_KEY = "array_to_string(path, '/') AS key, value"


def _query(sql: str, ctes: str = ""):
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = (run, f"WITH {ctes} {sql}" if ctes else sql)
        return run

    return keep


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("path", "/").alias("key"), "value")


def _orders(spark: SparkSession, sf_dir: str) -> Store:
    """All orders' fields in a store."""
    store = Store(spark, scratch_folder(spark, "store"))
    store.put_rows(views.order_kv(spark, sf_dir))
    return store


# Paths and values


@_query(f"SELECT {_KEY} FROM kv WHERE path NOT IN (['orders', '1', 'status'], ['orders', '2', 'status']) UNION ALL SELECT 'orders/1/status', 'changed' UNION ALL SELECT 'orders/new/status', 'made'", views.KV_SQL)
def kv_put_delete_stored(spark, sf_dir):
    store = _orders(spark, sf_dir)
    store.put("orders/1/status", "changed")
    store.delete("orders/2/status")
    store.batch([{"type": "put", "key": "orders/new/status", "value": "made"}, {"type": "del", "key": "never/there"}])
    return _keyed(store.scan())


@_query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 2 = 0 THEN md5(c_name) ELSE md5('other') END AS hex FROM customer")
def kv_put_get_binary(spark, sf_dir):
    """Sixteen bytes a key, most of them no text; the odd keys are written twice."""
    c = views.table(spark, sf_dir, "customer")
    store = Store(spark, scratch_folder(spark, "store"))
    path = F.array(F.lit("sums"), F.col("c_custkey").cast("string")).alias("path")
    store.put_rows(c.select(path, F.unhex(F.md5(F.col("c_name").cast("binary"))).alias("value")))
    store.put_rows(c.where("c_custkey % 2 = 1").select(path, F.unhex(F.md5(F.lit("other").cast("binary"))).alias("value")))
    return store.prefix_scan("sums").select(F.get("path", F.lit(1)).alias("key"), F.lower(F.hex("data")).alias("hex"))


@_query(f"SELECT {_KEY} FROM kv WHERE (CASE WHEN path >= ['orders', '1', 'priority'] THEN 1 ELSE 0 END) = 1 AND (CASE WHEN path < ['orders', '2'] THEN 1 ELSE 0 END) = 1", views.KV_SQL)
def kv_range_stored(spark, sf_dir):
    store = _orders(spark, sf_dir)
    store.vacuum()  # in key order, so that the range's bounds skip row groups
    return _keyed(store.scan("orders/1/priority", "orders/2"))


@_query("SELECT array_to_string(path, '/') AS key, CASE WHEN path[3] = 'custkey' THEN value || '!' ELSE value END AS value FROM kv WHERE path[2] <> '1'", views.KV_SQL)
def kv_vacuum(spark, sf_dir):
    """The log itself after a vacuum: neither stale versions nor deletions are left."""
    store, kv = _orders(spark, sf_dir), views.order_kv(spark, sf_dir)
    store.put_rows(kv.where(F.get("path", F.lit(2)) == "custkey").select("path", F.concat("value", F.lit("!")).alias("value")))
    store.delete_prefix("orders/1")
    store.vacuum()
    return _keyed(store.ops())


@_query(f"SELECT {_KEY} FROM kv WHERE path[2] <> '3'", views.KV_SQL)
def kv_export_import(spark, sf_dir):
    store, folder = _orders(spark, sf_dir), scratch_folder(spark, "export")
    store.delete_prefix("orders/3")
    store.snapshot(folder)
    other = Store(spark, scratch_folder(spark, "store"))
    other.import_snapshot(folder)
    return _keyed(other.kv())


# Traversals


@_query(
    "SELECT p, greatest(1, ceil(n / d))::BIGINT AS equal, greatest(1, d // 2)::BIGINT AS range, (100 * greatest(1, ceil(n / d)))::BIGINT AS hop_of_100, least(greatest(1, ceil(n / d)), greatest(1, d // 2))::BIGINT AS chain FROM (SELECT p, count(*) AS n, count(DISTINCT s) AS d FROM triples GROUP BY p)",
    views.TRIPLES_SQL,
)
def graph_estimates(spark, sf_dir):
    stats = Graph(views.triples(spark, sf_dir)).analyse().stats
    rows = [(p, stats.has(p, "="), stats.has(p, ">"), stats.hop(p, 100), stats.chain(parse(f'g.V("x").Out("{p}").Has("{p}", >, "a")'))) for p in stats.counts]
    return spark.createDataFrame(rows, "p string, equal long, range long, hop_of_100 long, chain long")


@_query("SELECT s, p, o FROM triples WHERE p = 'in_region' AND o <> 'region:0' UNION SELECT 'nation:99', 'in_region', 'region:1'", views.TRIPLES_SQL)
def graph_layer_of_store(spark, sf_dir):
    g = Graph.open(Store(spark, scratch_folder(spark, "graph")).subtree("map"), "type Nation { in_region: Region @index(pos, osp); }")
    rows = [tuple(r) for r in views.triples(spark, sf_dir).where("p = 'in_region'").collect()]  # a fixed table of 25 nations
    return g.write(insert=rows).write(insert=[("nation:99", "in_region", "region:1")], delete=[r for r in rows if r[2] == "region:0"]).triples


# GraphQL


@_query("SELECT r_regionkey::VARCHAR AS id, CASE WHEN r_regionkey = 0 THEN 'renamed' ELSE r_name END AS name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT '1000', 'made' UNION ALL SELECT '1001', 'with, commas'")
def gql_mutations(spark, sf_dir):
    store = Store(spark, scratch_folder(spark, "entities"))
    store.put_rows(views.entities(spark, sf_dir))
    store.put("Regions/__meta/next_id", 1000)
    g = GraphQL(views.ENTITY_SDL, store=store)
    for query in ('createRegion(id: "1000", name: "made") { name }', 'createRegion(name: "with, commas") { name }', 'updateRegion(id: "0", name: "renamed") { name }', 'deleteRegion(id: "4") { id }'):
        got = g.execute(f"mutation {{ {query} }}")
        if "errors" in got:
            raise ValueError(str(got["errors"]))
    return g.frame("{ Regions { name } }")


@_query("SELECT * FROM (VALUES ('name', 'String!'), ('region', 'Region')) t(name, type)")
def gql_type(spark, sf_dir):
    got = GraphQL(views.ENTITY_SDL, views.entities(spark, sf_dir)).execute('{ __type(name: "Nation") { name } }')
    return spark.createDataFrame([(f["name"], f["type"]) for f in got["data"]["__type"]["fields"]], "name string, type string")


@_query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, NULL::VARCHAR AS message, NULL::INT AS line FROM nation UNION ALL SELECT NULL, NULL, 'Unknown field ''area'' on type ''Region''', 2")
def gql_partial_errors(spark, sf_dir):
    got = GraphQL(views.ENTITY_SDL, views.entities(spark, sf_dir)).execute("{ Nation { name }\n  bad: Region { area } }")
    rows = [(r["id"], r["name"], None, None) for r in got["data"]["Nation"]] + [(None, None, e["message"], e["locations"][0]["line"]) for e in got["errors"]]
    return spark.createDataFrame(rows, "id string, name string, message string, line int")


@_query("SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS value FROM orders WHERE o_orderkey = 7")
def gql_get(spark, sf_dir):
    g = GraphQL(views.ENTITY_SDL, views.entities(spark, sf_dir))
    return g.stored_at("Orders/7/status").select(F.lit("7").alias("key"), "value")


# Vectors

VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), means AS (SELECT label AS cid, i, avg(e[i]) AS m FROM v, range(1, 65) r(i) GROUP BY label, i), centroids AS (SELECT cid, list(m ORDER BY i) AS e FROM means GROUP BY cid)"


def label_centroids(v: DataFrame) -> list[tuple[int, list[float]]]:
    """Means of the labels: fixed centroids that SQL can state."""
    dims = len(v.first().embedding)
    means = v.groupBy("label").agg(*(F.avg(F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(dims))).collect()
    return sorted((r.label, list(r[1:])) for r in means)


def query_vector(v: DataFrame, key: int = 0) -> list[float]:
    return v.where(F.col("id") == key).first().embedding


def _index(spark: SparkSession, sf_dir: str, fmt: vectors.Format) -> vectors.VectorIndex:
    v = views.vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "embedding", F.lit(None).cast("binary").alias("metadata"))
    return vectors.VectorIndex(spark, fmt).insert_frame(v)


@_query("SELECT b.id::VARCHAR AS id, round(list_distance(a.e, b.e), 4) AS distance FROM v a JOIN v b ON a.id = 0 WHERE b.id NOT IN (0, 1, 2, 3) ORDER BY list_distance(a.e, b.e), b.id::VARCHAR LIMIT 10", VECTORS_SQL)
def vec_insert_delete(spark, sf_dir):
    index = _index(spark, sf_dir, vectors.Format(64)).delete(["0", "1", "2", "3"])
    return index.search(query_vector(views.vectors(spark, sf_dir)), 10).select("id", F.round("distance", 4).alias("distance"))


@_query("SELECT b.id::VARCHAR AS id, round(list_cosine_distance(a.e, b.e), 4) AS distance FROM v a JOIN v b ON a.id = 0 ORDER BY list_cosine_distance(a.e, b.e), b.id::VARCHAR LIMIT 10", VECTORS_SQL)
def vec_migrate(spark, sf_dir):
    index = _index(spark, sf_dir, vectors.Format(64, "slsh")).migrate(index="flat", metric="cosine")
    return index.search(query_vector(views.vectors(spark, sf_dir)), 10).select("id", F.round("distance", 4).alias("distance"))


@_query("SELECT id::VARCHAR AS id, arg_min(cid, (d, cid)) AS cid FROM (SELECT v.id, c.cid, list_distance(v.e, c.e) AS d FROM v, centroids c) GROUP BY id", VECTORS_SQL)
def vec_ivf_stored(spark, sf_dir):
    """The clusters that are stored with the vectors and read back: no search assigns them anew."""
    index = _index(spark, sf_dir, vectors.Format(64, "ivf"))
    index.centroids = label_centroids(views.vectors(spark, sf_dir))
    folder = scratch_folder(spark, "vectors")
    index.rebuild().save(folder)
    return vectors.VectorIndex.load(spark, folder).vectors.select("id", F.col("cid").cast("int").alias("cid"))
