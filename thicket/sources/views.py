"""Views of the driver's tables as triples, keys and values, an operation log and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shares

_READ: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read once a session, as a traversal's view names most tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READ or _READ[key].sparkSession is not spark:
        _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READ[key]


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _distinct(df: DataFrame, *columns: str) -> DataFrame:
    """In tasks whose number grows with the table."""
    return df.select(*columns).repartition(shares(df), *columns).distinct()


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s``, ``p``, ``o``. A filter on ``p`` leaves only the branches of that predicate in the plan."""
    t = lambda name: table(spark, sf_dir, name)
    item = t("lineitem")
    branches = [
        (t("customer"), _node("customer", "c_custkey"), "in_nation", _node("nation", "c_nationkey")),
        (t("supplier"), _node("supplier", "s_suppkey"), "in_nation", _node("nation", "s_nationkey")),
        (t("nation"), _node("nation", "n_nationkey"), "in_region", _node("region", "n_regionkey")),
        (t("orders"), _node("order", "o_orderkey"), "placed_by", _node("customer", "o_custkey")),
        (t("customer"), _node("customer", "c_custkey"), "segment", F.col("c_mktsegment")),
        (t("orders"), _node("order", "o_orderkey"), "status", F.col("o_orderstatus")),
        (t("orders"), _node("order", "o_orderkey"), "priority", F.col("o_orderpriority")),
        (_distinct(item, "l_orderkey", "l_partkey"), _node("order", "l_orderkey"), "contains", _node("part", "l_partkey")),
        (_distinct(item, "l_partkey", "l_suppkey"), _node("part", "l_partkey"), "supplied_by", _node("supplier", "l_suppkey")),
        (t("part"), _node("part", "p_partkey"), "brand", F.col("p_brand")),
        (t("part"), _node("part", "p_partkey"), "size", F.lpad(F.col("p_size").cast("string"), 3, "0")),
    ]
    return reduce(DataFrame.unionByName, [df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for df, s, p, o in branches])


#: The same triples for DuckDB.
TRIPLES_SQL = """triples AS (
  SELECT 'customer:' || c_custkey AS s, 'in_nation' AS p, 'nation:' || c_nationkey AS o FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey FROM nation
  UNION SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
  UNION SELECT 'customer:' || c_custkey, 'segment', c_mktsegment FROM customer
  UNION SELECT 'order:' || o_orderkey, 'status', o_orderstatus FROM orders
  UNION SELECT 'order:' || o_orderkey, 'priority', o_orderpriority FROM orders
  UNION SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
  UNION SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey FROM lineitem
  UNION SELECT 'part:' || p_partkey, 'brand', p_brand FROM part
  UNION SELECT 'part:' || p_partkey, 'size', lpad(p_size::VARCHAR, 3, '0') FROM part
)"""

ORDER_FIELDS = {"status": "o_orderstatus", "priority": "o_orderpriority", "custkey": "o_custkey"}


def order_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` = [orders, key, field], ``value``."""
    from ..operators.objects import flatten_rows

    orders = table(spark, sf_dir, "orders").select("o_orderkey", *(F.col(c).cast("string").alias(f) for f, c in ORDER_FIELDS.items()))
    return flatten_rows(orders, [F.lit("orders"), F.col("o_orderkey").cast("string")], list(ORDER_FIELDS))


KV_SQL = """kv AS (
  SELECT ['orders', o_orderkey::VARCHAR, 'status'] AS path, o_orderstatus AS value FROM orders
  UNION ALL SELECT ['orders', o_orderkey::VARCHAR, 'priority'], o_orderpriority FROM orders
  UNION ALL SELECT ['orders', o_orderkey::VARCHAR, 'custkey'], o_custkey::VARCHAR FROM orders
)"""


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation log: ``path`` = [users, user, event type]; an error deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.array(F.lit("users"), F.col("user_id").cast("string"), F.col("event_type")).alias("path"), F.col("props").alias("value"), F.col("event_id").alias("txn"), F.lit(0).alias("seq"), (F.col("event_type") == "error").alias("is_delete"))


OPS_SQL = """ops AS (
  SELECT ['users', user_id::VARCHAR, event_type] AS path, props AS value, event_id AS txn, event_type = 'error' AS is_delete FROM events
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


#: Types that the star schema has as entities.
ENTITY_SDL = """
type Region { name: String! nations: [Nation] }
type Nation { name: String! region: Region }
type Customer @plural(name: "Customers") { name: String! segment: String nation: Nation }
type Order { status: String priority: String custkey: Int customer: Customer }
enum Priority { LOW HIGH }
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kv`` of the types above: [Plural, id, field] or, in lists, [Plural, id, field, n]."""
    t = lambda name: table(spark, sf_dir, name)

    def leaves(df: DataFrame, plural: str, key: str, fields: dict[str, str]) -> list[DataFrame]:
        entries = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(c).cast("string").alias("v")) for f, c in fields.items()))).alias("e")
        rows = df.select(F.col(key).cast("string").alias("id"), entries)
        return [rows.select(F.array(F.lit(plural), F.col("id"), F.col("e.f")).alias("path"), F.col("e.v").alias("value"))]

    listed = t("nation").select(F.array(F.lit("Regions"), F.col("n_regionkey").cast("string"), F.lit("nations"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("path"), F.col("n_nationkey").cast("string").alias("value"))
    parts = [
        *leaves(t("region"), "Regions", "r_regionkey", {"name": "r_name"}),
        *leaves(t("nation"), "Nations", "n_nationkey", {"name": "n_name", "region": "n_regionkey"}),
        *leaves(t("customer"), "Customers", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}),
        *leaves(t("orders"), "Orders", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "custkey": "o_custkey", "customer": "o_custkey"}),
        listed,
    ]
    return reduce(DataFrame.unionByName, parts)
