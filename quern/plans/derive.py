"""Graphs derived from the star schema, by SQL that Spark and other engines read alike."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from quern.plans.graph import Graph

NODES = """SELECT p_partkey AS def_id, p_type || '.' || p_brand || '.P' || CAST(p_partkey AS VARCHAR(20)) AS name, p_type || '.' || p_brand AS module,
  CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'LARGE' THEN 'datatype' WHEN 'SMALL' THEN 'constructor' WHEN 'ECONOMY' THEN 'postulate' WHEN 'PROMO' THEN 'projection' ELSE 'record' END AS kind,
  CASE p_size % 10 WHEN 0 THEN 'H' WHEN 1 THEN 'P' ELSE 'D' END AS state,
  CASE p_size % 4 WHEN 0 THEN 'private' ELSE 'public' END AS access, p_size AS line, p_name AS sig, p_size % 7 = 0 AS is_unsafe, p_size % 11 = 0 AS is_unsolved
FROM part"""
_HELD = "SELECT l_orderkey, l_partkey, p_brand, min(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_brand"
_EDGES = """SELECT DISTINCT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 'signature' ELSE 'body' END AS prov
FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY {within} ORDER BY {order}) AS dst FROM ({held}) q) e WHERE dst IS NOT NULL"""
#: From part to part of one brand in an order, acyclic: ids rise along edges.
DAG = _EDGES.format(within="l_orderkey, p_brand", order="l_partkey", held=_HELD)
#: The same by price, with strong components of many sizes.
CYCLIC = _EDGES.format(within="l_orderkey, p_brand", order="price, l_partkey", held=_HELD)
#: From part to part in an order, whatever the brand: ten times as many edges.
SUCCESSION = _EDGES.format(within="l_orderkey", order="price, l_partkey", held=_HELD)
#: Orders and the brands in them, as baskets.
BASKETS = "SELECT DISTINCT l_orderkey AS owner, CAST(substr(p_brand, 7) AS BIGINT) AS item FROM lineitem JOIN part ON l_partkey = p_partkey"


def run_sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...] = ("part", "lineitem")):
    """``text`` over the tables; the caller's temporary views of these names stay."""
    own = {n: f"quern_{n}_{uuid.uuid4().hex}" for n in names}
    for n, view in own.items():
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(view)
        text = re.sub(rf"\b{n}\b", view, text)
    out = spark.sql(text)
    for view in own.values():
        spark.catalog.dropTempView(view)
    return out


def star_graph(spark: SparkSession, sf_dir: str, edges: str | None = None, cyclic: bool = False) -> Graph:
    """The graph of ``edges``; without them, of :data:`SUCCESSION` if ``cyclic``, else of :data:`DAG`."""
    nodes = run_sql(spark, sf_dir, NODES)
    nodes = nodes.selectExpr("def_id", "name", "module", "kind", "state", "access", "line", "sig", "IF(is_unsafe, array('unsafe'), array()) AS unsafe", "IF(is_unsolved, 1, 0) AS unsolved", "true AS is_real")
    return Graph(nodes, run_sql(spark, sf_dir, edges or (SUCCESSION if cyclic else DAG)))
