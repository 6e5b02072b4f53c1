"""The code graph laid over the driver's star schema, so that graph operators run on any scale.

Suppliers become classes, parts become functions and methods, consecutive order lines become
calls. The definition is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import register

CTE = """
WITH cls AS (
  SELECT s_suppkey, 'lib/region_' || n_regionkey || '/nation_' || s_nationkey || '.py' AS file_path, s_name FROM supplier JOIN nation ON s_nationkey=n_nationkey),
prt AS (
  SELECT p_partkey, replace(p_name,' ','_') || '_' || p_partkey AS name, p_name, p_type, p_brand, p_size, p_retailprice, p_partkey % (SELECT count(*) FROM supplier) AS owner,
    CASE p_partkey % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'class_method' WHEN 2 THEN 'static_method' WHEN 3 THEN 'async_function' ELSE 'function' END AS kind FROM part),
symbols AS (
  SELECT file_path || '#S' || s_suppkey AS id, 'S' || s_suppkey AS name, 'class' AS kind, file_path, CAST(NULL AS string) AS parent_class_id, CAST(-1 AS bigint) AS pk, s_suppkey AS sk,
    CAST(NULL AS string) AS type_hint, CAST(NULL AS string) AS return_type, 'supplier ' || s_name AS summary, CAST(NULL AS string) AS description, CAST(s_suppkey AS bigint) AS sym_ord FROM cls
  UNION ALL
  SELECT CASE WHEN kind LIKE '%method' THEN c.file_path || '#S' || s_suppkey || '.P' || p_partkey ELSE 'src/' || lower(p_type) || '/brand_' || substr(p_brand,7) || '.py#P' || p_partkey END,
    name, kind, CASE WHEN kind LIKE '%method' THEN c.file_path ELSE 'src/' || lower(p_type) || '/brand_' || substr(p_brand,7) || '.py' END,
    CASE WHEN kind LIKE '%method' THEN c.file_path || '#S' || s_suppkey END, CAST(p_partkey AS bigint), CAST(-1 AS bigint),
    CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'List[float]' ELSE 'Optional[Str]' END, CASE WHEN p_size % 4 = 0 THEN 'dict' WHEN p_size % 4 = 1 THEN 'bool' WHEN p_size % 4 = 2 THEN 'List[Dict]' END,
    p_type || ' ' || p_name, 'sold at ' || p_brand, CAST(100000000 + p_partkey AS bigint) FROM prt JOIN cls c ON owner = s_suppkey),
nxt AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS b FROM lineitem WHERE l_orderkey % 20 = 0),
calls_raw AS (
  SELECT a.id AS source, b.id AS target, l_orderkey AS line, CAST(l_linenumber AS bigint) AS col, l_orderkey*10+l_linenumber AS edge_ord FROM nxt JOIN symbols a ON a.pk=nxt.a JOIN symbols b ON b.pk=nxt.b WHERE nxt.a<>nxt.b),
edges AS (
  SELECT source, target, 'calls' AS kind, CAST(min(edge_ord) AS bigint) AS edge_ord FROM calls_raw GROUP BY source, target
  UNION ALL
  SELECT a.id, b.id, 'instantiates', CAST(min(l_orderkey*10+l_linenumber) AS bigint) FROM lineitem JOIN symbols a ON a.pk=l_partkey JOIN symbols b ON b.sk=l_suppkey WHERE l_orderkey % 20 = 1 GROUP BY a.id,b.id
  UNION ALL
  SELECT parent_class_id, id, 'contains', CAST(pk AS bigint) FROM symbols WHERE parent_class_id IS NOT NULL
  UNION ALL
  SELECT a.id, b.id, 'inherits', CAST(a.sk AS bigint) FROM symbols a JOIN symbols b ON a.sk>0 AND b.sk=CAST(floor(a.sk/2) AS bigint))
"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark, sf_dir).sql(CTE + "SELECT * FROM symbols")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register(spark, sf_dir).sql(CTE + "SELECT source || '->[' || kind || ']->' || target AS id, source, target, kind, edge_ord FROM edges")


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call locations, not de-duplicated."""
    return register(spark, sf_dir).sql(CTE + "SELECT target AS target_id, source AS caller_symbol_id, line, col, edge_ord FROM calls_raw")
