"""Stores, jobs, tree numbers and folds over the tables' rows."""

from __future__ import annotations

import itertools
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import batch, folds, intervals, preorder, rollup
from lodestar.plans import code_queries
from lodestar.plans.canonical import CTE, symbols
from lodestar.plans.registry import query
from lodestar.sources.stages import shared_dir, stage
from lodestar.sources.store import Clock, FlowStore, KeyedStore, SummaryStore


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stores/{name}-{uuid.uuid4().hex}"


def ticking() -> Clock:
    """A clock of its own for every store, one second to a reading."""
    seconds = itertools.count()
    return lambda: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=next(seconds))


@query(
    """WITH a AS (SELECT 'f' || c_custkey AS id, 'n' || c_custkey AS name, c_custkey AS k, CASE WHEN c_nationkey >= 5 AND c_nationkey < 16 THEN 'second' ELSE 'first' END AS step FROM customer WHERE c_nationkey < 16)
SELECT CASE WHEN k % 7 = 0 THEN 'g' || k ELSE id END AS id, name, CASE WHEN k % 7 = 0 THEN 'renamed' ELSE step END AS step FROM a WHERE k % 7 = 0 OR k % 5 <> 0"""
)
def flow_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers save in turn, one takes over names under new ids, the other deletes by id."""
    path, clock = fresh(spark, "flows"), ticking()
    one, two = FlowStore(spark, path, clock), FlowStore(spark, path, clock)
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    flow = lambda rows, letter, step: rows.select(F.concat(F.lit(letter), k).alias("id"), F.concat(F.lit("n"), k).alias("name"), F.array(F.lit(step)).alias("steps"))
    one.save(flow(c.where("c_nationkey < 10"), "f", "first"))
    two.save(flow(c.where("c_nationkey >= 5 and c_nationkey < 16"), "f", "second"))
    one.save(flow(c.where("c_nationkey < 16 and c_custkey % 7 = 0"), "g", "renamed"))
    two.delete(flow(c.where("c_custkey % 5 = 0"), "f", "").select("id"))
    return one.load().select("id", "name", F.get("steps", F.lit(0)).alias("step"))


@query("SELECT 'p' || p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'q' || p_partkey, p_size FROM part WHERE p_partkey % 4 = 0")
def store_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved after a store is cleared, and nothing from before, whether compacted or not."""
    store = KeyedStore(spark, fresh(spark, "cleared"), "k string, v int", ["k"], ticking())
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = lambda letter, where: p.where(where).select(F.concat(F.lit(letter), "p_partkey").alias("k"), F.col("p_size").alias("v"))
    store.upsert(rows("p", "true"))
    store.compact()
    store.upsert(rows("z", "true"))
    store.clear()
    store.upsert(rows("p", "p_partkey % 3 = 0"))
    store.upsert(rows("q", "p_partkey % 4 = 0"))
    store.compact()
    return store.load().select("k", "v")


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS summary, doc_id % 3 = 0 OR doc_id % 4 <> 0 AS valid,
  CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS symbol_summary FROM d"""
)
def summary_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and symbol summaries written twice; those whose text has changed since don't hold."""
    store = SummaryStore(spark, fresh(spark, "summaries"), ticking())
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    store.put("file", d.select("path", digest("text").alias("content_hash"), F.lit("first").alias("summary")))
    store.put("symbol", d.select("path", F.lit("f").alias("symbol"), F.lit("old").alias("summary")))
    store.put("file", d.where("doc_id % 3 = 0").select("path", digest(changed).alias("content_hash"), F.lit("second").alias("summary")))
    store.put("symbol", d.where("doc_id % 2 = 0").select("path", F.lit("f").alias("symbol"), F.lit("new").alias("summary")))
    holds = store.valid(d.select(F.col("path").alias("file_path"), changed.alias("content"))).select("path", F.lit(True).alias("ok"))
    symbol = store.get("symbol").select("path", F.col("summary").alias("symbol_summary"))
    return store.get("file").join(holds, "path", "left").join(symbol, "path").select("path", "summary", F.coalesce("ok", F.lit(False)).alias("valid"), "symbol_summary")


@query(
    """WITH n AS (SELECT count(DISTINCT o_custkey) AS files, count(*) AS symbols FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'stopped' AS state, 'file' AS level, files AS total, files AS done, 100 AS percent FROM n UNION ALL SELECT 'stopped', 'symbol', symbols, 0, 0 FROM n UNION ALL SELECT 'stopped', 'all', files + symbols, files, CAST(round(100 * files / (files + symbols)) AS INTEGER) FROM n
UNION ALL SELECT 'resumed', 'file', files, files, 100 FROM n UNION ALL SELECT 'resumed', 'symbol', symbols, symbols, 100 FROM n UNION ALL SELECT 'resumed', 'all', files + symbols, files + symbols, 100 FROM n"""
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis of the written files, stopped after its last round of files and taken up again by another job."""
    files, found = code_queries.python_symbols(spark, sf_dir)
    found = stage(found.select("id", "name", "kind", "file_path", "start_line", "end_line"), "job-symbols")
    path, clock = fresh(spark, "job"), ticking()
    summaries = SummaryStore(spark, fresh(spark, "job-summaries"), clock)
    job = lambda: batch.AnalysisJob(spark, path, files, found, summaries, lambda prompts: [p[:40] for p in prompts], round_items=20_000, clock=clock)
    first = job()
    first.plan()
    first.run(lambda: first.left or first.cancel())
    columns = ["level", "total", "done", "percent"]
    stopped = stage(first.progress().select(F.lit("stopped").alias("state"), *columns), "job-stopped")
    second = job()
    second.run()
    return stopped.unionByName(second.progress().select(F.lit("resumed").alias("state"), *columns))


TREE_SQL = """, fs AS (SELECT DISTINCT file_path FROM symbols),
fo AS (SELECT DISTINCT array_to_string(string_split(file_path, '/')[:i], '/') AS path FROM (SELECT file_path, unnest(range(1, len(string_split(file_path, '/')))) AS i FROM fs)),
nd AS (SELECT 'folder' AS kind, path, list_transform(string_split(path, '/'), lambda x: '0' || x) AS ks FROM fo
  UNION ALL SELECT 'file', file_path, list_append(list_transform(string_split(file_path, '/')[:-2], lambda x: '0' || x), '1' || string_split(file_path, '/')[-1]) FROM fs)"""


def canonical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = symbols(spark, sf_dir)
    return preorder.number_tree(rollup.tree_nodes(n.withColumn("is_dead", F.lit(False))))


@query(CTE + TREE_SQL + " SELECT kind, path, (row_number() OVER (ORDER BY array_to_string(ks, chr(1))) - 1)::BIGINT AS place FROM nd")
def scope_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preorder.scope_picker(canonical_tree(spark, sf_dir))


@query(CTE + TREE_SQL + " SELECT fo.path AS folder, fs.file_path AS path FROM fo JOIN fs ON starts_with(fs.file_path, fo.path || '/')")
def folder_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files below each folder: those whose number lies in the folder's interval."""
    numbered = stage(canonical_tree(spark, sf_dir), "members-tree")
    one = F.lit(1).alias("tree")
    spans = numbered.where("kind = 'folder'").select(one, F.col("pre").alias("start"), F.col("last").alias("end"), F.col("path").alias("folder"))
    points = numbered.where("kind = 'file'").select(one, F.col("pre").alias("line"), "path")
    return intervals.containing(points, spans, "tree").select("folder", "path")


@query(CTE + "SELECT file_path AS module, count(*) AS lines, (sum(least(length('- ' || name || ' (' || kind || ')'), 60)) + count(*))::BIGINT AS chars, TRUE AS bounded FROM symbols GROUP BY 1")
def folded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's lines per module, gathered in rows of at most 500 characters."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")"))
    parts = folds.chunked(symbols(spark, sf_dir).select(F.col("file_path").alias("key"), F.col("id").alias("ord"), line.alias("text")), 500, 60)
    return parts.groupBy(F.col("key").alias("module")).agg(F.sum("n").alias("lines"), F.sum(F.length("text") + 1).alias("chars"), (F.max(F.length("text")) <= 500).alias("bounded"))
