"""Search, incremental maintenance, tools and interactive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators import incremental, intervals, search, tools
from lodestar.plans import graph_queries
from lodestar.plans.canonical import CTE, edges, symbols
from lodestar.plans.registry import query
from lodestar.sources.stages import exchanged, stage
from lodestar.streaming.debounce import last_of_burst


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).withColumn("type_hints", F.when(F.col("type_hint").isNotNull(), F.array("type_hint")).otherwise(F.array().cast("array<string>")))


def scored_sql(words: list[str], cols: str = "id, score") -> str:
    """The score of one or more keywords in SQL: a chain that stops at an exact name."""
    parts, stop = [], []
    for w in words:
        own = f"CASE WHEN lower(name) = '{w}' THEN 100 ELSE CASE WHEN starts_with(lower(name), '{w}') THEN 50 WHEN contains(lower(name), '{w}') THEN 30 ELSE 0 END + CASE WHEN contains(lower(summary), '{w}') THEN 25 WHEN contains(lower(coalesce(description, '')), '{w}') THEN 15 ELSE 0 END END"
        parts.append(f"CASE WHEN {' OR '.join(stop)} THEN 0 ELSE {own} END" if stop else own)
        stop.append(f"lower(name) = '{w}'")
    return CTE + f", sc AS (SELECT *, CAST({' + '.join(parts)} AS BIGINT) AS score FROM symbols) SELECT {cols} FROM sc WHERE score > 0"


@query(CTE + "SELECT id, 1::BIGINT AS score FROM symbols ORDER BY sym_ord, id LIMIT 20")
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searchable(spark, sf_dir), "  ").select("id", "score")


@query(CTE + "SELECT id FROM symbols WHERE contains(kind, 'class')")
def search_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(searchable(spark, sf_dir), search.parse_filter("kind:Class")).select("id")


@query(CTE + "SELECT id FROM symbols WHERE kind <> 'class' AND contains(lower(type_hint), 'float')")
def search_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(searchable(spark, sf_dir), search.parse_filter("in:float")).select("id")


@query(CTE + "SELECT id FROM symbols WHERE kind <> 'class' AND contains(lower(coalesce(return_type, '')), 'dict')")
def search_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(searchable(spark, sf_dir), search.parse_filter("out:Dict")).select("id")


@query(CTE + "SELECT id, 10::BIGINT AS score FROM symbols WHERE kind <> 'class' AND contains(lower(type_hint), 'str') AND contains(kind, 'method') ORDER BY sym_ord, id LIMIT 20")
def search_filter_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searchable(spark, sf_dir), "in:str kind:method").select("id", "score")


@query(scored_sql(["red"]))
def search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(searchable(spark, sf_dir), ["red"]).where("score > 0").select("id", "score")


@query(scored_sql(["s1", "steel", "brand"]))
def search_multi_kw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(searchable(spark, sf_dir), ["s1", "steel", "brand"]).where("score > 0").select("id", "score")


@query(scored_sql(["s1"], "id, row_number() OVER (ORDER BY score DESC, sym_ord, id)::INTEGER AS position"))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches with their place; one global order is the result itself, of matches only."""
    found = search.scored(searchable(spark, sf_dir), ["s1"]).where("score > 0")
    return found.select("id", F.row_number().over(W.orderBy(F.col("score").desc(), "sym_ord", "id")).alias("position"))


@query(scored_sql(["s1"]) + " ORDER BY score DESC, sym_ord, id LIMIT 20")
def search_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searchable(spark, sf_dir), "S1").select("id", "score")


@query(scored_sql(["s1"], "id, name || '(' || coalesce(type_hint, '') || ')' || coalesce(' -> ' || return_type, '') AS signature, least(100, score) AS shown") + " ORDER BY score DESC, sym_ord, id LIMIT 10")
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searchable(spark, sf_dir), "s1", 10).select("id", search.signature().alias("signature"), search.shown_score(F.col("score")).alias("shown"))


@query(scored_sql(["tin"], "id, least(100, score * 2) AS shown"))
def score_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(searchable(spark, sf_dir), ["tin"]).where("score > 0").select("id", search.shown_score(F.col("score") * 2).alias("shown"))


# --- incremental ---------------------------------------------------------------------------

CUR = "WITH cur AS (SELECT 'doc/' || doc_id || '.py' AS file_path, text AS content, doc_id * 1000.0::DOUBLE AS mtime, doc_id FROM documents), snap AS (SELECT file_path, mtime + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0.4 END AS mtime, md5(CASE WHEN doc_id % 7 = 0 THEN content || '!' ELSE content END) AS content_hash FROM cur WHERE doc_id % 10 <> 0 UNION ALL SELECT 'gone/' || doc_id || '.py', 0, 'x' FROM cur WHERE doc_id % 25 = 0) "


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".py")).alias("file_path"), F.col("text").alias("content"), (F.col("doc_id") * 1000.0).alias("mtime"), "doc_id")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, odd = current(spark, sf_dir), F.col("doc_id") % 7 == 0
    kept = now.where("doc_id % 10 <> 0").select("file_path", (F.col("mtime") + F.when(odd, 5.0).otherwise(0.4)).alias("mtime"), incremental.content_hash(F.when(odd, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("content_hash"))
    return kept.unionByName(now.where("doc_id % 25 = 0").select(F.concat(F.lit("gone/"), "doc_id", F.lit(".py")).alias("file_path"), F.lit(0.0).alias("mtime"), F.lit("x").alias("content_hash")))


STATUS = CUR + "SELECT coalesce(c.file_path, s.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'deleted' WHEN abs(c.mtime - s.mtime) < 1 THEN 'reusable' ELSE 'modified' END AS status FROM cur c FULL JOIN snap s ON c.file_path = s.file_path"


@query(STATUS)
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff_status(current(spark, sf_dir), snapshot(spark, sf_dir))


@query(CUR + "SELECT file_path, 'new' AS status FROM cur")
def diff_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff_status(current(spark, sf_dir), snapshot(spark, sf_dir).limit(0))


@query(CUR + "SELECT file_path FROM snap WHERE file_path NOT IN (SELECT file_path FROM cur)")
def diff_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.deleted_files(current(spark, sf_dir), snapshot(spark, sf_dir))


@query("SELECT false AS valid")
def diff_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.all_valid(diff_status(spark, sf_dir))


@query(CUR + "SELECT file_path, md5(content) AS content_hash FROM cur")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("file_path", incremental.content_hash(F.col("content")).alias("content_hash"))


@query(CUR + "SELECT c.file_path, s.file_path IS NOT NULL AND (c.content IS NULL OR md5(c.content) = s.content_hash) AS hit FROM cur c LEFT JOIN snap s ON s.file_path = c.file_path")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_lookup(current(spark, sf_dir), snapshot(spark, sf_dir))


def summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = symbols(spark, sf_dir).select("file_path", F.col("id").alias("symbol"), F.col("summary"), "pk")
    return n.where("pk % 3 <> 0").drop("pk"), n.where("pk % 4 = 0").select("file_path", "symbol", F.upper("summary").alias("summary"))


MERGED = CTE + ", mg AS (SELECT file_path, id AS symbol, CASE WHEN pk % 4 = 0 THEN upper(summary) ELSE summary END AS summary FROM symbols WHERE pk % 3 <> 0 OR pk % 4 = 0) "


@query(MERGED + "SELECT file_path, symbol, summary FROM mg")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.merge_summaries(*summaries(spark, sf_dir))


@query(MERGED + "SELECT count(DISTINCT file_path) AS files, count(*) AS symbols FROM mg")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_stats(cache_merge(spark, sf_dir))


@query("SELECT 'f' || c_custkey AS id, 'flow ' || c_custkey AS name, CAST(c_mktsegment AS VARCHAR) AS note FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT 'f' || c_custkey, 'flow ' || c_custkey || ' new', 'by id' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'n' || c_custkey, 'flow ' || c_custkey, 'by name' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0")
def flow_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    flow = lambda rows, i, name, note: rows.select(F.concat(F.lit(i), key).alias("id"), name.alias("name"), note.alias("note"))
    name = F.concat(F.lit("flow "), key)
    new = flow(c.where("c_custkey % 5 = 0"), "f", F.concat(name, F.lit(" new")), F.lit("by id")).unionByName(flow(c.where("c_custkey % 7 = 0 and c_custkey % 5 <> 0"), "n", name, F.lit("by name")))
    return incremental.upsert_flows(flow(c, "f", name, F.col("c_mktsegment")), new)


# --- tools ---------------------------------------------------------------------------------


@query(CTE + "SELECT id, '### ' || name || ' (' || kind || ')' || chr(10) || '- file: ' || file_path || coalesce(chr(10) || '- returns: ' || return_type, '') || coalesce(chr(10) || '- ' || summary, '') AS markdown FROM symbols")
def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", tools.context_markdown().alias("markdown"))


@query(CTE + graph_queries.EGO + "SELECT direction, b.kind, s.name FROM bth b JOIN symbols s ON s.id = b.other")
def tool_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.ego_neighbors(spark, sf_dir).select("direction", "kind", "name")


@query(graph_queries.reach_sql(graph_queries.ALL_KINDS, graph_queries.TOP, graph_queries.paths.MAX_DEPTH, "SELECT unnest(range(0, max(depth) + 1))::INTEGER AS step FROM d"))
def tool_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered steps of a traced path: one more than its hops."""
    e = edges(spark, sf_dir)
    start = graph_queries.top_caller(spark, sf_dir)
    found = graph_queries.paths.find_path(symbols(spark, sf_dir), e, start, graph_queries.far_node(spark, sf_dir))
    return tools.trace_steps(found, e).select("step")


@query(scored_sql(["s1"], "id, score") + " ORDER BY score DESC, sym_ord, id LIMIT 10")
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searchable(spark, sf_dir), "s1", 10).select("id", "score")


@query(graph_queries.dead_sql(cols="id AS node_id") + " ORDER BY node_id LIMIT 20")
def tool_dead_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.dead_code(spark, sf_dir).orderBy("node_id").limit(20)


@query(CTE + "SELECT pk AS index, pk // 3 AS chunk FROM symbols WHERE pk >= 0")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.batch_chunks(symbols(spark, sf_dir).where("pk >= 0").select(F.col("pk").alias("index"), F.col("summary").alias("prompt"))).select("index", "chunk")


# --- interactive ---------------------------------------------------------------------------


@query("SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR epoch(n) - epoch(ts) >= 3600")
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of_burst(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id", 3600.0).select("event_id")


@query(
    CTE
    + """, rg AS (SELECT id, kind, file_path, CASE WHEN kind = 'class' THEN 0 ELSE pk * 10 END AS a, CASE WHEN kind = 'class' THEN 1000000000 ELSE pk * 10 + 30 END AS b FROM symbols),
cu AS (SELECT file_path, pk * 10 + 12 AS line FROM symbols WHERE pk % 3 = 0 AND pk >= 0),
m AS (SELECT c.file_path, c.line, r.id, row_number() OVER (PARTITION BY c.file_path, c.line ORDER BY r.b - r.a, CASE WHEN r.kind IN ('class') THEN 1 ELSE 0 END, r.a DESC, r.id) AS k FROM cu c JOIN rg r ON r.file_path = c.file_path AND c.line BETWEEN r.a AND r.b)
SELECT file_path, line, id FROM m WHERE k = 1"""
)
def enclosing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost symbol at a cursor line: equality on cells of the file, then the shortest."""
    with exchanged(spark):
        n = stage(symbols(spark, sf_dir), "enclosing-symbols")
        is_class = F.col("kind") == "class"
        spans = n.select("id", "kind", "file_path", F.when(is_class, F.lit(0)).otherwise(F.col("pk") * 10).alias("start"), F.when(is_class, F.lit(1000000000)).otherwise(F.col("pk") * 10 + 30).alias("end"))
        cursors = n.where("pk % 3 = 0 and pk >= 0").select("file_path", (F.col("pk") * 10 + 12).alias("line"))
        return stage(intervals.innermost(cursors, spans), "enclosing")
