"""Graph store, paths, dead code, rollup and macro clustering over the canonical graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import deadcode, graph, macro, paths, rollup
from lodestar.plans.canonical import CTE, edges, symbols, usages
from lodestar.plans.registry import query

HUB = "lib/region_"  # the ego queries look at the first class by id
EID = "source || '->[' || kind || ']->' || target"
FOCUS = "(SELECT min(id) FROM symbols WHERE kind = 'class')"


def focus(spark: SparkSession, sf_dir: str) -> str:
    return symbols(spark, sf_dir).where("kind = 'class'").agg(F.min("id")).first()[0]


def top_caller(spark: SparkSession, sf_dir: str) -> str:
    """The function with the most distinct callees; ties to the smaller id."""
    return edges(spark, sf_dir).where("kind = 'calls'").groupBy("source").count().orderBy(F.col("count").desc(), "source").first()[0]


TOP = "(SELECT source FROM edges WHERE kind = 'calls' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


@query(CTE + "SELECT id, name, kind, file_path, parent_class_id FROM symbols")
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", "name", "kind", "file_path", "parent_class_id")


@query(CTE + f"SELECT {EID} AS id, source, target, kind, edge_ord FROM edges")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(CTE + f"SELECT {EID} || CASE WHEN kind = 'calls' THEN '@' || (edge_ord // 10) || ':' || (edge_ord % 10) ELSE '' END AS edge_key FROM edges")
def edge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("kind") == "calls", F.floor(F.col("edge_ord") / 10).cast("long"))
    return edges(spark, sf_dir).select(graph.edge_key(line, F.col("edge_ord") % 10).alias("edge_key"))


@query(CTE + "SELECT id, CASE WHEN pk % 9 = 0 THEN upper(name) ELSE name END AS name, kind FROM symbols UNION ALL SELECT 'new#N' || pk, 'n' || pk, 'function' FROM symbols WHERE pk % 50 = 1")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = symbols(spark, sf_dir)
    new = old.where("pk % 9 = 0").select("id", F.upper("name").alias("name"), "kind").unionByName(old.where("pk % 50 = 1").select(F.concat(F.lit("new#N"), "pk").alias("id"), F.concat(F.lit("n"), "pk").alias("name"), F.lit("function").alias("kind")))
    return graph.upsert(old.select("id", "name", "kind"), new, "id")


@query(CTE + f"SELECT id, name, kind FROM symbols WHERE id = {FOCUS}")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).where(F.col("id") == focus(spark, sf_dir)).select("id", "name", "kind")


@query(CTE + f"SELECT {EID} AS id FROM edges WHERE source NOT IN (SELECT id FROM symbols WHERE pk % 10 = 3) AND target NOT IN (SELECT id FROM symbols WHERE pk % 10 = 3)")
def node_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = symbols(spark, sf_dir)
    return graph.delete_nodes(n, edges(spark, sf_dir), n.where("pk % 10 = 3"))[1].select("id")


@query(CTE + f"SELECT {EID} AS id, source, target, kind FROM edges WHERE source = {TOP} AND kind = 'calls'")
def edge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where((F.col("source") == top_caller(spark, sf_dir)) & (F.col("kind") == "calls")).select("id", "source", "target", "kind")


@query(CTE + f"SELECT {EID} AS id FROM edges WHERE NOT (kind = 'calls' AND edge_ord % 7 = 0)")
def edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.join(e.where("kind = 'calls' and edge_ord % 7 = 0").select("id"), "id", "left_anti").select("id")


@query(CTE + f"SELECT {EID} AS id FROM edges WHERE source IN (SELECT id FROM symbols WHERE pk % 4 <> 1) AND target IN (SELECT id FROM symbols WHERE pk % 4 <> 1)")
def edges_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.valid_edges(edges(spark, sf_dir), symbols(spark, sf_dir).where("pk % 4 <> 1")).select("id")


@query(CTE + "SELECT id FROM symbols WHERE kind = 'class'")
def graph_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that is cleared and then gets its classes again."""
    n = symbols(spark, sf_dir)
    none, _ = graph.clear(n, edges(spark, sf_dir))
    return graph.upsert(none, n.where("kind = 'class'"), "id").select("id")


FIRST_FILE = "(SELECT min(file_path) FROM symbols WHERE kind = 'function')"


def first_file(spark: SparkSession, sf_dir: str) -> str:
    return symbols(spark, sf_dir).where("kind = 'function'").agg(F.min("file_path")).first()[0]


@query(
    CTE
    + f""", n2 AS (SELECT id FROM symbols WHERE file_path <> {FIRST_FILE} UNION ALL SELECT id FROM symbols WHERE file_path = {FIRST_FILE} AND pk % 2 = 0)
SELECT {EID} AS id FROM edges WHERE source IN (SELECT id FROM n2) AND target IN (SELECT id FROM n2)"""
)
def file_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is parsed again and has lost its odd symbols."""
    n, e, path = symbols(spark, sf_dir), edges(spark, sf_dir), first_file(spark, sf_dir)
    kept = n.where((F.col("file_path") == path) & F.expr("pk % 2 = 0"))
    leaving = e.join(kept.select(F.col("id").alias("source")), "source", "left_semi").select(*e.columns)
    return graph.replace_file(n, e, path, kept, leaving)[1].select("id")


@query(CTE + f"SELECT {EID} AS id FROM edges WHERE source NOT IN (SELECT id FROM symbols WHERE file_path = {FIRST_FILE}) AND target NOT IN (SELECT id FROM symbols WHERE file_path = {FIRST_FILE})")
def file_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.delete_file(symbols(spark, sf_dir), edges(spark, sf_dir), first_file(spark, sf_dir))[1].select("id")


@query(CTE + f"SELECT id, name FROM symbols WHERE file_path = {FIRST_FILE}")
def nodes_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).where(F.col("file_path") == first_file(spark, sf_dir)).select("id", "name")


@query(CTE + f"SELECT DISTINCT id, name FROM symbols WHERE id IN (SELECT source FROM edges WHERE target = {FOCUS})")
def in_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_neighbors(symbols(spark, sf_dir), edges(spark, sf_dir), focus(spark, sf_dir)).select("id", "name")


@query(CTE + f"SELECT DISTINCT id, name FROM symbols WHERE id IN (SELECT target FROM edges WHERE source = {FOCUS})")
def out_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_neighbors(symbols(spark, sf_dir), edges(spark, sf_dir), focus(spark, sf_dir)).select("id", "name")


@query(CTE + f"SELECT {EID} AS id, kind FROM edges WHERE target = {FOCUS}")
def in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("target") == focus(spark, sf_dir)).select("id", "kind")


@query(CTE + f"SELECT {EID} AS id, kind FROM edges WHERE source = {FOCUS}")
def out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("source") == focus(spark, sf_dir)).select("id", "kind")


EGO = f""", bth AS (SELECT 'in' AS direction, {EID} AS edge_id, kind, source AS other FROM edges WHERE target = {FOCUS}
  UNION ALL SELECT 'out', {EID}, kind, target FROM edges WHERE source = {FOCUS}), ids AS (SELECT {FOCUS} AS id UNION SELECT other FROM bth) """


@query(CTE + EGO + "SELECT direction, edge_id, b.kind, s.id, s.name FROM bth b JOIN symbols s ON s.id = b.other")
def ego_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_neighbors(symbols(spark, sf_dir), edges(spark, sf_dir), focus(spark, sf_dir))


@query(CTE + EGO + f"SELECT id, name, CASE WHEN id = {FOCUS} THEN 0 ELSE 1 END AS hops FROM symbols WHERE id IN (SELECT id FROM ids)")
def ego_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_nodes(symbols(spark, sf_dir), edges(spark, sf_dir), focus(spark, sf_dir)).select("id", "name", "hops")


@query(
    CTE
    + f""", em AS MATERIALIZED (SELECT {EID} AS eid, source, target FROM edges), fo AS MATERIALIZED (SELECT {FOCUS} AS f),
ids AS MATERIALIZED (SELECT f AS id FROM fo UNION SELECT target FROM em, fo WHERE source = f UNION SELECT source FROM em, fo WHERE target = f)
SELECT eid AS id FROM em WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)"""
)
def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_edges(edges(spark, sf_dir), focus(spark, sf_dir)).select("id")


@query(CTE + EGO + ", two AS (SELECT id FROM ids UNION SELECT target FROM edges WHERE source IN (SELECT id FROM ids) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM ids)) SELECT id, name FROM symbols WHERE id IN (SELECT id FROM two)")
def ego_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_nodes(symbols(spark, sf_dir), edges(spark, sf_dir), focus(spark, sf_dir), 2).select("id", "name")


@query(CTE + "SELECT (SELECT count(*) FROM symbols) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM symbols WHERE kind <> 'class') AS function_count, (SELECT count(*) FROM symbols WHERE kind = 'class') AS class_count")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(symbols(spark, sf_dir), edges(spark, sf_dir))


PARALLEL = ", par AS (SELECT source, target, kind, edge_ord FROM edges UNION ALL SELECT source, target, 'contains', edge_ord FROM edges WHERE kind = 'calls' AND edge_ord % 7 = 0 UNION ALL SELECT source, target, 'inherits', edge_ord FROM edges WHERE kind = 'instantiates' AND edge_ord % 3 = 0)"


@query(CTE + PARALLEL + f" SELECT source, target, id, kind FROM (SELECT source, target, {EID} AS id, kind, row_number() OVER (PARTITION BY source, target ORDER BY CASE kind WHEN 'calls' THEN 0 WHEN 'instantiates' THEN 1 WHEN 'inherits' THEN 2 ELSE 3 END, edge_ord) AS r FROM par) WHERE r = 1")
def best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).drop("id")
    more = e.where("kind = 'calls' and edge_ord % 7 = 0").withColumn("kind", F.lit("contains")).unionByName(e.where("kind = 'instantiates' and edge_ord % 3 = 0").withColumn("kind", F.lit("inherits")))
    return graph.best_edge(e.unionByName(more).withColumn("id", graph.edge_id()))


@query(CTE + "SELECT target AS id, count(DISTINCT line * 10 + col) AS usage_count FROM calls_raw GROUP BY target")
def usage_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.usage_counts(usages(spark, sf_dir).withColumn("file_path", F.lit("orders"))).select(F.col("target_id").alias("id"), "usage_count")


@query(CTE + "SELECT s.id, CASE WHEN coalesce(u.c, 0) > 0 THEN u.c || ' usages' WHEN s.id NOT IN (SELECT target FROM edges WHERE kind <> 'contains') THEN 'orphan' ELSE 'root' END AS badge FROM symbols s LEFT JOIN (SELECT target, count(DISTINCT line * 10 + col) AS c FROM calls_raw GROUP BY target) u ON u.target = s.id")
def usage_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    used = e.where("kind <> 'contains'").select(F.col("target").alias("t")).distinct()
    joined = n.join(usage_count(spark, sf_dir), "id", "left").join(used, F.col("id") == F.col("t"), "left")
    return joined.select("id", F.when(F.coalesce("usage_count", F.lit(0)) > 0, F.concat("usage_count", F.lit(" usages"))).when(F.col("t").isNull(), F.lit("orphan")).otherwise(F.lit("root")).alias("badge"))


@query(CTE + EGO + "SELECT edge_id, CASE direction WHEN 'in' THEN CASE kind WHEN 'calls' THEN 'called by' WHEN 'instantiates' THEN 'created by' WHEN 'inherits' THEN 'extended by' ELSE 'part of' END ELSE CASE kind WHEN 'calls' THEN 'calls' WHEN 'instantiates' THEN 'creates' WHEN 'inherits' THEN 'extends' ELSE 'has' END END AS label FROM bth")
def relation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_neighbors(spark, sf_dir).select("edge_id", graph.relation_label(F.col("direction"), F.col("kind")).alias("label"))


# --- paths ---------------------------------------------------------------------------------


@query("SELECT true AS found, 0 AS total_hops, 0.0::DOUBLE AS total_cost")
def path_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = focus(spark, sf_dir)
    return paths.find_path(symbols(spark, sf_dir), edges(spark, sf_dir), at, at).select("found", "total_hops", "total_cost")


def reach_sql(kinds: str, start: str, depth: int, tail: str) -> str:
    step = f"SELECT e.target, min(r.depth) + 1 FROM r JOIN e ON e.source = r.node LEFT JOIN recurring.r AS old ON old.node = e.target WHERE old.node IS NULL AND r.depth < {depth} GROUP BY e.target"
    return CTE.replace("WITH cls", "WITH RECURSIVE cls", 1) + f", e AS (SELECT DISTINCT source, target FROM edges WHERE kind IN ({kinds})), d(node, depth) USING KEY (node) AS (SELECT {start} AS node, 0 AS depth UNION {step.replace(' r ', ' d AS r ')}) {tail}".replace("recurring.r", "recurring.d")


ALL_KINDS = "'calls', 'instantiates', 'inherits', 'contains'"


@query(reach_sql(ALL_KINDS, TOP, paths.MAX_DEPTH, "SELECT depth, count(*) AS nodes FROM d GROUP BY depth"))
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bfs(edges(spark, sf_dir), top_caller(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(reach_sql(ALL_KINDS, TOP, paths.MAX_DEPTH, "SELECT node, depth FROM d"))
def bfs_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bfs(edges(spark, sf_dir), top_caller(spark, sf_dir)).select("node", "depth")


@query(reach_sql("'calls'", TOP, paths.MAX_DEPTH, "SELECT node, depth FROM d"))
def bfs_calls_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.bfs(edges(spark, sf_dir), top_caller(spark, sf_dir), kinds=["calls"]).select("node", "depth")


FAR = "SELECT true AS found, max(depth) AS total_hops FROM d"


def far_node(spark: SparkSession, sf_dir: str) -> str:
    return paths.bfs(edges(spark, sf_dir), top_caller(spark, sf_dir)).orderBy(F.col("depth").desc(), "node").first()["node"]


@query(reach_sql(ALL_KINDS, TOP, paths.MAX_DEPTH, FAR))
def bfs_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to a farthest node has as many hops as its level."""
    start = top_caller(spark, sf_dir)
    return paths.find_path(symbols(spark, sf_dir), edges(spark, sf_dir), start, far_node(spark, sf_dir)).select("found", "total_hops")


@query()
def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of that way, numbered; which of several shortest ways depends on edge order."""
    start = top_caller(spark, sf_dir)
    return paths.find_path(symbols(spark, sf_dir), edges(spark, sf_dir), start, far_node(spark, sf_dir)).select(F.posexplode("node_ids").alias("step", "node"))


@query(
    CTE.replace("WITH cls", "WITH RECURSIVE cls", 1)
    + f""", e AS (SELECT source, target, min(CASE kind WHEN 'calls' THEN 1.0::DOUBLE WHEN 'instantiates' THEN 1.2 WHEN 'inherits' THEN 1.8 ELSE 2.5 END) AS w FROM edges GROUP BY source, target),
r(node, cost) USING KEY (node) AS (SELECT {TOP}, 0.0::DOUBLE UNION
  SELECT e.target, min(r.cost + e.w) FROM r JOIN e ON e.source = r.node LEFT JOIN recurring.r AS old ON old.node = e.target WHERE old.cost IS NULL OR r.cost + e.w < old.cost - 1e-9 GROUP BY e.target)
SELECT node, CAST(round(cost, 4) AS DOUBLE) AS cost FROM r"""
)
def dijkstra_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of every node that can be reached."""
    return paths.cheapest(edges(spark, sf_dir), top_caller(spark, sf_dir)).select("node", F.round("cost", 4).alias("cost"))


# --- dead code -----------------------------------------------------------------------------

WL = CTE + """, wl AS (SELECT id, kind, parent_class_id, pk, CASE WHEN pk % 13 = 0 THEN 'test_' || name WHEN pk % 13 = 1 THEN '__call__' WHEN pk % 13 = 2 AND kind = 'function' THEN 'main' ELSE name END AS name,
  CASE WHEN pk % 17 = 0 THEN 'src/tests/t.py' WHEN pk % 17 = 1 THEN 'src/pkg/__init__.py' ELSE file_path END AS file_path,
  CASE WHEN pk % 7 = 0 THEN ['@app.get("/x")'] WHEN pk % 7 = 1 THEN ['@property', '@pytest.fixture'] WHEN pk % 7 = 2 THEN ['@property'] ELSE CAST([] AS VARCHAR[]) END AS decorators, pk % 11 = 0 AS is_exported FROM symbols)"""


def plain(patterns: tuple[str, ...]) -> str:
    return "(?i)(" + "|".join(p.removeprefix("(?i)") for p in patterns) + ")"


def held(patterns: tuple[str, ...]) -> str:
    return f"len(list_filter(decorators, lambda d: regexp_matches(d, '{plain(patterns)}'))) > 0"


SQL_RULES = {
    "export": "(is_exported OR regexp_matches(file_path, '(^|/)__init__\\.py$'))",
    "test": f"(starts_with(name, 'test_') OR ends_with(name, '_test') OR (kind = 'class' AND (starts_with(name, 'Test') OR ends_with(name, 'Test') OR ends_with(name, 'TestCase'))) OR {held(deadcode.TEST_DECORATORS)} OR regexp_matches(file_path, '{plain(deadcode.TEST_PATHS)}'))",
    "framework": f"({held(deadcode.FRAMEWORK_DECORATORS)})",
    "magic": "regexp_matches(name, '^__[a-zA-Z0-9_]+__$')",
    "main": "(kind IN ('function', 'async_function') AND name IN ('main', 'cli', 'run'))",
}
SQL_ANY = "(" + " OR ".join(SQL_RULES.values()) + ")"


def nodes_for_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with decorators, export flags, and some names and paths that the rules exempt."""
    pk = F.col("pk")
    name = F.when(pk % 13 == 0, F.concat(F.lit("test_"), "name")).when(pk % 13 == 1, F.lit("__call__")).when((pk % 13 == 2) & (F.col("kind") == "function"), F.lit("main")).otherwise(F.col("name"))
    path = F.when(pk % 17 == 0, F.lit("src/tests/t.py")).when(pk % 17 == 1, F.lit("src/pkg/__init__.py")).otherwise(F.col("file_path"))
    decorators = F.when(pk % 7 == 0, F.array(F.lit('@app.get("/x")'))).when(pk % 7 == 1, F.array(F.lit("@property"), F.lit("@pytest.fixture"))).when(pk % 7 == 2, F.array(F.lit("@property"))).otherwise(F.array().cast("array<string>"))
    return symbols(spark, sf_dir).select("id", "kind", "parent_class_id", "pk", name.alias("name"), path.alias("file_path"), decorators.alias("decorators"), (pk % 11 == 0).alias("is_exported"))


def rule_query(rule: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes_for_rules(spark, sf_dir).where(dict(deadcode.RULES)[rule]()).select("id")

    run.__name__ = f"wl_{rule}"
    query(WL + f"SELECT id FROM wl WHERE {SQL_RULES[rule]}")(run)


for _rule in SQL_RULES:
    rule_query(_rule)


@query(WL + "SELECT id, CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in SQL_RULES.items()) + " END AS reason FROM wl")
def whitelist_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_for_rules(spark, sf_dir).select("id", deadcode.whitelist_reason().alias("reason"))


def dead_sql(kinds: str = "kind <> 'contains'", more: str = "", cols: str = "id AS node_id, name, kind, 0::BIGINT AS effective_in_degree, 'no incoming reference to ' || kind || ' ' || name AS reason") -> str:
    return WL + f"SELECT {cols} FROM wl WHERE NOT {SQL_ANY} {more} AND id NOT IN (SELECT target FROM edges WHERE {kinds}) AND id NOT IN (SELECT target FROM calls_raw)"


@query(dead_sql(cols="id AS node_id"))
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_code_details(spark, sf_dir).select("node_id")


@query(dead_sql())
def dead_code_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.detect(nodes_for_rules(spark, sf_dir), edges(spark, sf_dir), usages(spark, sf_dir))


@query(dead_sql("true", cols="id AS node_id"))
def dead_code_with_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.detect(nodes_for_rules(spark, sf_dir), edges(spark, sf_dir), usages(spark, sf_dir), ignore_contains=False).select("node_id")


@query(dead_sql(more="AND kind NOT IN ('method', 'class_method', 'static_method')", cols="id AS node_id"))
def dead_code_no_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.detect(nodes_for_rules(spark, sf_dir), edges(spark, sf_dir), usages(spark, sf_dir), include_methods=False).select("node_id")


@query(dead_sql(more="AND name NOT LIKE '%red%'", cols="id AS node_id"))
def dead_code_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.detect(nodes_for_rules(spark, sf_dir), edges(spark, sf_dir), usages(spark, sf_dir), custom=F.col("name").like("%red%")).select("node_id")


@query(WL + f"SELECT id, NOT {SQL_ANY} AND id NOT IN (SELECT target FROM edges WHERE kind <> 'contains') AND id NOT IN (SELECT target FROM calls_raw) AS is_dead FROM wl")
def dead_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", "is_dead")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes_for_rules(spark, sf_dir)
    return deadcode.mark(n, deadcode.detect(n, edges(spark, sf_dir), usages(spark, sf_dir)))


@query(CTE + "SELECT id, name, kind FROM symbols WHERE NOT regexp_matches(name, '^__[a-zA-Z0-9_]+__$') AND id NOT IN (SELECT target FROM edges WHERE kind IN ('calls', 'instantiates', 'inherits')) AND id NOT IN (SELECT target FROM calls_raw)")
def dead_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.simple_dead(symbols(spark, sf_dir), edges(spark, sf_dir), usages(spark, sf_dir))


# --- rollup --------------------------------------------------------------------------------

DEAD = CTE + ", sd AS (SELECT s.*, s.id NOT IN (SELECT target FROM edges WHERE kind <> 'contains') AS is_dead FROM symbols s), ff AS (SELECT file_path, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind <> 'class') AS functions, count(*) FILTER (is_dead) AS dead FROM sd GROUP BY file_path)"
FOLDERS = DEAD + ", fo AS (SELECT *, unnest(range(1, len(string_split(file_path, '/')))) AS i FROM ff), fs AS (SELECT array_to_string(string_split(file_path, '/')[:i], '/') AS folder, * FROM fo)"


def with_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = edges(spark, sf_dir).where("kind <> 'contains'").select(F.col("target").alias("t")).distinct()
    return symbols(spark, sf_dir).join(used, F.col("id") == F.col("t"), "left").withColumn("is_dead", F.col("t").isNull()).drop("t")


@query(DEAD + "SELECT file_path, classes, functions, dead FROM ff")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.file_stats(with_dead(spark, sf_dir)).select("file_path", "classes", "functions", "dead")


@query(DEAD + "SELECT c.id, c.name, count(m.id) AS methods, CAST(c.is_dead AS BIGINT) + count(m.id) FILTER (m.is_dead) AS dead FROM sd c LEFT JOIN sd m ON m.parent_class_id = c.id WHERE c.kind = 'class' GROUP BY c.id, c.name, c.is_dead")
def tree_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.class_stats(with_dead(spark, sf_dir))


@query(FOLDERS + "SELECT DISTINCT folder, len(string_split(folder, '/'))::INTEGER AS depth FROM fs")
def tree_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select(F.explode(rollup.folders_of(F.col("file_path"))).alias("folder")).distinct().withColumn("depth", F.size(F.split("folder", "/")))


@query(FOLDERS + "SELECT folder, len(string_split(folder, '/'))::INTEGER AS depth, count(*) AS files, sum(classes)::BIGINT AS classes, sum(functions)::BIGINT AS functions, sum(dead)::BIGINT AS dead FROM fs GROUP BY folder")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.folder_stats(rollup.file_stats(with_dead(spark, sf_dir)))


@query(DEAD + "SELECT id, coalesce(parent_class_id, 'file:' || file_path) AS parent_id, summary, is_dead FROM sd")
def tree_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dead(spark, sf_dir).select("id", F.coalesce("parent_class_id", F.concat(F.lit("file:"), "file_path")).alias("parent_id"), "summary", "is_dead")


TREE = FOLDERS + """, pth AS (SELECT DISTINCT folder FROM fs), tree AS (
  SELECT 'folder:' || folder AS id, CASE WHEN folder LIKE '%/%' THEN 'folder:' || regexp_replace(folder, '/[^/]*$', '') ELSE 'folder:root' END AS parent_id, 'folder' AS kind, string_split(folder, '/')[-1] AS name, folder AS path FROM pth
  UNION ALL SELECT 'file:' || file_path, CASE WHEN file_path LIKE '%/%' THEN 'folder:' || regexp_replace(file_path, '/[^/]*$', '') ELSE 'folder:root' END, 'file', string_split(file_path, '/')[-1], file_path FROM ff
  UNION ALL SELECT id, coalesce(parent_class_id, 'file:' || file_path), kind, name, file_path FROM sd)"""


@query(TREE + " SELECT id, kind, name FROM tree WHERE parent_id = 'folder:src'")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.tree_nodes(with_dead(spark, sf_dir)).where("parent_id = 'folder:src'").select("id", "kind", "name")


@query(TREE + """, hit AS (SELECT * FROM tree WHERE kind NOT IN ('folder', 'file') AND name LIKE '%red%'), up AS (
  SELECT id FROM hit UNION SELECT parent_id FROM hit UNION SELECT 'file:' || path FROM hit
  UNION SELECT 'folder:' || array_to_string(string_split(path, '/')[:i], '/') FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM hit)) SELECT id, kind FROM tree WHERE id IN (SELECT id FROM up)""")
def tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.with_ancestors(rollup.tree_nodes(with_dead(spark, sf_dir)), F.col("name").like("%red%") & ~F.col("kind").isin("folder", "file")).select("id", "kind")


@query(FOLDERS + "SELECT folder, sum(classes)::BIGINT AS classes, sum(functions)::BIGINT AS functions, sum(dead)::BIGINT AS dead FROM fs WHERE i = 1 GROUP BY folder")
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.folder_stats(rollup.file_stats(with_dead(spark, sf_dir))).where("depth = 1").select("folder", "classes", "functions", "dead")


# --- macro ---------------------------------------------------------------------------------

MOD = "CASE WHEN len(string_split(file_path, '/')) < 2 THEN '根模块 (root)' WHEN string_split(file_path, '/')[1] IN ('src', 'app') AND len(string_split(file_path, '/')) > 2 THEN array_to_string(string_split(file_path, '/')[:2], '/') ELSE string_split(file_path, '/')[1] END"
MACRO = CTE + f", mo AS (SELECT *, {MOD} AS module FROM symbols), me AS (SELECT a.module AS source, b.module AS target, e.edge_ord, a.name AS caller, b.name AS callee FROM edges e JOIN mo a ON a.id = e.source JOIN mo b ON b.id = e.target WHERE a.module <> b.module), mf AS (SELECT a.file_path AS source, b.file_path AS target, e.edge_ord, a.name AS caller, b.name AS callee FROM edges e JOIN mo a ON a.id = e.source JOIN mo b ON b.id = e.target WHERE a.file_path <> b.file_path)"


@query(MACRO + " SELECT id, module FROM mo")
def module_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", macro.module_of(F.col("file_path")).alias("module"))


@query(MACRO + " SELECT module, count(*) AS symbols, count(*) FILTER (kind <> 'class') AS functions, count(*) FILTER (kind = 'class') AS classes, count(DISTINCT file_path) AS files FROM mo GROUP BY module")
def macro_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.modules(symbols(spark, sf_dir))


@query(MACRO + " SELECT count(DISTINCT module) AS modules, CASE WHEN count(DISTINCT module) <= 1 THEN 'file' ELSE 'module' END AS mode FROM mo")
def macro_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.mode(symbols(spark, sf_dir))


@query(MACRO + " SELECT source || '-->' || target AS id, source, target, count(*) AS weight FROM me GROUP BY source, target")
def macro_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.macro_edges(symbols(spark, sf_dir), edges(spark, sf_dir))


@query(MACRO + " SELECT source, target, step, caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY edge_ord, caller, callee)::INTEGER AS step FROM me) WHERE step <= 5")
def macro_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.samples(symbols(spark, sf_dir), edges(spark, sf_dir))


@query(CTE + "SELECT DISTINCT file_path FROM symbols UNION SELECT string_split(source, '#')[1] FROM edges UNION SELECT string_split(target, '#')[1] FROM edges")
def macro_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.macro_files(symbols(spark, sf_dir), edges(spark, sf_dir))


@query(MACRO + " SELECT source || '-->' || target AS id, source, target, count(*) AS weight FROM mf GROUP BY source, target")
def macro_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.macro_edges(symbols(spark, sf_dir), edges(spark, sf_dir), unit="file")


@query(CTE + ", ent AS (SELECT DISTINCT file_path FROM symbols WHERE pk % 31 = 0), us AS (SELECT DISTINCT s.file_path FROM calls_raw c JOIN symbols s ON s.id = c.target WHERE c.line % 60 = 0) SELECT DISTINCT file_path, file_path IN (SELECT file_path FROM ent) OR file_path IN (SELECT file_path FROM us) AS is_script FROM symbols")
def macro_script_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are files of every 31st part; calls from every third order count as top-level usages."""
    n = symbols(spark, sf_dir)
    own = usages(spark, sf_dir).join(n.select(F.col("id").alias("target_id"), "file_path"), "target_id").withColumn("is_top_level_script", F.expr("line % 60 = 0"))
    return macro.script_flags(n.select("file_path").distinct(), n.where("pk % 31 = 0").select("file_path").distinct(), own)
