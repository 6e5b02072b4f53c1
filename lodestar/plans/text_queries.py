"""Text operators of extraction, over one-line code texts made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.extract import language_of
from lodestar.plans.canonical import CTE, symbols, usages
from lodestar.plans.registry import query
from lodestar.sources import reports
from lodestar.sources.tables import register


@query(CTE + ", p AS (SELECT file_path || CASE sym_ord % 5 WHEN 0 THEN '' WHEN 1 THEN '.ts' WHEN 2 THEN '.TSX' WHEN 3 THEN '.js' ELSE '.txt' END AS f FROM symbols) SELECT CASE lower(regexp_extract(f, '\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' END AS language, count(*) AS files FROM p GROUP BY 1")
def ext_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("sym_ord") % 5
    ext = F.when(o == 0, "").when(o == 1, ".ts").when(o == 2, ".TSX").when(o == 3, ".js").otherwise(".txt")
    return symbols(spark, sf_dir).select(language_of(F.concat("file_path", ext)).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query(CTE + "SELECT id, replace(replace(file_path, '/', chr(92)), chr(92), '/') AS path FROM symbols")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", T.normalize_path(F.translate("file_path", "/", "\\")).alias("path"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS cut FROM documents")
def slice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", reports.source_lines(F.col("text"), F.lit(2), F.lit(4)).alias("cut"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'pkg.' || lower(p_type) ELSE '.' || lower(p_type) END AS module, 'n' || p_size AS symbol FROM part")
def imports_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 3
    module = F.concat(F.when(k == 0, F.lit("")).when(k == 1, F.lit("pkg.")).otherwise(F.lit(".")), F.lower("p_type"))
    code = F.concat(F.lit("from "), module, F.lit(" import n"), "p_size", F.lit(" as a"))
    pattern = r"^from\s+([\w.]+)\s+import\s+(\w+)"
    return p.select("p_partkey", F.regexp_extract(code, pattern, 1).alias("module"), F.regexp_extract(code, pattern, 2).alias("symbol"))


@query("SELECT o_orderkey, unnest(['load', 'obj.save' || (o_orderkey % 7), 'f' || o_custkey]) AS callee FROM orders")
def call_sites_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.operators.extract import KEYWORDS, call_chain

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code = F.concat(F.lit("if (load(x)): obj.save"), F.col("o_orderkey") % 7, F.lit("(f"), "o_custkey", F.lit(" (1))"))
    return o.select("o_orderkey", F.explode(call_chain(code, KEYWORDS)).alias("c")).select("o_orderkey", F.col("c.callee").alias("callee"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'class_method' WHEN 1 THEN 'static_method' WHEN 2 THEN 'async_function' ELSE 'method' END AS kind FROM part")
def method_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 4
    decorators = F.when(k == 0, F.array(F.lit("@cached"), F.lit("@classmethod"))).when(k == 1, F.array(F.lit("@staticmethod"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", T.method_kind(decorators, k == 2).alias("kind"))


@query(CTE + "SELECT id, CASE WHEN sym_ord % 2 = 0 THEN name IN ('S2', 'S4') ELSE sym_ord % 3 = 0 END AS exported FROM symbols WHERE kind = 'class'")
def export_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("sym_ord") % 3 == 0, F.lit("a/__init__.py")).otherwise(F.col("file_path"))
    names = F.when(F.col("sym_ord") % 2 == 0, F.array(F.lit("S2"), F.lit("S4")))
    return symbols(spark, sf_dir).where("kind = 'class'").select("id", T.export_flag(F.col("name"), path, names).alias("exported"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part")
def split_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", T.split_top_level(F.translate("p_name", " ", ","), F.lit(",")).alias("parts"))


SHAPES = ["None", "True", '"a b"', "42", "-1.5", "[1, 2]", "{}", "{1: 2}", "{1, 2}", "(1, 2)", "a == b", "a / b", "a + b", "User(1)", "plain"]
KINDS = ["None", "bool", "str", "int", "float", "list", "dict", "dict", "set", "tuple", "bool", "float", "int", "User", None]


@query("SELECT p_partkey, [" + ", ".join(f"'{k}'" if k else "NULL" for k in KINDS) + "][p_partkey % 15 + 1] AS kind FROM part")
def infer_literal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    shape = F.get(F.array(*[F.lit(s) for s in SHAPES]), (F.col("p_partkey") % 15).cast("int"))
    return p.select("p_partkey", T.literal_type(shape).alias("kind"))


@query(CTE + "SELECT s.file_path, row_number() OVER (PARTITION BY s.file_path ORDER BY c.line, c.col, c.target, c.source)::INTEGER AS step, substr(c.target, 1, 60) AS call_snippet FROM calls_raw c JOIN symbols s ON s.id = c.source WHERE c.line % 100 = 0")
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every fifth order line stand for module-level calls."""
    from pyspark.sql import Window as W

    u = usages(spark, sf_dir).where("line % 100 = 0").join(symbols(spark, sf_dir).select(F.col("id").alias("caller_symbol_id"), "file_path"), "caller_symbol_id")
    step = F.row_number().over(W.partitionBy("file_path").orderBy("line", "col", "target_id", "caller_symbol_id"))
    return u.select("file_path", step.alias("step"), F.substring("target_id", 1, 60).alias("call_snippet"))


@query(CTE + "SELECT string_split(file_path, '/')[1] AS module, string_agg('- ' || name || ' (' || kind || ')', chr(10) ORDER BY '- ' || name || ' (' || kind || ')') AS body FROM symbols WHERE kind = 'class' GROUP BY 1")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = register(spark, sf_dir) and symbols(spark, sf_dir).where("kind = 'class'")
    return reports.sections(n, F.get(F.split("file_path", "/"), F.lit(0)))
