"""Macro graph: symbol edges summed to modules or files, with sample calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: fixed value: the module of files without a folder
ROOT = "根模块 (root)"
SAMPLES = 5


def module_of(path: Column) -> Column:
    """src/ and app/ with something below count with their next folder; a bare file is in the root module."""
    parts = F.split(path, "/")
    two = F.get(parts, F.lit(0)).isin("src", "app") & (F.size(parts) > 2)
    return F.when(F.size(parts) < 2, F.lit(ROOT)).when(two, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def modules(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(module_of(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("kind") != "class").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_distinct("file_path").alias("files"))


def mode(symbols: DataFrame) -> DataFrame:
    """One row: 'file' where modules would say too little (one, or two with the root among them), else 'module'."""
    m = symbols.select(module_of(F.col("file_path")).alias("m")).distinct().agg(F.count(F.lit(1)).alias("modules"), F.max((F.col("m") == ROOT).cast("int")).alias("root"))
    return m.select("modules", F.when((F.col("modules") <= 1) | ((F.col("root") == 1) & (F.col("modules") <= 2)), F.lit("file")).otherwise(F.lit("module")).alias("mode"))


def ends(symbols: DataFrame, edges: DataFrame, unit: str) -> DataFrame:
    """Edges with the module (or file) and name of both ends; an end that is no symbol counts as the path before its #."""
    own = module_of(F.col("file_path")) if unit == "module" else F.col("file_path")
    at = symbols.groupBy("id").agg(F.min(F.struct(own.alias("unit"), "name")).alias("s"))
    a = at.select(F.col("id").alias("__a"), F.col("s.unit").alias("ua"), F.col("s.name").alias("na"))
    b = at.select(F.col("id").alias("__b"), F.col("s.unit").alias("ub"), F.col("s.name").alias("nb"))
    joined = edges.join(a, F.col("source") == F.col("__a"), "left").join(b, F.col("target") == F.col("__b"), "left")
    name = lambda n, end: F.coalesce(n, end if unit == "module" else F.substring_index(end, "#", -1))
    return joined.select("edge_ord", F.coalesce("ua", F.substring_index("source", "#", 1)).alias("source"), F.coalesce("ub", F.substring_index("target", "#", 1)).alias("target"), name(F.col("na"), F.col("source")).alias("caller"), name(F.col("nb"), F.col("target")).alias("callee")).where("source <> target")


def macro_edges(symbols: DataFrame, edges: DataFrame, unit: str = "module") -> DataFrame:
    """(id, source, target, weight): edges between different units."""
    found = ends(symbols, edges, unit).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return found.select(F.concat("source", F.lit("-->"), "target").alias("id"), "source", "target", "weight")


def samples(symbols: DataFrame, edges: DataFrame, unit: str = "module", n: int = SAMPLES) -> DataFrame:
    """(source, target, step, caller, callee): the first ``n`` edges of each pair.

    The row limit is pushed into the window, so each task keeps n rows of a pair before the shuffle.
    """
    w = W.partitionBy("source", "target").orderBy("edge_ord", "caller", "callee")
    return ends(symbols, edges, unit).withColumn("step", F.row_number().over(w)).where(F.col("step") <= n).select("source", "target", "step", "caller", "callee")


def macro_files(symbols: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(file_path): files of symbols, of edge ends and of script entries."""
    found = symbols.select("file_path").unionByName(edges.select(F.explode(F.array(F.substring_index("source", "#", 1), F.substring_index("target", "#", 1))).alias("file_path")))
    return (found if entries is None else found.unionByName(entries.select("file_path"))).distinct()


def script_flags(files: DataFrame, entries: DataFrame, usages: DataFrame) -> DataFrame:
    """(file_path, is_script): entry files, and files one of whose functions their own top level uses."""
    own = usages.where("is_top_level_script").select("file_path").unionByName(entries.select("file_path")).distinct().select(F.col("file_path").alias("__f"))
    return files.join(own, F.col("file_path") == F.col("__f"), "left").select("file_path", F.col("__f").isNotNull().alias("is_script"))
