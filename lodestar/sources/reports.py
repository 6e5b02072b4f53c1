"""Text that leaves the engine: report sections and source excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.folds import LIMIT, PIECE, chunked


def source_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, counted from 1."""
    return F.array_join(F.slice(F.split(content, "\r?\n"), start, end - start + 1), "\n")


def sections(symbols: DataFrame, module: Column) -> DataFrame:
    """(module, body): one Markdown list per module, which must fit a row; ``section_parts`` has no such bound."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")"))
    return symbols.groupBy(module.alias("module")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))


def section_parts(symbols: DataFrame, module: Column, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """(key, chunk, text, n): the lines of ``sections`` in rows of at most ``limit`` characters, for modules of any size."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")"))
    return chunked(symbols.select(module.alias("key"), line.alias("ord"), line.alias("text")), limit, piece, "report")


def write_report(symbols: DataFrame, files: DataFrame, project: str, path: str) -> None:
    """A Markdown report: project, modules, files (entries marked) and their symbols, as text files in order."""
    entry = F.when(F.col("is_script"), F.lit(" (entry)")).otherwise(F.lit(""))
    folder = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    heads = files.select(folder(F.col("file_path")).alias("m"), F.col("file_path").alias("f"), F.lit("").alias("s"), F.concat(F.lit("## "), "file_path", entry).alias("value"))
    rows = symbols.select(folder(F.col("file_path")).alias("m"), F.col("file_path").alias("f"), F.col("id").alias("s"), F.concat(F.lit("- "), "name", F.lit(" ("), "kind", F.lit(")")).alias("value"))
    title = symbols.sparkSession.createDataFrame([("", "", "", f"# {project}")], "m string, f string, s string, value string")
    title.unionByName(heads).unionByName(rows).orderBy("m", "f", "s").select("value").write.mode("overwrite").text(path)
