"""Summaries by an attached model: prompts as columns, calls in partitions, results as rows.

The model is any callable from a list of prompts to a list of answers; tests use a stub.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.operators.calls import Config, Model, pooled
from lodestar.operators.folds import folded
from lodestar.operators.incremental import content_hash

#: fixed values: how much of a text a prompt quotes, how many functions share one
SNIPPET, BATCH_SNIPPET, FILE_CHARS, BATCH = 2500, 1500, 2200, 3
MARK = "=== SYMBOL: "


def symbol_prompt(name: Column, snippet: Column) -> Column:
    return F.concat(F.lit("Summarise the symbol "), name, F.lit(":\n"), F.substring(snippet, 1, SNIPPET))


def micro_batches(functions: DataFrame) -> DataFrame:
    """(file_path, batch, names, prompt): functions of a file by threes, one prompt each."""
    n = F.row_number().over(W.partitionBy("file_path").orderBy("sym_ord", "name")) - 1
    one = F.struct((n % BATCH).alias("k"), "name", F.substring("snippet", 1, BATCH_SNIPPET).alias("s"))
    grouped = functions.withColumn("batch", F.floor(n / BATCH)).withColumn("one", one).groupBy("file_path", "batch").agg(F.array_sort(F.collect_list("one")).alias("own"))
    text = F.array_join(F.transform("own", lambda x: F.concat(F.lit(MARK), x["name"], F.lit(" ===\n"), x["s"])), "\n")
    return grouped.select("file_path", "batch", F.col("own.name").alias("names"), text.alias("prompt"))


def ask(prompts: DataFrame, model: Model, config: Config = Config(), fallback: Model | None = None) -> DataFrame:
    """``prompts`` with columns answer and error: ``config.concurrency`` calls of a task at a time, each with its deadline.

    A call that fails or isn't back in time leaves a null answer and its error, and no other row is touched.
    """

    def call(batches: Iterable) -> Iterator:  # noqa: ANN001
        for pdf in batches:
            out = pooled(model, list(pdf["prompt"]), config, fallback)
            yield pdf.assign(answer=[a for a, _ in out], error=[e for _, e in out])

    fields = [f for f in prompts.schema.fields if f.name not in ("answer", "error")]
    return prompts.select(*[f.name for f in fields]).mapInPandas(call, StructType([*fields, StructField("answer", StringType()), StructField("error", StringType())]))


def split_answers(asked: DataFrame) -> DataFrame:
    """(file_path, symbol, summary): an answer cut at its marks; without marks it belongs to the first name."""
    parts = F.split("answer", MARK)
    marked = F.contains(F.col("answer"), F.lit(MARK))
    rows = F.when(marked, F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*?)\s*===", 1)).alias("symbol"), strip(F.regexp_replace(p, r"^.*?===\s*", "")).alias("summary")))).otherwise(F.array(F.struct(F.get("names", F.lit(0)).alias("symbol"), strip(F.col("answer")).alias("summary"))))
    return asked.where("answer is not null").select("file_path", F.explode(rows).alias("r")).select("file_path", "r.symbol", clean_markdown(F.col("r.summary")).alias("summary"))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; trim alone takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_markdown(text: Column) -> Column:
    """Without a code fence around it and without outer quotes."""
    bare = F.regexp_replace(strip(text), r"(?s)^```\w*\n?(.*?)\n?```$", "$1")
    return strip(F.regexp_replace(bare, r"^[\"'](.*)[\"']$", "$1"))


def summarise(files: DataFrame, cache: DataFrame, model: Model) -> dict[str, DataFrame]:
    """Bottom-up summaries of files, folders and the project; files whose hash is cached are not asked again."""
    hashed = files.select("file_path", "content", content_hash(F.col("content")).alias("content_hash"))
    known = hashed.join(cache.select("file_path", "content_hash", "summary"), ["file_path", "content_hash"])
    new = hashed.join(cache.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")
    asked = ask(new.select("file_path", "content_hash", F.concat(F.lit("Summarise the file "), "file_path", F.lit(":\n"), F.substring("content", 1, FILE_CHARS)).alias("prompt")), model)
    file_level = known.select("file_path", "content_hash", "summary").unionByName(asked.select("file_path", "content_hash", clean_markdown(F.col("answer")).alias("summary")))
    folder = F.when(F.contains(F.col("file_path"), F.lit("/")), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit("root"))
    told = file_level.select(folder.alias("key"), F.col("file_path").alias("ord"), F.concat("file_path", F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, 150)).alias("text"))
    folders = folded(told, answers(model)).select(F.col("key").alias("folder"), F.col("text").alias("summary"))
    above = folders.select(F.lit("project").alias("key"), F.col("folder").alias("ord"), F.concat("folder", F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, 200)).alias("text"))
    return {"files": file_level, "folders": folders, "project": folded(above, answers(model)).select(F.col("text").alias("summary"))}


def answers(model: Model, config: Config = Config()):  # noqa: ANN201
    """The step of a fold that asks the model about every chunk."""

    def step(chunks: DataFrame) -> DataFrame:
        said = ask(chunks.withColumnRenamed("text", "prompt"), model, config)
        return said.withColumn("text", clean_markdown(F.col("answer")))

    return step
