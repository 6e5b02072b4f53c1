"""Change detection and summary caches: joins of what is with what was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_MS = 1.0


def diff_status(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(file_path, status): new, modified (times at least 1 ms apart, or unknown), reusable or deleted.

    ``files(file_path, mtime)`` and ``snapshot(file_path, mtime)`` hold milliseconds.
    """
    now, was = files.select("file_path", F.col("mtime").alias("now")), snapshot.select(F.col("file_path").alias("__p"), F.col("mtime").alias("was"))
    joined = now.join(was, F.col("file_path") == F.col("__p"), "full")
    same = F.coalesce(F.abs(F.col("now") - F.col("was")) < TOLERANCE_MS, F.lit(False))
    status = F.when(F.col("__p").isNull(), F.lit("new")).when(F.col("file_path").isNull(), F.lit("deleted")).when(same, F.lit("reusable")).otherwise(F.lit("modified"))
    return joined.select(F.coalesce("file_path", "__p").alias("file_path"), status.alias("status"))


def deleted_files(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    return snapshot.join(files.select("file_path"), "file_path", "left_anti").select("file_path")


def all_valid(status: DataFrame) -> DataFrame:
    """One row: is the whole snapshot still valid?"""
    return status.agg((F.count_if(F.col("status") != "reusable") == 0).alias("valid"))


def content_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(file_path, hit): a cached entry holds only for the same content; a file without content takes any."""
    was = cache.select(F.col("file_path").alias("__p"), F.col("content_hash").alias("__h"))
    joined = files.select("file_path", content_hash(F.col("content")).alias("h")).join(was, F.col("file_path") == F.col("__p"), "left")
    return joined.select("file_path", (F.col("__p").isNotNull() & (F.col("h").isNull() | (F.col("h") == F.col("__h")))).alias("hit"))


def merge_summaries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, symbol, summary): one row per symbol; new summaries win."""
    return cache.join(new.select("file_path", "symbol"), ["file_path", "symbol"], "left_anti").unionByName(new)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def upsert_flows(flows: DataFrame, new: DataFrame) -> DataFrame:
    """A flow replaces those with its id or its name."""
    return flows.join(new.select("id"), "id", "left_anti").join(new.select("name"), "name", "left_anti").select(*flows.columns).unionByName(new)


def delete_flow(flows: DataFrame, flow_id: str) -> DataFrame:
    return flows.where(F.col("id") != flow_id)
