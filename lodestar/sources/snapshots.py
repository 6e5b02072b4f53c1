"""Snapshots of extracted tables: one Parquet folder per table, and a manifest that is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = "1.0"


def save(tables: dict[str, DataFrame], path: str) -> str:
    """Write the tables under a fresh version and point the manifest at it; readers never see half a write."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    rows = [(VERSION, version, name) for name in tables]
    spark.createDataFrame(rows, "format string, version string, name string").withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the latest snapshot; None where there is none or its format differs."""
    try:
        last = spark.read.parquet(f"{path}/manifest").where(F.col("format") == VERSION)
        newest = last.agg(F.max_by("version", "saved")).first()[0]
        names = [r["name"] for r in last.where(F.col("version") == newest).select("name").collect()]
        return {n: spark.read.parquet(f"{path}/{newest}/{n}") for n in names} or None
    except AnalysisException:
        return None
