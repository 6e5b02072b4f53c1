"""The driver's Parquet tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("nation", "supplier", "part", "lineitem")) -> SparkSession:
    """Make the tables of ``sf_dir`` visible to SQL and return the session."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark
