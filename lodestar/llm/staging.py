"""Stage tables: materialised intermediate results in the folder all executors share.

A stage table cuts lineage the way ``checkpoint()`` does, but as compressed Parquet, so a lost
executor costs a re-read and never a recomputation of what went before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for stage tables, read from ``spark.checkpoint.dir``.

    Where that setting is absent a local session (tests) uses a folder beside its warehouse;
    on a cluster the setting is required, because a machine-local folder would not be shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
