"""Gapless ranks inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based rank of each row in its group, ordered by (bucket, order).

    ``bucket`` cuts a group into parts that one task can sort. Parts are counted first (with
    map-side aggregation, so a hot group costs one row per part); running sums of those counts
    give each part its first rank, and only the rows of one part are ranked together. A group
    column that is null forms a group of its own.
    """
    df = df.withColumn("__b", bucket)
    keys = [*group, "__b"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before if group else W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    part = W.partitionBy(*keys).orderBy(*order)
    return (
        df.join(first, match, "left")
        .withColumn(name, F.col("__first") + F.row_number().over(part) - 1)
        .drop("__b", "__first", *[f"__k{i}" for i in range(len(keys))])
    )
