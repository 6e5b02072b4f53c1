"""Debounced events and rescans on file changes, as batch windows and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of_burst(events: DataFrame, key: str, time: str, order: str, gap_seconds: float) -> DataFrame:
    """The events after which their key is quiet for ``gap_seconds``."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    following = F.lead(at).over(W.partitionBy(key).orderBy(time, order))
    quiet = following - at >= F.lit(int(gap_seconds * 1_000_000))
    return events.withColumn("__quiet", following.isNull() | quiet).where("__quiet").drop("__quiet")


def debounced_stream(events: DataFrame, key: str, time: str, value: str, gap: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """(key, value, at): the last event of each session of a stream; state is one row per open session."""
    sessions = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return sessions.agg(F.max_by(value, time).alias(value), F.max(time).alias("at")).select(key, value, "at")


def suppressed(events: DataFrame, navigations: DataFrame, key: str, time: str, window_ms: int = 600) -> DataFrame:
    """Events that don't come within ``window_ms`` after a navigation of the same key."""
    nav = navigations.select(F.col(key).alias("__k"), F.col(time).alias("__t"))
    after = F.unix_millis(F.col(time).cast("timestamp")) - F.unix_millis(F.col("__t").cast("timestamp"))
    return events.join(nav, (F.col(key) == F.col("__k")) & after.between(0, window_ms), "left_anti")


def watch_files(stream: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str):  # noqa: ANN201
    """Run ``refresh`` on each batch of changed files until all that is there has been seen."""
    return stream.writeStream.foreachBatch(lambda batch, _: refresh(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
