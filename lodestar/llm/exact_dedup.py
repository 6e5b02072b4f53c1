"""Exact deduplication by a tree-merge of sorted digest runs (operator 9); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

RUNS, FAN_IN, CUTS = 64, 4, 256
KEY = ["sha", "check", "n_bytes"]


def digests(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """(doc_id, sha, check, n_bytes, run): the digest of each whole text and what verifies it.

    ``check`` (a second, unrelated hash) and the byte length travel with the digest, so that
    two texts count as equal only where all three agree.
    """
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int"))


def cut_of(cuts: int) -> Column:
    """Which of ``cuts`` equal ranges of digests a digest lies in, in order of digests."""
    head = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    return F.floor(head * F.lit(cuts) / F.lit(float(1 << 32))).cast("int")


def first_runs(rows: DataFrame) -> DataFrame:
    """(run, sha, check, n_bytes, keep_id, group_size): each run with one entry a digest.

    Every task reduces what it reads before it gives anything away, so a text that fills a
    third of all rows leaves it as one entry a run.
    """
    return rows.groupBy("run", *KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def merge_round(level: DataFrame, fan_in: int, cuts: int) -> DataFrame:
    """Merge ``fan_in`` neighbouring runs into one, cut into ``cuts`` ranges of digests.

    A cell (run, range) goes to one task, which sorts its runs into one and passes over it
    once: entries that agree in digest, second hash and length stand side by side, at most
    ``fan_in`` of them, and the first, with the largest identifier, stays with the sum of
    their sizes. The result is a sorted run again.
    """
    cell = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("cut", cut_of(cuts)).repartition("run", "cut")
    equal = W.partitionBy("run", "cut", *KEY).orderBy(F.col("keep_id").desc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = W.partitionBy("run", "cut", *KEY).orderBy(F.col("keep_id").desc_nulls_last())
    merged = cell.select("run", *KEY, "keep_id", F.sum("group_size").over(equal).alias("group_size"), F.row_number().over(first).alias("at"))
    return merged.where("at = 1").drop("at")


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """(sha, check, n_bytes, keep_id, group_size) for all texts, by a tree of merges over sorted digest runs.

    Tasks exchange runs as in a butterfly: with every round a task holds fewer runs, but a
    smaller range of digests of each, so all rounds, the last too, are spread over all tasks.
    """
    level, left = first_runs(rows), runs
    while left > 1:
        left = -(-left // fan_in)
        level = merge_round(level, fan_in, CUTS * -(-runs // left))
    return level.drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs(doc_id, text)``.

    Null counts as the empty text; texts are equal when their bytes are. The largest doc_id of
    a group stays. Rows that repeat it are all marked kept, since they can't be told apart. A
    row without doc_id counts in group_size and stays only if no row of its group has one; an
    empty table gives no rows. Other columns are not read.
    """
    rows = stage(digests(docs), "exact-rows")
    groups = stage(merge_runs(rows).where("group_size > 1"), "exact-groups").select(F.col("sha").alias("g_sha"), F.col("check").alias("g_check"), F.col("n_bytes").alias("g_bytes"), "keep_id", "group_size")
    same = (F.col("sha") == F.col("g_sha")) & (F.col("check") == F.col("g_check")) & (F.col("n_bytes") == F.col("g_bytes"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, same, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` doesn't keep; rows that repeat are one row."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(text, 256)) == F.col("__sha")), "left_semi").dropDuplicates(["doc_id", "text"])
