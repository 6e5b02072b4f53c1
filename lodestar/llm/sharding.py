"""Sharding by proportional stratified interleaving (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranking import bucketed_rank
from lodestar.llm.staging import stage

PART_ROWS = 100_000


def interleave(docs: DataFrame, shards: int = 24, seed: str = "shard") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row of ``docs(doc_id, text, source)``.

    Rows are shuffled within their source by a seeded hash and ranked; the r-th of n gets the
    fraction (r + u) / n, where u in [0, 1) is fixed by the source. Sorted by fraction, every
    run of rows holds each source in proportion, and the order is cut into ``shards`` runs
    whose row counts differ by at most one. Both orders are taken in hash or fraction ranges,
    with counted offsets, never in one task. A null source is a stratum of its own; rows
    without doc_id and repeated rows are told apart by text and then interchangeable. Null
    texts have no bytes and crc32 of the empty text; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), text)).alias("h"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bits = max(8, (total // PART_ROWS).bit_length())
    order = [F.col(c) for c in ("h", "doc_id", "text_crc32", "size")]
    ranked = bucketed_rank(rows, ["source"], F.shiftright(F.col("h"), 64 - bits), order, "r")
    strata = stage(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), "n"), "shard-strata")
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    timed = stage(ranked.join(strata, F.col("source").eqNullSafe(F.col("s"))).withColumn("f", (F.col("r") + u) / F.col("n")).drop("s", "n", "r"), "shard-fractions")
    placed = bucketed_rank(timed, [], F.floor(F.col("f") * F.lit(1 << bits)), [F.col("f"), F.col("source"), *order], "at")
    n = max(total, 1)
    cut = placed.withColumn("shard", F.expr(f"cast(at * {shards} div {n} as int)"))
    slot = F.expr(f"at - (shard * {n}L + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: str = "shard") -> None:
    """Write ``docs`` as one folder per shard, each in slot order. Rows need distinct doc_ids."""
    where = interleave(docs, shards, seed).select(F.col("doc_id").alias("__id"), "shard", "slot")
    placed = docs.join(where, F.col("doc_id") == F.col("__id")).drop("__id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
