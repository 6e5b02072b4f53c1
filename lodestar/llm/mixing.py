"""Mixing sources to target weights by hash-threshold histograms (operator 6); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

LEVELS, HEX_PER_LEVEL = 3, 3


def n_words(text: Column) -> Column:
    """Number of maximal runs of anything but \\x20 and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, split by weight and capped.

    ``sizes(source, source_size)`` has one row per source. Weights go by code point of the
    source, null last, repeating. A target stops at ``most`` times its source's size; what is
    over is shared again by weight among the others, until none is above. Sources in the order
    of cap over weight fill up first, so one pass over the running sums finds the level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("w", w).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), "level"))).over(whole)
    water = leveled.withColumn("water", first["level"])
    return water.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))).alias("target"))


def _hash(seed: str) -> Column:
    """The first hex digits of a seeded hash of the doc_id; of the text where there is no doc_id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, LEVELS * HEX_PER_LEVEL)


def thresholds(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, base, prefix, whole): what each source takes of ``rows(source, size, h)``.

    A document is taken ``base`` times, and once more if its hash is below ``prefix`` or, where
    ``whole``, equal to it. Sizes are summed by source and hash bucket; only the bucket that
    holds a budget's boundary is summed again, by the next digits.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = source_targets(sizes, weights, share, most).withColumn("base", F.when(F.col("target") >= F.col("source_size"), F.lit(1)).otherwise(F.lit(0)))
    zero = F.lit(0).cast("long")
    cut = stage(budgets.select("*", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"), F.lit("").alias("prefix"), zero.alias("below"), zero.alias("cell")), "mix-targets")
    for k in range(1, LEVELS + 1):
        at = cut.select(F.col("source").alias("s"), "prefix", "below", "budget")
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
        bins = inside.groupBy("source", F.substring("h", 1, k * HEX_PER_LEVEL).alias("bin")).agg(F.sum("size").alias("cell"), F.min("below").alias("start"), F.min("budget").alias("budget"))
        run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("below", F.col("start") + F.coalesce(F.sum("cell").over(run), F.lit(0)))
        # the boundary is in the last bin that starts at or under the budget
        edge = bins.where("below <= budget").groupBy("source").agg(F.max(F.struct("bin", "below", "cell")).alias("e")).select(F.col("source").alias("s"), "e")
        kept = [F.coalesce(F.col(f"e.{new}"), F.col(old)).alias(old) for new, old in (("bin", "prefix"), ("below", "below"), ("cell", "cell"))]
        cut = stage(cut.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", "budget", *kept), f"mix-level{k}")
    nearer = F.abs(F.col("below") + F.col("cell") - F.col("budget")) < F.abs(F.col("below") - F.col("budget"))
    return cut.select("source", "source_size", "target", "base", "prefix", nearer.alias("whole"))


def _copies() -> Column:
    under = (F.col("h") < F.col("prefix")) | (F.col("whole") & (F.col("h") == F.col("prefix")))
    return F.col("base") + F.when(under, F.lit(1)).otherwise(F.lit(0))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), _hash(seed).alias("h"))
    return stage(rows, "mix-rows")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs(doc_id, text, source)``.

    Every document has a fixed hash of its doc_id. A source whose target is below its size
    takes the documents under a hash threshold, one above it takes all of them and those under
    the threshold once more, so a larger budget always contains a smaller one; at the last
    level the boundary cell is taken if that comes nearer. No row is sorted. Null texts have
    size 0, a null source is a source of its own, rows without doc_id are hashed by their text,
    and rows with equal ids of one source share one hash and one fate. An empty table gives no
    rows; other columns are not read.
    """
    rows = _sized(docs, seed)
    cut = thresholds(rows, weights, share, most).withColumnRenamed("source", "s")
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies())
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once or repeated; same columns.

    Texts meet only the table of thresholds, one row per source, and are not shuffled.
    """
    cut = thresholds(_sized(docs, seed), weights, share, most).select(F.col("source").alias("__s"), "base", "prefix", "whole")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("source").cast("string").alias("__source"), _hash(seed).alias("h"))
    joined = own.join(cut, F.col("__source").eqNullSafe(F.col("__s"))).where(_copies() > 0)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), _copies()))).select("__row.*")
