"""Numbers along an order, without one task or the driver ever holding what is numbered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.sources.stages import stage

IN_RANGE = (1 << 33) - 1


def prefix_sums(df: DataFrame, order: Sequence[str | Column], weight: Column, out: str, name: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over all rows before each one in ``order``.

    Rows are cut into ranges of the order, each sorted in its own task. What reaches the driver is one
    sum per range, and each range's rows then add theirs. Rows that ``order`` doesn't tell apart stand
    in some order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stage(dealt.withColumn("__weight", weight.cast("long")).withColumn("__part", F.shiftright("__at", 33)), f"{name}-ranges")
    first, starts = 0, {}
    for r in sorted(placed.groupBy("__part").agg(F.sum("__weight").alias("s")).collect()):
        starts[r["__part"]] = first
        first += r["s"]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in (starts or {0: 0}).items() for x in kv]), F.col("__part"))
    before = F.sum("__weight").over(W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn(out, base + F.coalesce(before, F.lit(0))).drop("__at", "__weight", "__part")


def numbered(df: DataFrame, out: str, name: str) -> tuple[DataFrame, int]:
    """``df`` as a stage table with ``out``: numbers from 0 without gaps, in any order; and how many rows there are.

    Rows keep their tasks, so nothing is sorted or shuffled, and one count per task reaches the driver.
    """
    placed = stage(df.withColumn("__at", F.monotonically_increasing_id()), f"{name}-numbered")
    part, total, starts = F.shiftright("__at", 33), 0, {}
    for p, n in sorted(placed.groupBy(part).count().collect()):
        starts[p] = total
        total += n
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in (starts or {0: 0}).items() for x in kv]), part)
    return placed.withColumn(out, base + F.col("__at").bitwiseAND(IN_RANGE)).drop("__at"), total
