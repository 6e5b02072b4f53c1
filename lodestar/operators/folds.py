"""Many short texts under a key folded to one, by steps that never hold more than a bounded text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ranges import prefix_sums
from lodestar.sources.stages import stage

#: characters that a row of joined texts may have, and those that each text keeps in it
LIMIT, PIECE = 8000, 200


def chunked(rows: DataFrame, limit: int = LIMIT, piece: int = PIECE, name: str = "fold") -> DataFrame:
    """(key, chunk, text, n): the texts of ``rows(key, ord, text)`` in order, joined by line breaks.

    Each text is cut to ``piece`` characters, and a chunk ends before it would pass ``limit`` (which must be
    at least twice ``piece``): places come from running sums over ranges, so a key may have any
    number of texts. Null texts are empty. Chunks of a key count upwards, with gaps.
    """
    if limit < 2 * (piece + 1):
        raise ValueError("limit must leave room for two pieces")
    cut = rows.select("key", "ord", F.substring(F.coalesce("text", F.lit("")), 1, piece).alias("text"))
    summed = prefix_sums(cut, ["key", "ord", "text"], F.length("text") + 1, "before", name)
    first = summed.groupBy("key").agg(F.min("before").alias("first"))
    # a text that starts in a stride of limit - piece ends within limit
    placed = summed.join(first.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key"))).withColumn("chunk", F.floor((F.col("before") - F.col("first")) / (limit - piece - 1)))
    return placed.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("before", "text"))).alias("l")).select("key", "chunk", F.array_join("l.text", "\n").alias("text"), F.size("l").alias("n"))


def folded(rows: DataFrame, answer: Callable[[DataFrame], DataFrame], limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """(key, text): one text per key of ``rows(key, ord, text)``, where ``answer`` turns (key, chunk, text) into shorter texts.

    Keys whose texts fill several chunks get an answer to each, and those are folded in turn: each round
    divides their number by ``limit / piece`` about, so rounds are few.
    """
    done, step = None, 0
    while True:
        parts = stage(chunked(rows, limit, piece, f"fold-{step}"), f"fold-chunks-{step}")
        counts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("key", "__key")
        marked = parts.join(counts, F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
        said = stage(answer(marked).select("key", F.col("chunk").alias("ord"), "text", "m"), f"fold-answers-{step}")
        whole = said.where("m = 1").select("key", "text")
        done = whole if done is None else done.unionByName(whole)
        rows = said.where("m > 1").select("key", "ord", "text")
        step += 1
        if rows.isEmpty():
            return done
