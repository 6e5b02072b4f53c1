"""Which interval holds a point: an equality join on cells whose width follows the interval's length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: widths of cells are powers of four: few levels to ask for, and never more than five cells for an interval
WIDTHS = tuple(4**i for i in range(16))


def level_of(length: Column) -> Column:
    """The widest level whose cells are no longer than the interval; points count as 1."""
    out = F.lit(0)
    for i, w in enumerate(WIDTHS[1:], 1):
        out = F.when(length >= w, F.lit(i)).otherwise(out)
    return out


def width_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), level + 1)


def cells(spans: DataFrame) -> DataFrame:
    """``spans`` with ``level`` and ``cell``: the cells of its level that each interval [start, end] meets."""
    sized = spans.where("end >= start").withColumn("level", level_of(F.col("end") - F.col("start") + 1))
    w = width_of(F.col("level"))
    return sized.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor(F.col("end") / w))))


def containing(points: DataFrame, spans: DataFrame, on: str = "file_path") -> DataFrame:
    """Each point(on, line, ...) with each span(on, start, end, ...) that holds it; other column names must differ.

    An interval lies in at most five cells of its level and a point asks one cell of each level that ``on``
    has, so the join grows with points, spans and hits alone, however long the file. Keys are
    (on, level, cell): a file with very many spans is spread over its cells. Null keys, and
    intervals that end before they start, hold nothing.
    """
    laid = cells(spans)
    levels = laid.select(on, "level").distinct().groupBy(on).agg(F.collect_set("level").alias("levels"))
    asked = points.join(levels, on).withColumn("level", F.explode("levels")).drop("levels")
    asked = asked.withColumn("cell", F.floor(F.col("line") / width_of(F.col("level"))))
    return asked.join(laid, [on, "level", "cell"]).where(F.col("line").between(F.col("start"), F.col("end"))).drop("level", "cell")


def innermost(points: DataFrame, spans: DataFrame, on: str = "file_path") -> DataFrame:
    """(on, line, id): the shortest span(on, start, end, id, kind) around each distinct point.

    Of equally long ones a function or method goes before a class, then the later start, then the smaller id.
    Of spans from one line to the same other line only the one that goes first is compared with points.
    """
    late = (F.col("kind") == "class").cast("int")
    own = spans.groupBy(on, "start", "end").agg(F.min(F.struct(late.alias("late"), "id")).alias("s")).select(on, "start", "end", "s.late", "s.id")
    met = containing(points.select(on, "line").distinct(), own, on)
    order = F.struct((F.col("end") - F.col("start")).alias("length"), "late", (-F.col("start")).alias("back"), "id")
    return met.groupBy(on, "line").agg(F.min(order).alias("m")).select(on, "line", "m.id")


def excerpts(files: DataFrame, spans: DataFrame, most_chars: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(id, excerpt): lines start to end of each span(file_path, start, end, id), cut to ``most_chars``.

    A file's lines are split once, whatever the number of its spans. ``keep`` names columns of ``spans`` that go along.
    """
    own = spans.groupBy("file_path").agg(F.collect_list(F.struct("id", "start", "end", *keep)).alias("spans"))
    lines = files.select("file_path", F.split(F.col("content"), "\r\n|\r|\n").alias("lines"))
    cut = lines.join(own, "file_path").select(F.inline(F.transform("spans", lambda s: F.struct(s["id"].alias("id"), *[s[k].alias(k) for k in keep], F.array_join(F.slice(F.col("lines"), s["start"], F.greatest(s["end"] - s["start"] + 1, F.lit(0))), "\n").alias("excerpt")))))
    return cut if most_chars is None else cut.withColumn("excerpt", F.substring("excerpt", 1, most_chars))
