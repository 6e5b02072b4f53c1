"""Analysis of a project by a model as a job that can be stopped, resumed and watched.

Every item (a file, a symbol, a folder, the project) is a row of a store with its state. A level's
pending items are dealt into rounds once; a round asks the model about its items in one Spark job and
commits their answers, reading no others. Rounds that take less time than Spark needs to begin them go
several to a Spark job, a lot. Its tasks keep their answers as each of them ends, and those of all tasks
that run at a time are a round's, so whatever ends the job, an item is asked again only if it was among
the ``round_items`` that were being asked.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import enrich, folds, intervals
from lodestar.operators.calls import Config, Model
from lodestar.operators.incremental import content_hash
from lodestar.operators.ranges import numbered
from lodestar.sources.stages import shared_dir, stage
from lodestar.sources.store import Clock, KeyedStore, SummaryStore, one_row

LEVELS = ("file", "symbol", "folder", "project")
ASKED = ("level", "item", "path", "symbol", "content_hash", "prompt")
PENDING, DONE, FAILED = "pending", "done", "failed"
ITEM = "level string, item string, path string, symbol string, content_hash string, prompt string, state string, answer string, error string"
#: a row when a lot begins, and one when its answers are settled
LOT = "lot string, level string, settled boolean"
#: seconds that a lot of several rounds may take as far as the one before it tells; a single call may take as long
LOT_S = 60


class AnalysisJob:
    """Summaries of ``files(file_path, content)`` and ``symbols(id, name, kind, file_path, start_line, end_line)``.

    ``path`` keeps the job's items, ``summaries`` what was found; a file whose text is known there is not asked again.
    ``round_items`` bounds what one round asks, and so what breaking it off can lose.
    """

    def __init__(self, spark: SparkSession, path: str, files: DataFrame, symbols: DataFrame, summaries: SummaryStore, model: Model, config: Config = Config(), fallback: Model | None = None, round_items: int = 256, clock: Clock = lambda: datetime.now(UTC)) -> None:
        self.spark, self.files, self.symbols, self.summaries = spark, files, symbols, summaries
        self.model, self.config, self.fallback, self.round_items = model, config, fallback, round_items
        self.items = KeyedStore(spark, path, ITEM, ["level", "item"], clock)
        self.asked = T.StructType([f for f in self.items.fields if f.name in ASKED])
        self.tag = f"analysis-{uuid.uuid4().hex}"
        #: rounds that the running level still has
        self.left = 0
        #: rounds that the next lot may have
        self.at_once = 1
        self.stop, self.idle = threading.Event(), threading.Event()
        self.idle.set()

    def plan(self, scope: str = "all", at: str | None = None) -> None:
        """Items of the whole project, of the files below a folder, of one file, or of one symbol (by id).

        Items that the job has already keep their state.
        """
        path = F.col("file_path")
        inside = {"all": F.lit(True), "folder": path.startswith(f"{at}/"), "file": path == at, "symbol": path == str(at).split("#")[0]}[scope]
        files = self.files.where(inside).select("file_path", "content", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))
        known = self.summaries.valid(files).select(F.col("path").alias("file_path"))
        new = files if scope == "symbol" else files.join(known, "file_path", "left_anti")
        prompt = F.concat(F.lit("Summarise the file "), path, F.lit(":\n"), F.substring("content", 1, enrich.FILE_CHARS))
        file_items = new.select(F.lit("file").alias("level"), path.alias("item"), path.alias("path"), F.lit(None).cast("string").alias("symbol"), "content_hash", prompt.alias("prompt"))
        chosen = self.symbols.where("kind <> 'class'").where(F.col("id") == at if scope == "symbol" else F.lit(True))
        spans = chosen.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id", "name").join(new.select("file_path", "content_hash"), "file_path")
        cut = intervals.excerpts(files, spans.withColumn("path", path), enrich.SNIPPET, ("path", "name", "content_hash"))
        symbol_items = cut.select(F.lit("symbol").alias("level"), F.col("id").alias("item"), "path", F.col("id").alias("symbol"), "content_hash", enrich.symbol_prompt(F.col("name"), F.col("excerpt")).alias("prompt"))
        self.add(symbol_items if scope == "symbol" else file_items.unionByName(symbol_items))

    def add(self, items: DataFrame) -> None:
        had = self.items.latest([]).select("level", "item")
        new = items.join(had, ["level", "item"], "left_anti")
        self.items.upsert(new.select("*", F.lit(PENDING).alias("state"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error")))

    def cancel(self, now: bool = False) -> None:
        """No further round begins; with ``now`` the running one is broken off and its items stay pending."""
        self.stop.set()
        while now and not self.idle.is_set():  # a job may begin just after it was asked to stop
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.idle.wait(0.2)

    def run(self, on_round: Callable[[], None] = lambda: None) -> bool:
        """Ask about all pending items, level by level; false if it was cancelled. May be called again.

        Folders are folded from the summaries of their files, and the project from those of its folders.
        """
        self.stop.clear()
        self.idle.clear()
        try:
            self.recover()
            for level in ("file", "symbol"):
                for some, rounds, left in self.lots(level):
                    if self.stop.is_set() or not self.lot(some, rounds, level):
                        break
                    for k in range(rounds):
                        self.left = left + rounds - k - 1
                        on_round()
            for level in ("folder", "project"):
                if not self.stop.is_set():
                    self.fold(level)
                    on_round()
            return not self.stop.is_set()
        finally:
            self.idle.set()

    def tagged[R](self, work: Callable[[], R]) -> R | None:
        """What ``work`` gives, run under the job's tag; None if it was broken off."""
        if self.stop.is_set():
            return None
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        try:
            return work()
        except Exception:
            if self.stop.is_set():
                return None
            raise
        finally:
            context.removeJobTag(self.tag)
            context.setInterruptOnCancel(False)

    def dealt(self, level: str) -> tuple[str, int]:
        """The pending items of a level by rounds of ``round_items`` in a folder, and how many rounds there are; the store is read once for all of them."""
        pending = self.items.load().where((F.col("level") == level) & (F.col("state") == PENDING)).select(*ASKED)
        placed, total = numbered(pending, "at", "analysis")
        path = f"{shared_dir(self.spark)}/stages/analysis-rounds-{uuid.uuid4().hex}"
        if not total:
            return path, 0
        placed.withColumn("round", F.floor(F.col("at") / self.round_items)).drop("at").write.partitionBy("round").parquet(path)
        return path, -(-total // self.round_items)

    def lots(self, level: str) -> Iterator[tuple[DataFrame, int, int]]:
        """(items, rounds, rounds left after them): a job's first lot is a single round, a later one as many as go by in ``LOT_S``, at most eight times the number before."""
        if self.stop.is_set():
            return
        path, rounds = self.dealt(level)
        k = 0
        while k < rounds:
            n = min(self.at_once, rounds - k)
            began = time.monotonic()
            yield self.spark.read.schema(self.asked).parquet(*[f"{path}/round={i}" for i in range(k, k + n)]), n, rounds - k - n
            k += n
            self.at_once = max(1, int(n * min(8, LOT_S / max(time.monotonic() - began, 0.001))))

    def lot(self, some: DataFrame, rounds: int, level: str) -> bool:
        """Ask about the items of some rounds; false when that was broken off. What was answered by then is settled in either case."""
        name = uuid.uuid4().hex
        self.note(name, level, False)
        # as many tasks run at a time as deal with one round's items
        tasks = rounds * min(self.spark.sparkContext.defaultParallelism, self.round_items)
        answers = enrich.ask(some.repartition(tasks), self.model, self.config, self.fallback)
        # by this algorithm a task's file is in its place when the task ends, whatever becomes of the others
        put = answers.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        whole = self.tagged(lambda: put.parquet(self.answers(name)) or True)
        self.settle_lot(name, level)
        return bool(whole)

    def answers(self, lot: str) -> str:
        return f"{self.items.path}/answers/{lot}"

    def note(self, lot: str, level: str, settled: bool) -> None:
        one_row(self.spark).select(F.lit(lot).alias("lot"), F.lit(level).alias("level"), F.lit(settled).alias("settled")).write.mode("append").parquet(f"{self.items.path}/lots")

    def settle_lot(self, lot: str, level: str) -> None:
        schema = T.StructType([*self.asked, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
        try:
            said = self.spark.read.schema(schema).parquet(self.answers(lot))
        except AnalysisException:  # broken off before it began
            said = None
        if said is not None and not said.isEmpty():
            self.settle(said.withColumn("answer", enrich.clean_markdown(F.col("answer"))), level)
        self.note(lot, level, True)

    def recover(self) -> None:
        """Settle what the tasks of a lot answered whose driver ended before it."""
        try:
            lots = self.spark.read.schema(LOT).parquet(f"{self.items.path}/lots").groupBy("lot", "level").agg(F.max("settled").alias("settled")).where("not settled").collect()
        except AnalysisException:
            return
        for r in lots:
            self.settle_lot(r["lot"], r["level"])

    def settle(self, said: DataFrame, level: str) -> None:
        """Commit answers as summaries first and as done items then, so that a break between the two asks again at worst."""
        good = said.where("answer is not null")
        self.summaries.put(level, good.select("path", "symbol", "content_hash", F.col("answer").alias("summary")))
        self.items.upsert(said.withColumn("state", F.when(F.col("answer").isNull(), F.lit(FAILED)).otherwise(F.lit(DONE))), once=True)

    def fold(self, level: str) -> None:
        """Folders from their files, or the project from its folders."""
        below = {"folder": "file", "project": "folder"}[level]
        told = self.summaries.get(below).select("path", F.concat("path", F.lit(": "), "summary").alias("text"))
        parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("root")) if level == "folder" else F.lit("")
        rows = stage(told.select(parent.alias("key"), F.col("path").alias("ord"), "text"), "analysis-told")
        if rows.isEmpty():
            return
        found = self.tagged(lambda: stage(folds.folded(rows, enrich.answers(self.model, self.config)), "analysis-fold"))
        if found is None:
            return
        none = F.lit(None).cast("string")
        self.settle(found.select(F.lit(level).alias("level"), F.col("key").alias("item"), F.col("key").alias("path"), none.alias("symbol"), none.alias("content_hash"), none.alias("prompt"), F.col("text").alias("answer"), none.alias("error")), level)

    def progress(self) -> DataFrame:
        """(level, total, done, failed, percent) of files and symbols, and of both together; 0 of 0 is 0 %."""
        return progress(self.items.latest(["state"]).where("level in ('file', 'symbol')"))


def progress(items: DataFrame) -> DataFrame:
    counts = items.select(F.explode(F.array("level", F.lit("all"))).alias("level"), "state").groupBy("level").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == DONE).alias("done"), F.count_if(F.col("state") == FAILED).alias("failed"))
    names = items.sparkSession.createDataFrame([("file",), ("symbol",), ("all",)], "level string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = names.join(counts, "level", "left").select("level", zero("total"), zero("done"), zero("failed"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * (F.col("done") + F.col("failed")) / F.col("total"))).otherwise(F.lit(0)).cast("int"))
