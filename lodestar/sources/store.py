"""A keyed store on Parquet: every write is a commit of its own, and readers merge the commits that count.

A commit is a folder of rows, dealt by a hash of their key, and one row of the manifest that is
written last; until then nobody sees it. Writers never touch each other's folders, so of two that
interleave neither loses a row: per key the latest write holds, by the writer's clock, then by commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "1.0"
MANIFEST = "version string, commit string, covers array<string>, at timestamp"
BUCKETS = 32
#: into how many tasks a bucket's rows are dealt when they are written
TASKS = 4

Clock = Callable[[], datetime]


def one_row(spark: SparkSession) -> DataFrame:
    """A row to select literals from; Spark makes it without Python workers."""
    return spark.range(0, 1, 1, 1)


class KeyedStore:
    """Rows of ``schema`` by ``keys``, kept under ``path``.

    ``legacy`` gives the rows of an older store; they count until something is committed here, and the
    first commit takes them over. Null keys are keys like others. Of rows with one key in one write any one stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], clock: Clock = lambda: datetime.now(UTC), legacy: Callable[[], DataFrame | None] = lambda: None) -> None:
        self.spark, self.path, self.keys, self.clock, self.legacy = spark, path.rstrip("/"), list(keys), clock, legacy
        self.fields = T.StructType.fromDDL(schema)
        extra = [T.StructField("updated_at", T.TimestampType()), T.StructField("__gone", T.BooleanType())]
        self.rows = T.StructType([*self.fields, *extra])

    def manifest(self) -> list[dict]:
        """The commits so far: a row for each write since the store began."""
        try:
            found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").where(F.col("version") == VERSION).collect()
        except AnalysisException:
            return []
        return [r.asDict() for r in found]

    def live(self) -> list[str]:
        """Commits that no later one stands in for."""
        entries = self.manifest()
        covered = {c for e in entries for c in e["covers"]}
        return sorted(e["commit"] for e in entries if e["commit"] not in covered)

    def raw(self, commits: Sequence[str]) -> DataFrame:
        root = f"{self.path}/commits"
        schema = T.StructType([*self.rows, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not commits:
            return one_row(self.spark).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/commit={c}" for c in commits])

    def merged(self, commits: Sequence[str], only: Sequence[str] | None = None) -> DataFrame:
        """(fields, updated_at): the latest row of every key, where that is no tombstone; of the other fields those in ``only`` are read."""
        own = {k: f"__k{i}" for i, k in enumerate(self.keys)}
        names = [n for n in self.rows.names if only is None or n in own or n in only or n in ("updated_at", "__gone")]
        # the keys are those that rows were grouped by, so a condition on them comes before the grouping
        last = F.max_by(F.struct(*[n for n in names if n not in own]), F.struct("updated_at", "commit")).alias("r")
        return self.raw(commits).groupBy("bucket", *[F.col(k).alias(c) for k, c in own.items()]).agg(last).select("bucket", *[F.col(own.get(n, f"r.{n}")).alias(n) for n in names]).where("not __gone").drop("__gone")

    def load(self) -> DataFrame:
        """(fields, updated_at) of the store; of the older one where nothing was committed; else empty."""
        return self.latest()

    def latest(self, only: Sequence[str] | None = None) -> DataFrame:
        """The store's rows; with ``only`` its keys, those fields and updated_at."""
        names = [f for f in self.fields.names if only is None or f in only or f in self.keys]
        if self.manifest():
            return self.merged(self.live(), only).drop("bucket")
        older = self.legacy()
        if older is None:
            return self.merged([], only).drop("bucket")
        return older.select(*names, F.lit(None).cast("timestamp").alias("updated_at"))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys ``wanted`` has; only their buckets are read when they are few."""
        some = [r[0] for r in wanted.select(self.bucket()).distinct().limit(BUCKETS).collect()]
        held = self.merged(self.live()).where(F.col("bucket").isin(some)).drop("bucket") if self.manifest() else self.load()
        match = F.lit(True)
        for k in self.keys:
            match = match & held[k].eqNullSafe(wanted[k])
        return held.join(wanted, match, "left_semi")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def commit(self, rows: DataFrame, at: datetime, covers: Sequence[str] = (), once: bool = True) -> str:
        """Write ``rows(fields, updated_at, __gone)`` and make them count, in place of ``covers``; ``once`` tells that no two have one key."""
        name = uuid.uuid4().hex
        # a bucket goes to several tasks, a key to one
        dealt = rows.select(*self.rows.names, self.bucket().alias("bucket"), F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(TASKS)).alias("__task")).repartition("bucket", "__task")
        if not once:
            dealt = dealt.dropDuplicates(["bucket", "__task", *self.keys])
        dealt.drop("__task").write.partitionBy("bucket").parquet(f"{self.path}/commits/commit={name}")
        entry = {"version": F.lit(VERSION), "commit": F.lit(name), "covers": F.array(*[F.lit(c) for c in covers]).cast("array<string>"), "at": F.lit(at).cast("timestamp")}
        one_row(self.spark).select(*[v.alias(k) for k, v in entry.items()]).write.mode("append").parquet(f"{self.path}/manifest")
        return name

    def take_over(self) -> None:
        if (older := self.legacy()) is not None and not self.manifest():
            epoch = datetime.fromtimestamp(0, UTC)
            self.commit(older.select(*self.fields.names, F.lit(epoch).alias("updated_at"), F.lit(False).alias("__gone")), epoch)

    def upsert(self, rows: DataFrame, once: bool = False) -> str:
        """New rows, and new values for known keys, stamped with the clock's time; ``once`` tells that no two have one key."""
        self.take_over()
        at = self.clock()
        return self.commit(rows.select(*self.fields.names, F.lit(at).cast("timestamp").alias("updated_at"), F.lit(False).alias("__gone")), at, once=once)

    def delete(self, wanted: DataFrame) -> int:
        """Leave tombstones for the keys of ``wanted``; gives how many rows went."""
        self.take_over()
        gone = self.lookup(wanted.select(*self.keys).distinct())
        n = gone.count()
        if n:
            at = self.clock()
            values = [F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields]
            self.commit(gone.select(*values, F.lit(at).cast("timestamp").alias("updated_at"), F.lit(True).alias("__gone")), at)
        return n

    def clear(self) -> None:
        """Nothing that is committed by now counts any more; what another writer commits meanwhile does."""
        none = self.spark.createDataFrame([], self.rows)
        self.commit(none, self.clock(), self.live())

    def compact(self) -> None:
        """One commit in place of those there are by now; tombstones go."""
        live = self.live()
        if len(live) > 1:
            self.commit(self.merged(live).withColumn("__gone", F.lit(False)), self.clock(), live)

    def export(self, path: str) -> None:
        """The rows as indented JSON texts."""
        self.load().select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


class FlowStore(KeyedStore):
    """Named flows; a flow takes the place of those with its id or its name."""

    def __init__(self, spark: SparkSession, path: str, clock: Clock = lambda: datetime.now(UTC), legacy_path: str | None = None) -> None:
        super().__init__(spark, path, "id string, name string, steps array<string>", ["id"], clock, lambda: legacy_flows(spark, legacy_path) if legacy_path else None)

    def load(self) -> DataFrame:
        # a name may have been taken by another id, in this writer's commits or another's
        last = F.max_by(F.struct("*"), F.struct(F.coalesce("updated_at", F.lit(datetime.fromtimestamp(0, UTC))), "id")).alias("r")
        return super().load().groupBy(F.col("name").alias("__name")).agg(last).select("r.*")

    def save(self, flows: DataFrame) -> None:
        self.upsert(flows)


def legacy_flows(spark: SparkSession, path: str) -> DataFrame | None:
    """The flows of a JSON file {version, flows: [...]}; None where there is none or it can't be read."""
    try:
        read = spark.read.option("multiLine", True).json(path)
        flows = read.select(F.explode("flows").alias("f"))
        kinds = {f.name for f in flows.schema["f"].dataType.fields}
    except (AnalysisException, AttributeError):
        return None
    column = lambda n, t: (F.col(f"f.{n}") if n in kinds else F.lit(None)).cast(t).alias(n)
    return flows.select(column("id", "string"), column("name", "string"), column("steps", "array<string>"))


class SummaryStore(KeyedStore):
    """Summaries of the project, folders, files and symbols; ``scope`` tells which, ``content_hash`` of what text."""

    def __init__(self, spark: SparkSession, path: str, clock: Clock = lambda: datetime.now(UTC)) -> None:
        super().__init__(spark, path, "scope string, path string, symbol string, content_hash string, summary string", ["scope", "path", "symbol"], clock)

    def put(self, scope: str, rows: DataFrame) -> None:
        """Summaries of one scope: rows(path, summary), with symbol and content_hash where they have them."""
        given = [F.col(c) if c in rows.columns else F.lit("" if c == "path" else None).cast("string").alias(c) for c in ("path", "symbol", "content_hash", "summary")]
        self.upsert(rows.select(F.lit(scope).alias("scope"), *given).withColumn("path", F.translate("path", "\\", "/")))

    def get(self, scope: str) -> DataFrame:
        return self.load().where(F.col("scope") == scope)

    def valid(self, files: DataFrame) -> DataFrame:
        """The file summaries whose text is still that of files(file_path, content); without content any holds."""
        now = files.select(F.col("file_path").alias("path"), F.md5(F.encode("content", "UTF-8")).alias("now"))
        return self.get("file").join(now, "path").where(F.col("now").isNull() | (F.col("now") == F.col("content_hash"))).drop("now")

    def stats(self) -> DataFrame:
        return self.load().agg(F.count_if(F.col("scope") == "file").alias("files"), F.count_if(F.col("scope") == "symbol").alias("symbols"))
