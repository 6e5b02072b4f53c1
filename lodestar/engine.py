"""The engine: a source tree to a code graph, kept up to date, with its derived views."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import source_order
from lodestar.operators import deadcode, extract, graph, incremental, intervals, macro, resolve, rollup, search
from lodestar.operators.tools import Server
from lodestar.sources import snapshots, trees
from lodestar.sources.stages import stage

SCRIPT = ("ts", "tsx", "js", "jsx")
trees.register_parser("python", ["py"], extract.python_tables)
trees.register_parser("script", SCRIPT, extract.script_tables)

SYMBOLS = ["id", "name", "kind", "file_path", "start_line", "start_column", "end_line", "end_column", "decorators", "is_exported", "parent_class_id", "parameters", "return_type", "summary", "description", "sym_ord"]
PARTS = {"symbols": SYMBOLS, "bases": ["class_id", "base_ord", "base"], "params": ["id", "param", "type_hint"], "imports": ["file_path", "module_name", "imported_symbol", "alias", "is_wildcard", "level", "imp_ord"], "call_sites": ["call_ord", "file_path", "caller_id", "callee_name", "line", "col"]}


def extract_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of extraction over ``files(file_path, content)``, each parser on the files of its extensions."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    parts = [parser(files.where(ext.isin(*own))) for own, parser in trees.parsers().values()]
    for p in parts:
        s = p["symbols"]
        doc = F.col("docstring") if "docstring" in s.columns else F.lit(None).cast("struct<summary:string,description:string>")
        p["symbols"] = s.withColumn("summary", doc["summary"]).withColumn("description", doc["description"])
    tables = {name: stage(reduce(DataFrame.unionByName, [p[name].select(*cols) for p in parts]), f"engine-{name}") for name, cols in PARTS.items()}
    steps = [p["pipeline_steps"] for p in parts if "pipeline_steps" in p]
    tables["pipeline_steps"] = stage(reduce(DataFrame.unionByName, steps), "engine-pipeline")
    return tables


@dataclass
class Engine:
    spark: SparkSession
    files: DataFrame
    tables: dict[str, DataFrame]
    resolve_ts_paths: bool = False
    symbols: DataFrame = field(init=False)
    edges: DataFrame = field(init=False)
    edges_raw: DataFrame = field(init=False)
    usages: DataFrame = field(init=False)

    @classmethod
    def scan(cls, spark: SparkSession, root: str, snapshot: str | None = None, resolve_ts_paths: bool = False) -> Engine:
        """Read a tree; with a snapshot folder only new and modified files are parsed again.

        ``resolve_ts_paths`` links the relative modules of scripts by path, not by names alone.
        """
        files = stage(trees.read_tree(spark, root), "engine-files")
        before = snapshots.load(spark, snapshot) if snapshot else None
        if before and any(set(cols) - set(before[n].columns) for n, cols in PARTS.items() if n in before):
            before = None  # written before a column was added
        if before is None:
            tables = extract_tables(files)
        else:
            status = stage(incremental.diff_status(files, before["files"]), "engine-status")
            changed = status.where("status in ('new', 'modified')").select("file_path")
            fresh = extract_tables(files.join(changed, "file_path", "left_semi"))
            kept = status.where("status = 'reusable'").select(F.col("file_path").alias("__kept"))
            owner = {"bases": F.substring_index("class_id", "#", 1), "params": F.substring_index("id", "#", 1)}
            tables = {n: stage(before[n].join(kept, owner.get(n, F.col("file_path")) == F.col("__kept"), "left_semi").unionByName(t), f"engine-merged-{n}") for n, t in fresh.items()}
        engine = cls(spark, files, tables, resolve_ts_paths)
        engine.resolve()
        if snapshot:
            snapshots.save({"files": files.select("file_path", "mtime"), **tables}, snapshot)
        return engine

    def resolve(self) -> None:
        """Names to edges and usages; all of it again whenever a file changed, since names cross files."""
        t, spark = self.tables, self.spark
        ordered = self.files.select("file_path", F.xxhash64("file_path").alias("file_ord"))
        place = source_order(F.col("sym_ord"), F.lit(0))
        self.symbols = stage(graph.latest(t["symbols"].withColumn("sym_ord", place)), "engine-latest")
        names = self.symbols.withColumn("is_exported", F.coalesce("is_exported", F.lit(False)))
        found = stage(resolve.resolve_calls(t["call_sites"], t["imports"], ordered, names, t["bases"], t["params"], self.resolve_ts_paths), "engine-resolved")
        scope = resolve.scopes(t["imports"], ordered, names, self.resolve_ts_paths)
        links = resolve.base_links(t["bases"], names, scope)
        calls = resolve.call_edges(t["call_sites"], found, names).select("source", "target", "kind", "edge_ord")
        contains = resolve.contains_edges(names.withColumn("sym_ord", F.col("start_line").cast("long")))
        raw = calls.unionByName(contains).unionByName(resolve.inherits_edges(links))
        self.edges_raw = stage(raw.withColumn("id", graph.edge_id()), "engine-edges-raw")
        self.edges = stage(graph.valid_edges(self.edges_raw, names), "engine-edges")
        self.usages = stage(resolve.usage_rows(t["call_sites"], found), "engine-usages")

    def spans(self) -> DataFrame:
        """(file_path, start, end, id, kind): the lines of every symbol."""
        return self.symbols.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id", "kind")

    def enclosing(self, cursors: DataFrame) -> DataFrame:
        """(file_path, line, id): the innermost symbol at each cursor(file_path, line)."""
        return intervals.innermost(cursors, self.spans())

    def excerpts(self, most_chars: int | None = None) -> DataFrame:
        """(id, excerpt): the source of every symbol."""
        return intervals.excerpts(self.files, self.spans(), most_chars)

    def entries(self) -> DataFrame:
        return self.tables["pipeline_steps"].select("file_path").distinct()

    def dead(self, **options) -> DataFrame:  # noqa: ANN003
        return deadcode.detect(self.symbols, self.edges, self.usages, **options)

    def tree(self) -> DataFrame:
        return rollup.tree_nodes(deadcode.mark(self.symbols, self.dead()), self.entries())

    def macro_graph(self) -> tuple[str, DataFrame]:
        unit = macro.mode(self.symbols).first()["mode"]
        return unit, macro.macro_edges(self.symbols, self.edges_raw, unit)

    def searchable(self) -> DataFrame:
        return self.symbols.withColumn("type_hints", F.coalesce(F.filter(F.transform("parameters", lambda p: p["type_hint"]), lambda h: h.isNotNull()), F.array().cast("array<string>")))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(self.searchable(), query, limit)

    def server(self, model=None) -> Server:  # noqa: ANN001
        return Server(self.searchable(), self.edges, self.usages, model)
