"""Source text to symbols, imports and call sites, as relational steps over lines and statements.

One pass over a file gathers its lines to statements by running bracket depth and finds blocks by
their indents (``blocks``). Python code is used only for that pass, to blank out strings and
comments, and to read parameter lists and docstrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lodestar.functions import script
from lodestar.functions.text import docstring, export_flag, literal_type, method_kind, normalize_path, parameters, source_order
from lodestar.operators import blocks
from lodestar.sources.stages import stage

#: fixed values: words before a bracket that are no call
KEYWORDS = "if elif else while for in return yield assert except with def class lambda and or not is del raise try finally from import as pass break continue global nonlocal async await".split()
#: fixed values: folders that a scan skips
SKIPPED = (".git", "__pycache__", ".venv", "node_modules", "out", "dist")
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def python_places(files: DataFrame) -> DataFrame:
    """Statements with what they are and where they stand in their file's blocks (blocks.STATEMENT)."""
    return blocks.read(files)


def python_tables(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, bases, params, imports, call_sites and pipeline_steps of Python files.

    A symbol reaches from its first decorator to the last line of its block. Comment lines right above
    it (or above its decorators) stand in for a missing docstring.
    """
    lines = stage(python_places(files), "extract-places")
    symbols = stage(python_symbols(lines), "extract-symbols")
    bases = symbols.where("bases_text <> ''").select(F.col("id").alias("class_id"), F.posexplode(F.split("bases_text", r"\s*,\s*")).alias("base_ord", "b")).select("class_id", "base_ord", F.trim("b").alias("base"))
    params = symbols.where("kind <> 'class'").select("id", F.explode("parameters").alias("p")).select("id", F.col("p.name").alias("param"), "p.type_hint")
    calls = stage(python_calls(lines), "extract-calls")
    return {"symbols": symbols.drop("bases_text"), "bases": bases, "params": params, "imports": python_imports(lines), "call_sites": calls.drop("call_snippet"), "pipeline_steps": python_steps(calls)}


#: the columns that python_symbols reads
OF_SYMBOLS = ["file_path", "stmt", "first", "indent", "code", "raw", "what", "name", "owner", "body_of", "inner", "head", "doc_of", "comment_of", "end_line", "end_column"]


def symbol_places(lines: DataFrame) -> DataFrame:
    """Those statements that python_symbols looks at: heads, decorators, comments over them, docstrings, returns and __all__."""
    named = F.col("what").isin(blocks.CLASS, blocks.DEF, blocks.DECORATOR)
    told = F.col("comment_of").isNotNull() | F.col("doc_of").isNotNull()
    kept = named | told | F.contains("code", F.lit("return")) | F.startswith("raw", F.lit("__all__"))
    return lines.where(kept).select(*OF_SYMBOLS)


def python_symbols(lines: DataFrame) -> DataFrame:
    """Symbols of the statements ``lines``, a stage table, for it is read for each of their parts; with bases_text."""
    st = lines.where(F.col("what") != blocks.COMMENT)
    is_class = F.col("what") == blocks.CLASS
    owned = st.where(is_class | (F.col("what") == blocks.DEF)).where("body_of is null and not (what = 'class' and owner is not null)").select("file_path", "stmt", "first", "indent", "code", "raw", is_class.alias("is_class"), F.col("code").rlike(r"^\s*async\b").alias("is_async"), "name", "owner", "end_line", "end_column")
    decos = st.where(F.col("what") == blocks.DECORATOR).where("head is not null")
    held = decos.groupBy("file_path", F.col("head").alias("stmt")).agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("df"), F.trim("raw").alias("d")))).alias("ds"), F.min("stmt").alias("top"))
    notes = lines.where("comment_of is not null").groupBy("file_path", "comment_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt", "raw"))), lambda c: c["raw"]), "\n").alias("note"))
    own_note = notes.select("file_path", F.col("comment_of").alias("stmt"), F.col("note").alias("own_note"))
    top_note = notes.select("file_path", F.col("comment_of").alias("top"), F.col("note").alias("top_note"))
    exports = st.where(F.col("raw").rlike(r"^__all__\s*=\s*\[")).groupBy("file_path").agg(F.min_by("raw", "stmt").alias("all")).select("file_path", F.transform(F.regexp_extract_all("all", F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1)), lambda s: F.trim(s)).alias("exported"))
    doc = st.where("doc_of is not null").where(F.trim(F.translate("code", "\n", " ")).rlike(r'^[rRuU]?"\s*"*\s*"+$')).select("file_path", F.col("doc_of").alias("stmt"), F.trim("raw").alias("doc"))
    rets = st.where("body_of is not null and not inner").where(F.col("code").rlike(r"^\s*return\b")).select("file_path", F.col("body_of").alias("stmt"), F.regexp_replace("raw", r"^\s*return\b\s*", "").alias("expr"))
    returned = rets.groupBy("file_path", "stmt").agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list(literal_type(F.col("expr")))))).alias("ts"), F.count(F.lit(1)).alias("n"))
    inferred = owned.where("not is_class").select("file_path", "stmt").join(returned, ["file_path", "stmt"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ts", F.coalesce("ts", F.array().cast("array<string>")))
    plain = F.filter("ts", lambda t: t != "None")
    union = F.when(F.col("n") == 0, F.lit("None")).when(F.size("ts") == 0, F.lit(None)).when(F.size(plain) == 0, F.lit("None")).when((F.size("ts") == 2) & (F.size(plain) == 1), F.concat(F.lit("Optional["), F.get(plain, F.lit(0)), F.lit("]"))).otherwise(F.array_join("ts", " | "))
    sig = r"(?s)^\s*(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*\])?\s*\((.*)\)\s*(?:->\s*(.+?))?\s*:[^:]*$"
    joined = owned.join(held, ["file_path", "stmt"], "left").join(exports, "file_path", "left").join(doc, ["file_path", "stmt"], "left").join(own_note, ["file_path", "stmt"], "left").join(top_note, ["file_path", "top"], "left").join(inferred.select("file_path", "stmt", union.alias("inferred")), ["file_path", "stmt"], "left")
    decorators = F.coalesce(F.col("ds.d"), F.array().cast("array<string>"))
    one_line = F.regexp_replace(F.regexp_replace("raw", r"(?m)\s+#[^\"'\n]*$", ""), r"(:)\s*[^\s:][^:\n]*$", "$1")
    return joined.select(
        F.concat("file_path", F.lit("#"), F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))).alias("id"),
        "name",
        F.when(F.col("is_class"), F.lit("class")).when(F.col("owner").isNotNull(), method_kind(decorators, F.col("is_async"))).when(F.col("is_async"), F.lit("async_function")).otherwise(F.lit("function")).alias("kind"),
        "file_path",
        F.coalesce(F.get("ds.df", F.lit(0)), F.col("first")).cast("int").alias("start_line"),
        (F.col("indent") + 1).alias("start_column"),
        "end_line",
        "end_column",
        decorators.alias("decorators"),
        docstring("doc", F.coalesce("top_note", "own_note")).alias("docstring"),
        F.when(F.col("owner").isNotNull(), F.lit(False)).otherwise(export_flag(F.col("name"), F.col("file_path"), F.col("exported"))).alias("is_exported"),
        F.when(F.col("owner").isNotNull(), F.concat("file_path", F.lit("#"), "owner")).alias("parent_class_id"),
        F.when(~F.col("is_class"), parameters(F.regexp_extract(one_line, sig, 1))).alias("parameters"),
        F.when(~F.col("is_class"), F.coalesce(F.nullif(F.trim(F.regexp_extract(one_line, sig, 2)), F.lit("")), "inferred")).alias("return_type"),
        F.when(F.col("is_class"), F.regexp_extract("raw", r"(?s)^\s*class\s+\w+\s*\((.*?)\)\s*:", 1)).alias("bases_text"),
    ).withColumn("sym_ord", F.col("start_line").cast("long"))


def python_imports(st: DataFrame) -> DataFrame:
    """(file_path, module_name, imported_symbol, alias, is_wildcard, level, imp_ord)."""
    flat = F.regexp_replace(F.regexp_replace("code", r"\s+", " "), r"[;\\].*$|\\", "")
    own = st.where(F.col("code").rlike(r"^\s*(from|import)\s")).select("file_path", "stmt", F.trim(flat).alias("t"))
    frm = r"^from (\.*) ?([\w.]*) import \(? ?(.*?),? ?\)?$"
    # both forms in one branch, or the files were read for each
    is_from, is_import = F.col("t").rlike(frm), F.col("t").rlike(r"^import ")
    items = F.when(is_from, F.regexp_extract("t", frm, 3)).otherwise(F.regexp_replace("t", "^import ", ""))
    both = own.where(is_from | is_import).select("file_path", "stmt", F.when(is_from, F.length(F.regexp_extract("t", frm, 1))).otherwise(F.lit(0)).alias("level"), F.when(is_from, F.regexp_extract("t", frm, 2)).alias("module_name"), F.posexplode(F.split(items, r"\s*,\s*")).alias("k", "item"))
    both = both.withColumn("thing", F.regexp_extract("item", r"^([\w.*]+)", 1)).withColumn("alias", F.nullif(F.regexp_extract("item", r" as (\w+)", 1), F.lit("")))
    plain = F.col("module_name").isNull()
    order = source_order(F.col("stmt"), F.col("k"))
    return both.where("thing <> ''").select("file_path", F.when(plain, F.col("thing")).otherwise(F.col("module_name")).alias("module_name"), F.when(~plain & (F.col("thing") != "*"), F.col("thing")).alias("imported_symbol"), "alias", (F.col("thing") == "*").alias("is_wildcard"), "level", order.alias("imp_ord"))


def call_chain(code: Column, keywords: list[str]) -> Column:
    """array<struct<callee, column>>: the identifier chain left of every bracket of a blanked line."""
    pieces = F.split(code, r"\(", -1)

    def one(i: Column) -> Column:
        piece, prior = F.get(pieces, i), F.coalesce(F.get(pieces, i - 1), F.lit(""))
        end = F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "("))
        chain = F.regexp_extract(piece, r"([A-Za-z0-9_.$]*[A-Za-z0-9_$])\s*$", 1)
        gap = F.length(F.regexp_extract(piece, r"(\s*)$", 1))
        is_super = piece.rlike(r"^\s*\)\s*\.\w+\s*$") & prior.rlike(r"(^|[^\w.])super\s*$")
        callee = F.when(is_super, F.concat(F.lit("super()"), F.when(chain.startswith("."), chain).otherwise(F.concat(F.lit("."), chain)))).otherwise(chain)
        column = F.when(is_super, end - gap - F.length(piece) + gap - 5).otherwise(end - gap - F.length(chain) + 1)
        declared = piece.rlike(r"(^|\s)(def|class|function)\s+\w+\s*$")
        return F.struct(F.when(~declared, callee).alias("callee"), column.cast("int").alias("column"))

    found = F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), one)).otherwise(F.array().cast("array<struct<callee:string,column:int>>"))
    return F.filter(found, lambda x: x["callee"].isNotNull() & (x["callee"] != "") & ~x["callee"].isin(*keywords))


def python_calls(lines: DataFrame) -> DataFrame:
    """(file_path, caller_id, line, col, callee_name, call_snippet, call_ord): calls in function bodies and in module statements."""
    called = lines.where(F.col("caller").isNotNull() | F.col("loose") & ~F.col("code").rlike(r"^\s*(from\s|import\s)")).where(F.contains("code", F.lit("(")))
    caller = F.concat("file_path", F.lit("#"), F.coalesce("caller", F.lit("<module>")))
    split = called.select("file_path", caller.alias("caller_id"), "first", F.posexplode(F.split("code", "\n")).alias("k", "text"))
    spread = split.select("file_path", "caller_id", (F.col("first") + F.col("k")).cast("long").alias("line"), "text", F.explode(call_chain(F.col("text"), KEYWORDS)).alias("c"))
    order = source_order(F.col("line"), F.col("col"))
    return spread.select("file_path", "caller_id", "line", F.col("c.column").cast("long").alias("col"), F.col("c.callee").alias("callee_name"), F.substring(F.trim("text"), 1, 60).alias("call_snippet")).withColumn("call_ord", order)


def python_module_calls(files: DataFrame) -> DataFrame:
    """What python_calls has of module statements: no other statement leaves the pass over a file."""
    return python_calls(blocks.read_module(files))


def python_steps(calls: DataFrame) -> DataFrame:
    """pipeline_steps: the module-level calls of each file, numbered."""
    step = F.row_number().over(W.partitionBy("file_path").orderBy("line", "col"))
    return calls.where("caller_id like '%#<module>'").withColumn("step", step).select("file_path", "step", "line", "callee_name", "call_snippet", "call_ord")


PARAMETERS = pa.list_(pa.struct([(c, pa.string()) for c in ("name", "type_hint", "default_value", "kind")]))
#: columns of the rows of a script file; those that a kind of row doesn't have are null
SCRIPT_ROW = {
    **dict.fromkeys(("file_path", "what", "name", "kind", "owner"), pa.string()),
    **dict.fromkeys(("line", "col", "end_line", "end_column"), pa.int32()),
    "exported": pa.bool_(),
    "params": PARAMETERS,
    "returns": pa.string(),
    "bases": pa.list_(pa.string()),
    **dict.fromkeys(("summary", "description", "module", "alias"), pa.string()),
}


def script_rows(files: DataFrame) -> DataFrame:
    """SCRIPT_ROW of TypeScript and JavaScript files: what one pass over a file's tokens finds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], t) for n, t in SCRIPT_ROW.items()], names=list(SCRIPT_ROW))
            held.clear()
            return batch

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held += [{**r, "file_path": path} for r in script.rows_of(content.as_py())]
                if len(held) >= blocks.BATCH:
                    yield out()
        yield out()

    ddl = ", ".join(f"{n} {from_arrow_type(t).simpleString()}" for n, t in SCRIPT_ROW.items())
    return files.select(normalize_path(F.col("file_path")).alias("file_path"), "content").mapInArrow(task, ddl)


def script_tables(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, bases, params, imports and call_sites of TypeScript and JavaScript files.

    Symbols are classes, methods and constructors, functions at any depth, and arrow functions, function and class
    expressions that a variable is set to, over any number of lines. Methods of object
    literals are neither symbols nor calls; what they call belongs to the symbol around them. The last
    comment before a declaration gives its summary and description.
    """
    rows = stage(script_rows(files), "script-rows")
    is_class = F.col("kind") == "class"
    owner = F.concat("file_path", F.lit("#"), "owner")
    symbols = rows.where("what = 'symbol'").select(
        F.concat("file_path", F.lit("#"), F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))).alias("id"),
        "name",
        "kind",
        "file_path",
        F.col("line").alias("start_line"),
        F.col("col").alias("start_column"),
        "end_line",
        "end_column",
        F.array().cast("array<string>").alias("decorators"),
        F.struct("summary", "description").alias("docstring"),
        F.col("exported").alias("is_exported"),
        owner.alias("parent_class_id"),
        F.when(~is_class, F.col("params")).alias("parameters"),
        F.col("returns").alias("return_type"),
        F.col("line").cast("long").alias("sym_ord"),
    )
    heads = rows.where("what = 'symbol' and kind = 'class'")
    bases = heads.select(F.concat("file_path", F.lit("#"), "name").alias("class_id"), F.posexplode("bases").alias("base_ord", "base"))
    params = symbols.where("kind <> 'class'").select("id", F.explode("parameters").alias("p")).select("id", F.col("p.name").alias("param"), "p.type_hint")
    imports = rows.where("what = 'import'").select("file_path", F.col("module").alias("module_name"), F.col("name").alias("imported_symbol"), "alias", F.lit(False).alias("is_wildcard"), F.lit(0).alias("level"), source_order(F.col("line"), F.col("col")).alias("imp_ord"))
    calls = rows.where("what = 'call'").select("file_path", F.coalesce(owner, F.concat("file_path", F.lit("#<module>"))).alias("caller_id"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("name").alias("callee_name"), source_order(F.col("line"), F.col("col")).alias("call_ord"))
    return {"symbols": symbols, "bases": bases, "params": params, "imports": imports, "call_sites": calls}
