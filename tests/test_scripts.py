"""TypeScript and JavaScript extraction, docstrings, parameters, return types, streams and enrichment."""

import datetime as dt

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import enrich, extract, graph, search
from lodestar.streaming.debounce import debounced_stream, last_of_burst, suppressed

SERVICE = """import { Db, Log as L } from './db';
import path from 'path';

// a comment with call()
export class OrderService extends Base {
  private total = 0.0;
  constructor(private db: Db) { super(); }
  async place(item: string, n = 1): Promise<boolean> {
    const text = "fake(";
    return this.db.save(item);
  }
}

export function total(xs: number[]): number {
  return xs.length;
}

export const half = (x: number): number => {
  return total([x]);
};
"""


def test_script_tables(spark):
    got = extract.script_tables(spark.createDataFrame([("src/a.ts", SERVICE)], "file_path string, content string"))
    rows = {r["id"]: r for r in got["symbols"].collect()}
    assert set(rows) == {"src/a.ts#OrderService", "src/a.ts#OrderService.constructor", "src/a.ts#OrderService.place", "src/a.ts#total", "src/a.ts#half"}
    assert rows["src/a.ts#OrderService.place"]["return_type"] == "Promise<boolean>"
    assert [(b["base"]) for b in got["bases"].collect()] == ["Base"]
    assert {(r["imported_symbol"], r["alias"]) for r in got["imports"].collect()} == {("Db", None), ("Log", "L"), ("path", None)}
    calls = {(r["caller_id"].split("#")[1], r["callee_name"]) for r in got["call_sites"].collect()}
    assert ("half", "total") in calls and ("OrderService.place", "self.db.save") in calls and not any("fake" in c for _, c in calls)


def test_docstrings():
    google = T.parse_doc('"""Do it.\n\nMore words.\n\nArgs:\n    a (float): first\n      goes on\n    b: second\n\nReturns:\n    a thing\n"""')
    assert google == {"summary": "Do it.", "description": "More words.", "params": {"a": "(float) first goes on", "b": "second"}, "returns": "a thing"}
    sphinx = T.parse_doc("'''Do.\n:param x: one\n:returns: two'''")
    assert sphinx["params"] == {"x": "one"} and sphinx["returns"] == "two"
    assert T.parse_doc(None, "# only\n# comments")["summary"] == "only"
    assert T.parse_doc('r"""Raw."""')["summary"] == "Raw." and T.parse_doc("") is None


def test_parameters():
    kinds = [(p["name"], p["kind"]) for p in T.parse_parameters("a, b: int, *args, c=1, **kw")]
    assert kinds == [("a", "positional"), ("b", "positional"), ("args", "args"), ("c", "keyword"), ("kw", "kwargs")]
    nested = T.parse_parameters("a: Dict[str, List[int]], b: str = 'x, y', c=(1, 2)")
    assert [p["default_value"] for p in nested] == [None, "'x, y'", "(1, 2)"]
    assert [(p["name"], p["kind"]) for p in T.parse_parameters("a, /, b, *, c")] == [("a", "positional"), ("b", "positional"), ("c", "keyword")]


def test_literal_types(spark):
    cases = {"None": "None", "False": "bool", "f'x'": "str", "12": "int", "0.5": "float", "[1]": "list", "{}": "dict", "{1: 2}": "dict", "{1, 2}": "set", "1, 2": "tuple", "a and b": "bool", "a / b": "float", "a * b": "int", "User(x)": "User", "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r["e"]: r["t"] for r in df.select("e", T.literal_type(F.col("e")).alias("t")).collect()} == cases


def test_multi_line_strings_hold_no_calls(spark):
    code = 'def f():\n    """text call()\n    other(1)\n    """\n    return g(1)\n'
    got = extract.python_tables(spark.createDataFrame([("a.py", code), ("b.py", None)], "file_path string, content string"))
    assert [r["callee_name"] for r in got["call_sites"].collect()] == ["g"]


def test_repeated_ids_keep_the_last(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 3, "c")], "id string, sym_ord int, v string")
    assert {(r["id"], r["v"], r["sym_ord"]) for r in graph.latest(df).collect()} == {("x", "b", 1), ("y", "c", 3)}


def test_search_filters():
    f = search.parse_filter("in:Float big  out:dict kind:class in: IN:x orders")
    assert (f.in_type, f.out_type, f.kind, f.keywords) == ("", "dict", "class", ["big IN:x orders"])
    assert search.parse_filter("in").keywords == ["in"] and search.parse_filter("kind:").keywords == []


def test_debounce(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0 + dt.timedelta(milliseconds=ms), i) for i, ms in enumerate((0, 100, 200, 900, 1000, 5000))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v long")
    assert [r["v"] for r in last_of_burst(df, "k", "ts", "v", 0.25).orderBy("v").collect()] == [2, 4, 5]
    nav = spark.createDataFrame([("u", t0 + dt.timedelta(milliseconds=850))], "k string, ts timestamp")
    assert [r["v"] for r in suppressed(df, nav, "k", "ts").orderBy("v").collect()] == [0, 1, 2, 5]
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = debounced_stream(stream, "k", "ts", "v").writeStream.outputMode("append").format("memory").queryName("deb").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert all(r["v"] in (2, 4, 5) for r in spark.table("deb").collect())


def test_enrichment(spark):
    functions = spark.createDataFrame([("a.py", f"f{i}", f"code {i}", i) for i in range(4)], "file_path string, name string, snippet string, sym_ord int")
    batches = enrich.micro_batches(functions)
    assert sorted(len(r["names"]) for r in batches.collect()) == [1, 3]
    answer = lambda prompts: ["\n".join(f"{enrich.MARK}{p.split(' ===')[0]} ===\nsays {p.split(' ===')[0]}" for p in text.split(enrich.MARK)[1:]) for text in prompts]
    got = {r["symbol"]: r["summary"] for r in enrich.split_answers(enrich.ask(batches, answer)).collect()}
    assert got == {f"f{i}": f"says f{i}" for i in range(4)}
    files = spark.createDataFrame([("a/x.py", "one"), ("b.py", "two")], "file_path string, content string")
    cache = spark.createDataFrame([("b.py", "b8a9f715dbb64fd5c56e7783c6820a61", "known")], "file_path string, content_hash string, summary string")
    out = enrich.summarise(files, cache, lambda prompts: [f"```\n{len(p)}\n```" for p in prompts])
    assert {r["file_path"]: r["summary"] for r in out["files"].collect()}["b.py"] == "known"
    assert out["folders"].count() == 2 and out["project"].count() == 1


def test_imports_read_files_once(spark):
    """Both forms of import come from one pass over the files."""
    from lodestar.operators import extract

    files = spark.createDataFrame([("p/a.py", "import os.path as p, sys\nfrom ..b import (c as d,\n  e)\nfrom . import *\nx = 1\n")], "file_path string, content string")
    found = extract.python_imports(extract.python_places(files))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = sorted(tuple(r) for r in found.select("module_name", "imported_symbol", "alias", "is_wildcard", "level").fillna("-").collect())
    assert got == [("", "-", "-", True, 1), ("b", "c", "d", False, 2), ("b", "e", "-", False, 2), ("os.path", "-", "p", False, 0), ("sys", "-", "-", False, 0)]


def test_symbols_need_their_own_statements_only(spark):
    """Statements without a part in a symbol aren't put down for it, and the symbols stay as they are."""
    from lodestar.operators import extract
    from lodestar.sources.stages import stage

    text = "__all__ = ['f']\n# about f\n@a\n@b(\n  1)\ndef f(x: int,\n      y=2):\n    \"\"\"Doc.\"\"\"\n    z = x\n    load(z)\n    if z:\n        return 1\n    return None\n\nclass C(B):\n    k = 1\n    # on m\n    async def m(self):\n        # inside\n        await self.n()\n        return 'x'\nrun(C)\n"
    places = stage(extract.python_places(spark.createDataFrame([("p/a.py", text)], "file_path string, content string")), "all-places")
    few = stage(extract.symbol_places(places), "few-places")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(extract.python_symbols(few)) == rows(extract.python_symbols(places))
    assert few.where("raw like '%load(%' or raw like '%run(%' or raw like '%z = x%'").isEmpty()
