"""Symbol ranges, comments that document symbols, and lookups by line."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import blocks, extract, intervals

CODE = '''# about f
#   more about f
@deco(g(1))
@other
def f(a, b=(1,
            2)):
    x = call(a)

    def inner():
        # not a symbol
        return hidden()
    return "s"


# far away

class C(Base):
    # of y
    y = 1

    # of m
    @property
    # between
    def m(self):
        return self.z(
            1)

    # not next to it

    def p(self): return 1

    class D:
        def n(self):
            """Doc of n."""
# trailing
if True:
    def late():
        # comment inside
        pass
main(f)
'''


@pytest.fixture(scope="module")
def python(spark):
    files = [("a.py", CODE), ("empty.py", ""), ("null.py", None), ("open.py", "class A:\n    def m(self):\n        x = (1,\n")]
    return extract.python_tables(spark.createDataFrame(files, "file_path string, content string"))


def test_ranges_of_blocks(python):
    got = {r["id"]: (r["start_line"], r["start_column"], r["end_line"], r["end_column"]) for r in python["symbols"].collect()}
    assert got == {
        "a.py#f": (3, 1, 12, 14),
        "a.py#C": (17, 1, 34, 27),
        "a.py#C.m": (22, 5, 26, 14),
        "a.py#C.p": (30, 5, 30, 25),
        "a.py#C.n": (33, 9, 34, 27),
        "a.py#late": (37, 5, 39, 12),
        "open.py#A": (1, 1, 4, 0),
        "open.py#A.m": (2, 5, 4, 0),
    }


def test_comments_document_what_stands_below(python):
    got = {r["id"].split("#")[1]: (r["summary"], r["description"]) for r in python["symbols"].select("id", "docstring.summary", "docstring.description").collect()}
    assert got["f"] == ("about f", "more about f")
    assert got["C"] == (None, None) and got["C.p"] == (None, None) and got["late"] == (None, None)
    assert got["C.m"] == ("of m", "") and got["C.n"] == ("Doc of n.", "")


def test_decorators_are_no_calls(python):
    calls = {(r["caller_id"], r["callee_name"]) for r in python["call_sites"].collect()}
    assert calls == {("a.py#f", "call"), ("a.py#f", "hidden"), ("a.py#C.m", "self.z"), ("a.py#<module>", "main")}


def test_blocks_against_plain_nesting():
    """Random indents: ends, owners and bodies as a quadratic search finds them."""
    rnd = random.Random(2)
    for _ in range(40):
        rows = [(i, rnd.choice(["def", "class", "other", "other", "blank", "comment"]), f"n{i}", rnd.choice([0, 0, 2, 4, 6]), i, 9) for i in range(60)]
        got = blocks.file_places(pd.DataFrame(rows, columns=["stmt", "what", "name", "indent", "last", "width"]).assign(file_path="f")).to_dict("records")
        solid = [r for r in rows if r[1] not in ("blank", "comment")]
        for r, g in zip(rows, got, strict=True):
            i, what, _, indent, *_ = r
            if what in ("blank", "comment"):
                continue
            around = [h for h in solid if h[0] < i and h[1] in ("def", "class") and h[3] < indent and not any(h[0] < s[0] < i and s[3] <= h[3] for s in solid)]
            functions = [h for h in around if h[1] == "def"]
            assert (None if pd.isna(g["body_of"]) else g["body_of"]) == (functions[0][0] if functions else None)
            if not functions:
                assert (None if pd.isna(g["owner"]) else g["owner"]) == (around[0][2] if around else None)
            if what in ("def", "class"):
                behind = [s[0] for s in solid if s[0] > i and s[3] <= indent]
                assert (None if pd.isna(g["stop"]) else g["stop"]) == (behind[0] if behind else None)
                inside = [s[0] for s in solid if s[0] >= i and (not behind or s[0] < behind[0])]
                assert g["end_line"] == inside[-1]


def test_long_file_takes_time_linear_in_its_lines(spark):
    """100,000 lines, half of them heads: a join of every head with every later line would not end."""
    def code(n):
        return "".join(f"class C{i}:\n    def m(self):\n        go({i})\n\n" for i in range(n))

    places = lambda n: pd.DataFrame({"file_path": "f", "stmt": range(n), "what": ["class", "def", "other", "blank"] * (n // 4), "name": "x", "indent": [0, 4, 8, 0] * (n // 4), "last": range(n), "width": 1})
    took = []
    for n in (40_000, 400_000):
        rows, began = places(n), time.perf_counter()
        blocks.file_places(rows)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1
    began = time.perf_counter()
    got = extract.python_tables(spark.createDataFrame([("big.py", code(25_000))], "file_path string, content string"))["symbols"]
    assert got.where("end_line = start_line + 2").count() == 25_000
    assert time.perf_counter() - began < 120


def test_intervals_against_every_pair(spark):
    rnd = random.Random(6)
    spans = [(f"f{rnd.randint(0, 3)}", a := rnd.randint(-20, 5000), a + rnd.choice([-1, 0, 0, 1, 3, 4, 15, 16, 17, 63, 300, 4000]), f"s{i}", rnd.choice(["class", "method", "function"])) for i in range(300)]
    spans += [(None, 0, 100, "none", "class"), spans[0], ("f0", -5, 2_000_000_000, "whole", "class")]
    points = [(f"f{rnd.randint(0, 4)}", rnd.randint(-30, 9000)) for _ in range(400)] + [("f0", 1_999_999_999), (None, 5), ("f0", None)]
    s = spark.createDataFrame(spans, "file_path string, start int, end int, id string, kind string")
    p = spark.createDataFrame(points, "file_path string, line int")
    want = {}
    for f, line in set(points):
        held = [(e - a, k == "class", -a, i) for g, a, e, i, k in spans if None not in (f, g, line) and f == g and a <= line <= e]
        if held:
            want[f, line] = min(held)[3]
    assert {(r["file_path"], r["line"]): r["id"] for r in intervals.innermost(p, s).collect()} == want
    every = sorted((f, line, i) for f, line in set(points) for g, a, e, i, _ in spans if None not in (f, g, line) and f == g and a <= line <= e)
    assert sorted((r["file_path"], r["line"], r["id"]) for r in intervals.containing(p.distinct(), s).collect()) == every


def test_hot_file_is_spread_over_its_cells(spark):
    """One file with all spans: no cell of a level gets more than the spans that meet it."""
    s = spark.range(20_000).selectExpr("'f' file_path", "cast(id * 10 as int) start", "cast(id * 10 + 9 as int) end", "cast(id as string) id", "'method' kind")
    p = spark.range(0, 200_000, 7).selectExpr("'f' file_path", "cast(id as int) line")
    cells = intervals.cells(s)
    assert cells.groupBy("file_path", "level", "cell").count().agg({"count": "max"}).first()[0] <= 4
    assert intervals.innermost(p, s).where("id <> cast(floor(line / 10) as string)").count() == 0


def test_excerpts(spark):
    files = spark.createDataFrame([("a", "1\r\n2\n3\r4"), ("b", None)], "file_path string, content string")
    spans = spark.createDataFrame([("a", 2, 3, "x"), ("a", 3, 9, "y"), ("a", 3, 2, "z"), ("c", 1, 1, "gone")], "file_path string, start int, end int, id string")
    assert {r["id"]: r["excerpt"] for r in intervals.excerpts(files, spans).collect()} == {"x": "2\n3", "y": "3\n4", "z": ""}
    assert intervals.excerpts(files, spans, 1).where("id = 'x'").first()["excerpt"] == "2"


def test_engine_finds_the_symbol_at_a_cursor(spark, tmp_path):
    from lodestar.engine import Engine

    root = tmp_path / "proj"
    (root / "web").mkdir(parents=True)
    (root / "a.py").write_text(CODE)
    (root / "web" / "util.ts").write_text("// adds\nexport function add(\n  a: number,\n): number {\n  return a;\n}\n")
    (root / "web" / "index.ts").write_text("import { add as plus } from './util';\nexport const two = () =>\n  plus(1);\n")
    engine = Engine.scan(spark, str(root), resolve_ts_paths=True)
    cursors = spark.createDataFrame([("proj/a.py", 10), ("proj/a.py", 18), ("proj/a.py", 15), ("proj/web/util.ts", 5)], "file_path string, line int")
    assert {(r["file_path"], r["line"]): r["id"] for r in engine.enclosing(cursors).collect()} == {("proj/a.py", 10): "proj/a.py#f", ("proj/a.py", 18): "proj/a.py#C", ("proj/web/util.ts", 5): "proj/web/util.ts#add"}
    assert {r["id"]: r["excerpt"] for r in engine.excerpts().collect()}["proj/a.py#late"] == "    def late():\n        # comment inside\n        pass"
    assert engine.search("adds").first()["id"] == "proj/web/util.ts#add"
    assert engine.edges.where("source = 'proj/web/index.ts#two' and target = 'proj/web/util.ts#add' and kind = 'calls'").count() == 1


def test_places_are_found_without_a_shuffle(spark):
    """Every file is read by itself: what many short files cost must be their statements, not a sort or a frame for each."""
    files = spark.range(2000).selectExpr("concat('f', id, '.py') as file_path", r"'# n\nclass A:\n    def m(self):\n        go(\n            1)\n\n# end' as content")
    lines = extract.python_places(files)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    got = extract.python_calls(lines).select("caller_id", "line", "col", "callee_name")
    assert got.count() == 2000 and got.where("caller_id like '%#A.m' and line = 4 and col = 9 and callee_name = 'go'").count() == 2000
    one = [r["stmt"] for r in lines.where("file_path = 'f7.py'").collect()]
    assert one == [1, 2, 3, 4]


def test_spans_that_reach_alike_are_compared_once(spark):
    """20,000 classes over a whole file and as many cursors in it: one span for each cursor, not 400 million pairs."""
    n = 20_000
    i = F.col("id")
    wide = spark.range(n).select(F.lit("a.py").alias("file_path"), F.lit(0).cast("long").alias("start"), F.lit(10**9).cast("long").alias("end"), F.format_string("C%05d", i).alias("id"), F.lit("class").alias("kind"))
    short = spark.createDataFrame([("a.py", 5, 7, "f", "function"), ("a.py", 5, 7, "D", "class"), ("a.py", 6, 6, "E", "class")], wide.schema)
    began = time.perf_counter()
    got = {r["line"]: r["id"] for r in intervals.innermost(spark.range(n).select(F.lit("a.py").alias("file_path"), i.alias("line")), wide.unionByName(short)).collect()}
    assert time.perf_counter() - began < 30
    assert got == {**dict.fromkeys(range(n), "C00000"), 5: "f", 6: "E", 7: "f"}


def test_module_statements_are_those_of_the_whole_pass(spark):
    parts = ["def f(a):", "class C:", "\n", "\n", "(", ")", '"""', "'''", "'", '"', "# c", "# '''", "\\", "\\\n", "run(x)", "if x:", "@deco", "return h(1)", "\r\n", "import os(", "x = 1", "\x0c", "[", "}"]
    r = random.Random(3)
    texts = ["", CODE, CODE + "run(C)\n    .more(1)\nif x:\n    go(1,\ndef g(\n2)\n"]
    texts += ["\n".join(" " * r.choice([0, 0, 2, 4]) + "".join(r.choice(parts) for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 25))) for _ in range(3000)]

    def whole(text):
        found = blocks.file_statements("f", text)
        return [(f, c) for f, c, loose in zip(found["first"], found["code"], found["loose"]) if loose and "(" in c]

    assert [blocks.module_statements(t) for t in texts] == [whole(t) for t in texts]
    assert sum(len(whole(t)) for t in texts) > 1000
    files = spark.createDataFrame([("src\\a.py", CODE + "run(C, go(2))\n"), ("b.py", None)], "file_path string, content string")
    assert blocks.read_module(files).count() == len(whole(CODE + "run(C, go(2))\n"))
    own, both = (extract.python_steps(extract.python_calls(x)).drop("call_ord").collect() for x in (blocks.read_module(files), blocks.read(files)))
    assert own == both and [x["callee_name"] for x in own][-2:] == ["run", "go"]
