"""Statements of files and where blocks begin and end: one pass per file, with a stack of open heads.

A file is one row when it is read, so it fits a task, and what a pass finds needs no shuffle. Files
are read one after another and their statements leave in batches of many files. Everything derived
from a place (docstrings, decorators, comments) is then an equality join on (file, statement).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from lodestar.functions.text import mask_code, normalize_path

#: what a statement is
COMMENT, BLANK, DECORATOR, DEF, CLASS, OTHER = "comment", "blank", "decorator", "def", "class", "other"
#: columns of places, and of the statements that have them
PLACE = {
    **dict.fromkeys(("stop", "end_line", "end_column"), pa.int32()),
    "owner": pa.string(),
    "body_of": pa.int32(),
    **dict.fromkeys(("inner", "loose"), pa.bool_()),
    **dict.fromkeys(("head", "doc_of", "comment_of"), pa.int32()),
}
STATEMENT = {
    "file_path": pa.string(),
    **dict.fromkeys(("stmt", "first", "last", "indent", "width"), pa.int32()),
    **dict.fromkeys(("code", "raw", "what", "name", "caller"), pa.string()),
    **PLACE,
}
#: statements in one batch
BATCH = 20_000

QUOTES = re.compile(r"\"\"\"|'''")
GOES_ON = re.compile(r"\\[ \t\x0b\f\r]*\Z")
BRACKET = re.compile(r"[(\[{)\]}]")
HEAD = re.compile(r"\s*(?:(@)|class\s+(\w+)|(?:async\s+)?def\s+(\w+))", re.A)


def statements(content: str | None) -> dict[str, list]:
    """first, last, indent, width, code, raw, what and name of a Python text's statements, lone comments and blank lines.

    Strings and comments are blanked in ``code``. A line belongs to the statement before it where a bracket or a
    triple quote is open or a backslash ends that line.
    """
    text = re.sub("\r\n?", "\n", content or "")
    out: dict[str, list] = {c: [] for c in ("first", "last", "indent", "width", "code", "raw", "what", "name")}
    firsts, lasts, indents, widths, shown_codes, shown_raws, whats, names = out.values()
    raws, codes = text.split("\n"), mask_code(text).split("\n")
    depth, quoted, begun, goes_on = 0, 0, 0, False

    def put(behind: int) -> None:
        one = behind - begun == 1
        code, raw = (codes[begun], raws[begun]) if one else ("\n".join(codes[begun:behind]), "\n".join(raws[begun:behind]))
        name, m = None, HEAD.match(code)
        if m:
            what = DECORATOR if m[1] else CLASS if m[2] else DEF
            name = m[2] or m[3]
        elif code.strip(" \n\t"):
            what = OTHER
        else:
            shown = raw.strip(" \t")
            what = COMMENT if shown.startswith("#") else OTHER if shown else BLANK
        firsts.append(begun + 1)
        lasts.append(behind)
        indents.append(len(code) - len(code.lstrip(" \t")))
        widths.append(len(raws[behind - 1]))
        shown_codes.append(code)
        shown_raws.append(raw)
        whats.append(what)
        names.append(name)

    for i, code in enumerate(codes):
        if i and not goes_on:
            put(i)
            begun = i
        if BRACKET.search(code):
            depth += code.count("(") + code.count("[") + code.count("{") - code.count(")") - code.count("]") - code.count("}")
        if '"""' in raws[i] or "'''" in raws[i]:
            quoted += len(QUOTES.findall(raws[i]))
        goes_on = depth > 0 or quoted % 2 == 1 or "\\" in code and GOES_ON.search(code) is not None
    put(len(codes))
    return out


def places(stmts: list[int], whats: list[str], names: list[str | None], indents: list[int], lasts: list[int], widths: list[int]) -> dict[str, list]:
    """PLACE of one file's statements, in their order.

    ``stop`` is the first statement behind a head's block, ``end_line`` and ``end_column`` the end of its last
    statement; ``owner`` the outermost class around it. ``body_of`` is the outermost function whose body
    holds a statement, ``inner`` tells that a further block lies between. ``head`` is the
    statement that a decorator decorates, ``comment_of`` the statement right below a comment, ``doc_of``
    the head whose body a statement opens; ``loose`` statements stand outside every block.
    """
    n = len(stmts)
    out: dict[str, list] = {c: [False if c in ("inner", "loose") else None] * n for c in PLACE}
    # open heads, how many of them are functions, and the places of the outermost function and class
    stack: list[int] = []
    functions: list[int] = []
    decorators: list[int] = []
    comments: list[int] = []
    opened: set[int] = set()
    before = -1

    def close(until: int | None) -> None:
        i = stack.pop()
        if functions and functions[-1] == i:
            functions.pop()
        out["stop"][i], out["end_line"][i], out["end_column"][i] = until, lasts[before], widths[before]

    for i in range(n):
        what = whats[i]
        if what == COMMENT:
            comments.append(i)
            continue
        if what == BLANK:
            comments.clear()
            continue
        while stack and indents[stack[-1]] >= indents[i]:
            close(stmts[i])
        for c in comments:
            out["comment_of"][c] = stmts[i]
        comments.clear()
        if stack and stack[-1] not in opened:
            opened.add(stack[-1])
            out["doc_of"][i] = stmts[stack[-1]]
        if functions:
            out["body_of"][i] = stmts[functions[0]]
            out["inner"][i] = stack[-1] != functions[0]
        elif stack:
            out["owner"][i] = names[stack[0]]
        else:
            out["loose"][i] = what == OTHER
        if what == DECORATOR:
            decorators.append(i)
        else:
            for d in decorators:
                out["head"][d] = stmts[i]
            decorators.clear()
        before = i
        if what in (DEF, CLASS):
            stack.append(i)
            if what == DEF:
                functions.append(i)
    while stack:
        close(None)
    return out


def file_places(rows: pd.DataFrame) -> pd.DataFrame:
    """Places of one file's statements(file_path, stmt, what, name, indent, last, width)."""
    rows = rows.sort_values("stmt", ignore_index=True)
    out = places(*[rows[c].tolist() for c in ("stmt", "what", "name", "indent", "last", "width")])
    kinds = {c: "boolean" if t == pa.bool_() else "string" if t == pa.string() else "Int64" for c, t in PLACE.items()}
    return pd.DataFrame({"file_path": rows["file_path"], "stmt": rows["stmt"], **{c: pd.array(v, kinds[c]) for c, v in out.items()}})


def file_statements(path: str, content: str | None) -> dict[str, list]:
    """STATEMENT of one file; ``caller`` is the outermost function around, with its class. Blank lines are left out."""
    found = statements(content)
    stmts = list(range(1, len(found["first"]) + 1))
    place = places(stmts, *[found[c] for c in ("what", "name", "indent", "last", "width")])
    names, owners = found["name"], place["owner"]
    called = [None if b is None else f"{owners[b - 1]}.{names[b - 1]}" if owners[b - 1] is not None else names[b - 1] for b in place["body_of"]]
    rows = {"file_path": [path] * len(stmts), "stmt": stmts, **found, "caller": called, **place}
    kept = [i for i, (w, below) in enumerate(zip(found["what"], place["comment_of"], strict=True)) if w != BLANK and (w != COMMENT or below is not None)]
    return rows if len(kept) == len(stmts) else {c: [v[i] for i in kept] for c, v in rows.items()}


MODULE_STATEMENT = {"file_path": pa.string(), "first": pa.int32(), "code": pa.string(), "caller": pa.string(), "loose": pa.bool_()}


def module_statements(content: str | None) -> list[tuple[int, str]]:
    """(first, code) of those statements outside every block that hold a bracket, as ``statements`` and ``places`` have them.

    While a head is open, only a line that is indented no further than the outermost one can stand outside it, so
    other lines aren't looked at. Whether such a line begins a statement follows from the brackets and triple
    quotes before it, which are counted.
    """
    text = re.sub("\r\n?", "\n", content or "")
    masked, raw = f"\n{mask_code(text)}\n", f"\n{text}\n"
    triples = [m.span() for m in QUOTES.finditer(raw)]
    # a triple quote inside a string or a comment, or a string that breaks off behind a backslash, moves where statements begin
    if any(masked[i] != '"' and masked[j - 1] != '"' for i, j in triples) or masked.count("\n") != raw.count("\n"):
        found = statements(content)
        place = places(list(range(1, len(found["first"]) + 1)), *[found[c] for c in ("what", "name", "indent", "last", "width")])
        return [(f, c) for f, c, loose in zip(found["first"], found["code"], place["loose"], strict=True) if loose and "(" in c]
    out: list[tuple[int, str]] = []
    # open brackets, triple quotes and lines before ``counted``
    depth, quoted, line, counted = 0, 0, 1, 1

    def goes_on(until: int) -> bool:
        """Whether what stands before the line at ``until`` goes on in it."""
        nonlocal depth, quoted, line, counted
        code = masked[counted:until]
        if BRACKET.search(code):
            depth += code.count("(") + code.count("[") + code.count("{") - code.count(")") - code.count("]") - code.count("}")
        while quoted < len(triples) and triples[quoted][0] < until:
            quoted += 1
        line += code.count("\n")
        counted = until
        before = code[code.rfind("\n", 0, -1) + 1 : -1]
        return depth > 0 or quoted % 2 == 1 or "\\" in before and GOES_ON.search(before) is not None

    # the indent of the outermost open head
    outer: int | None = None
    at = 1
    while m := _line(outer).search(masked, at - 1):
        begin, at = m.start() + 1, masked.index("\n", m.end() - 1) + 1
        if begin > counted and goes_on(begin):
            continue
        first = line
        while goes_on(at) and at < len(masked):
            at = masked.index("\n", at) + 1
        code = masked[begin : at - 1]
        head = HEAD.match(code)
        outer = m.end() - 1 - begin if head and not head[1] else None
        if not head and "(" in code:
            out.append((first, code))
    return out


@lru_cache
def _line(most: int | None) -> re.Pattern:
    """A line that is indented by ``most`` at most, with the end of the one before it."""
    return re.compile(r"\n[ \t]*[^ \t\n]" if most is None else rf"\n[ \t]{{0,{most}}}[^ \t\n]")


def read_module(files: DataFrame) -> DataFrame:
    """MODULE_STATEMENT of Python files(file_path, content): what stands outside every block and may hold a call."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, first, code, None, True) for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True) for first, code in module_statements(content.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(MODULE_STATEMENT), MODULE_STATEMENT.values(), strict=True)], names=list(MODULE_STATEMENT))

    ddl = ", ".join(f"{n} {from_arrow_type(t).simpleString()}" for n, t in MODULE_STATEMENT.items())
    return files.where("file_path is not null").select(normalize_path(F.col("file_path")).alias("file_path"), "content").mapInArrow(task, ddl)


def read(files: DataFrame) -> DataFrame:
    """STATEMENT of Python files(file_path, content), in time linear in a file's length.

    A task holds a batch of files and of statements.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in STATEMENT}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held[c], t) for c, t in STATEMENT.items()], names=list(STATEMENT))
            for v in held.values():
                v.clear()
            return batch

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for c, v in file_statements(path, content.as_py()).items():
                    held[c] += v
                if len(held["stmt"]) >= BATCH:
                    yield out()
        yield out()

    ddl = ", ".join(f"{n} {from_arrow_type(t).simpleString()}" for n, t in STATEMENT.items())
    return files.where("file_path is not null").select(normalize_path(F.col("file_path")).alias("file_path"), "content").mapInArrow(task, ddl)
