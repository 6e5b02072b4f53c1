"""Small text helpers, as columns where Spark has the function and as Arrow-batched UDFs where it hasn't."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "([{", ")]}"


PYTHON_TOKEN = re.compile(r"#[^\n]*|(\"\"\"|''')(?:\\.|(?!\1).)*(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", re.S)
SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", re.S)
PYTHON_BEGIN, SCRIPT_BEGIN = re.compile("[#\"']"), re.compile("[/`\"']")


def mask_code(text: str, python: bool = True) -> str:
    """``text`` with the insides of strings and comments turned into blanks, length and lines kept.

    Knows '#' comments and triple quotes (Python) or // and /* */ comments and back quotes (scripts).
    """

    def blank(s: str) -> str:
        inside = "\n".join([" " * len(line) for line in s.split("\n")]) if "\n" in s else " " * len(s)
        return inside if s[0] in "#/" else '"' + inside[1:-1] + ('"' if len(s) > 1 else "")

    # where a token may begin is sought by one set of signs, which is far quicker than trying each form at every place
    begins, token = (PYTHON_BEGIN, PYTHON_TOKEN) if python else (SCRIPT_BEGIN, SCRIPT_TOKEN)
    out, kept, m = [], 0, begins.search(text)
    while m:
        found = token.match(text, m.start())
        if found:
            out += (text[kept : m.start()], blank(found[0]))
            kept = found.end()
        m = begins.search(text, kept if found else m.end())
    return "".join(out) + text[kept:] if out else text


def split_top(text: str, delimiter: str) -> list[str]:
    """Split outside brackets and quotes; parts are trimmed and an empty tail is dropped."""
    parts, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in OPEN or c in CLOSE:
            depth += 1 if c in OPEN else -1
        elif c == delimiter and depth <= 0:
            parts.append(text[at:i].strip())
            at = i + 1
    tail = text[at:].strip()
    return [*parts, tail] if tail else parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_top_level(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else split_top(t, d) for t, d in zip(text, delimiter, strict=True)])


PARAMETER = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "type_hint", "default_value", "kind")]))


def parse_parameters(text: str) -> list[dict]:
    """Parameters of a signature: '/' is skipped, a bare '*' makes what follows keyword-only."""
    out, keyword_only = [], False
    for part in split_top(text or "", ","):
        if part in ("/", ""):
            continue
        if part == "*":
            keyword_only = True
            continue
        kind = "kwargs" if part.startswith("**") else "args" if part.startswith("*") else ""
        halves = split_top(part, "=")
        default = "=".join(halves[1:]) if len(halves) > 1 else None
        named = split_top(halves[0], ":")
        hint = ":".join(named[1:]) if len(named) > 1 else None
        keyword_only = keyword_only or kind == "args"
        out.append({"name": named[0].lstrip("*"), "type_hint": hint, "default_value": default, "kind": kind or ("keyword" if keyword_only or default is not None else "positional")})
    return out


@F.pandas_udf(PARAMETER)
def parameters(text: pd.Series) -> pd.Series:
    return text.map(parse_parameters, na_action="ignore")


DOC = T.StructType([T.StructField("summary", T.StringType()), T.StructField("description", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("returns", T.StringType())])
HEADER = re.compile(r"^(args|arguments|parameters|params|returns?|yields|raises|examples?|notes?)\s*:?\s*$", re.I)
FIELD = re.compile(r"^(\*{0,2}\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$")
TAG = re.compile(r"^:(param|return|returns|rtype|raises|type)\s*([^:]*):\s*(.*)$")


def clean_docstring(raw: str) -> str:
    """The text of a string literal without prefix, quotes and common indent."""
    m = re.match(r"(?is)^[rubf]{0,2}(\"\"\"|'''|\"|')(.*)\1$", raw.strip())
    lines = (m[2] if m else raw).expandtabs().split("\n")
    rest = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    cut = min(rest, default=0)
    return "\n".join([lines[0].strip(), *(x[cut:].rstrip() for x in lines[1:])]).strip()


def parse_doc(raw: str | None, comments: str | None = None) -> dict | None:
    """Summary, description, parameters and return text; leading comments stand in for a missing docstring."""
    text = clean_docstring(raw) if raw else ""
    if not text:
        told = [s for line in (comments or "").split("\n") if (s := re.sub(r"^\s*#+\s?", "", line).strip())]
        return {"summary": told[0], "description": "\n".join(told[1:]), "params": {}, "returns": None} if told else None
    prose, params, returns, section, current = [], {}, [], "", ""
    for line in text.split("\n"):
        s = line.strip()
        header, tag = HEADER.match(s), TAG.match(s)
        if re.fullmatch(r"-{3,}", s):
            continue
        if tag:
            section, current = tag[1], tag[2].split()[-1] if tag[2].split() else ""
            if section == "param":
                params[current] = tag[3]
            elif section.startswith("return"):
                returns.append(tag[3])
        elif header:
            section, current = header[1].lower(), ""
        elif section.startswith(("arg", "param")):
            field = FIELD.match(s)
            if field and s:
                current = field[1].lstrip("*")
                params[current] = f"({field[2]}) {field[3]}" if field[2] else field[3]
            elif s and current:
                params[current] = f"{params[current]} {s}".strip()
        elif section.startswith("return"):
            if s:
                returns.append(s)
        elif not section:
            prose.append(s)
    summary, _, description = "\n".join(prose).strip().partition("\n")
    return {"summary": summary, "description": description.strip(), "params": params, "returns": " ".join(returns) or None}


@F.pandas_udf(DOC)
def docstring(raw: pd.Series, comments: pd.Series) -> pd.DataFrame:
    rows = [parse_doc(a, b) or {"summary": None, "description": None, "params": None, "returns": None} for a, b in zip(raw, comments, strict=True)]
    return pd.DataFrame(rows, columns=DOC.names)


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def literal_type(expression: Column) -> Column:
    """The type of a returned expression, by its shape; null where the shape doesn't tell."""
    e = F.trim(expression)
    rules = [
        (e.isin("", "None"), "None"),
        (e.isin("True", "False"), "bool"),
        (e.rlike(r"^(?i:f|r|u|b|rf|fr)?(\"[^\"]*\"|'[^']*')$"), "str"),
        (e.rlike(r"^-?\d+$"), "int"),
        (e.rlike(r"^-?\d*\.\d+$"), "float"),
        (e.rlike(r"^\[.*\]$|^list\s*\("), "list"),
        (e.rlike(r"^\{\s*\}$|^\{[^,]*:.*\}$|^dict\s*\("), "dict"),
        (e.rlike(r"^\{.*\}$|^set\s*\("), "set"),
        (e.rlike(r"^\(\s*\)$|^\(.*,.*\)$|^tuple\s*\(") | (e.rlike(",") & ~e.rlike(r"[(\[{]")), "tuple"),
        (e.rlike(r"==|!=|<=|>=|<|>|\bin\b|\bis\b|\band\b|\bor\b|\bnot\b"), "bool"),
        (e.rlike(r"[+\-*/%]") & e.rlike("/") & ~e.rlike("//"), "float"),
        (e.rlike(r"[+\-*/%]"), "int"),
    ]
    out = F.when(e.rlike(r"^[A-Z]\w*\s*\("), F.regexp_extract(e, r"^([A-Z]\w*)\s*\(", 1))
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def method_kind(decorators: Column, is_async: Column) -> Column:
    return F.when(F.exists(decorators, lambda d: d.startswith("@classmethod")), F.lit("class_method")).when(F.exists(decorators, lambda d: d.startswith("@staticmethod")), F.lit("static_method")).when(is_async, F.lit("async_function")).otherwise(F.lit("method"))


def export_flag(name: Column, path: Column, exported: Column) -> Column:
    """In __all__ where the file has one; else public and in an __init__.py."""
    return F.coalesce(F.array_contains(exported, name), path.endswith("__init__.py") & ~name.startswith("_"))


def source_order(line: Column, column: Column) -> Column:
    """Where something stands in the source, as one number: files by their 64-bit hash, then lines, then columns.

    It has room for lines and columns up to 2^31 and keeps files with unequal hashes apart.
    """
    file = F.xxhash64("file_path").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return (file * F.lit(1 << 62).cast("decimal(19,0)") + (line.cast("long") * F.lit(1 << 31) + column.cast("long"))).cast("decimal(38,0)")
