"""Filtered, scored symbol search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the words of a result's reason
SAYS = {"exact": "名称完全匹配: ", "prefix": "名称前缀匹配: ", "inside": "名称包含关键字: ", "summary": "文档摘要命中: ", "description": "详细文档命中: ", "blank": "默认推荐", "filter": "匹配类型过滤规则"}
#: fixed values: points of a match
EXACT, PREFIX, INSIDE, SUMMARY, DESCRIPTION, FILTER_ONLY, BLANK = 100, 50, 30, 25, 15, 10, 1


@dataclass
class Filter:
    in_type: str = ""
    out_type: str = ""
    kind: str = ""
    keywords: list[str] = field(default_factory=list)


def parse_filter(query: str) -> Filter:
    """in:, out: and kind: words (the last holds, an empty one takes the filter back); the rest is one phrase.

    Their names are lower case, as observed: "IN:float" is part of the phrase.
    """
    out, rest = Filter(), []
    for word in query.split():
        name, colon, value = word.partition(":")
        where = {"in": "in_type", "out": "out_type", "kind": "kind"}.get(name)
        if where and colon:
            setattr(out, where, value.lower())
        else:
            rest.append(word)
    if rest:
        out.keywords = [" ".join(rest)]
    return out


def filtered(nodes: DataFrame, f: Filter) -> DataFrame:
    """Predicates on kind, parameter types and return type; Catalyst pushes what the source can take."""
    if f.kind:
        nodes = nodes.where(F.contains(F.lower("kind"), F.lit(f.kind)))
    if f.in_type:
        nodes = nodes.where((F.col("kind") != "class") & F.exists("type_hints", lambda t: F.contains(F.lower(t), F.lit(f.in_type))))
    if f.out_type:
        nodes = nodes.where((F.col("kind") != "class") & F.contains(F.lower(F.coalesce("return_type", F.lit(""))), F.lit(f.out_type)))
    return nodes


def keyword_score(keyword: str) -> tuple[Column, Column, Column, Column]:
    """(score, exact, reason by name, reason by documentation) of one keyword."""
    k, name = F.lit(keyword.lower()), F.lower("name")
    exact = name == k
    by_name = F.when(name.startswith(k), F.lit(PREFIX)).when(F.contains(name, k), F.lit(INSIDE)).otherwise(F.lit(0))
    in_summary = F.coalesce(F.contains(F.lower("summary"), k), F.lit(False))
    in_text = F.coalesce(F.contains(F.lower("description"), k), F.lit(False))
    by_doc = F.when(in_summary, F.lit(SUMMARY)).when(in_text, F.lit(DESCRIPTION)).otherwise(F.lit(0))
    told = {what: F.lit(f"{SAYS[what]}{keyword.lower()}") for what in ("prefix", "inside", "summary", "description")}
    by_name_reason = F.when(exact, F.concat(F.lit(SAYS["exact"]), "name")).when(name.startswith(k), told["prefix"]).when(F.contains(name, k), told["inside"])
    by_doc_reason = F.when(in_summary, told["summary"]).when(in_text, told["description"])
    return F.when(exact, F.lit(EXACT)).otherwise(by_name + by_doc), exact, by_name_reason, by_doc_reason


def scored(nodes: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``nodes`` with score and reason. Keywords add up until one is the exact name, which ends the count."""
    score, reason, stopped = F.lit(0), F.lit(None).cast("string"), F.lit(False)
    for keyword in keywords:
        own, exact, by_name, by_doc = keyword_score(keyword)
        score = F.when(stopped, score).otherwise(score + own)
        reason = F.when(stopped, reason).otherwise(F.coalesce(by_name, reason, by_doc))
        stopped = stopped | exact
    return nodes.withColumn("score", score.cast("long")).withColumn("reason", reason)


def search(nodes: DataFrame, query: str, limit: int = 20, expand: Callable[[str], Sequence[str]] | None = None) -> DataFrame:
    """The best ``limit`` symbols: filters, then score, then a top-N that never sorts the whole table.

    ``nodes`` need id, name, kind, type_hints, return_type, summary, description, sym_ord.
    ``expand`` may add keywords to a phrase of three or more letters; if it fails it is ignored.
    """
    f = parse_filter(query)
    if not query.strip():
        return nodes.withColumn("score", F.lit(BLANK).cast("long")).withColumn("reason", F.lit(SAYS["blank"])).orderBy("sym_ord", "id").limit(limit)
    found = filtered(nodes, f)
    if not f.keywords:
        return found.withColumn("score", F.lit(FILTER_ONLY).cast("long")).withColumn("reason", F.lit(SAYS["filter"])).orderBy("sym_ord", "id").limit(limit)
    keywords = list(f.keywords)
    if expand and len(keywords[0]) >= 3:
        try:
            keywords += [k for k in expand(keywords[0]) if k not in keywords]
        except Exception:  # noqa: BLE001  a model that fails leaves the plain search
            pass
    return scored(found, keywords).where("score > 0").orderBy(F.col("score").desc(), "sym_ord", "id").limit(limit)


def signature() -> Column:
    return F.concat("name", F.lit("("), F.array_join(F.coalesce("type_hints", F.array().cast("array<string>")), ", "), F.lit(")"), F.when(F.col("return_type").isNotNull(), F.concat(F.lit(" -> "), "return_type")).otherwise(F.lit("")))


def shown_score(score: Column) -> Column:
    return F.least(F.lit(100), F.round(score)).cast("long")
