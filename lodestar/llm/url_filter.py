"""URL filters as a temporal list join (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

#: How exactly a kind of entry names a URL; the most exact active entry decides.
KINDS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user, port and closing dot; '' if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")), r"\.$", "")


def path_of(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """All (kind, pattern) that could name ``url``: itself, its path prefixes, its host, its domains."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")))).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")), F.struct(F.lit("url").alias("kind"), url.alias("pattern")))
    return F.when(host == "", F.slice(exact, 2, 1)).otherwise(F.concat(exact, domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, verdict, active_from, active_until): dated entries as validity intervals.

    ``entries(kind, pattern, verdict, listed_at)`` holds list events; verdict is 'block',
    'allow' or 'remove'. An event holds from its time until the next event of its pattern; of
    events at one time 'allow' comes before 'block' before 'remove', and the last holds.
    Entries with a null field are ignored.
    """
    events = entries.select("kind", "pattern", "verdict", "listed_at").dropna().groupBy("kind", "pattern", "listed_at").agg(F.max(F.struct(F.expr("array_position(array('allow','block','remove'), verdict)").alias("o"), "verdict")).alias("e"))
    following = F.lead("listed_at").over(W.partitionBy("kind", "pattern").orderBy("listed_at"))
    return events.select("kind", "pattern", F.col("e.verdict").alias("verdict"), F.col("listed_at").alias("active_from"), following.alias("active_until")).where("verdict <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, verdict, kind, pattern, active_from) for every row of ``captures``.

    Every capture is joined to the entries active when it was fetched: by equality on its keys
    and by interval on time, so nothing is sorted by host and a host that a third of captures
    share meets a handful of list rows. The most exact kind decides, then the longest pattern,
    then 'allow' before 'block'. A capture that no entry names, a null URL and a null time are
    kept ('keep', other fields null). Repeated rows are all returned, and an empty table gives
    none. Other columns of ``captures`` are not read.
    """
    valid = stage(intervals(entries), "url-intervals")
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched_at"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("pattern")))
    keyed = base.select("*", F.posexplode(F.coalesce(F.concat(none, url_keys(F.col("url"))), none)).alias("pos", "key")).select("id", "url", "fetched_at", (F.col("pos") == 0).cast("int").alias("own"), F.col("key.kind").alias("k"), F.col("key.pattern").alias("p"))
    active = (F.col("k") == F.col("kind")) & (F.col("p") == F.col("pattern")) & (F.col("fetched_at") >= F.col("active_from")) & (F.col("active_until").isNull() | (F.col("fetched_at") < F.col("active_until")))
    hit = F.when(F.col("kind").isNotNull(), F.struct(F.element_at(rank, F.col("kind")).alias("exact"), F.length("pattern").alias("long"), (F.col("verdict") == "allow").alias("allows"), "verdict", "kind", "pattern", "active_from"))
    judged = keyed.join(valid, active, "left").groupBy("id", "url", "fetched_at").agg(F.max(hit).alias("hit"), F.sum("own").alias("copies"))
    whole = judged.select("id", "url", "fetched_at", "hit", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.select("id", "url", "fetched_at", F.coalesce("hit.verdict", F.lit("keep")).alias("verdict"), F.col("hit.kind").alias("kind"), F.col("hit.pattern").alias("pattern"), F.col("hit.active_from").alias("active_from"))
