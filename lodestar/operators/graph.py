"""The typed directed multigraph as two DataFrames: nodes(id, ...) and edges(id, source, target, kind, ...).

Point lookups and changes are filters, semi- and anti-joins; nothing is held on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.sources.stages import stage


def edge_id() -> Column:
    return F.concat("source", F.lit("->["), "kind", F.lit("]->"), "target")


def edge_key(line: Column, column: Column) -> Column:
    """The edge id, with @line:column where the edge has a call site."""
    return F.when(line.isNotNull(), F.concat("id", F.lit("@"), line, F.lit(":"), column)).otherwise(F.col("id"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the first by ``order``; by aggregation, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(order, *[c for c in rest if c != order])).alias("__first")
    return df.groupBy(*keys).agg(first).select(*[F.col(k) if k in keys else F.col(f"__first.{k}") for k in df.columns])


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the nodes with an id of ``gone(id)`` and all edges at them."""
    ids = gone.select("id").distinct()
    left = nodes.join(ids, "id", "left_anti")
    at = ids.select(F.col("id").alias("__gone"))
    kept = edges.join(at, F.col("source") == F.col("__gone"), "left_anti").join(at, F.col("target") == F.col("__gone"), "left_anti")
    return left, kept


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select(F.col("id").alias("__id")).distinct()
    return edges.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")


def replace_file(nodes: DataFrame, edges: DataFrame, path: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the nodes of one file and the edges that leave it; edges into vanished nodes go."""
    others = nodes.where(F.col("file_path") != path)
    all_nodes = others.unionByName(new_nodes)
    left = edges.join(nodes.where(F.col("file_path") == path).select(F.col("id").alias("__own")), F.col("source") == F.col("__own"), "left_anti")
    return all_nodes, valid_edges(left.unionByName(new_edges), all_nodes)


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.where(F.col("file_path") == path))


def clear(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty graph of the same columns."""
    return nodes.limit(0), edges.limit(0)


def in_neighbors(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    ids = edges.where(F.col("target") == node).select(F.col("source").alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def out_neighbors(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    ids = edges.where(F.col("source") == node).select(F.col("target").alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def ego_neighbors(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(direction, edge_id, kind, id, name): one row per edge at ``node``, with the node at its other end."""
    into = edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("id").alias("edge_id"), "kind", F.col("source").alias("other"))
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("id").alias("edge_id"), "kind", F.col("target").alias("other"))
    named = nodes.select("id", "name")
    return into.unionByName(out).join(named, F.col("other") == F.col("id")).select("direction", "edge_id", "kind", "id", "name")


def ego_ids(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """(id, hops): the nodes within ``depth`` edges of ``node`` in either direction, with the least number of edges.

    The first hop is a filter. For further ones the edges are staged once, both ways round, and each hop
    joins only the nodes that the one before it reached first.
    """
    spark = edges.sparkSession
    ends = edges.select("source", "target") if depth < 2 else stage(edges.select("source", "target").distinct(), "ego-edges")
    reached = spark.createDataFrame([(node, 0)], "id string, hops int")
    if depth < 1:
        return reached
    at = ends.where((F.col("source") == node) | (F.col("target") == node)).select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("id"))
    frontier = at.where(F.col("id") != node).distinct().withColumn("hops", F.lit(1))
    both = ends.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(ends.select(F.col("target").alias("a"), F.col("source").alias("b")))
    for hop in range(2, depth + 1):
        frontier = stage(frontier, f"ego-{hop - 1}")
        reached = reached.unionByName(frontier)
        met = frontier.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = met.join(reached.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
    return reached.unionByName(frontier)


def ego_nodes(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    return nodes.join(ego_ids(edges, node, depth), "id")


def ego_edges(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """The edges whose ends both lie in the ego set."""
    held = stage(edges, "ego-all")
    ids = stage(ego_ids(held, node, depth), "ego-ids").select(F.col("id").alias("__id"))
    return held.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, functions (whatever isn't a class) and classes."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") != "class").alias("function_count"), F.count_if(F.col("kind") == "class").alias("class_count"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edge_count")), F.lit(True))


def best_edge(edges: DataFrame, prefer_calls: bool = True) -> DataFrame:
    """One edge per (source, target): calls before instantiates before inherits before the rest, then the first."""
    kind = F.coalesce(F.element_at(F.create_map(F.lit("calls"), F.lit(0), F.lit("instantiates"), F.lit(1), F.lit("inherits"), F.lit(2)), F.col("kind")), F.lit(3))
    rank = kind if prefer_calls else F.lit(0)
    return edges.groupBy("source", "target").agg(F.min(F.struct(rank.alias("rank"), "edge_ord", "id", "kind")).alias("e")).select("source", "target", "e.id", "e.kind")


def usage_counts(usages: DataFrame) -> DataFrame:
    """(target_id, usage_count): distinct locations per target."""
    return usages.groupBy("target_id", "file_path", "line", "col").agg(F.lit(1).alias("one")).groupBy("target_id").agg(F.count(F.lit(1)).alias("usage_count"))


def relation_label(direction: Column, kind: Column) -> Column:
    """What an edge means, read from the node in focus."""
    words = {"in": {"calls": "called by", "instantiates": "created by", "inherits": "extended by", "contains": "part of"}, "out": {"calls": "calls", "instantiates": "creates", "inherits": "extends", "contains": "has"}}
    table = F.create_map(*[F.lit(x) for d, own in words.items() for k, v in own.items() for x in (f"{d}:{k}", v)])
    return F.coalesce(F.element_at(table, F.concat(direction, F.lit(":"), kind)), kind)


def latest(raw: DataFrame, key: str = "id", order: str = "sym_ord") -> DataFrame:
    """Ids may repeat: the last definition holds, at the place of the first."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    first = F.min(order).over(W.partitionBy(key))
    return raw.withColumn("__r", last).withColumn("__first", first).where("__r = 1").drop("__r", order).withColumnRenamed("__first", order)
