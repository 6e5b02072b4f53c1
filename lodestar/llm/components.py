"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.staging import stage


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node reachable.

    Nodes are 64-bit integers. Each round hooks a node and its parent to the smallest
    grandparent seen among its neighbours and then halves every path, so long chains collapse
    in a logarithmic number of rounds. All joins meet two scans of stage tables, which lets
    adaptive execution split a hub's rows, and all minima aggregate before they shuffle.
    Self links and null ends are ignored; an empty edge list gives an empty result.
    """
    e = stage(edges.select("a", "b").where("a is not null and b is not null and a <> b"), f"{name}-links")  # read twice
    both = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("f")).select("node", "f"), f"{name}-f0")
    state, seen = None, None
    for r in range(max_rounds):
        up = parents.select(F.col("node").alias("pn"), F.col("f").alias("g"))
        state = stage(parents.join(up, F.col("f") == F.col("pn"), "left").select("node", "f", F.coalesce("g", "f").alias("g")), f"{name}-g{r}")
        now = state.agg(F.sum(F.col("f").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
        near = state.select(F.col("node").alias("pn"), "g")
        best = both.join(near, F.col("b") == F.col("pn")).groupBy("a").agg(F.min("g").alias("m"))
        hooked = state.join(best, F.col("node") == F.col("a"), "left").withColumn("m", F.least("g", "m"))
        moves = hooked.select(F.explode(F.array(F.struct("node", F.least("f", "m").alias("f")), F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("x")).select("x.*")
        parents = stage(moves.groupBy("node").agg(F.min("f").alias("f")), f"{name}-f{r + 1}")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return state.select("node", F.col("f").alias("root"))
