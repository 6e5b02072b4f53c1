"""Path search as frontier joins: breadth-first levels and cheapest costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.graph import best_edge
from lodestar.sources.stages import stage

#: fixed values: the cost of an edge by kind, and of any other kind
WEIGHTS = {"calls": 1.0, "instantiates": 1.2, "inherits": 1.8, "contains": 2.5}
OTHER_WEIGHT = 1.0
MAX_DEPTH = 50
RESULT = "found boolean, node_ids array<string>, edge_ids array<string>, total_hops int, total_cost double, message string"


def allowed(edges: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    return edges if kinds is None else edges.where(F.col("kind").isin(list(kinds)))


def numbered(level: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """(node, depth, queue_ord, parent): a level's nodes numbered from ``start`` in ``order``.

    The level is cut into ranges of that order, each sorted in its own task; what reaches the
    driver is one count per range.
    """
    dealt = level.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.select("node", "depth", "parent", F.monotonically_increasing_id().alias("at")), f"{name}-ranges")
    part = F.shiftright("at", 33)  # the task's number, above the row's number in the task
    first, offsets = start, {}
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        offsets[r["part"]] = first
        first += r["count"]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in (offsets or {0: 0}).items() for x in kv]), part)
    return placed.select("node", "depth", (base + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("queue_ord"), "parent")


def bfs(edges: DataFrame, start: str, max_depth: int = MAX_DEPTH, kinds: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """(node, depth, queue_ord, parent): nodes in the order in which a queue would reach them.

    Each level joins the frontier with the edges, drops nodes already reached, and gives a node
    to the parent that is earliest in the queue. Levels are stage tables, so lineage stays flat
    and a lost executor costs one level. Stops when ``target`` is reached.
    """
    spark = edges.sparkSession
    steps = stage(allowed(edges, kinds).select("source", "target", "edge_ord"), "bfs-edges")
    reached = frontier = stage(spark.createDataFrame([(start, 0, 0, None)], "node string, depth int, queue_ord long, parent string"), "bfs-0")
    size = 1
    for depth in range(1, max_depth + 1):
        met = frontier.select(F.col("node").alias("parent"), F.col("queue_ord").alias("p")).join(steps, F.col("parent") == F.col("source"))
        first = met.groupBy("target").agg(F.min(F.struct("p", "edge_ord", "parent")).alias("e")).join(reached.select(F.col("node").alias("__seen")), F.col("target") == F.col("__seen"), "left_anti")
        frontier = numbered(first.select(F.col("target").alias("node"), F.lit(depth).alias("depth"), F.col("e.p").alias("p"), F.col("e.edge_ord").alias("edge_ord"), F.col("e.parent").alias("parent")), ["p", "edge_ord", "node"], size, f"bfs-{depth}")
        found = frontier.agg(F.count(F.lit(1)), F.max((F.col("node") == target).cast("int")) if target else F.lit(0)).first()
        if not found[0]:
            break
        size += found[0]
        reached = reached.unionByName(frontier)
        if found[1]:
            break
    return reached


def cheapest(edges: DataFrame, start: str, weights: Mapping[str, float] | None = None, kinds: Sequence[str] | None = None, max_depth: int = MAX_DEPTH, width: float = 8.0) -> DataFrame:
    """(node, cost, hops, parent): least summed edge weight from ``start``, by delta-stepping.

    Costs are cut into buckets of ``width``. A round relaxes the nodes of the current bucket whose cost fell
    since they were relaxed last, and writes the costs that fall as a delta; when none do, the next
    bucket is opened. A node's cost is the least in its deltas, so nothing is rewritten. ``max_depth`` bounds
    the edges of a path.
    """
    table = {**WEIGHTS, **(weights or {})}
    spark = edges.sparkSession
    price = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("kind")), F.lit(OTHER_WEIGHT))
    steps = stage(allowed(edges, kinds).groupBy("source", "target").agg(F.min(price).alias("w")), "cost-edges")
    deltas = stage(spark.createDataFrame([(start, 0.0, 0, None, 0)], "node string, cost double, hops int, parent string, turn int"), "cost-0")
    opened, end, last = 0.0, width, 0
    while True:
        best = deltas.groupBy("node").agg(F.min(F.struct("cost", "hops", "parent", "turn")).alias("b")).select("node", "b.*")
        fresh = (F.col("cost") < end) & ((F.col("turn") == last) | (F.col("cost") >= opened)) & (F.col("hops") < max_depth)
        front = best.where(fresh).select(F.col("node").alias("from"), F.col("cost").alias("so_far"), F.col("hops").alias("h"))
        offers = front.join(steps, F.col("from") == F.col("source")).groupBy("target").agg(F.min(F.struct((F.col("so_far") + F.col("w")).alias("cost"), (F.col("h") + 1).alias("hops"), F.col("from").alias("parent"))).alias("o"))
        lower = offers.join(best.select("node", F.col("cost").alias("old")), F.col("target") == F.col("node"), "left").where("old is null or o.cost < old - 1e-9")
        delta = stage(lower.select(F.col("target").alias("node"), "o.cost", "o.hops", "o.parent", F.lit(last + 1).alias("turn")), f"cost-{last + 1}")
        low = delta.agg(F.min("cost"), F.count(F.lit(1))).first()
        if low[1]:
            last += 1
            deltas = deltas.unionByName(delta)
            if low[0] < end:
                opened = end
                continue
        # this bucket is settled; the next one begins with the lowest cost beyond it
        rest = best.where(F.col("cost") >= end).agg(F.min("cost")).first()[0]
        following = min(x for x in (rest, low[0] if low[1] else None, float("inf")) if x is not None)
        if following == float("inf"):
            return best.drop("turn")
        opened, end, last = end, max(end, following) + width, last + (0 if low[1] else 1)


def find_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, algorithm: str = "bfs", max_depth: int = MAX_DEPTH, kinds: Sequence[str] | None = None, weights: Mapping[str, float] | None = None, prefer_calls: bool = True) -> DataFrame:
    """One row: found, node_ids, edge_ids, total_hops, total_cost, message."""
    spark = nodes.sparkSession
    known = {r["id"] for r in nodes.where(F.col("id").isin(source, target)).select("id").distinct().collect()}
    for name, what in ((source, "source"), (target, "target")):
        if name not in known:
            return failure(spark, f"{what} symbol not found: {name}")
    if source == target:
        return spark.createDataFrame([(True, [source], [], 0, 0.0, "same symbol")], RESULT)
    tree = bfs(edges, source, max_depth, kinds, target) if algorithm == "bfs" else cheapest(edges, source, weights, kinds, max_depth)
    chain = walk_back(tree, source, target, max_depth)
    if not chain:
        return failure(spark, f"no path within {max_depth} hops")
    hops = spark.createDataFrame(list(zip(chain, chain[1:], range(len(chain) - 1), strict=False)), "source string, target string, hop int")  # at most max_depth rows
    table = {**WEIGHTS, **(weights or {})}
    used = {r["hop"]: r for r in hops.join(best_edge(allowed(edges, kinds).join(F.broadcast(hops), ["source", "target"], "left_semi"), prefer_calls), ["source", "target"]).collect()}
    own = [used[i] for i in range(len(chain) - 1)]
    cost = sum(table.get(e["kind"], OTHER_WEIGHT) for e in own)
    return spark.createDataFrame([(True, chain, [e["id"] for e in own], len(own), float(cost), "")], RESULT)


def walk_back(tree: DataFrame, source: str, target: str, max_depth: int) -> list[str]:
    """The chain of parents from ``target``; one point lookup per hop, at most ``max_depth``."""
    chain, at = [target], target
    while at != source:
        row = tree.where(F.col("node") == at).select("parent").first()
        if row is None or row[0] is None or len(chain) > max_depth:
            return []
        at = row[0]
        chain.append(at)
    return chain[::-1]


def failure(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(False, [], [], 0, 0.0, message)], RESULT)
