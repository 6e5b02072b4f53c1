"""Cheapest paths and ego sets against plain searches of random graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, paths

KINDS = list(paths.WEIGHTS) + ["other"]


def random_graph(seed, nodes=60, edges=170):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}", rnd.choice(KINDS), i) for i in range(edges)] + [("n0", "n0", "calls", 999), ("n1", "n2", "calls", 1000), ("n1", "n2", "inherits", 1001)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, kind string, edge_ord int").withColumn("id", graph.edge_id())


def dijkstra(rows, start):
    out, queue, best = {}, [(0.0, start)], {start: 0.0}
    while queue:
        cost, node = heapq.heappop(queue)
        if node in out:
            continue
        out[node] = cost
        for s, t, k, _ in rows:
            price = cost + paths.WEIGHTS.get(k, paths.OTHER_WEIGHT)
            if s == node and price < best.get(t, float("inf")):
                best[t] = price
                heapq.heappush(queue, (price, t))
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 8.0), (2, 0.5), (3, 1000.0), (4, 2.0)])
def test_cheapest_is_dijkstra(spark, seed, width):
    rows = random_graph(seed)
    tree = {r["node"]: r for r in paths.cheapest(frame(spark, rows), "n0", width=width).collect()}
    want = dijkstra(rows, "n0")
    assert {n: round(r["cost"], 6) for n, r in tree.items()} == {n: round(c, 6) for n, c in want.items()}
    # each parent is one edge away and on a cheapest path itself
    prices = {}
    for s, t, k, _ in rows:
        prices[s, t] = min(prices.get((s, t), 9), paths.WEIGHTS.get(k, paths.OTHER_WEIGHT))
    for n, r in tree.items():
        if n != "n0":
            assert r["cost"] == pytest.approx(tree[r["parent"]]["cost"] + prices[r["parent"], n])


def test_cheapest_on_a_line_and_alone(spark):
    line = [(f"n{i}", f"n{i + 1}", "calls", i) for i in range(12)]
    got = {r["node"]: (r["cost"], r["hops"]) for r in paths.cheapest(frame(spark, line), "n0", width=3.0).collect()}
    assert got == {f"n{i}": (float(i), i) for i in range(13)}
    assert {r["node"] for r in paths.cheapest(frame(spark, line), "n0", max_depth=4).collect()} == {f"n{i}" for i in range(5)}
    assert [r["node"] for r in paths.cheapest(frame(spark, line), "nowhere").collect()] == ["nowhere"]


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_ego_sets(spark, depth):
    rows = random_graph(7, 80, 120)
    hops, at = {"n3": 0}, {"n3"}
    for d in range(1, depth + 1):
        at = {b for s, t, *_ in rows for a, b in ((s, t), (t, s)) if a in at} - set(hops)
        hops |= dict.fromkeys(at, d)
    e = frame(spark, rows)
    assert {r["id"]: r["hops"] for r in graph.ego_ids(e, "n3", depth).collect()} == hops
    inside = [(s, t, k) for s, t, k, _ in rows if s in hops and t in hops]
    assert sorted((r["source"], r["target"], r["kind"]) for r in graph.ego_edges(e, "n3", depth).collect()) == sorted(inside)


def test_found_paths_are_valid_and_shortest(spark):
    rows = random_graph(5)
    e = frame(spark, rows)
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(60)], "id string, name string")
    depth, at, steps = {"n0": 0}, ["n0"], {(s, t) for s, t, *_ in rows}
    for n in at:
        for s, t in sorted(steps):
            if s == n and t not in depth:
                depth[t] = depth[n] + 1
                at.append(t)
    far = max(depth, key=lambda n: (depth[n], n))
    row = paths.find_path(nodes, e, "n0", far).first()
    assert row["total_hops"] == depth[far] == len(row["edge_ids"])
    assert all(p in steps for p in zip(row["node_ids"], row["node_ids"][1:]))
    assert e.where(F.col("id").isin(row["edge_ids"])).count() >= len(set(row["edge_ids"]))
