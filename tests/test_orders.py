"""Order keys, long inheritance, and the order of a breadth-first queue."""

import collections
import random

import xxhash
from pyspark.sql import functions as F

from lodestar.functions.text import source_order
from lodestar.operators import paths, resolve


def test_source_order_keeps_places_apart(spark):
    """Files whose hashes share their low bits, and columns over 4096, have places of their own, in order."""
    seen, pair = {}, None
    for i in range(400_000):
        name = f"f{i}.py"
        low = xxhash.xxh64_intdigest(name, 42) & 0x1FFFFFFF
        if low in seen:
            pair = (seen[low], name)
            break
        seen[low] = name
    rows = [(f, line, col) for f in pair for line in (1, 2, 70_000) for col in (0, 4095, 4096, 5000)]
    got = spark.createDataFrame(rows, "file_path string, line long, col long").select("*", source_order(F.col("line"), F.col("col")).alias("o")).collect()
    assert len({r["o"] for r in got}) == len(rows)
    for f in pair:
        own = sorted((r["o"], r["line"], r["col"]) for r in got if r["file_path"] == f)
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_ancestors_of_any_height(spark):
    """Forty levels, a cycle at the top, and a class with two bases in order."""
    links = [(f"c{i}", f"c{i + 1}", 0) for i in range(40)] + [("c40", "c39", 0), ("d", "c38", 1), ("d", "e", 0)]
    got = resolve.ancestors(spark.createDataFrame(links, "class_id string, parent_id string, base_ord int")).collect()
    assert {r["ancestor_id"]: r["depth"] for r in got if r["class_id"] == "c0"} == {f"c{i}": i for i in range(1, 41)}
    assert [r["ancestor_id"] for r in sorted((r for r in got if r["class_id"] == "d"), key=lambda r: (r["depth"], r["ord"]))][:2] == ["e", "c38"]


def test_queue_order(spark):
    rnd = random.Random(7)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}", "calls", i) for i in range(150)] + [("n0", f"h{i}", "calls", 200 + i) for i in range(300)]
    own = collections.defaultdict(list)
    for s, t, _, o in edges:
        own[s].append((o, t))
    queue, at = ["n0"], 0
    while at < len(queue):
        for _, t in sorted(own[queue[at]]):
            if t not in queue:
                queue.append(t)
        at += 1
    got = paths.bfs(spark.createDataFrame(edges, "source string, target string, kind string, edge_ord long"), "n0").orderBy("queue_ord").collect()
    assert [r["node"] for r in got] == queue and [r["queue_ord"] for r in got] == list(range(len(queue)))
