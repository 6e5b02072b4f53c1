"""Steps of the resolver whose rows must grow with the input and not with its square, and joins that must not pass the driver."""

import time

from pyspark.sql import functions as F

from lodestar.operators import resolve
from lodestar.sources.stages import exchanged, stage


def test_wildcards_of_one_file_are_met_once(spark):
    """20,000 wildcard imports of a file with 20,000 names, by one file: 20,000 names and not 400 million pairs."""
    n = 20_000
    i = F.col("id")
    imports = spark.range(n).select(F.lit("a.py").alias("file_path"), F.lit(True).alias("is_wildcard"), (n - i).alias("imp_ord"))
    resolved = spark.range(1, n + 1).select(i.alias("imp_ord"), F.when(i == 1, F.lit("first.py")).otherwise(F.lit("many.py")).alias("path"))
    name = F.concat(F.lit("x"), i)
    many = spark.range(n).select(F.concat(F.lit("many.py#"), name).alias("id"), name.alias("name"), F.lit("many.py").alias("file_path"), F.lit(True).alias("is_exported"), i.alias("sym_ord"))
    few = spark.createDataFrame([("first.py#x7", "x7", "first.py", True, 2), ("first.py#again", "x7", "first.py", True, 3), ("first.py#hidden", "x8", "first.py", False, 1)], many.schema)
    began = time.perf_counter()
    got = {r["name"]: (r["target_id"], r["ord"]) for r in resolve.scope_wildcard(imports, resolved, many.unionByName(few)).collect()}
    assert time.perf_counter() - began < 30
    assert len(got) == n
    assert (got["x7"], got["x8"]) == (("first.py#x7", 1), ("many.py#x8", 2))


def test_methods_come_from_the_first_ancestor_that_has_them(spark):
    symbols = spark.createDataFrame([("A", "m", "A.m1", 1), ("A", "m", "A.m0", 0), ("B", "m", "B.m", 5), ("B", "n", "B.n", 6), ("C", "n", "C.n", 1), ("C", "k", "C.k", 1), (None, "m", "f", 0)], "parent_class_id string, name string, id string, sym_ord long")
    closure = spark.createDataFrame([("A", "C", 2, "0.0"), ("A", "B", 1, "1"), ("D", "C", 1, "0"), ("D", "B", 1, "1")], "class_id string, ancestor_id string, depth int, ord string")
    got = {(r["class_id"], r["name"]): r["id"] for r in resolve.method_table(symbols, closure).collect()}
    assert got == {("A", "m"): "A.m0", ("A", "n"): "B.n", ("A", "k"): "C.k", ("B", "m"): "B.m", ("B", "n"): "B.n", ("C", "n"): "C.n", ("C", "k"): "C.k", ("D", "n"): "C.n", ("D", "k"): "C.k", ("D", "m"): "B.m"}


def test_classes_of_one_root_meet_its_methods_in_many_tasks(spark):
    """Groups of a class and a name are only made where rows are dealt by class, not where all classes meet one root."""
    symbols = spark.range(50).select(F.lit("R").alias("parent_class_id"), F.concat(F.lit("m"), "id").alias("name"), F.concat(F.lit("R.m"), "id").alias("id"), F.col("id").alias("sym_ord"))
    closure = spark.range(2000).select(F.concat(F.lit("C"), "id").alias("class_id"), F.lit("R").alias("ancestor_id"), F.lit(1).alias("depth"), F.lit("0").alias("ord"))
    with exchanged(spark):
        table = resolve.method_table(stage(symbols, "root-symbols"), stage(closure, "root-closure"))
        lines = table._jdf.queryExecution().executedPlan().toString().splitlines()
        assert table.count() == 2001 * 50
    groups = [i for i, line in enumerate(lines) if "min(turn" in line and "partial_min" in line]
    assert groups
    for i in groups:
        below = next(line for line in lines[i + 1 :] if "Exchange" in line or "Join" in line)
        assert "hashpartitioning(class_id" in below


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    left, right = (stage(spark.range(200_000).select("id", F.lit("same").alias(c)), f"small-{c}") for c in ("x", "y"))
    plan = lambda: left.join(right, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with exchanged(spark):
        assert "Broadcast" not in plan()
    assert spark.conf.get(key) == before
