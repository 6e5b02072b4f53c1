"""Folders and files numbered as a walk through the tree meets them, so that a subtree is one interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ranges import prefix_sums
from lodestar.operators.rollup import folders_of


def walk_key(path: Column, is_file: Column) -> Column:
    """Sorts like a walk: a folder right before what it holds, folders before files, both by name."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(is_file & (i == F.size(parts) - 1), F.lit("1")).otherwise(F.lit("0")), p)), "\x01")


def number_tree(tree: DataFrame) -> DataFrame:
    """(pre, last, kind, name, path, depth) of the folders and files of ``tree``; pre counts from 0 without gaps.

    A node's subtree is what stands from ``pre`` to ``last``. Numbers come from ranges of the walk's keys,
    and subtree sizes from counts by folder, so a folder of any size costs no task more than its share.
    """
    nodes = tree.where("kind in ('folder', 'file')").select("kind", "name", "path", "depth")
    numbered = prefix_sums(nodes.withColumn("key", walk_key(F.col("path"), F.col("kind") == "file")), ["key"], F.lit(1), "pre", "preorder")
    below = nodes.select(F.explode(folders_of(F.col("path"))).alias("above")).groupBy("above").agg(F.count(F.lit(1)).alias("n"))
    sized = numbered.join(below, (F.col("kind") == "folder") & (F.col("path") == F.col("above")), "left")
    return sized.select("pre", (F.col("pre") + F.coalesce("n", F.lit(0))).alias("last"), "kind", "name", "path", "depth")


def scope_picker(numbered: DataFrame) -> DataFrame:
    """(kind, path, place): folders and files as a picker lists them, each kind by its place in the walk."""
    return numbered.select("kind", "path", F.col("pre").alias("place"))


def members(numbered: DataFrame, folder: str) -> DataFrame:
    """The files below ``folder``, at any depth: one interval of the numbers."""
    own = numbered.where((F.col("kind") == "folder") & (F.col("path") == folder)).select(F.col("pre").alias("__lo"), F.col("last").alias("__hi"))
    return numbered.where("kind = 'file'").join(F.broadcast(own), (F.col("pre") > F.col("__lo")) & (F.col("pre") <= F.col("__hi"))).drop("__lo", "__hi")
