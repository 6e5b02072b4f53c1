"""Folder, file, class and method statistics as flat tree nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folders_of(path: Column) -> Column:
    """All folders above a file, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def file_stats(symbols: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(file_path, classes, functions, dead, is_script): ``symbols`` need kind, parent_class_id, is_dead.

    Functions are all that isn't a class, orphan methods included; the dead count leaves out a
    method whose class isn't in the table, since no displayed node holds it.
    """
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("__c")).distinct()
    shown = symbols.join(classes, F.col("parent_class_id") == F.col("__c"), "left").withColumn("shown", F.col("parent_class_id").isNull() | F.col("__c").isNotNull())
    stats = shown.groupBy("file_path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") != "class").alias("functions"), F.count_if(F.col("is_dead") & F.col("shown")).alias("dead"))
    if entries is None:
        return stats.withColumn("is_script", F.lit(False))
    marked = entries.select(F.col("file_path").alias("__e")).distinct()
    joined = stats.join(marked, F.col("file_path") == F.col("__e"), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(F.coalesce("file_path", "__e").alias("file_path"), zero("classes"), zero("functions"), zero("dead"), F.col("__e").isNotNull().alias("is_script"))


def class_stats(symbols: DataFrame) -> DataFrame:
    """(id, methods, dead): of each class, its own dead flag included."""
    methods = symbols.where("kind <> 'class' and parent_class_id is not null").groupBy(F.col("parent_class_id").alias("__c")).agg(F.count(F.lit(1)).alias("methods"), F.count_if("is_dead").alias("dead_methods"))
    own = symbols.where("kind = 'class'").select("id", "name", F.col("is_dead").cast("long").alias("own"))
    return own.join(methods, F.col("id") == F.col("__c"), "left").select("id", "name", F.coalesce("methods", F.lit(0)).alias("methods"), (F.col("own") + F.coalesce("dead_methods", F.lit(0))).alias("dead"))


def folder_stats(files: DataFrame) -> DataFrame:
    """(folder, depth, files, classes, functions, dead): sums over everything below a folder.

    Each file's counts go to all its folders: a ROLLUP whose depth varies from path to path.
    """
    spread = files.select("*", F.explode(folders_of(F.col("file_path"))).alias("folder"))
    return spread.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("classes").alias("classes"), F.sum("functions").alias("functions"), F.sum("dead").alias("dead")).select("folder", F.size(F.split("folder", "/")).alias("depth"), "files", "classes", "functions", "dead")


def tree_nodes(symbols: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(id, parent_id, kind, name, path, depth): the whole architecture tree, flat."""
    files = file_stats(symbols, entries)
    parent = lambda p: F.when(F.contains(p, F.lit("/")), F.concat(F.lit("folder:"), F.regexp_replace(p, "/[^/]*$", ""))).otherwise(F.lit("folder:root"))
    last = lambda p: F.element_at(F.split(p, "/"), -1)
    folder, path = F.col("folder"), F.col("file_path")
    a = folder_stats(files).select(F.concat(F.lit("folder:"), folder).alias("id"), parent(folder).alias("parent_id"), F.lit("folder").alias("kind"), last(folder).alias("name"), folder.alias("path"), "depth")
    b = files.select(F.concat(F.lit("file:"), path).alias("id"), parent(path).alias("parent_id"), F.lit("file").alias("kind"), last(path).alias("name"), path.alias("path"), F.size(F.split(path, "/")).alias("depth"))
    c = symbols.select("id", F.coalesce("parent_class_id", F.concat(F.lit("file:"), path)).alias("parent_id"), "kind", "name", path.alias("path"), (F.size(F.split(path, "/")) + F.when(F.col("parent_class_id").isNull(), 1).otherwise(2)).alias("depth"))
    return a.unionByName(b).unionByName(c)


def with_ancestors(tree: DataFrame, hit: Column) -> DataFrame:
    """The tree nodes that match, and the folders and files above them."""
    found = tree.where(hit)
    path = F.col("path")
    ups = F.concat(F.array(F.concat(F.lit("file:"), path)), F.transform(folders_of(path), lambda f: F.concat(F.lit("folder:"), f)))
    above = found.where("kind not in ('folder')").select(F.explode(ups).alias("__id")).unionByName(found.select(F.col("parent_id").alias("__id"))).unionByName(found.select(F.col("id").alias("__id"))).distinct()
    return tree.join(above, F.col("id") == F.col("__id"), "left_semi")
