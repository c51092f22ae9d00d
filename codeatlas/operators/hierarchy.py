"""Trees out of separated names: namespaces, folders, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..runtime import written
from .closure import ancestors
from .numbering import running_total


def prefixes(parts: Column) -> Column:
    """All leading runs of an array, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.slice(parts, 1, k))


def tree(names: DataFrame, path: Column, separator: str) -> DataFrame:
    """One row per node: path, parent, title, depth, and the leaves below it."""
    parts = F.filter(path, lambda p: p != "")
    nodes = names.select(parts.alias("parts")).filter(F.size("parts") > 0).select(F.explode(prefixes(F.col("parts"))).alias("p"))
    counted = nodes.groupBy("p").agg(F.count(F.lit(1)).alias("leaves"))
    size = F.size("p")
    return counted.select(
        F.array_join("p", separator).alias("path"),
        F.when(size > 1, F.array_join(F.slice("p", 1, F.greatest(size - 1, F.lit(1))), separator)).alias("parent"),
        F.element_at("p", -1).alias("title"),
        size.alias("depth"),
        "leaves",
    )


def namespace_outline(types: DataFrame, namespace: str, name: str) -> DataFrame:
    """Namespaces and types as nodes of one tree, each title once: ``sort_title`` puts types behind the namespaces beside them.

    A type and a namespace of the same path share a node.
    """
    spaces = tree(types, F.split(namespace, r"\."), ".").select("path", "parent", "title", "depth", F.lit(False).alias("is_type"))
    parent = F.when(F.col(namespace) != "", F.col(namespace))
    own = types.select(F.concat_ws(".", parent, F.col(name)).alias("path"), parent.alias("parent"), F.col(name).alias("title"), F.lit(True).alias("is_type")).distinct()
    own = own.withColumn("depth", F.size(F.split("path", r"\.")))
    both = spaces.unionByName(own).groupBy("path", "parent", "title", "depth").agg(F.max("is_type").alias("is_type"), F.min("is_type").alias("all_type"))
    return both.withColumn("sort_title", F.when(F.col("all_type"), F.concat(F.lit("{"), "title")).otherwise(F.col("title"))).drop("all_type")


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with their position among those of one parent: the properties folder first, then by name."""
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("parent").orderBy(*folder_order(F.col("title")), "title")))


def namespace_tree(types: DataFrame, namespace: str) -> DataFrame:
    return tree(types, F.split(namespace, r"\."), ".")


def folder_tree(files: DataFrame, path: str) -> DataFrame:
    """Folders of files; drive roots are dropped."""
    parts = F.split(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[\\/]")
    return tree(files, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def folder_order(title: Column) -> list[Column]:
    """The properties folder first, then by name without case."""
    return [F.when(fold(title) == "PROPERTIES", 0).otherwise(1), fold(title)]


def nesting_depth(qualified: Column, namespace: Column) -> Column:
    """How many types a declaration stands in."""
    rest = F.when(namespace == "", qualified).otherwise(F.substring(qualified, F.length(namespace) + 2, F.length(qualified)))
    return F.size(F.split(rest, r"\.")) - 1


def locations(declared: DataFrame) -> DataFrame:
    """Places of each symbol in order; ``files`` counts those apart from case."""
    return declared.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("file", "offset"))).alias("places"), F.countDistinct(fold("file")).alias("files"))


def partial_symbols(declared: DataFrame, key: str, file: Column) -> DataFrame:
    """Symbols declared in several files."""
    return declared.groupBy(key).agg(F.countDistinct(file).alias("files")).filter("files > 1")


def partial_pages(declared: DataFrame, key: str, file: Column) -> DataFrame:
    """Symbols declared in several files, with these in the order of their paths without extension."""
    stem = F.regexp_replace(file, r"\.[^.\\/]*$", "")
    files = declared.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(fold(stem).alias("f"), file.alias("file")))).alias("l")).filter(F.size("l") > 1)
    return files.select(key, F.transform("l", lambda x: x["file"]).alias("files"))


def nested_order(nodes: DataFrame) -> DataFrame:
    """(node, parent, title, depth, enter, leave): nested-set numbers of a forest whose siblings are in ``folder_order`` of their titles.

    ``enter`` numbers nodes in the order of a page that shows each with all below it, and ``leave`` is where its own end, so
    a page is a sort and a part of it a range.  Sizes of subtrees come from below (how many have a node as ancestor); what
    earlier siblings hold is a running total in sorted ranges; the sum of that along the way down is the number.  A node with
    very many children is shared by ranges like any other.  Nodes are distinct; a parent that is no node makes a root.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_there"))
    rows = nodes.select("node", "parent", "title").join(known, "parent", "left").withColumn("parent", F.when(F.col("_there"), F.col("parent"))).drop("_there")
    rows = written(rows, "nested-nodes")
    up = ancestors(rows)
    sizes = up.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("below"))
    sized = rows.join(sizes, "node", "left").withColumn("size", F.coalesce("below", F.lit(0)) + 1).drop("below")
    order = [F.col("parent"), *folder_order(F.col("title")), F.col("title"), F.col("node")]
    total = written(running_total(sized, order, "size", "total"), "nested-totals")
    first = total.groupBy(F.col("parent").alias("_parent")).agg(F.min("total").alias("first"))
    step = F.col("total") - F.col("first") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    own = total.join(first, F.col("parent").eqNullSafe(F.col("_parent"))).select(*total.columns, step.alias("step"))
    own = written(own.drop("total"), "nested-steps")
    above = up.join(own.select(F.col("node").alias("ancestor"), "step"), "ancestor").groupBy("node").agg(F.sum("step").alias("above"), F.count(F.lit(1)).alias("depth"))
    enter = F.col("step") + F.coalesce("above", F.lit(0))
    return own.join(above, "node", "left").select("node", "parent", "title", F.coalesce("depth", F.lit(0)).alias("depth"), enter.alias("enter"), (enter + F.col("size")).alias("leave"))
