"""Assembly graph: who refers to whom, federations, forwards, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..functions.kinds import PSEUDO_ASSEMBLIES
from .numbering import folded_order, ranked


def referencing_counts(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """Of each indexed assembly, how many others refer to it; ``edges`` are distinct."""
    hits = edges.join(indexed.select(F.col("assembly").alias("to_assembly")), "to_assembly", "left_semi")
    per = hits.groupBy(F.col("to_assembly").alias("assembly")).agg(F.count(F.lit(1)).alias("n"))
    return indexed.select("assembly").join(per, "assembly", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_referenced(counted: DataFrame, top: int = 100) -> DataFrame:
    return counted.orderBy(F.desc("n"), fold("assembly"), "assembly").limit(top)


def referencing_lists(edges: DataFrame, below: int = 100) -> DataFrame:
    """Referring assemblies in order, for those that have fewer than ``below``.

    The lists are bounded by ``below``: sizes are counted before anything is collected.
    """
    few = edges.groupBy("to_assembly").agg(F.countDistinct("from_assembly").alias("n")).filter(F.col("n") < below)
    kept = edges.join(few, "to_assembly")
    return kept.groupBy("to_assembly", "n").agg(F.concat_ws(",", F.sort_array(F.collect_set("from_assembly"))).alias("referencing"))


def used_references(refs: DataFrame, forwards: DataFrame | None = None) -> DataFrame:
    """Targets that an assembly really uses, and what it forwards to."""
    real = refs.filter((F.col("to_assembly") != F.col("from_assembly")) & ~F.col("to_assembly").isin(*PSEUDO_ASSEMBLIES))
    out = real.select("from_assembly", "to_assembly").distinct()
    return out if forwards is None else out.unionByName(forwards.select(F.col("assembly").alias("from_assembly"), "to_assembly")).distinct()


def merged_references(*sets: DataFrame) -> DataFrame:
    """Union of reference sets, equal names but for case once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy("from_assembly", fold("to_assembly").alias("to_fold")).agg(F.min("to_assembly").alias("to_assembly"))


def first_federation(external: DataFrame, servers: DataFrame) -> DataFrame:
    """The first server (in order) that has an assembly, names compared without case."""
    has = servers.select(fold("assembly_name").alias("k"), "server_index")
    return external.withColumn("k", fold("assembly_name")).join(has, "k").groupBy("assembly_name").agg(F.min("server_index").alias("server_index"))


def explorer_references(references: DataFrame, used: DataFrame, indexed: DataFrame, servers: DataFrame) -> DataFrame:
    """Declared references with how to show them: a link, a link elsewhere, or plain; and whether they are used."""
    federated = first_federation(references.select(F.col("to_assembly").alias("assembly_name")).distinct(), servers).select(F.col("assembly_name").alias("to_assembly"), "server_index")
    here = indexed.select(F.col("assembly").alias("to_assembly"), F.lit(True).alias("here"))
    out = references.join(used.withColumn("used", F.lit(True)), ["from_assembly", "to_assembly"], "left").join(here, "to_assembly", "left").join(federated, "to_assembly", "left")
    return out.select("from_assembly", "to_assembly", F.coalesce("used", F.lit(False)).alias("used"), F.when(F.col("here"), "link").when(F.col("server_index").isNotNull(), "federated").otherwise("plain").alias("shown"))


def indexed_only(edges: DataFrame, indexed: DataFrame | None) -> DataFrame:
    """Edges to assemblies of the list; without a list all of them."""
    return edges if indexed is None else edges.join(indexed.select(F.col("assembly").alias("to_assembly")), "to_assembly", "left_semi")


def used_by(edges: DataFrame, most: int = 100) -> DataFrame:
    """(assembly, position, referencing) of assemblies with 1 to ``most`` others that refer to them, by name."""
    few = edges.groupBy("to_assembly").agg(F.countDistinct("from_assembly").alias("n")).filter(F.col("n") <= most)
    lists = edges.join(few, "to_assembly").groupBy("to_assembly").agg(F.sort_array(F.collect_set(F.struct(fold("from_assembly").alias("f"), "from_assembly"))).alias("l"))
    return lists.select(F.col("to_assembly").alias("assembly"), F.posexplode("l").alias("position", "r")).select("assembly", "position", F.col("r.from_assembly").alias("referencing"))


def processed_order(assemblies: DataFrame) -> DataFrame:
    """Names of processed assemblies with their line in the list, which is sorted without case."""
    return folded_order(assemblies, "assembly", "line")


def first_server_path(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """A file's address by the first mapping whose root is a prefix of its path, case ignored; generated folders have none.

    Each path is cut into its prefixes at separators, so roots meet them in an
    equi-join instead of being tried one by one.
    """
    path = F.col("path")
    ends = F.transform(F.split(path, r"[\\/]"), lambda x, i: i)
    prefixes = F.transform(ends, lambda i: F.array_join(F.slice(F.split(path, r"[\\/]"), 1, i + 1), "/"))
    cut = files.filter(~fold("path").rlike(r"[\\/]OBJ[\\/]")).select("path", F.explode(prefixes).alias("prefix"))
    roots = mappings.select(F.regexp_replace(fold("root"), r"[\\/]+$", "").alias("root_fold"), "map_order", "server", F.length(F.regexp_replace("root", r"[\\/]+$", "")).alias("size"))
    roots = roots.withColumn("root_fold", F.translate("root_fold", "\\", "/"))
    hit = cut.join(roots, fold("prefix") == F.col("root_fold"))
    best = hit.groupBy("path").agg(F.min(F.struct("map_order", "server", "size")).alias("m"))
    return best.select("path", F.concat("m.server", F.translate(F.expr("substring(path, m.size + 1)"), "\\", "/")).alias("url"))


def custom_order(assemblies: DataFrame, order: DataFrame) -> DataFrame:
    """Listed assemblies in the list's order, the others by name after them; ``rank`` counts them."""
    listed = assemblies.join(order.select("assembly", "position"), "assembly", "left")
    found = ranked(listed, [F.coalesce("position", F.lit(2**31 - 1)), F.col("assembly")], "rank")
    return found.withColumn("rank", F.col("rank") + 1)


def collapse_external(candidates: DataFrame, processed: DataFrame, solution: DataFrame, federated: DataFrame) -> DataFrame:
    """External references still to index: the last path of each name that nothing else covers."""
    last = candidates.groupBy("assembly").agg(F.max_by("path", "seq").alias("path"))
    for other in (processed, solution, federated):
        last = last.join(other.select("assembly"), "assembly", "left_anti")
    return last


def running_number(df: DataFrame, partition: str, order: str) -> DataFrame:
    return df.withColumn("number", F.row_number().over(Window.partitionBy(partition).orderBy(order)))
