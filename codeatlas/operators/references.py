"""Find-all-references: grouping, counts, names, inheritance, and what nobody refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import NAMELESS, PSEUDO_ASSEMBLIES, reference_header
from ..functions.text import html_escape
from ..runtime import dealt


def lines(refs: DataFrame) -> DataFrame:
    """One row per symbol, kind, assembly, file and line with its occurrences in column order."""
    spans = F.sort_array(F.collect_list(F.struct("col_start", "col_end")))
    return refs.groupBy("to_symbol_id", "kind", "from_assembly", "from_path", "line").agg(spans.alias("occurrences"), F.count(F.lit(1)).alias("n"))


def counts(refs: DataFrame, *by: str) -> DataFrame:
    """Occurrences at each level of kind, assembly and file: counted by file first, so that only these counts are rolled up."""
    keys = [*by, "kind", "from_assembly", "from_path"]
    files = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return files.rollup(*keys).agg(F.sum("k").alias("n"), F.grouping_id().alias("level"))


def headers(refs: DataFrame) -> DataFrame:
    per_kind = refs.groupBy("to_symbol_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per_kind.withColumn("header", reference_header(F.col("kind"), F.col("n")))


def display_names(refs: DataFrame) -> DataFrame:
    """By symbol the first name in arrival order that names it."""
    named = ~F.col("to_name").isin(*NAMELESS)
    return refs.groupBy("to_symbol_id").agg(F.min_by(F.when(named, F.col("to_name")), F.when(named, F.struct("seq", "to_name"))).alias("name"))


def marked_lines(lines_: DataFrame) -> DataFrame:
    """Each line's text, escaped, with its occurrences in italics (``line_text``, ``occurrences`` sorted)."""
    piece = lambda a, b: html_escape(F.substring(F.col("line_text"), a + 1, b - a))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, o: F.struct(
        o["col_end"].alias("at"), F.concat(acc["out"], piece(acc["at"], o["col_start"]), F.lit("<i>"), piece(o["col_start"], o["col_end"]), F.lit("</i>")).alias("out")
    )
    done = F.aggregate("occurrences", start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length("line_text"))))
    return lines_.withColumn("html", done)


def unreferenced(locations: DataFrame, refs: DataFrame) -> DataFrame:
    """Declared at a place in text, and without any reference."""
    return locations.filter(F.col("offset") != 0).join(refs.select(F.col("to_symbol_id").alias("symbol_id")), "symbol_id", "left_anti")


def base_members(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Members with the base member they override; either one missing gives nothing."""
    own = symbols.select(F.col("symbol_id").alias("member_id"), F.col("name").alias("member"))
    base = symbols.select(F.col("symbol_id").alias("base_id"), F.col("name").alias("base"), F.col("assembly_name").alias("base_assembly"))
    return edges.join(own, "member_id").join(base, "base_id")


def code_only(refs: DataFrame) -> DataFrame:
    return refs.filter(~F.col("to_assembly").isin(*PSEUDO_ASSEMBLIES))


def page(refs: DataFrame) -> DataFrame:
    """A symbol's references, one row per file with its lines, and the counts that head the blocks it stands in.

    A row is bounded by its file, whatever the number of references of a symbol.  References move once, by symbol and kind: what is
    grouped and summed afterwards lies in one part.
    """
    block = ["to_symbol_id", "kind", "from_assembly"]
    whole = dealt(refs.dropna(subset=block), *block[:2])
    files = lines(whole).groupBy(*block, "from_path").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("line", "occurrences"))).alias("lines"))
    total = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    return files.withColumn("assembly_n", total(*block)).withColumn("kind_n", total(*block[:2]))


def highlight(refs: DataFrame, path: str, symbol: str) -> DataFrame:
    """The places of one symbol in one document."""
    return refs.filter((F.col("from_path") == path) & (F.col("to_symbol_id") == symbol)).select("line", "col_start", "col_end")


def local_ids(tokens: DataFrame, doc: str, name: str, position: str) -> DataFrame:
    """Names numbered within their document by first appearance, from 0."""
    first = tokens.groupBy(doc, name).agg(F.min(position).alias("first"))
    return first.withColumn("local_id", F.dense_rank().over(Window.partitionBy(doc).orderBy("first")) - 1)


def constructor_references(refs: DataFrame, constructors: DataFrame) -> DataFrame:
    """References to implicit constructors count as instantiations of their type too."""
    extra = refs.join(constructors.select(F.col("symbol_id").alias("to_symbol_id"), "type_id"), "to_symbol_id")
    return refs.unionByName(extra.withColumn("to_symbol_id", F.col("type_id")).withColumn("kind", F.lit(5)).drop("type_id"))


def interface_members(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Members with each interface member they implement; those whose assembly is not there are left out, one by one."""
    return base_members(edges, symbols)
