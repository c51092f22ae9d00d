"""Searches over the symbol table and the name lists.

A search takes the first 100 rows of each interpretation in index order, as the
index would deliver them, and only then ranks; interpretations add up.  All order
keys end in the symbol id, so results are the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold, fold_text
from ..functions.ids import lookup_id, short_key
from ..functions.kinds import glyph_kind, kind_rank, match_level, weight
from ..functions.text import symbol_url
from ..plans import search as plan

TOP = 100


def _folded(df: DataFrame, column: str, stored: str) -> DataFrame:
    """With the folded ``column``: the stored one, which filters reach in the scan, or else computed."""
    return df if stored in df.columns else df.withColumn(stored, fold(column))


INDEX_ORDER = ("name_fold", "kind_rank", "name", "assembly_number", "symbol_id")
RANK_ORDER = ("match_level", "kind_rank", "name", "assembly_number", "description", "symbol_id")


def materialize(packed: DataFrame, assemblies: DataFrame, projects: DataFrame) -> DataFrame:
    """Packed symbols (assembly_number, glyph, name, symbol_id, description) with names, project, kind and rank."""
    return (
        packed.join(assemblies.select("assembly_number", "assembly_name", "project_key"), "assembly_number", "left")
        .join(projects.select("project_key", "project_path"), "project_key", "left")
        .withColumn("kind", glyph_kind(F.col("glyph")))
        .withColumn("kind_rank", kind_rank(F.col("kind")))
    )


def search_symbols(symbols: DataFrame, text: str, top: int = TOP, distinct: bool = False) -> DataFrame:
    """Ranked matches of a query with their match level."""
    q = plan.parse(text)
    found = []
    for i in q.interpretations:
        rows = symbols.filter(plan.range_condition(i) & plan.query_condition(q) & plan.residual_condition(i)).orderBy(*INDEX_ORDER).limit(top)
        level = match_level(F.col("name"), F.col("name_fold"), i.term, fold_text(i.term))
        found.append(rows.withColumn("match_level", level))
    rows = reduce(DataFrame.unionByName, found) if found else symbols.limit(0).withColumn("match_level", F.lit(0))
    rows = rows.withColumn("weight", weight(F.col("match_level"), F.col("kind_rank")))
    return (rows.dropDuplicates(["symbol_id"]) if distinct else rows).orderBy(*RANK_ORDER)


def potential_results(symbols: DataFrame, text: str) -> DataFrame:
    """By interpretation, how many names lie in its range before any filter."""
    q = plan.parse(text)
    counts = [symbols.filter(plan.range_condition(i)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("interpretation"), "n") for k, i in enumerate(q.interpretations)]
    return reduce(DataFrame.unionByName, counts)


def group_by_assembly(results: DataFrame, referencing: DataFrame) -> DataFrame:
    """Results (a few hundred) by assembly, best weight first, then the most referenced; ``rank`` counts them."""
    grouped = results.groupBy("assembly_name").agg(F.min("weight").alias("best"), F.count(F.lit(1)).alias("n"))
    counted = grouped.join(referencing.select(F.col("assembly").alias("assembly_name"), F.col("n").alias("referencing")), "assembly_name", "left")
    by = [F.col("best"), F.desc("referencing"), fold("assembly_name")]
    return counted.withColumn("referencing", F.coalesce("referencing", F.lit(0))).withColumn("rank", F.row_number().over(Window.orderBy(*by))).orderBy(*by)


def search_assemblies(assemblies: DataFrame, text: str | None, verbatim: bool = False, top: int | None = TOP) -> DataFrame:
    """Assemblies with a project, all of them or by prefix."""
    rows = _folded(assemblies, "assembly_name", "name_fold").filter(F.col("project_key") != -1)
    if text:
        term = fold_text(text)
        rows = rows.filter(F.col("name_fold") == term if verbatim else F.col("name_fold").startswith(term))
    rows = rows.orderBy("name_fold", "assembly_name")
    return rows.limit(top) if top else rows


def search_projects(projects: DataFrame, assemblies: DataFrame, prefix: str, top: int = TOP) -> DataFrame:
    """Projects whose path begins so, with their assembly (the last of those that share one)."""
    owners = assemblies.groupBy("project_key").agg(F.max_by("assembly_name", "assembly_number").alias("assembly_name"))
    rows = _folded(projects, "project_path", "path_fold").filter(F.col("path_fold").startswith(fold_text(prefix)))
    return rows.join(owners, "project_key").orderBy("path_fold", "project_path").limit(top)


def search_names(names: DataFrame, column: str, prefix: str, top: int | None = TOP) -> DataFrame:
    """Names of a list that begin so; without a prefix all of them."""
    rows = _folded(names.withColumnRenamed(column, "name"), "name", "name_fold")
    rows = rows.filter(F.col("name_fold").startswith(fold_text(prefix))) if prefix else rows
    rows = rows.select("name", "name_fold").distinct()
    rows = rows.orderBy("name_fold", "name").select("name")
    return rows.limit(top) if top and prefix else rows


def guid_prefix(text: str) -> str:
    return text.lstrip("{(").rstrip("})")


def find_first(symbols: DataFrame, column: str, text: str) -> DataFrame:
    """The first row in order whose name begins so."""
    stored = "name_fold" if column == "name" else f"{column}_fold"
    return _folded(symbols, column, stored).filter(F.col(stored).startswith(fold_text(text))).orderBy(stored, column).limit(1).select(*symbols.columns)


def symbol_urls(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, symbol_id, url) for ids or documentation ids; the last in index order where several share an id, null where none has it."""
    wanted = terms.withColumn("symbol_id", lookup_id(F.col("term")))
    asked = symbols.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi")
    last = asked.groupBy("symbol_id").agg(F.max_by("assembly_name", F.struct(*INDEX_ORDER[:-1])).alias("assembly_name"))
    return wanted.join(last, "symbol_id", "left").select("term", "symbol_id", F.when(F.col("assembly_name").isNotNull(), symbol_url(F.col("assembly_name"), F.col("symbol_id"))).alias("url"))


def redirects(locations: DataFrame) -> DataFrame:
    """By symbol: bucket, key within it, its file, and whether several files make it a partial page."""
    files = locations.groupBy("symbol_id").agg(F.countDistinct(fold("file")).alias("files"), F.min("file").alias("file"))
    return files.select(F.substring("symbol_id", 1, 1).alias("bucket"), short_key(F.col("symbol_id")).alias("key"), "symbol_id", "files", F.when(F.col("files") == 1, F.col("file")).alias("file"))


def redirect_dictionary(redirected: DataFrame) -> DataFrame:
    """(bucket, number, file): the files that each of the 16 buckets names, so that its entries can name them by number."""
    files = redirected.filter(F.col("file").isNotNull()).select("bucket", "file").distinct()
    return files.withColumn("number", F.row_number().over(Window.partitionBy("bucket").orderBy("file")) - 1)


def follow_redirects(wanted: DataFrame, redirected: DataFrame) -> DataFrame:
    """(symbol_id, page) for ids: their file, the page that lists several, or null."""
    page = F.coalesce("file", F.concat(F.lit("partial/"), "symbol_id"))
    pages = redirected.select("bucket", "key", "symbol_id", page.alias("page"))
    asked = wanted.select("symbol_id", F.substring("symbol_id", 1, 1).alias("bucket"), short_key(F.col("symbol_id")).alias("key"))
    return asked.join(pages, ["bucket", "key", "symbol_id"], "left").select("symbol_id", "page")


#: The groups of a result page in their order, and the column that stands for a row.
GROUPS = {"symbols": "name", "assemblies": "assembly_name", "projects": "project_path", "guids": "name", "properties": "name", "items": "name", "targets": "name", "tasks": "name"}


def ranked(results: DataFrame) -> DataFrame:
    """Results (of a search, so a few hundred at most) with their place in the order of relevance."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*RANK_ORDER)))


def result_count(shown: int, potential: int, top: int = TOP) -> str:
    """What heads a list of results."""
    if shown >= top:
        return f"Displaying top {top} results out of {max(shown, potential)}:"
    return f"{shown} result{'' if shown == 1 else 's'} found:" if shown else "No results found."


class Index:
    """A loaded index: the relations of one build, and the router over them."""

    def __init__(self, symbols: DataFrame, assemblies: DataFrame, projects: DataFrame, lists: dict[str, DataFrame] | None = None):
        self.symbols, self.assemblies, self.projects, self.lists = symbols, assemblies, projects, lists or {}

    def search(self, text: str) -> dict[str, DataFrame] | str:
        """DataFrames by kind of result, or a note on why there are none."""
        q = plan.parse(text)
        if q.note:
            return q.note
        out: dict[str, DataFrame] = {}
        first = next(iter(q.names), None)
        for name in plan.route(q):
            if name == "symbols":
                out[name] = search_symbols(self.symbols, text)
            elif name == "assemblies":
                term = next(iter(q.dotted), first)
                core, verbatim = plan.strip_quotes(term) if term else (None, False)
                if core or "assembly" in q.kinds:
                    out[name] = search_assemblies(self.assemblies, core, verbatim)
            elif name == "projects":
                if q.paths:
                    out[name] = search_projects(self.projects, self.assemblies, q.paths[0])
            elif name == "guids":
                if name in self.lists:
                    out[name] = search_names(self.lists[name], "name", guid_prefix(text))
            elif name in self.lists and (first or len(plan.route(q)) == 1):
                out[name] = search_names(self.lists[name], "name", first or "")
        return out

    def page(self, text: str) -> DataFrame:
        """(section, title, n, header) of the groups of a result page that have results; n is at most ``TOP`` but for whole lists."""
        found = self.search(text)
        if isinstance(found, str):
            return self.symbols.limit(1).select(F.lit("note").alias("section"), F.lit(found).alias("title"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("header"))
        parts = []
        for section, title in GROUPS.items():
            if section in found:
                rows = found[section].select(F.lit(section).alias("section"), F.col(title).alias("title"))
                parts.append(rows.groupBy("section", "title").agg(F.count(F.lit(1)).alias("k")))
        rows = reduce(DataFrame.unionByName, parts)
        counts = rows.groupBy("section").agg(F.sum("k").alias("shown"))
        header = F.when(F.col("shown") == TOP, f"showing first {TOP}").otherwise(F.col("shown").cast("string"))
        return rows.join(counts.withColumn("header", header).drop("shown"), "section").select("section", "title", F.col("k").alias("n"), "header")
