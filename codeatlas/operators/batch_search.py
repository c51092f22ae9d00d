"""A table of queries against the symbol table, in one plan.

Queries are parsed to readings (a term, and what else a name must pass), a table of its own.
A name meets the readings whose term it begins with by an equi-join: each name gives its
first k characters for the lengths k that terms really have, and a quoted term meets whole
names.  So no name is tried against each reading, and a term that very many names begin with
is a skewed key like any other, which AQE splits.

Of each reading the first ``top`` names in index order stay, as in a search of its own; Spark
limits the groups of the window before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold_text
from ..functions.kinds import TYPE_KINDS, match_level, weight
from ..plans import search as plan
from ..runtime import ship, written
from .search import INDEX_ORDER, TOP

_READING = "reading int, term string, term_fold string, size int, kinds array<string>, paths array<string>, words array<string>, dotted array<string>, namespace string"
#: The size of a term that must be the whole name.
WHOLE = -1


def _rows(text: str | None) -> Iterator[tuple]:
    q = plan.parse(text or "")
    folded = lambda terms: [fold_text(t) for t in terms]
    kinds = sorted({k for kind in q.kinds for k in (TYPE_KINDS if kind == "type" else (kind,))}) or None
    for k, i in enumerate(q.interpretations):
        size = WHOLE if i.verbatim else len(i.term)
        yield k, i.term, fold_text(i.term), size, kinds, folded(q.paths), folded(i.words), folded(i.dotted), None if i.namespace is None else fold_text(i.namespace)


def readings(queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """The readings of every query; a query that has none, or no text, has no row."""
    ship(queries.sparkSession)
    kind = dict(queries.dtypes)[query]
    columns = [query, *(c.split()[0] for c in _READING.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(q, *row) for q, t in zip(b[query], b[text]) for row in _rows(t)], columns=columns)

    return queries.select(query, text).mapInPandas(run, f"`{query}` {kind}, {_READING}")


def _holds(column: str, part: Column) -> Column:
    return F.coalesce(F.col(column).contains(part), F.lit(False))


def _passes() -> Column:
    """What a name must pass beside its term, as in ``plans.search``."""
    kinds = F.col("kinds").isNull() | F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False))
    paths = F.forall("paths", lambda p: _holds("project_fold", p))
    words = F.forall("words", lambda w: _holds("name_fold", w) | _holds("assembly_fold", w) | _holds("project_fold", w))
    none = F.size("dotted") == 0
    by_assembly = none | F.exists("dotted", lambda d: _holds("assembly_fold", d))
    by_dots = none | by_assembly | F.exists("dotted", lambda d: _holds("desc_fold", d))
    return kinds & paths & words & F.when(F.col("namespace").isNotNull(), by_assembly & _holds("desc_fold", F.col("namespace"))).otherwise(by_dots)


def search_many(symbols: DataFrame, queries: DataFrame, query: str = "query", text: str = "text", top: int = TOP) -> DataFrame:
    """Columns of ``symbols`` with the query, the reading, match level and weight of every match."""
    asked = written(readings(queries, query, text), "readings")
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # as many as terms have lengths
    name = F.col("name_fold")
    keys = [F.struct(F.lit(k).alias("size"), (name if k == WHOLE else F.substring(name, 1, k)).alias("term_fold")) for k in sorted(sizes)]
    if not keys:
        keys = [F.struct(F.lit(0).alias("size"), F.lit("").alias("term_fold"))]
    long_enough = F.filter(F.array(*keys), lambda k: (k["size"] == WHOLE) | (F.length(k["term_fold"]) == k["size"]))
    met = symbols.withColumn("_key", F.explode(long_enough)).select(*symbols.columns, "_key.size", "_key.term_fold").join(asked, ["size", "term_fold"])
    w = Window.partitionBy(query, "reading").orderBy(*INDEX_ORDER)
    first = met.filter(_passes()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    level = match_level(F.col("name"), name, F.col("term"), F.col("term_fold"))
    found = first.withColumn("match_level", level).withColumn("weight", weight(F.col("match_level"), F.col("kind_rank")))
    return found.select(query, "reading", *symbols.columns, "match_level", "weight")
