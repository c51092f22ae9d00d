"""Statistics of projects, texts and use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..functions.kinds import is_type
from ..functions.text import thousands
from ..runtime import ship


def project_stats(documents: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """By assembly: documents, lines, characters, symbols, types and public types."""
    text = documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars")
    )
    declared = symbols.groupBy(key).agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(is_type(F.col("kind"))).alias("types"),
        F.count_if(is_type(F.col("kind")) & F.col("is_public")).alias("public_types"),
    )
    return text.join(declared, key, "full_outer").na.fill(0)


def text_stats(documents: DataFrame, key: str, text: str, size: str) -> DataFrame:
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return documents.groupBy(key).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("chars"), F.sum(lines).cast("long").alias("lines"))


def totals(per_project: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over all projects, also as text with separators."""
    sums = per_project.agg(F.count(F.lit(1)).alias("projects"), *(F.sum(c).alias(c) for c in columns))
    return sums.select("*", *(thousands(F.col(c)).alias(f"{c}_text") for c in ["projects", *columns]))


def usage(requests: DataFrame, user: Column) -> DataFrame:
    """Requests by user, case ignored."""
    return requests.groupBy(fold(user.cast("string")).alias("user")).agg(F.count(F.lit(1)).alias("n"))


def bigrams(texts: DataFrame, text: str) -> DataFrame:
    """How often each pair of neighbouring characters occurs."""
    t = F.col(text)
    pairs = F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, 2)))
    return texts.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _common(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def unique_prefix_length(names: DataFrame, column: str) -> DataFrame:
    """The least k for which first-k-characters keep all distinct values apart: one more than the longest prefix that two share.

    Two values that share most are neighbours when sorted, so each task compares the neighbours of its range and hands on its
    borders, one row a range, whose neighbours are compared in turn.
    """
    width = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(names.sparkSession)
    values = names.select(F.col(column).alias("v")).filter(F.col(column).isNotNull()).distinct()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        most = 0
        for b in batches:
            for v in b.column(0).to_pylist():
                if last is None:
                    first = v
                else:
                    most = max(most, _common(last, v))
                last = v
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([most], pa.int32())], ["part", "first", "last", "most"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, most = None, 0
        for b in batches:
            for first, last, inner in zip(*(b.column(c).to_pylist() for c in ("first", "last", "most"))):
                most = max(most, inner, 0 if before is None else _common(before, first))
                before = last
        yield pa.RecordBatch.from_arrays([pa.array([most + 1], pa.int32())], ["k"])

    borders = values.repartitionByRange(width, "v").sortWithinPartitions("v").mapInArrow(inside, "part int, first string, last string, most int")
    found = borders.repartition(1).sortWithinPartitions("part").mapInArrow(between, "k int")
    return found.agg(F.coalesce(F.max("k"), F.lit(1)).alias("k"))


def settings(lines: DataFrame, order: str | None = None) -> DataFrame:
    """``plugin:key=value`` lines as a map of each plugin; of a repeated key the last by ``order`` (the largest value without one)."""
    name, value = F.substring_index("line", "=", 1), F.expr("substring(line, instr(line, '=') + 1)")
    parts = lines.filter(F.col("line").rlike("^[^:=]+:[^=]+=")).select(F.substring_index(name, ":", 1).alias("plugin"), F.expr("substring(substring_index(line, '=', 1), instr(line, ':') + 1)").alias("k"), value.alias("v"), (F.col(order) if order else value).alias("o"))
    last = parts.groupBy("plugin", "k").agg(F.max_by("v", "o").alias("v"))
    return last.groupBy("plugin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("settings"))


def glyphs_by_line(marks: DataFrame, doc: str) -> DataFrame:
    """Distinct marks of every line up to the document's last one."""
    have = marks.groupBy(doc, "line").agg(F.concat_ws(",", F.sort_array(F.collect_set("glyph"))).alias("glyphs"))
    span = marks.groupBy(doc).agg(F.max("line").alias("last")).select(doc, F.explode(F.sequence(F.lit(1), "last")).alias("line"))
    return span.join(have, [doc, "line"], "left").withColumn("glyphs", F.coalesce("glyphs", F.lit("")))
