"""Readers of the text and binary layouts that an index comes in.

Line order within a file comes from where its lines stand: lines are numbered within
each part of a file that a task reads, and the counts of the parts are added up, so a
file of any size is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import Codec
from . import packed

STEM = r"([^/\\]*?)(?:\.[^./\\]*)?$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, n, value) with the line's number in its file, from 0, and the part of the file that it was read with."""
    lines, parts = _lines_and_parts(spark, path)
    return _numbered(lines, parts).select("file", "part", "n", "value")


def _numbered(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines with their numbers, and the numbers of the first line of their part and of the next part's."""
    return lines.join(parts, ["file", "part"]).withColumn("n", (F.col("at") + F.col("low") - F.col("first")).cast("int"))


def _lines_and_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines as they are read, and the parts of files with the first row number in each and the numbers of its lines (low to before high)."""
    part = ["file", "part"]
    # Row numbers of a scan are consecutive within a part of a file, whose first one turns them into line numbers.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value")
    )
    parts = lines.groupBy(*part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines, parts.select(*part, "first", before.alias("low"), (before + F.col("k")).alias("high"))


def assembly_map(spark: SparkSession, path: str) -> DataFrame:
    """``name;project key;referencing count``, numbered by line."""
    p = F.split("value", ";")
    return numbered_lines(spark, path).select(F.col("n").alias("assembly_number"), p[0].alias("assembly_name"), p[1].try_cast("int").alias("project_key"), p[2].try_cast("int").alias("referencing_count"))


def project_list(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("n").alias("project_key"), F.col("value").alias("project_path"))


def name_list(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of a folder without their extension, distinct; an unreadable content does not matter."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.regexp_extract("path", STEM, 1).alias("name")).distinct()


def symbol_lines(spark: SparkSession, path: str) -> DataFrame:
    """``name;id;kind;description;glyph``; other lines are dropped, the last of an id stays."""
    p = F.split("value", ";")
    rows = numbered_lines(spark, path).filter(F.size(p) == 5).select("file", "n", p[0].alias("name"), p[1].alias("symbol_id"), p[2].alias("kind"), p[3].alias("description"), p[4].try_cast("int").alias("glyph"))
    last = F.max_by(F.struct("name", "kind", "description", "glyph"), F.struct("file", "n")).alias("s")
    return rows.groupBy("symbol_id").agg(last).select("symbol_id", "s.*")


def declaration_map(spark: SparkSession, path: str) -> DataFrame:
    """``=id`` lines, each over its ``file;offset`` lines."""
    from ..operators.numbering import carry_down

    lines = numbered_lines(spark, path).withColumnRenamed("file", "source")
    header = F.when(F.col("value").startswith("="), F.expr("substring(value, 2)"))
    p = F.split("value", ";")
    return carry_down(lines, header, "symbol_id", "source").filter(~F.col("value").startswith("=")).select("symbol_id", p[0].alias("file"), p[1].try_cast("long").alias("offset"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """``member;assembly;other member``, distinct."""
    p = F.split("value", ";")
    return spark.read.text(path).filter(F.size(p) == 3).select(p[0].alias("member_id"), p[1].alias("base_assembly"), p[2].alias("base_id")).distinct()


def project_info(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``name=value`` lines: the first of each name, 0 where it is no number."""
    rows = numbered_lines(spark, path).withColumn("k", F.substring_index("value", "=", 1)).withColumn("v", F.expr("substring(value, instr(value, '=') + 1)"))
    first = [F.min_by(F.when(F.col("k") == x, F.col("v")), F.when(F.col("k") == x, F.col("n"))).alias(x) for x in names]
    return rows.groupBy("file").agg(*first).select("file", *(F.coalesce(F.col(x).try_cast("long"), F.lit(0)).alias(x) for x in names))


def _grouped(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, r): each ``size`` lines of a file; a rest is left out.

    Lines that one part of a file holds are put together where they are read; only those of groups across the bounds of
    parts are shuffled.  There is a row for each part of a file, so these are broadcast, which leaves lines in their order.
    """
    lines, parts = _lines_and_parts(spark, path)
    rows = _numbered(lines, F.broadcast(parts)).withColumn("g", F.floor(F.col("n") / size))
    inside = (F.col("g") * size >= F.col("low")) & ((F.col("g") + 1) * size <= F.col("high"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            t = pa.Table.from_batches([*rest, b]).combine_chunks()
            whole = len(t) // size * size
            rest = t.slice(whole).to_batches()
            if not whole:
                continue
            n = t["n"].to_numpy()[:whole].reshape(-1, size)
            if (n[:, 0] % size).any() or (n != n[:, :1] + np.arange(size)).any():
                raise ValueError("lines are not in the order of their file")
            (values,), (files,) = (t[c].slice(0, whole).chunks for c in ("value", "file"))
            r = pa.ListArray.from_arrays(pa.array(np.arange(0, whole + 1, size), pa.int32()), pa.concat_arrays([values]))
            yield pa.RecordBatch.from_arrays([files.take(pa.array(np.arange(0, whole, size))), r], ["file", "r"])
        if rest:
            raise ValueError("lines of a group are missing")

    here = rows.filter(inside).select("file", "n", "value").mapInArrow(together, "file string, r array<string>")
    across = rows.filter(~inside).groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("r")).filter(F.size("r") == size)
    return here.unionByName(across.select("file", F.col("r")["value"].alias("r")))


def reference_records(spark: SparkSession, path: str) -> DataFrame:
    """Two lines a record: seven fields, then the line of source."""
    p = F.split(F.col("r")[0], ";")
    names = ("from_assembly", "url", "from_path", "line", "col_start", "col_end", "kind")
    rows = _grouped(spark, path, 2).filter(F.size(p) == 7)
    typed = [p[k].try_cast("int").alias(x) if x in ("line", "col_start", "col_end", "kind") else p[k].alias(x) for k, x in enumerate(names)]
    return rows.select(F.regexp_extract("file", STEM, 1).alias("to_symbol_id"), *typed, F.col("r")[1].alias("line_text"))


def invocations(spark: SparkSession, path: str) -> DataFrame:
    """Three lines a record: project, output, command line."""
    return _grouped(spark, path, 3).select(*(F.col("r")[k].alias(x) for k, x in enumerate(("project", "output", "command_line"))))


def federation(spark: SparkSession, servers: list[tuple[str, str]]) -> DataFrame:
    """(server_index, server, assembly_name) of each server's assembly map, in the servers' order."""
    out = None
    for k, (server, path) in enumerate(servers):
        rows = spark.read.text(path).select(F.lit(k).alias("server_index"), F.lit(server).alias("server"), F.substring_index("value", ";", 1).alias("assembly_name"))
        out = rows if out is None else out.unionByName(rows)
    return out


RANGE = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()),
        T.StructField("lineNumber", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("lineText", T.StringType()),
        T.StructField("classification", T.StringType()), T.StructField("definitionSymbolId", T.StringType()), T.StructField("definitionKind", T.StringType()),
        T.StructField("searchString", T.StringType()), T.StructField("fullName", T.StringType()),
        T.StructField("hyperlinks", T.ArrayType(T.StructType([T.StructField("sourceFile", T.StringType()), T.StructField("start", T.IntegerType())]))),
    ]
)


def analyzed_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An analyzer's JSON: per file its syntactic and semantic ranges; with ``lines`` a line is a file's, and tasks share the lines."""
    schema = T.StructType([T.StructField("fileName", T.StringType()), T.StructField("syntacticClassifications", T.ArrayType(RANGE)), T.StructField("semanticClassifications", T.ArrayType(RANGE))])
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def documentation(spark: SparkSession, path: str) -> DataFrame:
    """(member_id, xml) of documentation files, each read as a whole; the last of a member stays."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    members = F.regexp_extract_all("value", F.lit(r"(?s)(<member\s+name=\"[^\"]*\"\s*(?:/>|>.*?</member>))"), F.lit(1))
    rows = whole.select("file", F.posexplode(members).alias("n", "xml")).withColumn("member_id", F.regexp_extract("xml", r'name="([^"]*)"', 1))
    return rows.groupBy("member_id").agg(F.max_by("xml", F.struct("file", "n")).alias("xml"))


def discover(spark: SparkSession, root: str) -> list[str]:
    """Sub-folders with references of their own (a folder ``R``), by the file system of the path."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "R")))


def parse_packed(data: bytes, codec: Codec | None = None) -> Iterator[tuple[int, int, str, str, str]]:
    """(assembly number, glyph, name, id, description) of the packed layout: a count, then rows with lengths as varints."""
    count = int.from_bytes(data[: packed.HEADER], "little")
    return (row[:5] for row in islice(packed.decode_rows(data, packed.HEADER, codec), count))


def write_packed(rows, codec: Codec | None = None) -> bytes:
    """The packed layout of (assembly number, glyph, name, id, description) rows; descriptions are coded, or plain UTF-8."""
    return len(rows).to_bytes(packed.HEADER, "little") + b"".join([packed.encode_row(*row, codec) for row in rows])


def project_documents(own: DataFrame, generated: DataFrame | None, attributes_name: str) -> DataFrame:
    """Documents of projects and those generated for them, without the file of assembly attributes (``name``)."""
    both = own if generated is None else own.unionByName(generated)
    return both.filter(F.regexp_replace("name", r"\.[^.]*$", "") != attributes_name)


# Build items that are shown as documents, by how they are read.
ITEM_READERS = {"Resource": "xml", "Page": "xml", "EmbeddedResource": "xml", "TypeScriptCompile": "script"}


def item_documents(items: DataFrame) -> DataFrame:
    """Build items (project, item_type, include) that are documents, once each, with their reader."""
    reader = F.coalesce(*(F.when(F.col("item_type") == k, r) for k, r in ITEM_READERS.items()))
    return items.withColumn("reader", reader).filter("reader is not null").select("project", "include", "reader").distinct()


def referenced_assemblies(references: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct references of assemblies that are known, and those to log as unresolved."""
    asked = references.select("assembly", "reference").distinct()
    names = known.select(F.col("assembly").alias("reference")).distinct()
    return asked.join(names, "reference", "left_semi"), asked.join(names, "reference", "left_anti")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The index that was published last at ``root``."""
    version = spark.read.text(f"{root}/versions").agg(F.max(F.col("value").cast("long"))).first()[0]
    return spark.read.parquet(f"{root}/v{version}")


def is_managed(content: Column) -> Column:
    """Whether a portable executable, as binary, has a runtime header; what is cut off or none at all has not."""

    def number(at: Column, size: int) -> Column:
        """The little-endian number of ``size`` bytes at ``at``; null behind the end."""
        digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
        turned = F.concat(*(F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)))
        return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast("long"))

    pe = F.least(number(F.lit(0x3C), 4), F.length(content))
    signed = (F.hex(F.substring(content, 1, 2)) == "4D5A") & (F.hex(F.substring(content, pe.cast("int") + 1, F.lit(4))) == "50450000")
    directory = pe + 24 + F.when(number(pe + 24, 2) == 0x20B, 112).otherwise(96) + 14 * 8
    return F.coalesce(signed & (number(directory, 4) != 0), F.lit(False))
