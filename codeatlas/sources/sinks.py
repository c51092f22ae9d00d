"""Writers of the index and its marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..operators.search import INDEX_ORDER


def write_symbols(symbols: DataFrame, path: str, partitions: int | None = None) -> None:
    """The searchable table in ranges of the folded name and sorted within, so that a prefix prunes files and row groups."""
    n = partitions or int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    symbols.repartitionByRange(n, "name_fold").sortWithinPartitions(*INDEX_ORDER).write.mode("overwrite").parquet(path)


def write_names(names: DataFrame, column: str, path: str, partitions: int = 1) -> None:
    """A name list with its folded names, sorted by them, so that a prefix prunes row groups."""
    rows = names.select(F.col(column).alias("name")).distinct().withColumn("name_fold", fold("name"))
    rows.repartitionByRange(partitions, "name_fold").sortWithinPartitions("name_fold", "name").write.mode("overwrite").parquet(path)


def write_references(refs: DataFrame, path: str) -> None:
    """By target assembly, sorted by symbol; never a file for each symbol.

    A hot assembly's rows are spread over as many tasks as the rebalancing needs.
    """
    refs.hint("rebalance", "to_assembly").sortWithinPartitions("to_symbol_id", "kind").write.mode("overwrite").partitionBy("to_assembly").parquet(path)


def write_declarations(symbols: DataFrame, path: str) -> None:
    symbols.hint("rebalance", "assembly_name").sortWithinPartitions("name", "symbol_id").write.mode("overwrite").partitionBy("assembly_name").parquet(path)


def write_maps(assemblies: DataFrame, projects: DataFrame, path: str) -> None:
    """``;`` separated lines in key order: dimensions, each in one file."""
    line = F.concat_ws(";", "assembly_name", F.col("project_key").cast("string"), F.col("referencing_count").cast("string"))
    assemblies.orderBy("assembly_number").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(f"{path}/assemblies")
    projects.orderBy("project_key").coalesce(1).select(F.col("project_path").alias("value")).write.mode("overwrite").text(f"{path}/projects")


def write_redirects(redirects: DataFrame, path: str) -> None:
    redirects.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_mart(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def archive_name(repository: str, when) -> str:
    """A name that sorts by time within its repository."""
    return f"{repository}/{when.strftime('%Y-%m-%dT%H.%M.%SZ')}.tar.gz"


def with_rejects(rows: DataFrame, good) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows to log."""
    ok = F.coalesce(good, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """Compiler messages as lines, in a folder for each project that has any."""
    line = F.concat(F.col("severity"), F.lit(" "), F.col("code"), F.lit(": "), F.translate("message", "\r\n", "  "))
    diagnostics.select("project", line.alias("value")).write.mode("append").partitionBy("project").text(path)


def append_manifest(archives: DataFrame, path: str) -> None:
    """Archives (repository, name) that were uploaded, beside those before."""
    archives.select("repository", "name").write.mode("append").parquet(path)


def publish(index: DataFrame, root: str, version: int) -> None:
    """A version of an index; readers see it only once it is complete, and keep the one before until they look again."""
    index.write.parquet(f"{root}/v{version}")
    spark = index.sparkSession
    spark.range(1).select(F.lit(str(version)).alias("value")).coalesce(1).write.mode("append").text(f"{root}/versions")
