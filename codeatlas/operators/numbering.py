"""Ordinal keys and first or last rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..runtime import written


def ordinal_keys(dimension: DataFrame, by: str, name: str) -> DataFrame:
    """0, 1, ... in the order of ``by``: for dimensions, whose rows one task can order."""
    return dimension.withColumn(name, (F.row_number().over(Window.orderBy(by)) - 1).cast("int"))


def ranged(df: DataFrame, order: list[Column], at: str) -> DataFrame:
    """``df`` stored in ranges of ``order``, with its place: range times 2^33 plus place in the range."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged-rows")


def _before(rows: DataFrame, at: str, amount: Column) -> DataFrame:
    """(range, amount of all earlier ranges): as many rows as there are ranges, which is what comes to the driver."""
    sums = rows.groupBy(F.shiftright(at, 33).alias("range")).agg(amount.alias("amount")).collect()
    out, total = [], 0
    for range_, amount_ in sorted((r["range"], r["amount"]) for r in sums):
        out.append((range_, total))
        total += amount_
    return rows.sparkSession.createDataFrame(out, "_range long, _before long")


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0, 1, ... over the whole table in a total order: rows are sorted in ranges, and the counts of the ranges added up.

    No task sees more than a range; only rows that are equal in all of ``order`` must share one.
    """
    at = _free(df, "_at")
    rows = ranged(df, order, at)
    placed = rows.join(F.broadcast(_before(rows, at, F.count(F.lit(1)))), F.shiftright(at, 33) == F.col("_range"))
    return placed.withColumn(name, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop(at, "_range", "_before")


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """What all earlier rows in a total order amount to, range by range as in ``ranked``."""
    at = _free(df, "_at")
    rows = ranged(df, order, at)
    placed = rows.join(F.broadcast(_before(rows, at, F.sum(amount))), F.shiftright(at, 33) == F.col("_range"))
    near = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, near + F.col("_before")).drop(at, "_range", "_before")


def folded_order(names: DataFrame, column: str, name: str) -> DataFrame:
    """Names with their place in the order without case, from 0."""
    return ranked(names, [fold(column), F.col(column)], name)


def project_keys(assemblies: DataFrame) -> DataFrame:
    """(assembly_name, project_path) with the ordinal of the path among the distinct ones, -1 without a path."""
    paths = ranked(assemblies.filter(F.col("project_path").isNotNull()).select("project_path").distinct(), [F.col("project_path")], "k")
    return assemblies.join(paths, "project_path", "left").select("assembly_name", "project_path", F.coalesce("k", F.lit(-1)).cast("int").alias("project_key"))


def pick(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order (Spark limits groups before the shuffle too)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def collision_suffix(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``file_name``: the n-th of one name gets its number before the extension, from the second on.

    Rows are sorted in ranges of name and order and stored so; the counts of the ranges are added up, so a name that
    many rows share is numbered by many tasks.
    """
    spark, own = df.sparkSession, []
    for x in ("part", "nth", "before"):
        while x in df.columns or x in own:
            x += "_"
        own.append(x)
    part, nth, before = own
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(width, F.col(name), *order).withColumn(part, F.spark_partition_id()), "ranged-names")
    counts = ranged.groupBy(name, part).agg(F.count(F.lit(1)).alias(nth))
    earlier = F.coalesce(F.sum(nth).over(Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.join(counts.select(name, part, earlier.alias(before)), [name, part])
    numbered = rows.withColumn(nth, F.row_number().over(Window.partitionBy(name, part).orderBy(*order)) + F.col(before))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 0)
    return numbered.withColumn("file_name", F.when(F.col(nth) > 1, F.concat(stem, F.col(nth).cast("string"), ext)).otherwise(F.col(name))).drop(*own)


def carry_down(lines: DataFrame, header: Column, name: str, source: str = "file", part: str = "part", order: str = "n") -> DataFrame:
    """Each line with the last header at or above it in its file, where ``part`` numbers the pieces of files that tasks read.

    A segmented scan: within a piece headers are carried by its own window, and the last header of each piece goes on to
    the pieces behind it, so a file of any size is the work of as many tasks as it has pieces.
    """
    w = Window.partitionBy(source, part).orderBy(order)
    near = lines.withColumn(name, F.last(header, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = lines.withColumn("_header", header).groupBy(source, part).agg(F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col(order))).alias("_last"))
    pieces = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    far = last.select(source, part, F.last("_last", ignorenulls=True).over(pieces).alias("_far"))
    return near.join(far, [source, part]).withColumn(name, F.coalesce(name, "_far")).drop("_far")
