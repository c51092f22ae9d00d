"""Choosing builds, projects and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import pick

#: The score of an invocation that asks to be used.
CHOSEN = 2**31 - 1


def _flag(properties: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.element_at(properties, name))) == "true", F.lit(False))


def framework_version(framework: Column) -> tuple[Column, Column]:
    """Major and minor version of a target framework; ``net48`` is 4.8, ``net8.0`` is 8.0, anything else 0."""
    f = F.lower(framework)
    dotted = F.regexp_extract(f, r"^(?:net|netcoreapp|netstandard)(\d+)\.(\d+)", 1)
    minor = F.regexp_extract(f, r"^(?:net|netcoreapp|netstandard)(\d+)\.(\d+)", 2)
    short, short_minor = F.regexp_extract(f, r"^net(\d)(\d?)\d*(?:-|$)", 1), F.regexp_extract(f, r"^net(\d)(\d?)\d*(?:-|$)", 2)
    number = lambda a, b: F.coalesce(F.when(dotted != "", a).otherwise(b).try_cast("int"), F.lit(0))
    return number(dotted, short), number(minor, short_minor)


def invocation_score(properties: Column, source_files: Column) -> Column:
    """Newer frameworks, then platforms (Linux, Unix, others), then more files; unsupported assemblies far below."""
    framework = F.element_at(properties, "TargetFramework")
    major, minor = framework_version(framework)
    platform = F.regexp_extract(F.lower(framework), r"-([a-z]+)", 1)
    bonus = F.when(platform == "linux", 600).when(platform == "unix", 550).when(platform != "", 500).otherwise(0)
    score = (
        F.when(_flag(properties, "IsPlatformNotSupportedAssembly"), -10000).otherwise(0)
        + F.coalesce(major * 1000 + minor * 100, F.lit(0)) + F.coalesce(bonus, F.lit(0)) + F.coalesce(source_files, F.lit(0))
    )
    return F.when(_flag(properties, "UseForSourceIndex"), CHOSEN).otherwise(score).cast("int")


def excluded(directory: Column, names: tuple[str, ...] = ("ref", "stubs"), parents: tuple[str, ...] = ("cycle-breakers",)) -> Column:
    """Projects whose folder has one of ``names`` or lies in one of ``parents``: those of references and stubs, and those that only break cycles."""
    parts = F.split(directory, r"[\\/]")
    last, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return directory.isNull() | (directory == "") | F.coalesce(last.isin(*names), F.lit(False)) | F.coalesce(parent.isin(*parents), F.lit(False))


def best(candidates: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """The highest score of each key, the first seen among equals."""
    return pick(candidates, keys, [F.desc(score), F.asc(seq)])


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: int = 10) -> DataFrame:
    return pick(rows, keys, order, keep)


def retention(rows: DataFrame, key: str, order: list[Column], keep: int = 10) -> DataFrame:
    """All rows with ``expired``: beyond the newest ``keep`` of their key."""
    return rows.withColumn("expired", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > keep)


def newest_archive(blobs: DataFrame, prefix: str) -> DataFrame:
    """Archive names begin with their repository and sort by time."""
    return blobs.filter(F.col("name").startswith(prefix)).orderBy(F.desc("name")).limit(1)


def first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    return pick(rows, [key], [F.asc(seq)])


def difference(included: DataFrame, excluded_: DataFrame) -> DataFrame:
    return included.select("path").distinct().join(excluded_.select("path"), "path", "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def containers(all_: DataFrame, in_use: DataFrame) -> DataFrame:
    """Stale containers with one less build to live, or to delete at 0."""
    stale = all_.join(in_use.select("container"), "container", "left_anti")
    left = F.greatest(F.col("ttl") - 1, F.lit(0))
    return stale.select("container", left.alias("ttl"), (left == 0).alias("delete"))


#: Parts of the names of test frameworks.
TEST_FRAMEWORKS = "xunit|nunit|mstest|unittestframework|testplatform"


def is_test_project(references: Column, known: str = TEST_FRAMEWORKS) -> Column:
    """References or packages of a test framework, by a pattern of lower-case names."""
    return F.exists(references, lambda r: F.lower(r).rlike(known))


def project_files(sources: DataFrame) -> DataFrame:
    """Source files (project, directory, root, file) as items of a normalized project: include, link.

    Paths use ``/``.  A file of the repository outside the project's directory is linked by its path
    in the repository; one outside the repository comes as a numbered external file of its project.
    """
    below = lambda folder: F.col("file").startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))
    rest = lambda folder: F.expr(f"substring(file, length(rtrim('/', {folder})) + 2)")
    up = F.repeat(F.lit("../"), F.size(F.split(rest_of("directory", "root"), "/")))
    inside = sources.filter(below(F.col("root")))
    own = F.when(below(F.col("directory")), rest("directory")).otherwise(F.concat(up, rest("root")))
    link = F.when(~below(F.col("directory")), rest("root"))
    outside = sources.filter(~below(F.col("root")))
    number = F.row_number().over(Window.partitionBy("project").orderBy("file"))
    name = F.element_at(F.split("file", "/"), -1)
    external = F.concat(up, F.lit("../_external/"), number.cast("string"), F.lit("/"), name)
    return inside.select("project", own.alias("include"), link.alias("link")).unionByName(outside.select("project", external.alias("include"), F.lit(None).cast("string").alias("link")))


def rest_of(path: str, root: str) -> Column:
    return F.expr(f"substring({path}, length(rtrim('/', {root})) + 2)")


def first_by_path_and_stem(rows: DataFrame, path: str, seq: str) -> DataFrame:
    """Projects in order, each only where neither its path nor its name without extension has come before.

    Equal paths have equal names, so the names alone decide.
    """
    stem = F.regexp_extract(path, r"([^\\/]*?)(?:\.[^.\\/]*)?$", 1)
    return pick(rows.withColumn("stem", stem), ["stem"], [F.asc(seq)]).drop("stem")
