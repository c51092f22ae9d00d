"""Session helpers that every part of the package may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_BASE: str | None = None
#: The folders that each open ``scratch`` has seen made.
_MADE: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``.

    The sources travel through Spark's own file server, so executors need no
    installation and no common folder with the driver.  Once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir() and not str(root).endswith(".zip"):
        folder = tempfile.mkdtemp(prefix="codeatlas-src-")
        archive = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local (tests) a folder of this
    process is used, since driver and executors are then the same machine.
    """
    global _LOCAL_BASE
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _LOCAL_BASE is None:
            _LOCAL_BASE = tempfile.mkdtemp(prefix="codeatlas-")
        base = "file://" + _LOCAL_BASE
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    folder = f"{shared_dir(spark)}/codeatlas-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(folder)
    return f"{folder}/{name}"


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of intermediate tables, by the file system they are on."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Collects the folders that are made inside; whoever has written what was read from them can ``discard`` them."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]


def task_count(spark: SparkSession) -> int:
    """Tasks that keep all cores busy to the end: those of a shuffle, and some for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys in ``task_count`` parts, which are not put together again for being small.

    A small stored table is read by few tasks; where a row costs much more than its bytes, they would do all the work.
    """
    return df.repartition(task_count(df.sparkSession), *keys)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that survives lost executors, and gives
    later joins plain scans below their exchanges, so that AQE may split skewed
    partitions of either side.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
