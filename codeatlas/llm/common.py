"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, new_folder, scratch, shared_dir, ship, written  # noqa: F401

def release(*forget) -> None:
    """At the end of a task: drop what its worker keeps and hand free memory back to the system.

    Workers are used again by later stages, whose memory would otherwise come on top.
    """
    for f in forget:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tagged(column: str) -> Column:
    """A string that keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id never does."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    per_class: int,
    fit_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """(label, whole text) of at most ``per_class`` labelled documents a class, and the labelled documents by class.

    ``usable`` is a condition on ``doc_id`` that says which labels may be learnt
    from.  An id with both labels counts for neither, and an id gives one text, its
    shortest, however many rows it has.  The sample is that of the least md5 of the
    id in each class, so it is the same for every layout of the tables; in that order
    it ends with the text that takes it beyond ``fit_bytes`` bytes.  All is decided by
    ids and sizes, before any text moves; the join's broadcast side is the sample,
    2 * per_class rows at most.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    counts = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    place = F.struct(F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"))
    sized = texts.select("doc_id", place.alias("place")).groupBy("doc_id").agg(F.min("place").alias("place")).join(known, "doc_id").select("doc_id", "y", "place.size", "place.hash")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sized = written(sized.withColumn("order", order), "labelled-sizes")
    listed = [r for y in (0, 1) for r in sized.filter(F.col("y") == y).orderBy("order", "doc_id").limit(per_class).collect()]
    chosen, held = [], 0
    for r in sorted(listed, key=lambda r: (r["order"], r["doc_id"])):
        if held >= fit_bytes:
            break
        chosen.append(r)
        held += r["size"]
    if not chosen:
        return [], counts
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["hash"]) for r in chosen], "doc_id long, hash long")
    met = texts.join(F.broadcast(wanted), (texts["doc_id"] == wanted["doc_id"]) & (F.xxhash64("text") == F.col("hash"))).select(texts["doc_id"], "text")
    whole = {r["doc_id"]: r["text"] for r in met.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(int(r["y"]), whole[r["doc_id"]]) for r in chosen], counts


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: dict[int, int], ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (mean, scale, weights with the constant last).

    Rows are weighted so that the classes count as in ``prior``.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    share = {c: max(1, prior.get(c, 0)) / max(1, sum(prior.values())) for c in (0, 1)}
    w = np.where(y == 1, share[1] / n[1], share[0] / n[0]) * len(y)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (p - y)) + penalty * beta
        hessian = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        beta -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return mean, scale, beta


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, beta = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ beta[:-1] + beta[-1], -30, 30)))
