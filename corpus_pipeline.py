"""From raw documents to packed training sequences in five stages.

Each stage works on all that its predecessor kept, takes effect on it, and is
written and read again before the next.  All but the last return the columns of
``documents``, whatever others there are; rows may lack any value, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import exact_dedup, jaccard, packing, quality, toxicity
from codeatlas.llm.common import discard, in_fold, scratch, table, written
from codeatlas.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network scores below its threshold.

    A null text is scored as the empty one; without labels of both classes all texts get the share of class 1.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    return docs.filter(toxicity.score_column(model) < toxicity.THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at its threshold or above.

    A null text is scored as the empty one; without labels of both classes all texts get the share of class 1.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    return docs.filter(quality.score_column(model) >= quality.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    ship(spark)
    return exact_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 or more: that of the smallest id, those without one last.

    Documents without words are in no group and stay.
    """
    ship(spark)
    linked = written(jaccard.join_components(docs, 5, 80, groups=True), "near-linked").filter("grp is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = linked.groupBy("grp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = written(linked.join(first, "grp").filter(order != F.col("first")).select("doc_id", "key"), "near-copies")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["key"])
    return docs.join(gone, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their token ids; a null text is the closing id alone."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: The first two stages are trained models, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``.

    What a stage wrote on its way, and the table that it read, go once its own table is written.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
