"""The pipeline's stages take effect and agree with plain versions of themselves."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from codeatlas.llm import exact_dedup, packing, quality, toxicity
from codeatlas.llm.common import in_fold
from tests.llm.test_similarity import brute

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def check_packed(rows, kept):
    """Each document's pieces in a row are its ids, and sequences are gapless."""
    coder, pieces, ends = packing.encoder(), defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(kept)
    for doc, text in kept.items():
        assert b"".join(pieces[doc][s] for s in sorted(pieces[doc])) == coder.encode_added(text or "") + np.array([0], "<u4").tobytes()
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_stages(spark):
    """Every stage against a plain version on its own input, and the whole run against the stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, columns, seen = spark.read.parquet(f"{SF}/labels.parquet"), docs.columns, []
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        after = C.written(stage(spark, docs, SF), f"test-{k}")
        assert after.columns == columns, name
        seen.append((docs, texts(docs), texts(after)))
        docs = after
    for (before, was, now), module, label, fold, keeps in ((seen[0], toxicity, "toxic", (4, 2), lambda s: s < 0.3), (seen[1], quality, "quality", (5, 0), lambda s: s >= 0.3)):
        ids = sorted(was)
        scores = module.score_texts([was[i] for i in ids], module.learn(before, labels, ~in_fold("doc_id", *fold)))
        assert now == {i: was[i] for i, s in zip(ids, scores) if keeps(s)} and 0 < len(now) < len(was)
    _, was, now = seen[2]
    best = {}
    for i, t in was.items():
        best[exact_dedup.normalise(t)] = max(best.get(exact_dedup.normalise(t), -1), i)
    assert set(now) == set(best.values())
    _, was, now = seen[3]
    assert set(now) == {i for i, (_, c) in brute(list(was.items()), 5, 80).items() if i == c}
    rows = C.run(spark, SF).collect()
    check_packed(rows, now)


def test_labels_decide_as_planted(spark):
    """Labelled documents that a stage drops are toxic, or bad, for the most part, and clean ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for stage, bad in ((C.drop_toxic, lambda r: r["toxic"] == 1), (C.keep_quality, lambda r: r["quality"] == 0)):
        kept = {r["doc_id"] for r in stage(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
        is_bad = {i: bad(r) for i, r in labels.items()}
        clean, dropped = [i for i in is_bad if not is_bad[i]], [i for i in is_bad if is_bad[i] and i not in kept]
        assert sum(i in kept for i in clean) / len(clean) > 0.97 and len(dropped) / sum(is_bad.values()) > 0.7


@pytest.mark.parametrize("rows", ["edge", "none"])
def test_stages_on_odd_tables(spark, docs, empty, rows, tmp_path):
    """Nulls, ties, repeated rows, clashing columns; and no rows.  Labels are there for none of them."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    start = (docs if rows == "edge" else empty).withColumn("grp", F.lit("g")).withColumn("key", F.lit(1)).withColumn("first", F.lit("f"))
    C.written(start, "odd").write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        before, now = now, C.written(stage(spark, now, str(tmp_path)), "odd-stage")
        assert now.schema == before.schema, name
        assert now.count() == before.count() if name in ("toxicity", "quality classifier") else now.count() <= before.count()
    kept = now.collect()
    if rows == "edge":
        assert len({exact_dedup.normalise(r["text"]) for r in kept}) == len(kept) > 5
        assert None in {r["doc_id"] for r in kept}  # a document without an id, unlike any other, stays
    packed = C.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(packing.encoder().encode_added(r["text"] or "")) // 4 + 1 for r in kept)
    assert sum(r["length"] for r in C.run(spark, str(tmp_path)).collect()) == sum(r["length"] for r in packed)


def test_stage_numbers():
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality classifier", "exact dedup", "n-gram Jaccard join", "packing"] and C.ORACLE_SQL is None
