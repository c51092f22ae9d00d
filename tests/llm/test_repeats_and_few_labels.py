"""Samples of repeated ids, models of very few labels, hot groups of equal rows, and SQL on repeated pages."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import quality, sharding, toxicity, warc
from codeatlas.llm.common import labelled_sample


def stored(spark, tmp_path, rows, schema, name="t", parts=4):
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def test_repeated_ids_do_not_crowd_out_others(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "again")] * 30 + [(k, f"text {k}") for k in range(2, 12)] + [(1, "another text of one"), (2, None)], "doc_id long, text string", "docs")
    labels = stored(spark, tmp_path, [(k, k % 2) for k in range(1, 12)], "doc_id long, toxic int", "labels")
    rows, counts = labelled_sample(docs, labels, "toxic", F.lit(True), 5, 1 << 20)
    assert len(rows) == len(set(rows)) == 10 and Counter(y for y, _ in rows) == {0: 5, 1: 5} and counts == {0: 5, 1: 6}
    every, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 99, 1 << 20)
    assert sorted(t for _, t in every) == sorted(["again"] + [f"text {k}" for k in range(2, 12)])
    few, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 99, 12)
    assert few == every[: len(few)] and len(few) in (2, 3)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_models_of_very_few_labels(n):
    good, bad = [f"a calm and ordinary sentence about rivers {k}" for k in range(n)], [f"worthless stupid idiot scum {k}" for k in range(n)]
    for fit, score in ((toxicity.fit, toxicity.score_texts), (quality.fit, quality.score_texts)):
        model = fit([(0, t) for t in bad] + [(1, t) for t in good], {0: n, 1: n})
        assert "constant" not in model
        scores = score([good[0], bad[0]], model)
        assert 0 <= scores.min() and scores.max() <= 1 and scores[0] > scores[1]
        assert fit([(1, t) for t in good], {1: n}) == {"constant": 1.0}


def test_dictionary_of_few_samples_takes_from_all(monkeypatch):
    def refuse(*_):
        raise quality.zstandard.ZstdError("too little")

    monkeypatch.setattr(quality.zstandard, "train_dictionary", refuse)
    texts = [bytes([65 + k]) * 5_000 for k in range(20)]
    assert {c for c in quality.build_dictionary(texts, 32 * quality.BLOCK)} == {65 + k for k in range(20)}
    assert quality.build_dictionary([b"ab", b"cd"]) == b"abcd"


def test_hot_group_of_equal_rows_is_split(spark, tmp_path):
    rng = random.Random(1)
    rows = [(None, "same", "s")] * 6000 + [(7, "seven", "s")] * 3000 + [(k, f"t{k}", rng.choice("sr")) for k in range(3000)]
    rng.shuffle(rows)
    docs = stored(spark, tmp_path, rows, "doc_id long, text string, source string")
    keyed = docs.select("doc_id", sharding.tagged("source").alias("stratum"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))).alias("h"), F.monotonically_increasing_id().alias("spread"), F.lit(0).alias("b"))
    parts = sharding._split(keyed, 200).groupBy("stratum", "b", "part").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("low"), F.max("h").alias("high")).orderBy("stratum", "part").collect()
    most = {s: max(r["k"] for r in parts if r["stratum"] == s and r["low"] == r["high"] and r["k"] > 1) for s in ("=s",)}
    assert most["=s"] < 400
    runs = [(r["low"], r["high"]) for r in parts if r["stratum"] == "=s"]
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))  # parts stand in the order of hashes
    found = sharding.stratified_shards(docs, bucket_rows=200).collect()
    assert len(found) == len(rows)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
    mixture = Counter((r["shard"], r["stratum"]) for r in found)
    total = Counter(r["stratum"] for r in found)
    assert all(abs(n - total[s] / 8) <= 2 for (_, s), n in mixture.items())


def test_sql_of_repeated_pages(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "u", "same"), (None, "u", "same"), (3, "v", "same"), (1, None, None), (2, "w", ""), (None, "x", "alone"), (4, "y", "é<b>")]
    stored(spark, tmp_path, rows, "page_id long, url string, html string", "pages")
    got = warc.op2_warc_revisits(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute("select page_id, payload_bytes, payload_digest, record_type, refers_to from (" + warc.SQL["op2_warc_revisits"] + ") t").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert Counter((r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4) == {("response", None): 1, ("revisit", 5): 3}
