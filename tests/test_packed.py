"""The data source of packed symbol files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeatlas.functions.codec import Codec, frequencies, pairs
from codeatlas.sources import packed, readers

SCHEMA = packed.SCHEMA


def some_rows(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abc.é(") for _ in range(r.randrange(k)))
    return [(r.choice((0, 1, 7, 200, 70_000)), r.randrange(400), word(9), f"{r.getrandbits(64):016x}", word(200)) for _ in range(n)]


def stored(spark, path, rows, **options):
    counts = dict(frequencies([x[4] for x in rows]))
    packed.write_symbols(spark.createDataFrame(rows, SCHEMA), path, counts, **options)
    return [f for f in os.listdir(path) if f.endswith(".bin")]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 700])
def test_round_trip(spark, tmp_path, n):
    rows, path = some_rows(n), str(tmp_path / "p")
    stored(spark, path, rows)
    assert collected(packed.read_symbols(spark, path)) == sorted(rows)


def test_one_file_is_many_tasks(spark, tmp_path):
    rows, path = some_rows(900), str(tmp_path / "p")
    spark_rows = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    packed.register(spark)
    spark_rows.write.format(packed.FORMAT).mode("overwrite").options(block_rows=16).save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".bin")]) == 1
    found = packed.read_symbols(spark, path, split_bytes=2_000)
    assert collected(found) == sorted(rows)
    used = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(used) > 10 and max(used) < 100


def test_files_end_at_their_bound(spark, tmp_path):
    rows, path = some_rows(900), str(tmp_path / "p")
    assert len(stored(spark, path, rows, file_bytes=3_000)) > 10
    assert collected(packed.read_symbols(spark, path)) == sorted(rows)


def test_columns_and_filters(spark, tmp_path):
    rows, path = some_rows(700), str(tmp_path / "p")
    stored(spark, path, rows, block_rows=8)
    found = packed.read_symbols(spark, path, ["symbol_id", "assembly_number"])
    assert collected(found.filter("assembly_number in (7, 200)").select("symbol_id")) == sorted((r[3],) for r in rows if r[0] in (7, 200))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_rows = packed.read_symbols(spark, path)
        for condition, kept in (("= 7", lambda a: a == 7), (">= 200", lambda a: a >= 200), ("< 1", lambda a: a < 1), ("in (0, 70000)", lambda a: a in (0, 70_000)), ("= 5", lambda a: a == 5)):
            assert collected(all_rows.filter(f"assembly_number {condition}")) == sorted(r for r in rows if kept(r[0])), condition
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_filters_leave_out_blocks(tmp_path):
    from pyspark.sql.datasource import EqualTo, IsNotNull

    reader = packed.FilteringReader(str(tmp_path), ["name"], 1)
    filters = [EqualTo(("assembly_number",), 7), EqualTo(("name",), "x"), IsNotNull(("assembly_number",))]
    assert list(reader.pushFilters(filters)) == filters and reader.filters == filters[:1]
    low, high = packed.np.array([0, 7, 8]), packed.np.array([6, 7, 9])
    assert reader._may_hold(low, high).tolist() == [False, True, False]


def test_files_of_other_origin(spark, tmp_path):
    rows, path = some_rows(300), tmp_path / "p"
    path.mkdir()
    (path / "a.bin").write_bytes(readers.write_packed(rows[:200]))
    (path / "b.bin").write_bytes(readers.write_packed(rows[200:]))
    (path / "c.bin").write_bytes(readers.write_packed([]))
    whole = packed.read_symbols(spark, str(path), split_bytes=500)
    assert collected(whole) == sorted(rows) and whole.rdd.getNumPartitions() == 3
    indexed = {os.path.basename(r["file"]): r["blocks"] for r in packed.index_files(spark, str(path), 10).collect()}
    assert indexed == {"a.bin": 20, "b.bin": 10, "c.bin": 0}
    split = packed.read_symbols(spark, str(path), split_bytes=500)
    assert collected(split) == sorted(rows) and split.rdd.getNumPartitions() > 10


def test_what_an_attempt_left_is_not_read(spark, tmp_path):
    rows, path = some_rows(50), tmp_path / "p"
    stored(spark, str(path), rows)
    (path / "left.bin").write_bytes(readers.write_packed(some_rows(5, 2)))
    assert collected(packed.read_symbols(spark, str(path))) == sorted(rows)
    again = some_rows(20, 3)
    stored(spark, str(path), again)
    manifests = [f for f in os.listdir(path) if f.startswith(packed.MANIFEST)]
    assert len(manifests) == 1 and json.loads((path / manifests[0]).read_text())["files"]
    assert collected(packed.read_symbols(spark, str(path))) == sorted(again)


def test_appended_files_keep_their_code(spark, tmp_path):
    rows, more, path = some_rows(60), some_rows(60, 4), str(tmp_path / "p")
    stored(spark, path, rows)
    spark.createDataFrame(more, SCHEMA).write.format(packed.FORMAT).mode("append").options(counts=json.dumps({"aa": 2, "a\0": 1, "\0\0": 1})).save(path)
    assert collected(packed.read_symbols(spark, path)) == sorted(rows + more)


def test_codec_steps_against_bits():
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(60))) for _ in range(400)]
    code = Codec(frequencies(texts))
    for t in texts:
        data = code.compress(t)
        bits = "".join(f"{b:08b}"[::-1] for b in data)
        assert bits.startswith("0" + "".join(code.bits[p] for p in pairs(t)))
        assert code.expand(data) == t
    with pytest.raises(ValueError):
        code.expand(b"\0")
