"""The table-driven lexer against a plain one, ranks in ranges, header carry, nested order, batch search and streams."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas.catalogs.builds import drained
from codeatlas.functions.folding import fold_text
from codeatlas.operators import batch_search, hierarchy, lexing, numbering, search, stats
from codeatlas.sources import readers, testdata as td
from codeatlas.streaming import builds

SF = "/root/testdata/sf0.001"


def plain(text, automaton):
    """One character after the other."""
    state, states = 0, []
    for c in text:
        state = automaton.table[state][automaton.kind[ord(c)] if ord(c) < 128 else 0]
        states.append(state)
    classes = [automaton.classes[automaton.class_of[s]] for s in states]
    for k in range(1, len(states)):
        for a, b, n in automaton.back:
            if (states[k - 1], states[k]) == (a, b):
                classes[max(0, k - n) : k] = [classes[k]] * min(n, k)
    out = []
    for k, c in enumerate(classes):
        if out and out[-1][2] == c:
            out[-1][1] += 1
        else:
            out.append([k, 1, c])
    return out


@pytest.mark.parametrize("segment", [1, 3, 7, 1024])
@pytest.mark.parametrize("automaton", [lexing.MARKUP, lexing.SCRIPT])
def test_segments(automaton, segment):
    rng = random.Random(segment)
    texts = ["".join(rng.choices("<>/!-=\"'[]?& ax1\n*`\\é", k=rng.randint(0, 120))) for _ in range(60)] + ["", "<" * 50, "<!--" + "x" * 200 + "-->"]
    got = automaton.spans(texts, segment)
    assert [[list(r) for r in zip(s.tolist(), n.tolist(), c)] for s, n, c in got] == [plain(t, automaton) for t in texts]


def classes(automaton, text):
    ((s, n, c),) = automaton.spans([text])
    return [(text[a : a + b], k) for a, b, k in zip(s, n, c) if k]


def test_classes_of_markup():
    assert classes(lexing.MARKUP, '<a b="c" d=e/>x&amp;<!-- y -->z</a><![CDATA[<q>]]><?p?>') == [
        ("<", "delimiter"), ("a", "name"), ("b", "attribute name"), ("=", "delimiter"), ('"', "attribute quotes"), ("c", "attribute value"), ('"', "attribute quotes"), ("d", "attribute name"),
        ("=", "delimiter"), ("e/", "attribute value"), (">", "delimiter"), ("x", "text"), ("&amp;", "entity reference"), ("<!-- y -->", "comment"), ("z", "text"), ("</", "delimiter"), ("a", "name"),
        (">", "delimiter"), ("<![CDATA[<q>]]>", "cdata section"), ("<?p?>", "processing instruction"),
    ]


def test_classes_of_script(spark):
    text = 'var a1 = "x\\"y"; // c\nif (2.5 / `z`) /* d */ f();'
    got = lexing.script_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("start").collect()
    assert [(r["token"], r["class"]) for r in got if r["class"]] == [
        ("var", "keyword"), ("a1", "identifier"), ("=", "punctuation"), ('"x\\"y"', "string"), (";", "punctuation"), ("// c", "comment"), ("if", "keyword"), ("(", "punctuation"), ("2.5", "number"),
        ("/", "punctuation"), ("`z`", "string"), (")", "punctuation"), ("/* d */", "comment"), ("f", "identifier"), ("();", "punctuation"),
    ]
    assert "".join(r["token"] for r in got) == text


def test_ranks_without_a_single_partition(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aAbB") + str(rng.randrange(40)), rng.randrange(9), k) for k in range(500)]
    df = spark.createDataFrame(rows, "name string, amount int, k int")
    found = numbering.ranked(df, [F.col("name"), F.col("k")], "place")
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    order = sorted(rows, key=lambda r: (r[0], r[2]))
    assert {r["k"]: r["place"] for r in found.collect()} == {r[2]: i for i, r in enumerate(order)}
    total = {r["k"]: r["total"] for r in numbering.running_total(df, [F.col("name"), F.col("k")], "amount", "total").collect()}
    assert total == {r[2]: sum(x[1] for x in order[:i]) for i, r in enumerate(order)}
    assert numbering.ranked(df.limit(0), [F.col("name")], "place").collect() == []


def test_prefixes_over_ranges(spark):
    rng = random.Random(3)
    values = list({"".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(400)}) + ["same", "same", None]
    longest = max(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(sorted(set(values[:-1])), sorted(set(values[:-1]))[1:]))
    assert stats.unique_prefix_length(spark.createDataFrame([(v,) for v in values], "v string").repartition(5), "v").first()["k"] == longest + 1
    assert stats.unique_prefix_length(spark.createDataFrame([], "v string"), "v").first()["k"] == 1


def test_headers_in_other_parts_of_a_file(spark, tmp_path):
    rng = random.Random(4)
    lines, want, header = [], [], None
    for k in range(3000):
        if k in (0, 5, 900) or k > 2900 and rng.random() < 0.5:
            header = f"id{k}"
            lines.append("=" + header)
        else:
            lines.append(f"file{k}.cs;{k}")
            want.append((header, f"file{k}.cs", k))
    (tmp_path / "map.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert readers.numbered_lines(spark, str(tmp_path)).select("part").distinct().count() > 10
        assert sorted(map(tuple, readers.declaration_map(spark, str(tmp_path)).collect()), key=lambda r: r[2]) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nested_order(spark):
    rng = random.Random(6)
    parent = {k: rng.choice([None, *range(k)]) if k > 2 else None for k in range(120)}
    title = {k: rng.choice(["Properties", "b", "B", "c", "é"]) for k in parent}
    key = lambda k: (title[k].upper() != "PROPERTIES", fold_text(title[k]), title[k], k)
    want, clock = {}, 0

    def walk(k, depth):
        nonlocal clock
        enter, clock = clock, clock + 1
        for child in sorted((c for c in parent if parent[c] == k), key=key):
            walk(child, depth + 1)
        want[k] = (depth, enter, clock)

    for root in sorted((c for c in parent if parent[c] is None), key=key):
        walk(root, 0)
    rows = hierarchy.nested_order(spark.createDataFrame([(k, parent[k], title[k]) for k in parent], "node int, parent int, title string")).collect()
    assert {r["node"]: (r["depth"], r["enter"], r["leave"]) for r in rows} == want


def test_batch_search_gives_what_single_searches_give(spark):
    symbols = td.symbols(spark, SF).cache()
    texts = ["cold widget", '"cold widget"', "cold type", "ECONOMY.small", "cold Brand#2.", "get_cold", "small.cs", "small src\\Brand#1", "red ri", "no such name", "x", "", "cold method property", "lar large"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "query int, text string")
    found = batch_search.search_many(symbols, df)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["symbol_id"], r["match_level"], r["weight"]))
    for k, t in enumerate(texts):
        want = [(r["symbol_id"], r["match_level"], r["weight"]) for r in search.search_symbols(symbols, t).collect()]
        assert sorted(got.get(k, [])) == sorted(want), t
    assert 99 not in got


def test_pairs_over_triggers_and_a_restart(spark, tmp_path):
    """A start waits over triggers, days and a restart of the stream; a batch run again repeats nothing."""
    schema = "seq long, ts timestamp, key long, event_type string"
    rows = [(1, "2024-01-01 00:00:00", 7, builds.START), (2, "2024-01-05 00:00:00", 8, builds.COMMAND), (3, "2024-02-01 00:00:00", 7, builds.COMMAND), (4, "2024-02-01 00:00:01", 7, builds.COMMAND), (5, "2024-03-01 00:00:00", 8, builds.START), (6, "2024-03-09 00:00:00", 8, builds.COMMAND)]
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(source)

    def put(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    for k, chunk in enumerate((rows[:2], rows[2:5], rows[5:])):
        spark.createDataFrame(chunk, "seq long, ts string, key long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        builds.pair_stream(stream).writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    got = {(r["key"], r["seq"], r["start_seq"]) for r in spark.read.schema(builds.PAIR).parquet(f"{out}/batch=*").collect()}
    batch = {tuple(r) for r in builds.pair_events(spark.read.schema(schema).parquet(source)).collect()}
    assert got == batch == {(7, 3, 1), (8, 6, 5)}


def test_pairs_of_many_keys_in_few_groups(spark, tmp_path):
    """State is kept by groups of keys, however many keys there are; null is one key, and large keys stay exact."""
    schema = "seq long, ts timestamp, key long, event_type string"
    n = 3_000
    key = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit(2**60) + F.col("id") * 7919 % n)
    kind = F.when(F.xxhash64("id") % 2 == 0, builds.START).otherwise(builds.COMMAND)
    rows = spark.range(4 * n).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), key.alias("key"), kind.alias("event_type"))
    for k in range(2):
        rows.filter(F.floor(F.col("seq") / (2 * n)) == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = builds.pair_stream(stream).writeStream.format("memory").queryName("many_pairs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(240)
    found, batch = (sorted(map(tuple, df.collect()), key=str) for df in (spark.table("many_pairs"), builds.pair_events(rows)))
    assert found == batch and any(r[0] is None for r in found)
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= builds.KEY_GROUPS + 1


def test_late_rows_of_sessions(spark, tmp_path):
    """A row later than the bound does not reach a stream of appended sessions; one within it does."""
    source = str(tmp_path / "in")
    times = [["2024-01-01 10:00:00"], ["2024-01-01 12:00:00"], ["2024-01-01 12:01:00"], ["2024-01-01 11:55:00", "2024-01-01 10:05:00"], ["2024-01-02 00:00:00"]]
    for k, chunk in enumerate(times):
        spark.createDataFrame([(1, t) for t in chunk], "key long, t string").select("key", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    rows = drained(builds.sessions(stream), "append", "late").orderBy("start").collect()
    assert [(str(r["start"]), r["n"]) for r in rows] == [("2024-01-01 10:00:00", 1), ("2024-01-01 11:55:00", 3)]
