"""Relational operators on small tables, readers and streams."""

import datetime
import os
import struct

from pyspark.sql import functions as F

from codeatlas.functions import codec
from codeatlas.functions.kinds import reference_header
from codeatlas.operators import closure, hierarchy, numbering, references, selection, spans, stats
from codeatlas.plans import options
from codeatlas.sources import readers, sinks
from codeatlas.streaming import builds


def test_project_keys(spark):
    of = lambda rows: {r["assembly_name"]: r["project_key"] for r in numbering.project_keys(spark.createDataFrame(rows, "assembly_name string, project_path string")).collect()}
    assert of([("a", "e"), ("b", "f"), ("c", "d")]) == {"a": 1, "b": 2, "c": 0}
    assert of([("a", None), ("b", "f"), ("c", "d")]) == {"a": -1, "b": 1, "c": 0}


def test_unique_prefix(spark):
    for k, values in [(1, "a b"), (2, "abc ace"), (3, "abcd abef"), (5, "abcde abcdg"), (7, "abcdefgh abcdefii"), (7, "abcdefgh1234zxcv abcdefiipokliuhj aosdfijficicufuf")]:
        assert stats.unique_prefix_length(spark.createDataFrame([(v,) for v in values.split()], "v string"), "v").first()["k"] == k


def test_scores(spark):
    def score(files=1, **properties):
        df = spark.createDataFrame([(properties or {"x": "y"}, files)], "p map<string,string>, f int")
        return df.select(selection.invocation_score(F.col("p"), F.col("f"))).first()[0]

    assert score(UseForSourceIndex="True", IsPlatformNotSupportedAssembly="true") == 2**31 - 1
    assert score(TargetFramework="net8.0") == 8001 and score(TargetFramework="net48") == 4801 and score(TargetFramework="netstandard2.1") == 2101
    assert score(TargetFramework="net8.0-linux") - score(TargetFramework="net8.0-windows") == 100
    assert score(TargetFramework="net8.0-unix") == 8551 and score(TargetFramework="what") == 1 and score(5) == 5
    assert score(TargetFramework="net8.0", IsPlatformNotSupportedAssembly="true") == -1999


def test_exclusion(spark):
    paths = ["", None, "/a/ref", "/a/stubs", "/a/cycle-breakers/b", "/a/b", "/a/reference"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(selection.excluded(F.col("p"))).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, False, False]


def test_marked_lines(spark):
    df = spark.createDataFrame([("a<b c", [(0, 1), (4, 5)])], "line_text string, occurrences array<struct<col_start:int,col_end:int>>")
    assert references.marked_lines(df).first()["html"] == "<i>a</i>&lt;b <i>c</i>"


def test_headers(spark):
    rows = spark.createDataFrame([(0, 1), (5, 2), (8, 3), (13, 1)], "k int, n int").select(reference_header(F.col("k"), F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1 derived type", "2 instantiations", "3 references", "1 MSBuild item assignment"]


def test_reference_page(spark):
    refs = spark.createDataFrame([("s", 8, "a", "f", 1, 3, 4), ("s", 8, "a", "f", 1, 0, 1), ("s", 8, "a", "h", 4, 0, 1), ("s", 8, "c", "f", 4, 0, 1), ("s", 0, "b", "g", 2, 0, 1)], "to_symbol_id string, kind int, from_assembly string, from_path string, line int, col_start int, col_end int")
    rows = references.page(refs).orderBy("kind", "from_assembly", "from_path").collect()
    assert [(r["kind"], r["from_assembly"], r["from_path"], r["kind_n"], r["assembly_n"], r["n"]) for r in rows] == [(0, "b", "g", 1, 1, 1), (8, "a", "f", 4, 3, 2), (8, "a", "h", 4, 3, 1), (8, "c", "f", 4, 1, 1)]
    assert [o["col_start"] for o in rows[1]["lines"][0]["occurrences"]] == [0, 3]


def test_closure_cycle(spark):
    rows = closure.forward_closure(spark.createDataFrame([("a", "t", "b"), ("b", "t", "c"), ("c", "t", "a"), ("x", "u", "y")], "assembly string, type_id string, to_assembly string")).collect()
    assert {(r["assembly"], r["terminal"]) for r in rows} == {("a", "c"), ("b", "a"), ("c", "b"), ("x", "y")}


def test_tree(spark):
    rows = hierarchy.namespace_tree(spark.createDataFrame([("A.B",), ("A.C",), ("",)], "ns string"), "ns").collect()
    assert {(r["path"], r["parent"], r["leaves"]) for r in rows} == {("A", None, 2), ("A.B", "A", 1), ("A.C", "A", 1)}


def test_settings(spark):
    rows = stats.settings(spark.createDataFrame([("git:a=1",), ("git:b=x=y",), ("bad",)], "line string")).collect()
    assert [(r["plugin"], r["settings"]) for r in rows] == [("git", {"a": "1", "b": "x=y"})]


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_readers(spark, tmp_path):
    p = lambda n, d: write(str(tmp_path / n), d)
    assert [tuple(r) for r in readers.assembly_map(spark, p("a/Assemblies.txt", "x;0;3\ny;-1;0\n")).orderBy("assembly_number").collect()] == [(0, "x", 0, 3), (1, "y", -1, 0)]
    assert readers.project_list(spark, p("p/P.txt", "a\nb\n")).count() == 2
    s = readers.symbol_lines(spark, p("d/D.txt", "n;1;class;d;3\nbad;2\nm;1;class;e;4\n")).collect()
    assert [(r["symbol_id"], r["name"], r["glyph"]) for r in s] == [("1", "m", 4)]
    d = readers.declaration_map(spark, p("m/M.txt", "=i\nf.cs;0\ng.cs;12\n=j\nh.cs;5\n")).collect()
    assert {(r["symbol_id"], r["file"], r["offset"]) for r in d} == {("i", "f.cs", 0), ("i", "g.cs", 12), ("j", "h.cs", 5)}
    assert readers.edges(spark, p("e/E.txt", "a;b;c\na;b;c\nx;y\n")).count() == 1
    i = readers.project_info(spark, p("i/i.txt", "Lines=12\nLines=13\nDocs=x\n"), ["Lines", "Docs", "None"]).first()
    assert (i["Lines"], i["Docs"], i["None"]) == (12, 0, 0)
    r = readers.reference_records(spark, p("r/abc.txt", "A;u;f.cs;3;1;4;8\nint x;\n")).first()
    assert (r["to_symbol_id"], r["line"], r["kind"], r["line_text"]) == ("abc", 3, 8, "int x;")
    assert readers.invocations(spark, p("v/v.txt", "p\no\nc\np2\no2\nc2\n")).count() == 2
    f = readers.federation(spark, [("s0", p("f/0.txt", "a;1\nb;2\n")), ("s1", p("f/1.txt", "a;1\n"))])
    assert f.filter("assembly_name = 'a'").count() == 2
    assert {x["name"] for x in readers.name_list(spark, os.path.dirname(p("n/Foo.html", "x"))).collect()} == {"Foo"}
    docs = readers.documentation(spark, p("x/x.xml", '<doc><members><member name="T:A"><summary>1</summary></member><member name="T:A">2</member></members></doc>')).collect()
    assert [r["xml"] for r in docs] == ['<member name="T:A">2</member>']
    rows = [(1, 3, "Näme", "00ff00ff00ff00ff", "desc"), (300, 196, "x", "f907d79481da6ba4", "")]
    assert list(readers.parse_packed(readers.write_packed(rows))) == rows
    write(str(tmp_path / "roots/one/R/x.txt"), "x"), write(str(tmp_path / "roots/two/y.txt"), "y")
    assert readers.discover(spark, str(tmp_path / "roots")) == ["one"]
    js = p("j/j.json", '{"fileName": "a.ts", "syntacticClassifications": [{"text": "x", "start": 0, "length": 1}], "semanticClassifications": []}')
    assert readers.analyzed_files(spark, js).first()["syntacticClassifications"][0]["length"] == 1


def test_line_numbers(spark, tmp_path):
    """Of several files, in one task or cut into many parts; an empty line counts, and a last break makes none."""
    for name, lines in (("a", ["one", "", "three"]), ("b", [f"line {k} " + "x" * (k % 50) for k in range(3000)]), ("c", ["only"])):
        write(str(tmp_path / f"t/{name}.txt"), "\r\n".join(lines) + ("\n" if name != "c" else ""))
    want = {("a", 0, "one"), ("a", 1, ""), ("a", 2, "three"), ("c", 0, "only")} | {("b", k, f"line {k} " + "x" * (k % 50)) for k in range(3000)}
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.numbered_lines(spark, str(tmp_path / "t")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == len(want) and {(os.path.basename(r["file"])[0], r["n"], r["value"]) for r in rows} == want


def test_readers_of_several_files(spark, tmp_path):
    """What depends on neighbouring lines stays within its file."""
    for name, text in (("a", "=i\nf.cs;0\ng.cs;1\n"), ("b", "h.cs;2\n=j\nk.cs;3\n")):
        write(str(tmp_path / f"m/{name}.txt"), text)
    d = readers.declaration_map(spark, str(tmp_path / "m")).collect()
    assert {(r["symbol_id"], r["file"]) for r in d} == {("i", "f.cs"), ("i", "g.cs"), (None, "h.cs"), ("j", "k.cs")}
    for name, n in (("a", 3), ("b", 4)):
        write(str(tmp_path / f"v/{name}.txt"), "".join(f"{name}p{k}\n{name}o{k}\n{name}c{k}\n" for k in range(n)) + "rest\n")
    got = {tuple(r) for r in readers.invocations(spark, str(tmp_path / "v")).collect()}
    assert got == {(f"{x}p{k}", f"{x}o{k}", f"{x}c{k}") for x, n in (("a", 3), ("b", 4)) for k in range(n)}
    for name, v in (("a", 1), ("b", 2)):
        write(str(tmp_path / f"i/{name}.txt"), f"Lines={v}\nLines=9\n")
    assert sorted(r["Lines"] for r in readers.project_info(spark, str(tmp_path / "i"), ["Lines"]).collect()) == [1, 2]


def test_codec(spark):
    texts = ["System.Console", "System.Con", "a", "", "ab", "naïve", "System.Console.Write(int, string)"]
    code = codec.Codec(codec.frequencies(texts))
    assert all(code.expand(code.compress(t)) == t for t in [*texts, "unseen ~~", "ü"]) and len(code.compress("System.Console")) < 14
    assert codec.Codec({"a\0": 3}).expand(codec.Codec({"a\0": 3}).compress("a")) == "a"
    assert codec.Codec(dict(reversed(codec.frequencies(texts).items()))).bits == code.bits
    rows = [(1, 3, "n", "00ff00ff00ff00ff", t) for t in texts]
    assert [r[4] for r in readers.parse_packed(readers.write_packed(rows, code), code)] == texts


def test_options():
    o = options.parse(['/out:"c:\\o p"', "/p:A=b=c", "/force", "/NOPLUGINS", "/useplugins", "x.CSPROJ", "y.txt", "/in:list", "/federation:s", "/offlinefederation:t=f", '/serverPath:"a=1"="b=2"', "/noplugin:git", "/root:c:\\r"], lines=lambda p: ["c:\\r\\z.sln"])
    assert (o.out, o.properties, o.flags) == ("c:\\o p", {"A": "b=c"}, {"/force", "/noplugins"})
    assert o.projects == [] and set(o.rejected) == {"y.txt", "x.CSPROJ", "c:\\r\\z.sln"}  # one input lies outside the root
    assert (o.federations, o.offline, o.server_paths, o.blacklist) == (["s"], {"t": "f"}, {"a=1": "b=2"}, ["git"])
    assert options.parse(["/root:c:\\r", "c:\\R\\a.dll"]).projects == ["c:\\R\\a.dll"] and not options.parse(["a.sln"], exists=lambda p: False).projects


def test_published(spark, tmp_path):
    root = str(tmp_path / "p")
    sinks.publish(spark.range(3), root, 1)
    first = readers.current(spark, root)
    sinks.publish(spark.range(5), root, 2)
    assert (first.count(), readers.current(spark, root).count()) == (3, 5)


def test_managed(spark):
    pe = bytearray(400)
    pe[:2], pe[0x3C:0x40], pe[0x80:0x84], pe[0x80 + 24 : 0x80 + 26] = b"MZ", struct.pack("<I", 0x80), b"PE\0\0", struct.pack("<H", 0x10B)
    native, at = bytes(pe), 0x80 + 24 + 96 + 14 * 8
    pe[at : at + 4] = struct.pack("<I", 1)
    far = bytes(pe[:0x3C]) + b"\xff" * 4 + bytes(pe[0x40:])
    files = [bytes(pe), native, b"MZ", b"", None, bytes(pe[: at + 2]), far, b"XX" + bytes(pe[2:])]
    rows = spark.createDataFrame(list(enumerate(files)), "k int, c binary").select("k", readers.is_managed(F.col("c")).alias("m"))
    assert [r["m"] for r in rows.orderBy("k").collect()] == [True] + [False] * 7


def test_sinks(spark, tmp_path):
    from codeatlas.sources.testdata import searchable

    s = searchable(spark.createDataFrame([("b", "d", "a", None, "class", 0, "1"), ("a", "d", "a", None, "class", 0, "2")], "name string, description string, assembly_name string, project_path string, kind string, assembly_number int, symbol_id string"))
    sinks.write_symbols(s, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    refs = spark.createDataFrame([("a", "1", 8), ("b", "2", 0)], "to_assembly string, to_symbol_id string, kind int")
    sinks.write_references(refs, str(tmp_path / "r"))
    assert sorted(x for x in os.listdir(tmp_path / "r") if "=" in x) == ["to_assembly=a", "to_assembly=b"]
    sinks.write_maps(spark.createDataFrame([(0, "x", 0, 3)], "assembly_number int, assembly_name string, project_key int, referencing_count int"), spark.createDataFrame([(0, "p")], "project_key int, project_path string"), str(tmp_path / "m"))
    assert readers.assembly_map(spark, str(tmp_path / "m/assemblies/*.txt")).first()["assembly_name"] == "x"
    assert sinks.archive_name("repo", datetime.datetime(2020, 1, 2, 3, 4, 5)) == "repo/2020-01-02T03.04.05Z.tar.gz"


def test_stream_pairs_as_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    kinds = ["TargetStarted", "TargetStarted", "TaskCommandLine", "TaskCommandLine", "Other", "TargetStarted", "Other", "TaskCommandLine"]
    rows = [(k, t + datetime.timedelta(seconds=k), k % 3, kinds[(k * 7) % 8]) for k in range(120)]
    schema = "seq long, ts timestamp, key long, event_type string"
    whole = spark.createDataFrame(rows, schema)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = builds.pair_stream(stream).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.sql("select * from pairs").collect())) == sorted(map(tuple, builds.pair_events(whole).collect()))


def test_extraction(spark):
    from codeatlas.operators import extract as X
    from codeatlas.operators import spans as S

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.style(F.lit(c))) for c in ("keyword", "punctuation", "string - verbatim", "new thing")] == ["k", None, "s", "unknownClassification"]
    assert one(X.script_glyph(F.lit("enum"))) == 18 and one(X.script_glyph(F.lit("?"))) == 195 and one(X.xml_style(F.lit("text"))) is None
    yes, no = F.lit(True), F.lit(False)
    kind = lambda base, derived, target="type", w=no, inside=yes: one(X.reference_kind(inside, F.lit(base), F.lit(derived), yes, F.lit(target), w))
    assert [kind("class", "class"), kind("interface", "interface"), kind("interface", "class"), kind("class", "class", inside=no), kind("class", "class", "field", yes, no)] == [0, 1, 2, 8, 6]
    assert one(X.link(yes, no, F.lit("x"), yes, F.lit(None), F.lit(None).cast("string"), no)) == "declaration"
    docs = spark.createDataFrame([(1, "int a;\n  b < c;\n" + "x" * 9000 + " y")], "d int, t string")
    tokens = spark.createDataFrame([(1, 4, 1), (1, 9, 1), (1, 13, 1), (1, 16 + 9001, 1)], "d int, start int, len int")
    rows = X.reference_rows(tokens, S.line_starts(docs, "d", "t"), "d").orderBy("start").collect()
    assert [(r["line"], r["col_start"], r["col_end"]) for r in rows] == [(1, 4, 5), (2, 0, 1), (2, 7, 8), (3, 9001, 9002)]
    parts = spark.createDataFrame([(1, 0, "a<", None, None), (1, 2, "b", "k", "u")], "d int, start int, text string, style string, href string")
    assert X.document_html(parts, "d").first()["html"] == 'a&lt;<a href="u"><span class="k">b</span></a>'
    members = lambda rows: spark.createDataFrame(rows, "type_id string, member_id string, signature string")
    got = X.implementations(members([("I", "I.m", "m()")]), members([("T", "T.m", "m()"), ("T", "T.n", "n()")]), spark.createDataFrame([("T", "I")], "type_id string, interface_id string"))
    assert [tuple(r) for r in got.collect()] == [("T", "I", "I.m", "T.m")]
    named = X.named_references(spark.createDataFrame([("this", "type", "T"), (".ctor", "method", "T")], "to_name string, to_kind string, to_type string"))
    assert [r["to_name"] for r in named.collect()] == ["T .ctor"]
    assert one(X.eligible(F.lit("method"), F.lit("a"))) and not one(X.eligible(F.lit("local"), F.lit("a")))
    assert one(X.reference_url(F.lit("A"), F.lit("B"), F.lit("p.html"), F.lit(3))) == "../../A/p.html#3"


def test_merged_and_filled_spans_sort_once(spark):
    """What is merged and filled is sorted for each step and dealt out once: no joins, no groups, no table of spans in one task."""
    rows = [(1, 5, 2, True, "a"), (1, 8, 9, True, "b"), (1, 9, 1, True, "c"), (1, 20, 1, False, "d"), (1, 22, 1, False, "e"), (None, 0, 3, True, "f"), (None, 3, 1, True, "g")]
    docs = spark.createDataFrame(rows, "d long, start long, len long, m boolean, c string")
    merged = spans.merge_runs(docs, "d", "m", "start", "c")
    assert sorted(map(tuple, merged.collect()), key=str) == [(1, 1, 5, 12, 3, "a"), (1, 2, 20, 1, 1, "d"), (1, 3, 22, 1, 1, "e"), (None, 1, 0, 4, 2, "f")]
    filled = spans.fill_gaps(merged.withColumn("n", F.lit(30)), "d", "n", "c")
    found = sorted(map(tuple, filled.collect()), key=str)
    one = [(1, 0, 5, True, None), (1, 17, 3, True, None), (1, 20, 1, False, "d"), (1, 21, 1, True, None), (1, 22, 1, False, "e"), (1, 23, 7, True, None), (1, 5, 12, False, "a")]
    assert found == [*one, (None, 0, 4, False, "f"), (None, 4, 26, True, None)]
    plan = filled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_references_of_a_page_move_once(spark):
    refs = spark.createDataFrame([("s", 8, "a", "f", 1, 3, 4), ("s", 8, None, "f", 1, 0, 1), (None, 8, "a", "f", 1, 0, 1)], "to_symbol_id string, kind int, from_assembly string, from_path string, line int, col_start int, col_end int")
    page = references.page(refs)
    assert [(r["n"], r["assembly_n"], r["kind_n"]) for r in page.collect()] == [(1, 1, 1)]
    plan = page._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_records_across_parts_of_a_file(spark, tmp_path):
    """Records are put together where they are read, also those that the bounds of parts cut; a rest is left out."""
    rows = [(f"project {k}" + "x" * (k % 23), f"out {k}", "" if k % 3 else f"/out:{k}") for k in range(300)]
    for name, some in (("a", rows[:200]), ("b", rows[200:])):
        (tmp_path / f"{name}.txt").write_text("".join("\n".join(r) + "\n" for r in some) + "rest\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    try:
        read = readers.invocations(spark, str(tmp_path))
        assert sorted(map(tuple, read.collect())) == sorted(rows)
        assert read.rdd.getNumPartitions() > 10
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "MapInArrow" in plan and "BroadcastHashJoin" in plan


def test_records_are_stored_compressed(spark):
    from codeatlas.catalogs import files

    path = files._write(spark.range(3).select(F.col("id").cast("string").alias("value")), "records", "gzip")
    names = [f for f in os.listdir(path.removeprefix("file://")) if f.startswith("part-")]
    assert names and all(f.endswith(".txt.gz") for f in names)
