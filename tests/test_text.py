"""Scalar text functions against worked cases."""

import pytest
from pyspark.sql import functions as F

from codeatlas.functions import folding, ids, kinds, text
from codeatlas.functions.plugins import Registry
from codeatlas.catalogs import texts
from codeatlas.operators import msbuild, spans
from codeatlas.operators.msbuild import references_in
from codeatlas.runtime import task_count

# Cases that must come out so.
SPLIT = {
    "$(a()) ": ["$(a())", " "], " $(a())": [" ", "$(a())"], "@a)": ["@a)"], "@(a())": ["@(a())"], "@(a()) ": ["@(a())", " "], " @(a())": [" ", "@(a())"], " @(a()) ": [" ", "@(a())", " "],
    "a@(b)c": ["a", "@(b)", "c"], "a@()c": ["a", "@()", "c"], "a@(b)c@(d)e": ["a", "@(b)", "c", "@(d)", "e"], "a@(b)c$(d)e": ["a", "@(b)", "c", "$(d)", "e"], "a$(b)c@(d)e": ["a", "$(b)", "c", "@(d)", "e"],
    "@(a)@(b)c": ["@(a)", "@(b)", "c"], "$(a)@(b)c": ["$(a)", "@(b)", "c"],
    "": [], "a": ["a"], "$(a)": ["$(a)"], "$(a": ["$(a"], "$a)": ["$a)"], "(a)": ["(a)"], "$(a())": ["$(a())"], " $(a()) ": [" ", "$(a())", " "],
    "a$(b)c": ["a", "$(b)", "c"], "a$()c": ["a", "$()", "c"], "a$(b)c$(d)e": ["a", "$(b)", "c", "$(d)", "e"], "a$(b$(c))": ["a", "$(b", "$(c)", ")"],
    "$(a)$(b)c": ["$(a)", "$(b)", "c"], "@(a)": ["@(a)"], "@(a": ["@(a"], "a@(b@(c))": ["a", "@(b", "@(c)", ")"], "@(a)$(b)c": ["@(a)", "$(b)", "c"],
    "@(a->b)": ["@(a-", ">b)"], "@(a-&gt;b)": ["@(a-", "&gt;b)"], "@(a,b)": ["@(a,", "b)"], "$(a.b)": ["$(a.b)"], " @(a->b) ": [" ", "@(a-", ">b) "],
}


@pytest.mark.parametrize("whole,parts", SPLIT.items())
def test_split_expressions(whole, parts):
    assert text.split_expressions(whole) == parts


# Cases that must come out so.
OFFSETS = [
    ("asbe", 1, 3, "asbe", 1, 3), ("a'be", 1, 3, "a&#39;be", 1, 7), ("'be", 0, 2, "&#39;be", 0, 6), ("'b'", 0, 3, "&#39;b&#39;", 0, 11),
    ("a'b'c", 1, 4, "a&#39;b&#39;c", 1, 12), ("a'b'c", 0, 4, "a&#39;b&#39;c", 0, 12), ("<b>a", 3, 4, "&lt;b&gt;a", 9, 10), ("a<b>", 1, 4, "a&lt;b&gt;", 1, 10),
    ("a<b>", 0, 1, "a&lt;b&gt;", 0, 1), ("<b>a", 0, 3, "&lt;b&gt;a", 0, 9), ("<a>", 0, 3, "&lt;a&gt;", 0, 9), ("<a>", 1, 2, "&lt;a&gt;", 4, 5),
    ("<a>", 0, 2, "&lt;a&gt;", 0, 5), ("<a>", 1, 3, "&lt;a&gt;", 4, 9), ("<'>>", 0, 4, "&lt;&#39;&gt;&gt;", 0, 17), ("<'>>", 2, 4, "&lt;&#39;&gt;&gt;", 9, 17),
    ("<'>>", 3, 4, "&lt;&#39;&gt;&gt;", 13, 17), ("<'>>", 1, 3, "&lt;&#39;&gt;&gt;", 4, 13),
]


@pytest.mark.parametrize("line,start,end,escaped,a,b", OFFSETS)
def test_escape_with_offsets(line, start, end, escaped, a, b):
    assert text.escape_with_offsets(line, start, end) == (escaped, a, b)


def test_escape_span_as_columns(spark):
    """The column form gives what the plain one does, also for spans beyond the text and lines with outer spaces."""
    cases = [(t, a, b) for t, a, b, *_ in OFFSETS] + [("  a<b> ", 2, 5), ("  <b>", -1, 9), ("a&b  ", 0, 5), ("", 0, 0)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, a int, b int")
    html, start, end = text.escape_span(F.col("t"), F.col("a"), F.col("b"))
    rows = df.select("k", html, start, end).orderBy("k").collect()
    assert [tuple(r)[1:] for r in rows] == [text.escape_with_offsets(*c) for c in cases]


def test_in_cone():
    cone = lambda p: text.in_cone("c:\\src\\p", p)
    assert cone("c:\\SRC\\p\\a.cs") == "c:\\SRC\\p\\a.cs" and cone("a.cs") == "c:\\src\\p\\a.cs" and cone("..\\q\\a.cs") == "c:\\src\\p\\q\\a.cs"
    assert cone("d:\\x\\a.cs") == "c:\\src\\p\\d\\x\\a.cs" and cone(".\\b\\..\\a.cs") == "c:\\src\\p\\a.cs"


LINES = {"": [], "a": [1], "\r": [1, 0], "\r\r": [1, 1, 0], "\n": [1, 0], "\n\n": [1, 1, 0], "\n\r": [1, 1, 0], "\r\n": [2, 0], "\r\n\r": [2, 1, 0], "a\r\nb\r\nc": [3, 3, 1]}


@pytest.mark.parametrize("whole,lengths", LINES.items())
def test_line_lengths(whole, lengths):
    assert text.line_lengths(whole) == lengths


def test_line_of():
    assert text.line_of([3, 3, 1], 4) == (1, 3) and text.line_of([3, 3, 1], 99) == (0, 0)


SEMICOLONS = {"": [], "a": ["a"], " a": [" ", "a"], "a;": ["a", ";"], ";;": [";", ";"], "a; b": ["a", ";", " ", "b"], "a;\r\nb;": ["a", ";", "\r\n", "b", ";"]}


def test_semicolons(spark):
    rows = spark.createDataFrame([(k,) for k in SEMICOLONS], "t string").select("t", text.semicolon_tokens(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in rows} == SEMICOLONS


# Cases that must come out so.
RELATIVE = [
    (r"c:\root\abcd\e\f\g.txt", r"c:\root\abc\h\i.txt", r"..\..\abcd\e\f\g.txt"), (r"c:\root\1.txt", r"c:\root\2.txt", "1.txt"),
    (r"c:\root\a\1.txt", r"c:\root\2.txt", r"a\1.txt"), (r"c:\1.txt", r"c:\root\2.txt", r"..\1.txt"), (r"c:\solution\project\R\1.html", r"c:\solution\project\document.txt", r"R\1.html"),
    (r"c:\solution\assembly\A.html", r"c:\solution\project\a\document.txt", r"..\..\assembly\A.html"), (r"c:\solution", r"c:\solution\project\a\document.txt", "..\\..\\"),
    ("c:\\solution\\", r"c:\solution\project\a\document.txt", "..\\..\\"), ("c:\\solution\\", r"c:\solution", "solution\\"), (r"c:\solution", r"c:\solution", "solution"),
    (r"c:\solution", "c:\\solution\\", ""), ("c:\\solution\\", "c:\\solution\\", ""), (r"d:\x\y.txt", r"c:\a\b.txt", "y.txt"),
]


@pytest.mark.parametrize("path,base,expected", RELATIVE)
def test_relative_to_file(path, base, expected):
    assert text.relative_to_file(path, base) == expected


@pytest.mark.parametrize("path,base,expected", [(r"c:\root\1.txt", "c:\\root\\", "1.txt"), (r"c:\root\a\1.txt", r"c:\root", r"a\1.txt"), (r"c:\root\1.txt", "c:\\root\\a\\", r"..\1.txt")])
def test_relative_to_folder(path, base, expected):
    assert text.relative_to_folder(path, base) == expected


SERVER = [('"a=1"="b=2"', ("a=1", "b=2")), ('"a=1"=b', ("a=1", "b")), ('a="b=2"', ("a", "b=2")), ("a=b", ("a", "b")), ('"a 1=b 2"', ("a 1", "b 2")), ("a", None), ("a=b=2", None)]


@pytest.mark.parametrize("argument,expected", SERVER)
def test_server_path(argument, expected):
    assert text.server_path(argument) == expected


def test_ids(spark):
    row = spark.range(1).select(ids.symbol_id(F.lit("T:System.Console")).alias("i")).withColumn("d", ids.id_to_decimal(F.col("i"))).withColumn("b", ids.decimal_to_id(F.col("d"))).first()
    assert row["i"] == row["b"] and int(row["d"]) == int.from_bytes(bytes.fromhex(row["i"]), "little")
    for n in (0, 127, 128, 300, 2**31 - 1):
        assert ids.varint_decode(ids.varint_encode(n)) == (n, len(ids.varint_encode(n)))


def test_folding(spark):
    assert folding.fold_text("straße_ıx") == "STRAßE_ıX"
    assert spark.range(1).select(folding.fold(F.lit("äöß_z"))).first()[0] == "ÄÖß_Z"


def test_kinds(spark):
    rows = spark.createDataFrame([(g,) for g in (3, 14, 24, 48, 80, 105, 110, 196, 999)], "g int").select(kinds.glyph_kind(F.col("g"))).collect()
    assert [r[0] for r in rows] == ["class", "delegate", "field", "interface", "method", "property", "struct", "file", "symbol"]
    assert spark.range(1).select(kinds.file_glyph(F.lit("a\\b.CS"))).first()[0] == 196


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.html_escape(F.lit("<a b='\"'>&"))) == "&lt;a b=&#39;&quot;&#39;&gt;&amp;"
    assert one(text.escape_field(F.lit("a;b\r\nc"))) == "a:b  c"
    assert one(text.strip_quotes(F.lit('"\'a\'"'))) == "a"
    assert one(text.property_name(F.lit("Name.Length"))) == "Name" and one(text.property_name(F.lit("$(x"))) is None
    assert one(text.thousands(F.lit(1234567))) == "1,234,567"
    assert one(text.depth_to_root(F.lit("a/b/c.cs"))) == "../../"
    assert one(text.page_path(F.lit("c:\\my dir\\bin\\x"))) == "c\\mydir\\bin_\\x"
    assert one(text.namespace_of(F.lit("A.B.C(x.y)"))) == "A.B" and one(text.namespace_of(F.lit("C"))) == ""
    assert one(text.trim_compiler(F.lit('"C:\\x y\\csc.exe" /out:a b.cs'))) == "/out:a b.cs"
    assert one(text.resolve_link(F.lit("@1@asm/A.html#id"), ["s0/", "s1/"])) == "s1/asm/A.html#id"
    assert one(text.empty_array_allocations(F.lit("x = new int[0]; y = new[] { }; z = new int[1]"))) == ["new int[0]", "new[] { }"]
    assert one(text.assembly_name(F.lit("<AssemblyName>$(RootNamespace)</AssemblyName><RootNamespace>R</RootNamespace>"), F.lit("a\\p.csproj"))) == "R"
    assert one(text.assembly_name(F.lit("<Project/>"), F.lit("a\\p.x.csproj"))) == "p.x"
    g = "0f8fad5b-d9cb-469f-a165-70867728950e"
    assert one(text.guid_literals(F.lit(f'a("{g}", @"{{{g.upper()}}}", "{g.replace("-", "")}", "no")'))) == [g] * 3
    assert text.url_encode("a b{ü}") == "a+b%7b%u00fc%7d"


def test_build_references():
    xml = """<Project>
<PropertyGroup><A>$(B)</A><XDependsOn> U ;V$(W)</XDependsOn></PropertyGroup><ItemGroup><C Include="@(D)"/><Compile/><Reference Include="$( E )"/></ItemGroup>
<!-- <Target Name="no"/> --><Target Name="T" DependsOnTargets="U;V"><Copy><Output ItemName="I" PropertyName="%(x)"/></Copy><ItemGroup/></Target>
<UsingTask TaskName="x.W" AssemblyName="L, Version=1"/><CallTarget Targets="Q"/><Import Project="p.props"/></Project>"""
    found = list(references_in(xml))
    assert all(xml[s : s + n] == name or kind in ("MSBuildTaskDeclaration", "Import") for kind, name, _, s, n in found)
    assert [(k.removeprefix("MSBuild"), n) for k, n, *_ in found] == [
        ("PropertyAssignment", "A"), ("PropertyUsage", "B"), ("PropertyAssignment", "XDependsOn"), ("TargetUsage", "U"), ("TargetUsage", "V"), ("PropertyUsage", "W"),
        ("ItemAssignment", "C"), ("ItemUsage", "D"), ("PropertyUsage", "E"), ("TargetDeclaration", "T"), ("TargetUsage", "U"), ("TargetUsage", "V"), ("TaskUsage", "Copy"),
        ("ItemAssignment", "I"), ("TaskDeclaration", "W"), ("Instantiation", "x.W"), ("TargetUsage", "Q"), ("Import", "p.props"),
    ]


def test_broken_build_files():
    kinds = lambda xml: [(k, n if k != "Unreadable" else "") for k, n, *_ in references_in(xml)]
    assert kinds("<broken") == [("Unreadable", "")] and kinds("") == [] and kinds("a < b") == [("Unreadable", "")]
    assert kinds('<PropertyGroup><A x="$(B)<C>$(D)</A>') == [("Unreadable", ""), ("MSBuildPropertyAssignment", "A"), ("MSBuildPropertyUsage", "B"), ("MSBuildPropertyUsage", "D")]
    assert kinds("<P></Q><PropertyGroup><A/></PropertyGroup></P>") == [("Unreadable", ""), ("MSBuildPropertyAssignment", "A")]
    deep = "<a>" * 5_000 + "<PropertyGroup><Z/></PropertyGroup>" + "</a>" * 5_000
    assert kinds(deep) == [("MSBuildPropertyAssignment", "Z")]
    assert kinds("<![CDATA[<PropertyGroup><A/>]]><?x <PropertyGroup><A/> ?>") == []


def test_build_files_are_scanned_by_many_tasks(spark):
    """A small table of parts is one part of a file, whose files one task would scan."""
    found = msbuild.build_references(texts._build_files(spark, "/root/testdata/sf0.001"))
    assert found.rdd.getNumPartitions() == task_count(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_reference_rows_in_one_scan(spark):
    """Each file has its own rows, also beside one of its path; a line has no break, and the CR before it is a space."""
    xml = '<PropertyGroup>\r\n  <A>$(B)</A>\r\n\t<C/></PropertyGroup>\r'
    files = spark.createDataFrame([("p", xml), ("p", "<ItemGroup><I/></ItemGroup>"), ("q", None)], "path string, text string")
    rows = msbuild.reference_rows(files)
    found = sorted((r["name"], r["line"], r["line_html"], r["col_start"], r["col_end"]) for r in rows.collect())
    a = "&lt;A&gt;$(B)&lt;/A&gt;"
    assert found == [("A", 2, a, 4, 5), ("B", 2, a, 11, 12), ("C", 3, "\t&lt;C/&gt;&lt;/PropertyGroup&gt;\r", 5, 6), ("I", 1, "&lt;ItemGroup&gt;&lt;I/&gt;&lt;/ItemGroup&gt;", 21, 22)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_plugins(spark):
    registry = Registry(blacklist=("barred",), settings={"loud": {"mark": "!"}})
    assert registry.add("loud", lambda s: {"text": lambda t, p, n: s["mark"] * n, "symbols": {"class": lambda n: n.upper()}})
    assert registry.add("fails", lambda s: {"text": lambda t, p, n: 1 / 0})
    assert not registry.add("barred", lambda s: {}) and not registry.add("broken", lambda s: s["none"])
    lines = spark.createDataFrame([("x", "p", 2)], "line_text string, path string, line int")
    assert registry.visit_lines(lines).first()["marks"] == "!!"
    found = registry.visit_symbols(spark.createDataFrame([("class", "a"), ("enum", "b")], "kind string, name string")).collect()
    assert {r["name"]: r["marks"] for r in found} == {"a": "A", "b": ""}
