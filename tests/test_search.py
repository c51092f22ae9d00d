"""The search language: tokens, readings, filters, order."""

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import search
from codeatlas.plans import search as plan
from codeatlas.sources.testdata import searchable

# Cases that must come out so.
SPLITS = [
    ("  a", ["a"]), ("a ", ["a"]), ("a b", ["a", "b"]), ('a b ', ["a", "b"]), ('"a" b', ['"a"', "b"]),
    ("", []), (" ", []), ("  ", []), ('"', ['"']), ('""', ['""']), ('"""', ['""', '"']), ('" "', ['" "']), ('" " ', ['" "']),
    (' " "', ['" "']), ("a", ["a"]), ('a"', ["a", '"']), ('"a', ['"a']), (" a", ["a"]), ("a  ", ["a"]), ("a b c", ["a", "b", "c"]),
    ('a b "c"', ["a", "b", '"c"']), ('a b c"', ["a", "b", "c", '"']), ('a b "c', ["a", "b", '"c']), (" a b ", ["a", "b"]),
    ('"a b"', ['"a b"']), ('"a" "b"', ['"a"', '"b"']), ('"a "b"', ['"a "', "b", '"']), ('a "b"', ["a", '"b"']),
]


@pytest.mark.parametrize("text,parts", SPLITS)
def test_tokens(text, parts):
    assert plan.tokenize(text) == parts


# Two symbols, and queries that must find the first, must not, or must find the second.
COLOR = dict(assembly_name="mscorlib", project_path="ndp\\clr\\src\\mscorlib\\mscorlib.csproj", name="ConsoleColor", description="System.ConsoleColor", kind="class")
WHERE = dict(assembly_name="System.Core", project_path="ndp\\clr\\src\\bcl\\System.Core\\System.Core.csproj", name="Where", description="System.Linq.Enumerable.Where<T>(bla bla bla)", kind="method")
YES = [
    "System.get_ConsoleC", "Console mscor", "Console clr", "System.Con Color", "Cons class", "Conso class struct", "Console System.", "Console System.C",
    "Console System.Co", "System.Con", "System.Console", "System.ConsoleColor", "System.set_ConsoleColor", "System.add_Cons", "get_Console", "set_Con", "add_ConsoleColor",
]
NO = ["Console Core", "System.Con Back", "Console env\\Editor", "Consol struct", "Console System.Cor", "Console System.Core"]
YES_WHERE = ["Where System", "Where System.", "Where System.Core", "Enumerable.Where", "Linq.Enumerable.Where"]


@pytest.fixture(scope="module")
def one(spark):
    rows = [dict(r, assembly_number=k, symbol_id=f"{k:016x}") for k, r in enumerate((COLOR, WHERE))]
    return searchable(spark.createDataFrame(rows)).cache()


@pytest.mark.parametrize("text,expected", [(q, {"ConsoleColor"}) for q in YES] + [(q, set()) for q in NO] + [(q, {"Where"}) for q in YES_WHERE])
def test_matches(one, text, expected):
    found = {r["name"] for r in search.search_symbols(one, text).collect()}
    assert (found & {"ConsoleColor"} if text in YES + NO else found) == expected


def index(spark, rows):
    rows = [dict(name=n, description=d, assembly_name="a", project_path=None, kind="class", assembly_number=0, symbol_id=f"{k:016x}") for k, (n, d) in enumerate(rows)]
    schema = "name string, description string, assembly_name string, project_path string, kind string, assembly_number int, symbol_id string"
    return searchable(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize(
    "names,text,expected",
    [
        (["a"], "bbb", []), (["aaa"], "aaa", ["aaa"]), (["aaa", "bbb"], "bbb", ["bbb"]), (["aa", "aaa"], "aaa", ["aaa"]),
        (["aaa", "aaa"], "aaa", ["aaa", "aaa"]), (["aaa", "aba"], "aab", []), (["a", "b", "bin", "bin", "c"], "bin", ["bin", "bin"]),
        (["a", "bin", "binary"], "binary", ["binary"]), (["a"], '"b', []), (["a"], '"b"', []), (["a"], '"a "', []),
    ],
)
def test_names(spark, names, text, expected):
    assert [r["name"] for r in search.search_symbols(index(spark, [(n, n) for n in names]), text).collect()] == expected


def test_namespaces_and_order(spark):
    of = lambda rows, q: [r["description"] for r in search.search_symbols(index(spark, rows), q).collect()]
    assert of([("Console", "System.Console"), ("Console", "Foo.Console")], "System.Con") == ["System.Console"]
    assert of([("Console", "System.Console"), ("Console", "System.Foo.Console")], "System.Con") == ["System.Console"]
    assert of([("ConsoleSpecialKey", "System.ConsoleSpecialKey"), ("Console", "System.Console")], "System.Console") == ["System.Console", "System.ConsoleSpecialKey"]
    named = [("SourceNamedTypeSymbol", "C.SourceNamedTypeSymbol"), ("SourceNamespaceSymbol", "C.SourceNamespaceSymbol"), ("SourceFolder", "C.SourceFolder")]
    assert of(named, "Source Symbol") == ["C.SourceNamedTypeSymbol", "C.SourceNamespaceSymbol"]


def test_limit_before_rank_and_union(spark):
    many = index(spark, [(f"foo{k:03d}", "x") for k in range(150)] + [("Foo", "x")])
    assert search.search_symbols(many, "foo").count() == 100
    both = index(spark, [("get_foo", "get_foo"), ("foobar", "get_foo")])
    assert search.search_symbols(both, "get_foo").count() == 2


def test_router_and_links():
    assert plan.route(plan.parse("System assembly")) == ["assemblies"]
    assert plan.route(plan.parse("Copy MSBuildTask")) == ["tasks"]
    assert len(plan.route(plan.parse("Copy"))) == 8
    assert plan.parse("ab").note and plan.parse("x" * 261).note and not plan.parse("abc").note
    assert plan.deep_link("q=abc") == {"kind": "query", "args": ["abc"]}
    assert plan.deep_link("a/b.cs,12") == {"kind": "file", "path": "a/b.cs", "line": 12}
    q = plan.parse("a.b a.b class class")
    assert q.dotted == ["a.b"] and q.names == ["a.b"] and q.kinds == ["class", "class"]


def test_prefix_reaches_the_scan(spark, tmp_path):
    index(spark, [("Console", "x"), ("zeta", "y")]).write.parquet(str(tmp_path / "s"))
    found = search.search_symbols(spark.read.parquet(str(tmp_path / "s")), "cons")
    assert "StringStartsWith(name_fold,CONS)" in found._jdf.queryExecution().toString()


def test_router_results(spark):
    s = index(spark, [("Console", "System.Console")])
    a = spark.createDataFrame([(0, "System.Core", 0), (1, "NoProject", -1)], "assembly_number int, assembly_name string, project_key int")
    p = spark.createDataFrame([(0, "src\\core.csproj")], "project_key int, project_path string")
    guids = spark.createDataFrame([("0a0b",)], "name string")
    got = search.Index(s, a, p, {"guids": guids}).search("Console")
    assert got["symbols"].count() == 1 and got["assemblies"].count() == 0
    assert [r["assembly_name"] for r in search.Index(s, a, p).search("assembly")["assemblies"].collect()] == ["System.Core"]
    assert search.Index(s, a, p).search("src\\co")["projects"].select(F.col("assembly_name")).first()[0] == "System.Core"


def test_stored_lists_reach_the_scan(spark, tmp_path):
    from codeatlas.sources import sinks

    sinks.write_names(spark.createDataFrame([("Copy",), ("copy",), ("Csc",)], "n string"), "n", str(tmp_path / "n"))
    found = search.search_names(spark.read.parquet(str(tmp_path / "n")), "name", "cop")
    assert [r["name"] for r in found.collect()] == ["Copy", "copy"] and "StringStartsWith(name_fold,COP)" in found._jdf.queryExecution().toString()


def test_lookup_reads_only_what_it_asks_for(spark):
    """Ids are met before anything is grouped."""
    from codeatlas.functions.ids import symbol_id

    s = index(spark, [("Console", "x"), ("zeta", "y")]).withColumn("symbol_id", symbol_id(F.concat(F.lit("T:"), "name")))
    terms = spark.createDataFrame([("T:Console",), ("T:none",)], "term string")
    urls = search.symbol_urls(s, terms)
    plan_text = urls._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan_text and {r["term"]: r["url"] is not None for r in urls.collect()} == {"T:Console": True, "T:none": False}
