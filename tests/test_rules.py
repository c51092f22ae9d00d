"""Rules of single values, each against the answers that are asked of it."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas import catalog
from codeatlas.functions import text
from codeatlas.operators import extract, selection


def answers(spark, values, rule):
    rows = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], ["k", *"abcdefg"[: len(values[0]) if isinstance(values[0], tuple) else 1]])
    return [r["x"] for r in rows.select("k", rule(rows).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "rule, known",
    [
        (extract.style, {"keyword": "k", "class name": "t", "punctuation": None, "string - verbatim": "s", "xml literal - name": "xln", "new thing": "unknownClassification"}),
        (extract.script_style, {"keyword": "k", "interface name": "t", "identifier": None, "comment": "c"}),
        (extract.xml_style, {"attribute name": "xan", "name": "xn", "text": None, "delimiter": "xd"}),
        (extract.script_glyph, {"enum": 18, "method": 72, "other": 195, "module": 150}),
        (text.declares_well, {"name": True, "name;": False, "name\n": False, "na": False}),
        (selection.excluded, {"": True, "/a/b/ref": True, "b/stubs": True, "/cycle-breakers/b": True, "/ref/b": False, "b/reference": False}),
    ],
)
def test_of_one_value(spark, rule, known):
    assert answers(spark, list(known), lambda d: rule(d["a"])) == list(known.values())


def test_empty_arrays(spark):
    code = ["a = new int[0]; b = new string[] { };", "f(new[] {})", "c = new int[1]; d = new[] { 1 };"]
    assert answers(spark, code, lambda d: F.array_join(text.empty_array_allocations(d["a"]), "|")) == ["new int[0]|new string[] { }", "new[] {}", ""]


def test_test_projects(spark):
    names = ["xUnit.core", "Quality.UnitTestFramework", "Newtonsoft.Json"]
    assert answers(spark, names, lambda d: selection.is_test_project(F.array(F.lit("x"), d["a"]))) == [True, True, False]


def test_reference_kinds(spark):
    """A base class, an interface of an interface, one of a class, one outside of a base list, a write, and a read."""
    cases = [(True, "class", "class", "type", False), (True, "interface", "interface", "type", False), (True, "interface", "class", "type", False), (False, "class", "class", "type", False), (False, "class", "class", "field", True), (False, "class", "class", "property", False)]
    rule = lambda d: extract.reference_kind(d["a"], d["b"], d["c"], F.lit(True), d["d"], d["e"])
    assert answers(spark, cases, rule) == [0, 1, 2, 8, 6, 8]


def test_eligible(spark):
    cases = [("method", "n"), ("local", "n"), ("typeparameter", "n"), ("method", ".ctor"), ("method", ".cctor")]
    assert answers(spark, cases, lambda d: extract.eligible(d["a"], d["b"])) == [True] + [False] * 4


def test_links(spark):
    def rule(d):
        k = d["a"]
        return extract.link(k < 2, k == 0, F.when(k >= 4, F.lit("t")), k == 4, F.when(k == 5, 0), F.when(k == 2, F.lit("g")), k == 3)

    assert answers(spark, list(range(7)), rule) == ["partial", "declaration", "guid", "empty_array", "reference", "federated", None]


def test_lines_as_columns(spark):
    r = random.Random(1)
    texts = ["", "\n", "a\r\n", "\r\r\n\n", *("".join(r.choice("ab\r\né") for _ in range(r.randrange(12))) for _ in range(200))]
    cases = [(t, r.randrange(14)) for t in texts]
    found = answers(spark, cases, lambda d: F.struct(text.any_line_lengths(d["a"]).alias("l"), text.line_at(text.any_line_lengths(d["a"]), d["b"]).alias("n")))
    expected = [(text.line_lengths(t), text.line_of(text.line_lengths(t), at)[0]) for t, at in cases]
    assert [(x["l"], x["n"]) for x in found] == expected


def test_server_options_as_columns(spark):
    r = random.Random(2)
    values = ['"a=b"', '"a=1"="b=2"', 'a="b"', '""=b', "a", "=", "", *("".join(r.choice('ab="\n') for _ in range(r.randrange(10))) for _ in range(600))]
    found = answers(spark, values, lambda d: text.server_option(d["a"]))
    assert [tuple(x) if x else None for x in found] == [text.server_path(v) for v in values]


def test_targets_are_counted_where_they_are_joined(spark):
    """References are dealt out by symbol in parts that stay apart, and counted there without copies of the rows."""
    plan = catalog.queries()["eligible_symbols"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("REPARTITION_BY_NUM") == 1
