"""From tokens to reference rows: classes, eligibility, kinds, links and lines.

Semantic facts (what a token refers to, what a type derives from) come as columns of
the input; the rules on top of them are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_span, html_escape

# Token classes that are not marked up, and the style of each that is, by style.
PLAIN_CLASSES = ("operator", "operator - overloaded", "number", "punctuation", "preprocessor text", "xml literal - text")
STYLES = {
    "k": ("keyword", "keyword - control"),
    "i": ("identifier", "field name", "enum member name", "constant name", "local name", "parameter name", "method name", "extension method name", "property name", "event name", "namespace name", "label name"),
    "t": ("class name", "struct name", "interface name", "enum name", "delegate name", "record name", "record class name", "record struct name", "module name", "type parameter name"),
    "k preprocess": ("preprocessor keyword",),
    "c": ("comment", "xml literal - comment", "xml doc comment - delimiter", "xml doc comment - name", "xml doc comment - text", "xml doc comment - comment", "xml doc comment - entity reference", "xml doc comment - attribute name", "xml doc comment - attribute quotes", "xml doc comment - attribute value", "xml doc comment - cdata section"),
    "xld": ("xml literal - delimiter",), "xln": ("xml literal - name",), "xlan": ("xml literal - attribute name",), "xlaq": ("xml literal - attribute quotes",), "xlav": ("xml literal - attribute value",),
    "xler": ("xml literal - entity reference",), "xlcs": ("xml literal - cdata section",), "xlpi": ("xml literal - processing instruction",), "xlee": ("xml literal - embedded expression",),
    "s": ("string", "string - verbatim"),
    "e": ("excluded code",),
}
UNKNOWN_STYLE = "unknownClassification"
# Styles of script and of XML classes, and pictures of script declarations.
SCRIPT_STYLES = {"k": ("keyword",), "c": ("comment",), "s": ("string",), "t": ("class name", "enum name", "interface name", "type alias name", "type parameter name", "module name")}
XML_STYLES = {"xan": ("attribute name",), "xav": ("attribute value",), "xcs": ("cdata section",), "c": ("comment",), "xd": ("delimiter",), "xer": ("entity reference",), "xn": ("name",), "xpi": ("processing instruction",)}
SCRIPT_GLYPHS = {"variable": 42, "function": 72, "parameter": 42, "interface": 48, "property": 102, "method": 72, "type parameter": 114, "module": 150, "class": 0, "constructor": 72, "enum": 18, "enum member": 24, "import": 6, "get accessor": 72, "set accessor": 72}
OTHER_SCRIPT_GLYPH = 195


def _styled(cls: Column, styles: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(cls.isin(*names), style) for style, names in styles.items()))


def style(cls: Column) -> Column:
    """The style of a token class; null where it is left plain."""
    return F.when(~cls.isin(*PLAIN_CLASSES), F.coalesce(_styled(cls, STYLES), F.lit(UNKNOWN_STYLE)))


def script_style(cls: Column) -> Column:
    return _styled(cls, SCRIPT_STYLES)


def xml_style(cls: Column) -> Column:
    return _styled(cls, XML_STYLES)


def script_glyph(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, g) for k, g in SCRIPT_GLYPHS.items()), F.lit(OTHER_SCRIPT_GLYPH))


def eligible(kind: Column, name: Column) -> Column:
    """Symbols that the index holds: nothing local, no constructors."""
    return ~kind.isin("local", "parameter", "typeparameter") & ~name.isin(".ctor", ".cctor")


def reference_kind(in_base_list: Column, base: Column, derived: Column, is_base: Column, target: Column, written: Column) -> Column:
    """The ordinal of a reference: what it does in a base list, a write to a field or property, or plain.

    ``base`` and ``derived`` are type kinds, ``is_base`` whether the target is a base
    class or interface of the type whose list it stands in.
    """
    inherits = F.when(base == "class", 0).when((base == "interface") & (derived == "interface"), 1).when(base == "interface", 2)
    return F.when(target.isin("field", "property") & written, 6).otherwise(F.coalesce(F.when(in_base_list & is_base, inherits), F.lit(8)))


def named_references(refs: DataFrame) -> DataFrame:
    """Without ``this`` and ``base`` standing for a type; constructors get their type's name before their own."""
    kept = refs.filter(~(F.col("to_name").isin("this", "base") & (F.col("to_kind") == "type")))
    return kept.withColumn("to_name", F.when(F.col("to_name") == ".ctor", F.concat("to_type", F.lit(" .ctor"))).otherwise(F.col("to_name")))


def link(declares: Column, partial: Column, target: Column, here: Column, federated: Column, guid: Column, empty_array: Column) -> Column:
    """What a token links to, the first that holds."""
    return (
        F.when(declares & partial, "partial").when(declares, "declaration").when(guid.isNotNull(), "guid").when(empty_array, "empty_array")
        .when(target.isNotNull() & here, "reference").when(target.isNotNull() & federated.isNotNull(), "federated")
    )


def reference_url(from_assembly: Column, to_assembly: Column, page: Column, line: Column) -> Column:
    """A page as seen from a symbol's reference page: two folders up, and over where the assembly differs."""
    near = F.concat(F.lit("../"), page)
    return F.concat(F.when(from_assembly == to_assembly, near).otherwise(F.concat(F.lit("../../"), from_assembly, F.lit("/"), page)), F.lit("#"), line.cast("string"))


def lines_of_spans(spans: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Spans with the line they start in: an equi-join on blocks of offsets, then the one line that holds them.

    Offsets are cut into blocks; a line meets the blocks that it covers.
    """
    block = 4096
    covers = F.sequence(F.floor(F.col("line_start") / block), F.floor((F.col("line_start") + F.length("line_text")) / block))
    blocks = lines.select(doc, "line", F.col("start").alias("line_start"), "line_text").withColumn("block", F.explode(covers))
    hit = spans.withColumn("block", F.floor(F.col("start") / block)).join(blocks, [doc, "block"])
    return hit.filter((F.col("start") >= F.col("line_start")) & (F.col("start") <= F.col("line_start") + F.length("line_text"))).drop("block")


def reference_rows(spans: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Tokens (start, len) with line number, escaped line text and the columns of the token in it."""
    rows = lines_of_spans(spans, lines, doc)
    at = F.col("start") - F.col("line_start")
    html, start, end = escape_span(F.col("line_text"), at, at + F.col("len"))
    return rows.select(*spans.columns, (F.col("line") + 1).alias("line"), html.alias("line_html"), start.cast("int").alias("col_start"), end.cast("int").alias("col_end"))


def document_html(spans: DataFrame, doc: str) -> DataFrame:
    """Pages of spans that cover a text (start, text, style, href), bounded by the document."""
    inner = html_escape(F.col("text"))
    styled = F.when(F.col("style").isNotNull(), F.concat(F.lit('<span class="'), "style", F.lit('">'), inner, F.lit("</span>"))).otherwise(inner)
    linked = F.when(F.col("href").isNotNull(), F.concat(F.lit('<a href="'), "href", F.lit('">'), styled, F.lit("</a>"))).otherwise(styled)
    ordered = F.sort_array(F.collect_list(F.struct("start", linked.alias("html"))))
    return spans.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s["html"]), "").alias("html"))


def implementations(interface_members: DataFrame, type_members: DataFrame, implements: DataFrame) -> DataFrame:
    """Members of types that implement members of their interfaces: equal signatures."""
    own = type_members.select("type_id", F.col("member_id").alias("implementation"), "signature")
    asked = interface_members.select(F.col("type_id").alias("interface_id"), F.col("member_id").alias("interface_member"), "signature")
    return implements.join(asked, "interface_id").join(own, ["type_id", "signature"]).select("type_id", "interface_id", "interface_member", "implementation")
