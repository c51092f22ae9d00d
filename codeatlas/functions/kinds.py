"""Kinds of symbols and references, their ranks, labels and pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keywords, types among them, and reference kinds by display order.
KINDS = ("assembly", "type", "class", "struct", "interface", "enum", "delegate", "method", "property", "event", "field", "file", "MSBuildProperty", "MSBuildItem", "MSBuildTarget", "MSBuildTask")
TYPE_KINDS = ("class", "struct", "interface", "enum", "delegate")
LIST_KINDS = ("MSBuildProperty", "MSBuildItem", "MSBuildTarget", "MSBuildTask")
REFERENCE_KINDS = (
    "DerivedType", "InterfaceInheritance", "InterfaceImplementation", "Override", "InterfaceMemberImplementation",
    "Instantiation", "Write", "Read", "Reference", "GuidUsage", "EmptyArrayAllocation", "MSBuildPropertyAssignment",
    "MSBuildPropertyUsage", "MSBuildItemAssignment", "MSBuildItemUsage", "MSBuildTargetDeclaration", "MSBuildTargetUsage",
    "MSBuildTaskDeclaration", "MSBuildTaskUsage",
)
# Names that stand for nothing when a symbol's name is sought among its references.
NAMELESS = ("this", "base", "var", "UsingTask", "[")
# Assemblies that hold name lists instead of code.
PSEUDO_ASSEMBLIES = ("MSBuildProperties", "MSBuildItems", "MSBuildTargets", "MSBuildTasks", "GuidAssembly")
# Picture groups by kind (first, last) and single pictures.
GLYPH_RANGES = {"class": [(0, 5)], "field": [(6, 11), (24, 24), (42, 47)], "delegate": [(12, 17)], "enum": [(18, 23)], "event": [(30, 35)], "interface": [(48, 53)], "method": [(72, 83), (220, 221), (224, 224)], "property": [(102, 107)], "struct": [(108, 113)], "file": [(195, 196), (227, 228)]}
FILE_GLYPHS = {".cs": 196, ".vb": 195, ".ts": 228}
OTHER_FILE_GLYPH = 227


def kind_rank(kind: Column) -> Column:
    return F.when(kind.isin(*TYPE_KINDS), 1).when(kind == "field", 3).when(kind == "file", 4).otherwise(2)


def is_type(kind: Column) -> Column:
    return kind.isin(*TYPE_KINDS)


def glyph_kind(glyph: Column) -> Column:
    out = None
    for kind, ranges in GLYPH_RANGES.items():
        for low, high in ranges:
            hit = glyph.between(low, high)
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("symbol")


def file_glyph(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^.\\/]*)$", 1))
    out = F.lit(OTHER_FILE_GLYPH)
    for ext, glyph in FILE_GLYPHS.items():
        out = F.when(extension == ext, glyph).otherwise(out)
    return out


def match_level(name: Column, name_fold: Column, term: str, term_fold: str) -> Column:
    """1 equal, 2 equal but for case, 3 prefix, 4 prefix but for case, 5 inside, 7 otherwise."""
    return (
        F.when(name == term, 1).when(name_fold == term_fold, 2).when(name.startswith(term), 3)
        .when(name_fold.startswith(term_fold), 4).when(name_fold.contains(term_fold), 5).otherwise(7)
    )


def weight(level: Column, rank: Column) -> Column:
    return level * 10 + rank


def reference_label(kind: Column) -> Column:
    """The name of a reference kind from its ordinal."""
    return F.element_at(F.array(*map(F.lit, REFERENCE_KINDS)), kind + 1)


def reference_header(kind: Column, n: Column) -> Column:
    """What heads a block of references: the count, the kind in words, a plural where due."""
    words = F.lower(F.regexp_replace(reference_label(kind), r"(?<=[a-z])(?=[A-Z])", " "))
    plain = F.regexp_replace(words, "^msbuild", "MSBuild ")
    ending = F.when(plain.rlike("[sxz]$"), "es").otherwise("s")
    return F.concat(n.cast("string"), F.lit(" "), F.trim(F.regexp_replace(plain, " +", " ")), F.when(n == 1, "").otherwise(ending))
