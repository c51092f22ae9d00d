"""The search language: text to interpretations to column conditions.

Parsing is plain Python, once a query; the plan that comes out is a union of filters
over the symbol table, one for each interpretation, which Catalyst takes from there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folding import fold_text
from ..functions.kinds import KINDS, TYPE_KINDS

# File extensions that make a dotted term a file name, and accessor prefixes.
FILE_EXTENSIONS = ("cs", "vb", "ts", "csproj", "vbproj", "targets", "props", "xaml", "xml", "resx")
ACCESSORS = ("get_", "set_", "add_", "remove_")
SHORTEST, LONGEST = 3, 260


def tokenize(text: str) -> list[str]:
    """Terms between spaces; quotes hold spaces together, a quote without a partner takes the rest."""
    return re.findall(r'"[^"]*"?|[^ "]+', text)


def strip_quotes(text: str) -> tuple[str, bool]:
    quoted = len(text) > 1 and text[0] == text[-1] == '"'
    return (text[1:-1], True) if quoted else (text, False)


@dataclass(frozen=True)
class Interpretation:
    """One reading of a query: names that begin with ``term`` and pass the rest."""

    term: str
    verbatim: bool = False
    namespace: str | None = None
    words: tuple[str, ...] = ()
    dotted: tuple[str, ...] = ()

    def readings(self) -> list[Interpretation]:
        """Itself, and for an accessor's name the member it belongs to."""
        for prefix in ACCESSORS:
            if self.term.startswith(prefix):
                namespace = None if self.namespace is None else self.namespace.replace(prefix, "")
                return [self, replace(self, term=self.term[len(prefix) :], namespace=namespace)]
        return [self]


@dataclass
class Query:
    text: str
    kinds: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    dotted: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    interpretations: list[Interpretation] = field(default_factory=list)

    @property
    def note(self) -> str | None:
        """Why the query cannot run, if so."""
        if len(self.text) < SHORTEST:
            return "Enter at least 3 characters."
        return "The query is too long." if len(self.text) > LONGEST else None


def parse(text: str) -> Query:
    q = Query(text)
    for term in tokenize(text):
        if term in KINDS:
            q.kinds.append(term)
        elif "\\" in term and term not in q.paths:
            q.paths.append(term)
        elif "." in term and term not in q.dotted:
            q.dotted.append(term)
        elif term not in q.names:
            q.names.append(term)
    bare = lambda terms, but: tuple(strip_quotes(t)[0] for t in terms if t != but)
    for name in q.names:
        if len(name) >= SHORTEST:
            core, verbatim = strip_quotes(name)
            q.interpretations += Interpretation(core, verbatim, None, bare(q.names, core), bare(q.dotted, None)).readings()
    for term in q.dotted:
        core, verbatim = strip_quotes(term)
        last = core.rsplit(".", 1)[-1]
        if any(e.startswith(last.lower()) for e in FILE_EXTENSIONS):
            q.interpretations.append(Interpretation(core, verbatim))
        else:
            q.interpretations += Interpretation(last, verbatim, core, bare(q.names, None), bare(q.dotted, core)).readings()
    return q


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _holds(column: str, text: str) -> Column:
    return F.coalesce(F.col(column).contains(fold_text(text)), F.lit(False))


def query_condition(q: Query) -> Column:
    """Kinds (any of them) and project paths (all of them)."""
    kinds = {k for kind in q.kinds for k in (TYPE_KINDS if kind == "type" else (kind,))}
    out = F.col("kind").isin(*sorted(kinds)) if kinds else F.lit(True)
    for path in q.paths:
        out = out & _holds("project_fold", path)
    return out


def range_condition(i: Interpretation) -> Column:
    """The access path: a prefix, or for a quoted term the whole name."""
    term = fold_text(i.term)
    return F.col("name_fold") == term if i.verbatim else F.col("name_fold").startswith(term)


def residual_condition(i: Interpretation) -> Column:
    out = F.lit(True)
    for word in i.words:
        out = out & _any([_holds(c, word) for c in ("name_fold", "assembly_fold", "project_fold")])
    by_assembly = _any([_holds("assembly_fold", d) for d in i.dotted]) if i.dotted else F.lit(True)
    if i.namespace is not None:
        return out & by_assembly & _holds("desc_fold", i.namespace)
    if i.dotted:
        out = out & (by_assembly | _any([_holds("desc_fold", d) for d in i.dotted]))
    return out


LISTS = {"MSBuildProperty": "properties", "MSBuildItem": "items", "MSBuildTarget": "targets", "MSBuildTask": "tasks"}


def route(q: Query) -> list[str]:
    """The searches a query runs: one list if it names its kind, otherwise all eight."""
    if "assembly" in q.kinds:
        return ["assemblies"]
    for kind, name in LISTS.items():
        if kind in q.kinds:
            return [name]
    return ["symbols", "assemblies", "projects", "guids", *LISTS.values()]


DEEP_LINKS = (
    ("list", re.compile(r"^(MSBuild(?:Property|Item|Target|Task))=(.*)$")),
    ("empty_arrays", re.compile(r"^EmptyArrayAllocation$")),
    ("query", re.compile(r"^q=(.*)$")),
)


def deep_link(fragment: str) -> dict:
    """What a link's fragment asks for: a list, a query, or a file with line, id and pane."""
    for kind, pattern in DEEP_LINKS:
        if found := pattern.match(fragment):
            return {"kind": kind, "args": list(found.groups())}
    path, *rest = fragment.split(",")
    out = {"kind": "file", "path": path}
    for part in rest:
        key = "line" if part.isdigit() else "id" if re.fullmatch("[0-9a-f]{16}", part) else "pane"
        out[key] = int(part) if key == "line" else part
    return out
