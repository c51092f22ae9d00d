"""References in build files: properties, items, targets and tasks, declared or used, with their places.

Each file is scanned once, by a scanner that keeps places and survives broken files, and every
name that counts gives a row: its kind, the list it belongs to, where it starts in the file,
its line (from 1) and its columns there.  ``reference_rows`` puts the escaped text of the line
beside it, as for the references of code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_span, split_expressions
from ..functions.xmltext import Element, Fault, Text, scan

SCHEMA = "path string, kind string, name string, to_assembly string, start long, len long, line int, col_start int, col_end int"
#: The kind of the row that says a file is not well-formed, at the first fault; the link of an import; a task's class.
UNREADABLE, IMPORT, INSTANTIATION = "Unreadable", "Import", "Instantiation"
# The lists in place of code that names belong to, by what they name.
LISTS = {"Property": "MSBuildProperties", "Item": "MSBuildItems", "Target": "MSBuildTargets", "Task": "MSBuildTasks"}
# Characters that make a name an expression, and those that no property name has.
_COMPLEX = re.compile(r"[$:\[\]]")
_NO_FILE = re.compile(r'[\x00-\x1f"<>|*?/\\:]')
_BREAK, _PART, _WORD = re.compile("\n"), re.compile(r"[^;]+"), re.compile(r"\S+")
# Rows and characters of lines that a task holds before it hands them on.
_BATCH_ROWS, _BATCH_CHARS = 8_192, 4_000_000

#: kind, name, assembly, start, length
Found = tuple[str, str, "str | None", int, int]


def _named(what: str, use: str, text: str, start: int, name: str | None = None) -> Iterator[Found]:
    """A name in a text around which there may be space."""
    body = text.strip()
    if not body or what in ("Property", "Item") and _COMPLEX.search(body) or what == "Property" and _NO_FILE.search(body):
        return
    yield f"MSBuild{what}{use}", name or body, LISTS[what], start + len(text) - len(text.lstrip()), len(body)


def _targets(text: str, start: int) -> Iterator[Found]:
    for part in _PART.finditer(text):
        for word in _WORD.finditer(part[0]):
            yield from _named("Target", "Usage", word[0], start + part.start() + word.start())


def _expressions(text: str, start: int, targets: bool = False) -> Iterator[Found]:
    """Properties and items that a text uses; what is between them is a list of targets or nothing."""
    if "(" not in text:
        if targets:
            yield from _targets(text, start)
        return
    for part in split_expressions(text):
        if part.startswith("$(") and part.endswith(")") and len(part) > 3:
            yield from _named("Property", "Usage", part[2:-1].partition(".")[0], start + 2)
        elif part.startswith("@(") and part[-1] in ")-," and "%" not in part and len(part) > 3:
            yield from _named("Item", "Usage", part[2:-1], start + 2)
        elif targets:
            yield from _targets(part, start)
        start += len(part)


def _element(e: Element) -> Iterator[Found]:
    task = e.attribute("TaskName") if e.name == "UsingTask" else None
    if task is not None:
        yield from _named("Task", "Declaration", e.name, e.start, task.rpartition(".")[2])
    elif e.within("PropertyGroup"):
        yield from _named("Property", "Assignment", e.name, e.start)
    elif e.within("ItemGroup") and e.name not in ("Compile", "Reference"):
        yield from _named("Item", "Assignment", e.name, e.start)
    elif e.within("Target") and e.name not in ("ItemGroup", "PropertyGroup"):
        yield from _named("Task", "Usage", e.name, e.start)
    for name, name_start, value, start in e.attributes:
        if e.name == "Import" and name == "Project":
            yield IMPORT, value, None, name_start, len(name)
        if e.name == "Output" and name in ("ItemName", "PropertyName") and "%" not in value:
            yield from _named(name.removesuffix("Name"), "Assignment", value, start)
        elif e.name == "Target" and name == "Name":
            yield from _named("Target", "Declaration", value, start)
        elif e.name == "Target" and name in ("DependsOnTargets", "BeforeTargets", "AfterTargets") or e.name == "CallTarget" and name == "Targets":
            yield from _expressions(value, start, targets=True)
        elif e.name == "UsingTask" and name == "TaskName" and (assembly := _task_assembly(e)):
            yield INSTANTIATION, value, assembly, start, len(value)
        else:
            yield from _expressions(value, start)


def _task_assembly(e: Element) -> str | None:
    """The assembly of a task: the name of its file, or its name without version.  Names that need an evaluation have none."""
    file, name = e.attribute("AssemblyFile") or "", e.attribute("AssemblyName") or ""
    found = re.split(r"[\\/]", file)[-1].rpartition(".")[0] or re.split(r"[\\/]", file)[-1] if file.strip() else name.partition(",")[0].strip()
    return found if found and "$(" not in found else None


def references_in(xml: str) -> Iterator[Found]:
    """What a build file declares and uses, in the order of the file; the first fault of a broken one where it is found."""
    broken = False
    for part in scan(xml):
        if isinstance(part, Fault):
            if not broken:
                yield UNREADABLE, part.message, None, part.start, 0
            broken = True
        elif isinstance(part, Text):
            e = part.parent
            yield from _expressions(part.text, part.start, e is not None and e.name.endswith("DependsOn") and e.within("PropertyGroup"))
        else:
            yield from _element(part)


def _scanned(files: DataFrame, path: str, text: str, with_line: bool = False) -> DataFrame:
    """The references of every file, on request with the text of their line, where the CR of its break is a space."""
    columns = [c.split() for c in SCHEMA.split(", ") + ["line_text string"] * with_line]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for p, t in zip(*(c.to_pylist() for c in b.columns)):
                t = t or ""
                starts = [0, *(m.end() for m in _BREAK.finditer(t)), len(t) + 1]
                for kind, name, assembly, start, n in references_in(t):
                    line = bisect_right(starts, start, hi=len(starts) - 1)
                    column = start - starts[line - 1]
                    found = (p, kind, name, assembly, start, n, line, column, column + n)
                    if with_line:
                        shown = t[starts[line - 1] : starts[line] - 1]
                        if shown.endswith("\r") and line < len(starts) - 1:
                            shown = shown[:-1] + " "
                        found, held = (*found, shown), held + len(shown)
                    out.append(found)
                    if len(out) >= _BATCH_ROWS or held >= _BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, ", ".join(map(" ".join, columns)))


def build_references(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, name, to_assembly, start, len, line, col_start, col_end) of every reference; a null text has none.

    Scanning costs far more than reading: files that come out of few parts of a small table are best dealt out first (``runtime.dealt``).
    """
    return _scanned(files, path, text)


def reference_rows(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The references that belong to a list or an assembly, with the escaped text of their line and their columns in that.

    The scan that finds a reference has its line at hand, so lines are neither numbered nor joined.
    """
    found = _scanned(files, path, text, with_line=True).filter("to_assembly is not null")
    html, start, end = escape_span(F.col("line_text"), F.col("col_start"), F.col("col_start") + F.col("len"))
    return found.select("path", "kind", "name", "to_assembly", "start", "len", "line", html.alias("line_html"), start.cast("int").alias("col_start"), end.cast("int").alias("col_end"))
