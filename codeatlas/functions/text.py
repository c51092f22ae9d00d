"""Scalar text functions, as columns where Spark has the parts and as Python where not.

Functions on plain values end up in Arrow batches through ``arrow``; their column
twins are preferred wherever one exists.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that HTML escapes, in the order in which they must be replaced.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
_ESCAPE_OF = dict(HTML_ESCAPES)


def arrow(function: Callable, returns: str) -> Callable[..., Column]:
    """A function of plain values as one of columns, run on Arrow batches; null in, null out."""

    def of(*columns: Column) -> Column:
        def batch(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*series)], dtype=object)

        def one(a: pd.Series) -> pd.Series:
            return batch(a)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return batch(a, b)

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return batch(a, b, c)

        chosen = (one, two, three)[len(columns) - 1]
        return F.pandas_udf(chosen, returns)(*columns)

    return of


def html_escape(c: Column) -> Column:
    for plain, escaped in HTML_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def escape_with_offsets(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A line without outer spaces, escaped, and a span of it moved along.

    An escape moves the bounds that lie behind the place it is written at, in terms
    of what is written so far; bounds that leading spaces would push below 0 go too.
    """
    body = text.lstrip(" ")
    cut = len(text) - len(body)
    start, end = (p - cut if p > -1 else p for p in (start, end))
    body = body.rstrip(" ")
    end = min(end, len(body))
    written: list[str] = []
    length = 0
    for ch in body:
        piece = _ESCAPE_OF.get(ch, ch)
        grown = len(piece) - 1
        if grown:
            start += grown * (start > length)
            end += grown * (end > length)
        written.append(piece)
        length += len(piece)
    return "".join(written), start, end


def escape_span(c: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """``escape_with_offsets`` as columns: each bound moves by what escaping adds to the text before it."""
    cut = F.length(c) - F.length(F.ltrim(c))
    body = F.trim(c)
    inner = lambda p: F.when(p > -1, p - cut).otherwise(p)
    first, last = inner(start), F.least(inner(end), F.length(body))
    moved = lambda p: F.when(p > 0, F.length(html_escape(F.substring(body, F.lit(1), p)))).otherwise(p)
    return html_escape(body), moved(first), moved(last)


def url_encode(text: str) -> str:
    """Letters, digits and ``-_.!*()`` stay, a space is ``+``, code units above 127 are ``%uXXXX``."""
    out = []
    for ch in text:
        if ch.isascii() and (ch.isalnum() or ch in "-_.!*()"):
            out.append(ch)
        elif ch == " ":
            out.append("+")
        elif ord(ch) < 128:
            out.append(f"%{ord(ch):02x}")
        else:
            units = ch.encode("utf-16-be")
            out += [f"%u{units[k]:02x}{units[k + 1]:02x}" for k in range(0, len(units), 2)]
    return "".join(out)


def escape_field(c: Column) -> Column:
    """Text that cannot break a ``;`` separated line."""
    return F.translate(c, ";\r\n", ":  ")


def strip_quotes(c: Column) -> Column:
    """Without one pair of double, then of single quotes, where something stands between."""
    for q in ('"', "'"):
        c = F.when((F.length(c) > 2) & c.startswith(q) & c.endswith(q), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)
    return c


def line_lengths(text: str) -> list[int]:
    """Lengths of the lines with their breaks (CR LF, CR or LF); the last line counts even if empty."""
    if not text:
        return []
    parts = re.split(r"(?<=\r\n)|(?<=\r)(?!\n)|(?<=\n)", text)
    return [len(p) for p in parts]


def any_line_lengths(c: Column) -> Column:
    """``line_lengths`` as a column."""
    lengths = F.transform(F.split(c, r"(?<=\r\n)|(?<=\r)(?!\n)|(?<=\n)"), F.length)
    return F.when(c != "", lengths).when(c == "", F.array().cast("array<int>"))


def line_at(lengths: Column, position: Column) -> Column:
    """The line number of ``line_of`` as a column: how many lines end at or before the position, 0 beyond the end."""
    ends = F.transform(lengths, lambda _, k: F.aggregate(F.slice(lengths, 1, k + 1), F.lit(0), lambda a, b: a + b))
    line = F.size(F.filter(ends, lambda e: e <= position))
    return F.when(line < F.size(lengths), line).otherwise(0)


def line_of(lengths: list[int], position: int) -> tuple[int, int]:
    """Line number (from 0) and start of the line that holds ``position``; line 0 beyond the end."""
    at = 0
    for k, n in enumerate(lengths):
        if position < at + n:
            return k, at
        at += n
    return 0, 0


def lf_line_lengths(c: Column) -> Column:
    """As ``line_lengths`` for texts whose only break is LF."""
    parts = F.split(c, "\n")
    whole = F.transform(parts, lambda x, i: F.length(x) + F.when(i < F.size(parts) - 1, 1).otherwise(0))
    return F.when(c == "", F.array().cast("array<int>")).otherwise(whole)


def semicolon_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(;|[ \t\r\n]+|[^; \t\r\n]+)"), F.lit(1))


def split_expressions(text: str) -> list[str]:
    """A build text cut at its ``$(...)`` and ``@(...)`` expressions.

    Brackets nest; an inner expression cuts the outer one short; an item ends at a
    comma or dash; an expression that never closes takes the rest.
    """
    opening = re.compile(r"[$@]\(")
    out, done = [], 0
    while (found := opening.search(text, done)) is not None:
        at = found.start()
        depth, stop = 1, None
        for k in range(at + 2, len(text)):
            depth += (text[k] == "(") - (text[k] == ")")
            if depth == 0 or (text[at] == "@" and text[k] in ",-"):
                stop = k + 1
                break
        out += [text[done:at]] if at > done else []
        done = at
        if stop is None:
            break
        inner = opening.search(text, at + 2, stop)
        done = inner.start() if inner else stop
        out.append(text[at:done])
    return out + [text[done:]] if done < len(text) else out


def property_name(c: Column) -> Column:
    """The property of ``$(Name.Member)``; null where the name is not a plain one."""
    name = F.substring_index(c, ".", 1)
    return F.when(~name.rlike(r"[$:\[\]]"), name)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def _folder(path: str) -> str | None:
    """The folder of a path; a drive's root has none."""
    at = path.rfind("\\")
    if at < 0:
        return ""
    if at <= 2 and path[1:2] == ":":
        return None if len(path) == at + 1 else path[: at + 1]
    return path[:at]


def relative_to_folder(path: str, folder: str) -> str:
    """``path`` as seen from ``folder``, with ``\\``; the bare file name across drives."""
    if path[0] != folder[0]:
        return path.rsplit("\\", 1)[-1]
    here, up = folder.rstrip("\\"), 0
    inside = lambda: (path + "\\").lower().startswith((here.rstrip("\\") + "\\").lower())
    while not inside():
        here, up = _folder(here) or "", up + 1
    return "..\\" * up + path[len(here) :].removeprefix("\\")


def relative_to_file(path: str, other: str) -> str:
    return relative_to_folder(path, _folder(other) or other)


def sanitize_folder(name: Column) -> Column:
    plain = F.when(name == ".", "current").when(name == "..", "parent").otherwise(F.regexp_replace(name, ":+$", ""))
    return F.regexp_replace(plain, r'[\x00-\x1f|]', "_")


def sanitize_file(name: Column) -> Column:
    return F.regexp_replace(name, r'[\x00-\x1f"<>|:*?\\/]', "_")


def depth_to_root(path: Column) -> Column:
    """``../`` for each folder above a file."""
    return F.repeat(F.lit("../"), F.length(path) - F.length(F.translate(path, "\\/", "")))


def page_path(path: Column) -> Column:
    """The page of a source path: no colons or spaces, and no folder named ``bin``."""
    return F.replace(F.translate(path, ": ", ""), F.lit("\\bin\\"), F.lit("\\bin_\\"))


def guid_literals(c: Column) -> Column:
    """Canonical forms of the GUIDs among the quoted literals of a text."""
    h = "[0-9a-fA-F]"
    dashed = f"{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}"
    pattern = f'@?"((?:{h}{{32}}|{dashed}|\\{{{dashed}\\}}|\\({dashed}\\)))"'
    plain = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, "[-{}()]", "")))
    return F.transform(plain, canonical_guid)


def canonical_guid(x: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(x, a, n) for a, n in cuts])


def trim_compiler(c: Column) -> Column:
    """A command line without the compiler, quoted or not, and what starts it."""
    return F.regexp_replace(c, r'(?i)^\s*(?:"[^"]*?(?:csc|vbc|tsc)(?:\.exe|\.dll)?"|.*?(?:csc|vbc|tsc)(?:\.exe|\.dll)|(?:csc|vbc|tsc))\s+', "")


def server_path(argument: str) -> tuple[str, str] | None:
    """Key and value of ``a=b``, either side or (older form) both sides at once in quotes."""
    side = r'(?:"([^"=]*(?:=[^"]*)?)"|([^"=]+))'
    if found := re.fullmatch(r'"([^"=]+)=([^"=]+)"', argument):
        return found[1], found[2]
    if found := re.fullmatch(f"{side}={side}", argument):
        return found[1] or found[2], found[3] or found[4]
    return None


def server_option(argument: Column) -> Column:
    """``server_path`` as a column: a struct of key and value, each null where empty, or null."""
    side = r'(?:"([^"=]*(?:=[^"]*)?)"|([^"=]+))'
    whole, sides = r'\A"([^"=]+)=([^"=]+)"\z', rf"\A{side}={side}\z"
    group = lambda pattern, k: F.nullif(F.regexp_extract(argument, pattern, k), F.lit(""))
    of = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    either = lambda k: F.coalesce(group(sides, k), group(sides, k + 1))
    return F.when(argument.rlike(whole), of(group(whole, 1), group(whole, 2))).when(argument.rlike(sides), of(either(1), either(3)))


def external_link(index: Column, assembly: Column, symbol: Column) -> Column:
    return F.concat(F.lit("@"), index.cast("string"), F.lit("@"), assembly, F.lit("/A.html#"), symbol)


def resolve_link(link: Column, servers: list[str]) -> Column:
    """``@index@rest`` with the server's address in place of the index."""
    at = F.regexp_extract(link, "^@([0-9]+)@", 1)
    found = F.element_at(F.array(*map(F.lit, servers)), at.try_cast("int") + 1)
    return F.when(at != "", F.concat(found, F.regexp_replace(link, "^@[0-9]+@", ""))).otherwise(link)


def empty_array_allocations(c: Column) -> Column:
    """Allocations of arrays without elements that can be seen in the text alone."""
    return F.regexp_extract_all(c, F.lit(r"(new\s+\w+\s*\[\s*0\s*\]|new(?:\s+\w+)?\s*\[\s*\]\s*\{\s*\})"), F.lit(1))


def declares_well(c: Column) -> Column:
    """A declared name that can stand in a line of its own."""
    return (F.length(c) > 2) & ~c.rlike("[;\r\n]")


def namespace_of(description: Column) -> Column:
    """What stands before the last dot of the part before the parameters' bracket."""
    return F.regexp_extract(F.substring_index(description, "(", 1), r"^(.*)\.", 1)


def describe(container: Column, name: Column, parameters: Column, generic: Column) -> Column:
    """A symbol's description: its container, its name with type parameters, and its parameters in brackets where it has such."""
    typed = F.when(F.size(generic) > 0, F.concat(name, F.lit("<"), F.array_join(generic, ", "), F.lit(">"))).otherwise(name)
    called = F.when(parameters.isNotNull(), F.concat(typed, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))).otherwise(typed)
    return F.when(container != "", F.concat(container, F.lit("."), called)).otherwise(called)


def symbol_url(assembly: Column, symbol: Column) -> Column:
    return F.concat(F.lit("/"), assembly, F.lit("/A.html#"), symbol)


def assembly_name(project: Column, path: Column) -> Column:
    """The name in a project file, its root namespace where the name points there, else the last plain name element, else the file's stem.

    A binary's name is its stem.
    """
    named = F.regexp_extract(project, r"<(?:Module)?AssemblyName>((?:\w|\.|\$|\(|\)|-)+)</(?:Module)?AssemblyName>", 1)
    root = F.regexp_extract(project, r"<RootNamespace>((?:\w|\.)+)</RootNamespace>", 1)
    stem = F.regexp_extract(path, r"([^\\/]*?)(?:\.[^.\\/]*)?$", 1)
    elements = F.regexp_extract_all(project, F.lit(r"<AssemblyName[^>]*>([^<$]*)</AssemblyName>"), F.lit(1))
    plain = F.try_element_at(elements, F.lit(-1))
    pick = F.when(named == "$(RootNamespace)", F.when(root != "", root).otherwise(named)).when(named != "", named).when(plain != "", plain).otherwise(stem)
    return F.when(F.lower(path).rlike(r"\.(dll|exe)$"), stem).otherwise(pick)


def in_cone(folder: str, path: str) -> str:
    """``path`` as a full path inside ``folder``: one from elsewhere keeps what follows the folders they share.

    Paths use ``\\``; one without a root is taken from the folder.
    """
    folder = folder.rstrip("\\")
    if not re.match(r"[A-Za-z]:\\|\\", path):
        path = f"{folder}\\{path}"
    parts: list[str] = []
    for part in path.split("\\"):
        if part == ".." and len(parts) > 1:
            parts.pop()
        elif part != ".":
            parts.append(part)
    path = "\\".join(parts)
    if path.lower().startswith(folder.lower()):
        return path
    ours, k = folder.lower().split("\\"), 0
    while k < min(len(ours), len(parts)) and ours[k] == parts[k].lower():
        k += 1
    return folder + "\\" + "\\".join(parts[k:]).replace(":", "")
