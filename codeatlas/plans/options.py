"""The command line of an index run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..functions.text import server_path

# Endings of the inputs that can be indexed.
INPUTS = (".sln", ".binlog", ".buildlog", ".csproj", ".vbproj", ".dll", ".exe")


@dataclass
class Options:
    out: str | None = None
    root: str | None = None
    projects: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    federations: list[str] = field(default_factory=list)
    offline: dict[str, str] = field(default_factory=dict)
    server_paths: dict[str, str] = field(default_factory=dict)
    blacklist: list[str] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)
    rejected: list[str] = field(default_factory=list)


_FLAGS = {"/force", "/assemblylist", "/nobuiltinfederations", "/excludetests", "/excludeSourceGeneratedDocuments"}
_ANY_CASE = {"/donotincludereferencedprojects", "/noplugins", "/useplugins"}


def supported(path: str) -> bool:
    return path.lower().endswith(INPUTS)


def _bare(text: str) -> str:
    for quote in "\"'":
        if len(text) > 2 and text[0] == text[-1] == quote:
            text = text[1:-1]
    return text


def parse(arguments: Iterable[str], exists: Callable[[str], bool] = lambda path: True, lines: Callable[[str], Iterable[str]] = lambda path: ()) -> Options:
    """What the arguments ask for; ``exists`` and ``lines`` look at the file system.

    An argument that is none of the options is an input; inputs of other kinds, and all
    of them where one lies outside ``/root``, are rejected.
    """
    out = Options()

    def add(path: str) -> None:
        (out.projects if supported(path) and exists(path) else out.rejected).append(path)

    def pair(into: dict[str, str], text: str) -> None:
        if found := re.fullmatch("([^=]+)=(.+)", text):
            into[found[1]] = found[2]

    def mapping(text: str) -> None:
        found = server_path(text)
        (out.server_paths.__setitem__(*found) if found else out.rejected.append(text))

    takes: dict[str, Callable[[str], object]] = {
        "/out:": lambda v: setattr(out, "out", _bare(v)),
        "/root:": lambda v: setattr(out, "root", _bare(v)),
        "/in:": lambda v: [add(p) for p in lines(_bare(v))],
        "/p:": lambda v: pair(out.properties, v),
        "/federation:": out.federations.append,
        "/offlinefederation:": lambda v: pair(out.offline, v),
        "/serverPath:": mapping,
        "/noplugin:": out.blacklist.append,
    }
    for argument in arguments:
        name, colon, value = argument.partition(":")
        if argument in _FLAGS or argument.lower() in _ANY_CASE:
            out.flags.add(argument.lower())
        elif name + colon in takes:
            takes[name + colon](value)
        else:
            add(argument)
    if "/noplugins" in out.flags:
        out.flags.discard("/useplugins")
    inside = lambda p: (p + "\\").lower().startswith((out.root.rstrip("\\") + "\\").lower())
    if out.root and not all(map(inside, out.projects)):
        out.rejected, out.projects = out.rejected + out.projects, []
    return out
