"""A scanner of XML text that keeps places and survives broken files.

A state machine goes through the text once; a stack holds the open elements, so depth is
bounded by memory only.  What is malformed ends where the next tag begins: an end tag closes
the nearest open element of its name, or is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_SPACE = re.compile(r"[ \t\r\n]*")
_END = re.compile("[<>]")
_NAME = re.compile(r"[^\s<>/='\"&]+")
_VALUE = re.compile(r"\"([^\"<]*)(\"?)|'([^'<]*)('?)|([^\s<>\"']+)")
#: How what is not an element begins and ends.
_ASIDE = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">"))


@dataclass
class Element:
    """A start tag: its name and attributes (name, where, value, where) with places, and the element it is in."""

    name: str
    start: int
    parent: Element | None
    attributes: list[tuple[str, int, str, int]] = field(default_factory=list)

    def attribute(self, name: str) -> str | None:
        return next((v for k, _, v, _ in self.attributes if k == name), None)

    def within(self, *names: str) -> bool:
        """Whether the element is directly in one of these."""
        return self.parent is not None and self.parent.name in names


@dataclass
class Text:
    """Text between tags, the element it is in (none outside of the root)."""

    text: str
    start: int
    parent: Element | None


@dataclass
class Fault:
    """Where a file is not well-formed."""

    message: str
    start: int


def _attributes(xml: str, at: int, element: Element) -> tuple[int, str, Fault | None]:
    """Attributes from a place in a start tag: (where it ends, its last character or nothing, the first fault)."""
    fault = None
    while True:
        at = _SPACE.match(xml, at).end()
        if at >= len(xml):
            return at, "", fault or Fault("a tag does not end", at)
        if xml[at] == ">":
            return at + 1, ">", fault
        if xml.startswith("/>", at):
            return at + 2, "/", fault
        if xml[at] == "<":
            return at, "", fault or Fault("a tag does not end", at)
        name = _NAME.match(xml, at)
        if name is None:
            fault = fault or Fault("an attribute has no name", at)
            at += 1
            continue
        at = _SPACE.match(xml, name.end()).end()
        if xml[at : at + 1] != "=":
            fault = fault or Fault("an attribute has no value", at)
            continue
        at = _SPACE.match(xml, at + 1).end()
        value = _VALUE.match(xml, at)
        if value is None:
            fault = fault or Fault("an attribute has no value", at)
            continue
        group = next(g for g in (1, 3, 5) if value[g] is not None)
        if group == 5 or not value[group + 1]:
            fault = fault or Fault("a value has no closing quote", at)
        element.attributes.append((name[0], name.start(), value[group], value.start(group)))
        at = value.end()


def scan(xml: str) -> Iterator[Element | Text | Fault]:
    """Start tags and texts in the order of the file; faults where they are found, and at the end what stays open."""
    open_: Element | None = None
    at, depth_of = 0, {}  # how many open elements have a name
    while at < len(xml):
        tag = xml.find("<", at)
        tag = len(xml) if tag < 0 else tag
        if tag > at:
            yield Text(xml[at:tag], at, open_)
        at = tag
        if at == len(xml):
            break
        for begin, end in _ASIDE if xml.startswith(("<!", "<?"), at) else ():
            if xml.startswith(begin, at):
                stop = xml.find(end, at + len(begin))
                if stop < 0:
                    yield Fault(f"{begin} does not end", at)
                at = len(xml) if stop < 0 else stop + len(end)
                break
        else:
            closing = xml.startswith("</", at)
            name = _NAME.match(xml, at + 1 + closing)
            if name is None:
                yield Fault("a tag has no name", at)
                yield Text("<", at, open_)
                at += 1
            elif closing:
                if not depth_of.get(name[0]):
                    yield Fault("an end tag closes nothing", at)
                else:
                    if open_.name != name[0]:
                        yield Fault("an element is not closed", open_.start)
                    while True:
                        depth_of[open_.name] -= 1
                        closed, open_ = open_, open_.parent
                        if closed.name == name[0]:
                            break
                stop = _END.search(xml, name.end())
                at = len(xml) if stop is None else stop.end() if stop[0] == ">" else stop.start()
            else:
                element = Element(name[0], name.start(), open_)
                at, last, fault = _attributes(xml, name.end(), element)
                if fault:
                    yield fault
                yield element
                if last != "/":
                    depth_of[element.name] = depth_of.get(element.name, 0) + 1
                    open_ = element
    if open_ is not None:
        yield Fault("an element is not closed", open_.start)
