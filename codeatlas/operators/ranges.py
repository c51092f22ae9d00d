"""Reconciling the classified ranges that two analyses give of one text.

Ranges (start, len, class, semantic, link) are cut at all bounds of the ranges of their
text.  Of the pieces that share a place one stays, found by going through them in the order
of (start, syntactic first, ``seq``) and choosing the better of what is there and the next:

* of a semantic and a syntactic one, the place and link of the syntactic with the class of
  the semantic,
* otherwise the later, unless it is a comment; the one that goes leaves its link where the
  winner has none, and its class where the winner's is ``text``.

A semantic range that others cut is an ordinary one from there on: only a whole one keeps
its mark.  What no range covers is a gap without class.

One sweep does all that: bounds are visited in order, and what is open at a place is kept in
the order above in a tree of folded choices, where a range opens or closes in logarithmic
time, so a text with very many overlapping ranges costs no more than sorting them.  Spark
sorts the ranges of a partition by text, and the sweep streams over them: it holds the open
ranges of one text.

Ranges without length are dropped; a null class is a class of its own; a text without ranges
is one gap; texts of ranges that are not in the table of texts have no length and no gap
behind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

COMMENT, TEXT = "comment", "text"
_KEEP, _PUT, _FILL = range(3)  # what a choice does with the left side's class or link: keep it, replace it, or only where it says nothing

#: start, end, class, semantic, link
Range = tuple[int, int, "str | None", bool, "str | None"]


def better(left: tuple | None, right: tuple) -> tuple:
    """The choice between (semantic, class, link) of a piece and of the next one at the same place."""
    if left is None:
        return right
    if left[0] != right[0]:
        plain, cls = (right, left[1]) if left[0] else (left, right[1])
        return False, cls, plain[2]
    winner, victim = (left, right) if right[1] == COMMENT else (right, left)
    return winner[0], victim[1] if winner[1] == TEXT else winner[1], winner[2] if winner[2] is not None else victim[2]


def _step(cls: str | None, link: str | None) -> tuple:
    """A cut range as (its class and link alone, and what it does to those on its left); steps of cut ranges compose."""
    if cls == COMMENT:
        return cls, link, _FILL, cls, _FILL, link
    return cls, link, *((_KEEP, None) if cls == TEXT else (_PUT, cls)), *((_KEEP, None) if link is None else (_PUT, link))


def _on(step: tuple, cls: str | None, link: str | None) -> tuple:
    _, _, how, c, link_how, k = step
    cls = cls if how == _KEEP or how == _FILL and cls != TEXT else c
    return cls, link if link_how == _KEEP or link_how == _FILL and link is not None else k


def _then(a: tuple | None, b: tuple | None) -> tuple | None:
    """The step that does ``a`` and then ``b``."""
    if a is None or b is None:
        return b if a is None else a
    _, _, how, c, link_how, k = b
    if how == _KEEP:
        how, c = a[2], a[3]
    elif how == _FILL and a[2] != _KEEP:
        how, c = a[2], c if a[3] == TEXT else a[3]
    if link_how == _KEEP:
        link_how, k = a[4], a[5]
    elif link_how == _FILL and a[4] != _KEEP:
        link_how, k = a[4], a[5] if a[5] is not None else k
    return *_on(b, a[0], a[1]), how, c, link_how, k


class _Open:
    """Open ranges in the order in which they came, with the fold over all of them."""

    def __init__(self):
        self.width, self.next, self.live = 4, 0, 0
        self.nodes: list[tuple | None] = [None] * 8
        self.place: dict[int, int] = {}

    def _set(self, leaf: int, step: tuple | None) -> None:
        k = leaf + self.width
        self.nodes[k] = step
        while k > 1:
            k >>= 1
            self.nodes[k] = _then(self.nodes[2 * k], self.nodes[2 * k + 1])

    def add(self, key: int, step: tuple) -> None:
        if self.next == self.width:  # room again, without the closed ones
            kept = [(k, self.nodes[self.width + leaf]) for k, leaf in self.place.items()]
            self.width = max(4, 1 << (2 * len(kept)).bit_length())
            self.nodes = [None] * self.width + [s for _, s in kept] + [None] * (self.width - len(kept))
            self.place, self.next = {k: leaf for leaf, (k, _) in enumerate(kept)}, len(kept)
            for k in range(self.width - 1, 0, -1):
                self.nodes[k] = _then(self.nodes[2 * k], self.nodes[2 * k + 1])
        self.place[key] = self.next
        self._set(self.next, step)
        self.next += 1

    def remove(self, key: int) -> None:
        self._set(self.place.pop(key), None)

    def folded(self) -> tuple | None:
        return None if self.nodes[1] is None else (False, *self.nodes[1][:2])


def _visits(ranges: Iterable[Range]) -> Iterator[tuple[int, int, list[Range]]]:
    """(place, next bound, ranges that begin there) of each place from which a range is open; ``ranges`` rise by start."""
    groups, ends, here = groupby(ranges, key=lambda r: r[0]), [], None
    start, new = next(((s, list(g)) for s, g in groups), (None, []))
    while start is not None or ends:
        here = start if not ends else here
        begin: list[Range] = []
        if start == here:
            begin = new
            for r in begin:
                heapq.heappush(ends, r[1])
            start, new = next(((s, list(g)) for s, g in groups), (None, []))
        bound = ends[0] if start is None else min(ends[0], start)
        yield here, bound, begin
        while ends and ends[0] <= bound:
            heapq.heappop(ends)
        here = bound


def reconcile(ranges: Iterable[Range]) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(start, len, class, link) of the pieces of one text; ``ranges`` are in the order of the module, none is empty."""
    open_, closing, n = _Open(), [], 0
    for here, bound, begin in _visits(ranges):
        while closing and closing[0][0] <= here:
            open_.remove(heapq.heappop(closing)[1])
        best = open_.folded()
        for _, end, cls, semantic, link in begin:
            best = better(best, (semantic and end == bound, cls, link))
        yield here, bound - here, best[1], best[2]
        for _, end, cls, _, link in begin:
            if end > bound:
                open_.add(n, _step(cls, link))
                heapq.heappush(closing, (end, n))
                n += 1


def covered(ranges: Iterable[Range], length: int | None) -> Iterator[tuple[int, int, str | None, str | None]]:
    """``reconcile`` with the gaps, up to the length of the text."""
    done = 0
    for start, n, cls, link in reconcile(ranges):
        if start > done:
            yield done, start - done, None, None
        yield start, n, cls, link
        done = start + n
    if length is not None and length > done:
        yield done, length - done, None, None


def split(ranges: Iterable[tuple]) -> Iterator[tuple[int, int, tuple]]:
    """(start, len, range) of every piece of every range, whatever a range has behind its start and end."""
    active: list[tuple] = []
    for here, bound, begin in _visits(ranges):
        active = [r for r in active if r[1] > here] + begin
        for r in active:
            yield here, bound - here, r


def _by_text(docs: DataFrame | None, ranges: DataFrame, doc: str, length: str | None) -> DataFrame:
    """Rows of texts (first) and ranges, sorted within partitions that hold whole texts."""
    cols = [F.col("start").cast("long").alias("start"), (F.col("start") + F.col("len")).cast("long").alias("end"), "class", F.col("semantic").cast("boolean").alias("semantic")]
    cols += [F.col(c) if c in ranges.columns else F.lit(None).cast(t).alias(c) for c, t in (("link", "string"), ("seq", "long"))]
    rows = ranges.filter("len > 0").select(F.col(doc).alias("doc"), F.lit(None).cast("long").alias("total"), *cols)
    if docs is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("class", "string"), ("semantic", "boolean"), ("link", "string"), ("seq", "long"))]
        rows = rows.unionByName(docs.select(F.col(doc).alias("doc"), F.col(length).cast("long").alias("total"), *empty))
    return rows.repartition("doc").sortWithinPartitions("doc", F.col("start").asc_nulls_first(), "semantic", "seq", "end", "class", "link")


def _streamed(batches: Iterator[pa.RecordBatch], work) -> Iterator[list[tuple]]:
    """Rows of ``work(length, ranges)`` for each text with its key before them, in lists of some thousands."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc", "total", "start", "end", "class", "semantic", "link", "seq"))))
    out: list[tuple] = []
    for doc, group in groupby(rows, key=lambda r: r[0]):
        first = next(group)
        length, head = (first[1], ()) if first[2] is None else (None, (first,))
        found = ((r[2], r[3], r[4], r[5], r[6], r[7]) for part in (head, group) for r in part if r[2] is not None)
        for row in work(length, found):
            out.append((doc, *row))
            if len(out) >= 8192:
                yield out
                out = []
    if out:
        yield out


def _run(rows: DataFrame, doc: str, work, columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    ship(rows.sparkSession)
    key = rows.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(key), *(t for _, _, t in columns)]
        for out in _streamed(batches, work):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [doc, *(c for c, _, _ in columns)])

    return rows.mapInArrow(run, ", ".join([f"`{doc}` {key.simpleString()}", *(f"{c} {t}" for c, t, _ in columns)]))


_PLACE = [("start", "long", pa.int64()), ("len", "long", pa.int64())]
_SHOWN = [("class", "string", pa.string()), ("link", "string", pa.string())]


def prepared(docs: DataFrame, ranges: DataFrame, doc: str, length: str) -> DataFrame:
    """(doc, start, len, class, link): pieces and gaps that cover each text once.

    ``ranges`` are (doc, start, len, class, semantic) and may have ``link`` and ``seq``; of equal ``seq`` the order is that of the other columns.
    """
    return _run(_by_text(docs, ranges, doc, length), doc, lambda total, found: covered((r[:5] for r in found), total), [*_PLACE, *_SHOWN])


def origin_pieces(ranges: DataFrame, doc: str) -> DataFrame:
    """(doc, start, len, class, link, seq): the pieces of every range with what they come from.  As many rows as ranges have pieces."""
    return _run(_by_text(None, ranges, doc, None), doc, lambda _, found: ((s, n, r[2], r[4], r[5]) for s, n, r in split(found)), [*_PLACE, *_SHOWN, ("seq", "long", pa.int64())])
