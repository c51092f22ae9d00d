"""Lexing of whole texts by tables, many texts at a time.

An automaton is a table of states by classes of characters.  Every character gets the state
that it leads to, and a state stands for a class of token; where the class changes a span
ends, so spans cover each text once.

A batch of texts is cut into segments of equal length, and all segments take a step together,
which makes a step one lookup of arrays.  Where a segment begins in another state than the
first is not known, so segments behind the first of their text are run from every state at
once; the ends that come out are chained from segment to segment, and then each is run once
more from the state it really begins in.  A long text therefore takes as many steps as a
short one.

Openings whose first characters say too little (``<!--``, ``//``) are given their class
afterwards: ``back`` tells how many characters before a state belong to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .extract import script_style, xml_style

SEGMENT = 1024


class Automaton:
    """``rules``: by state, its token class and where characters lead from it ('' stands for all others).

    Characters of one rule share their target.  ``back`` is (from state, into state): characters before the one that enters.
    """

    def __init__(self, rules: dict[str, tuple[str | None, dict[str, str]]], back: dict[tuple[str, str], int]):
        self.names = list(rules)
        self.classes = list(dict.fromkeys(cls for cls, _ in rules.values()))
        number = {name: k for k, name in enumerate(self.names)}
        special = sorted({c for _, moves in rules.values() for chars in moves for c in chars})
        self.kind = np.zeros(128, np.uint8)
        for k, c in enumerate(special):
            self.kind[ord(c)] = k + 1
        self.table = np.zeros((len(rules), len(special) + 1), np.uint8)
        for name, (_, moves) in rules.items():
            self.table[number[name]] = number[moves[""]]
            for chars, to in moves.items():
                for c in chars:
                    self.table[number[name], self.kind[ord(c)]] = number[to]
        self.class_of = np.array([self.classes.index(cls) for cls, _ in rules.values()], np.uint8)
        self.back = [(number[a], number[b], n) for (a, b), n in back.items()]

    def _run(self, kinds: np.ndarray, states: np.ndarray, keep: bool) -> np.ndarray:
        """All states on the way (``keep``) or the last ones, of columns of ``kinds``; 255 stands for no character."""
        path = np.empty(kinds.shape, np.uint8) if keep else None
        for t, row in enumerate(kinds):
            there = row < 255
            moved = self.table[states, np.where(there, row, 0) if states.ndim == 1 else np.where(there, row, 0)[:, None]]
            states = np.where(there if states.ndim == 1 else there[:, None], moved, states)
            if keep:
                path[t] = states
        return path if keep else states

    def states(self, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """The state after each character, of all texts in a row, from their code points."""
        counts = [max(1, -(-len(t) // segment)) for t in texts]
        width = min(segment, max((len(t) for t in texts), default=0))
        kinds = np.full((sum(counts), width), 255, np.uint8)
        first, at = np.zeros(len(kinds), bool), 0
        for t, n in zip(texts, counts):
            first[at] = True
            flat = self.kind[np.minimum(t, 127)]
            flat[t > 127] = 0
            kinds[at : at + n].reshape(-1)[: len(t)] = flat
            at += n
        begin = np.zeros(len(kinds), np.uint8)
        if not first.all():
            every = np.broadcast_to(np.arange(len(self.names), dtype=np.uint8), (len(kinds), len(self.names)))
            more = np.flatnonzero(~first)
            needed = np.union1d(more, more - 1)  # where a segment ends matters to the next
            ends = dict(zip(needed.tolist(), self._run(kinds[needed].T, every[needed], keep=False)))
            for k in more.tolist():
                begin[k] = ends[k - 1][begin[k - 1]]
        path = self._run(kinds.T, begin, keep=True).T
        return path[kinds < 255]

    def spans(self, texts: list[str], segment: int = SEGMENT) -> list[tuple[np.ndarray, np.ndarray, list[str | None]]]:
        """(starts, lengths, classes) of each text, in characters."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        states = self.states(points, segment)
        classes, out, at = self.class_of[states], [], 0
        for t in points:
            own, cls = states[at : at + len(t)], classes[at : at + len(t)].copy()
            at += len(t)
            for a, b, n in self.back:
                for k in np.flatnonzero((own[1:] == b) & (own[:-1] == a)) + 1:
                    cls[max(0, k - n) : k] = cls[k]
            starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(t) else np.zeros(0, np.int64)
            out.append((starts, np.diff(np.append(starts, len(t))), [self.classes[c] for c in cls[starts]]))
        return out


_IN_TAG = {" \t\r\n": "tag", "/": "slash", ">": "end", "<": "open"}
_CONTENT = {"<": "open", "&": "entity", "": "text"}
_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$"

# Token classes of markup.
MARKUP = Automaton(
    {
        "text": ("text", _CONTENT),
        "open": ("delimiter", {"/": "close", "!": "bang", "?": "pi", " \t\r\n": "text", "<": "open", "&": "entity", "": "name"}),
        "close": ("delimiter", {">": "end", " \t\r\n": "tag", "<": "open", "": "name"}),
        "name": ("name", {**_IN_TAG, "": "name"}),
        "tag": (None, {**_IN_TAG, "=": "equals", '"': "double", "'": "single", "": "attribute"}),
        "attribute": ("attribute name", {**_IN_TAG, "=": "equals", "": "attribute"}),
        "equals": ("delimiter", {" \t\r\n": "value space", '"': "double", "'": "single", ">": "end", "<": "open", "": "bare"}),
        "value space": (None, {" \t\r\n": "value space", '"': "double", "'": "single", ">": "end", "<": "open", "": "bare"}),
        "double": ("attribute quotes", {'"': "quoted", "": "in double"}),
        "in double": ("attribute value", {'"': "quoted", "": "in double"}),
        "single": ("attribute quotes", {"'": "quoted", "": "in single"}),
        "in single": ("attribute value", {"'": "quoted", "": "in single"}),
        "quoted": ("attribute quotes", {**_IN_TAG, "": "attribute"}),
        "bare": ("attribute value", {" \t\r\n": "tag", ">": "end", "<": "open", "": "bare"}),
        "slash": ("delimiter", {**_IN_TAG, "": "attribute"}),
        "end": ("delimiter", _CONTENT),
        "bang": ("delimiter", {"-": "bang dash", "[": "cdata", ">": "end", "": "declaration"}),
        "bang dash": ("delimiter", {"-": "comment", ">": "end", "": "declaration"}),
        "declaration": ("delimiter", {">": "end", "": "declaration"}),
        "comment": ("comment", {"-": "comment dash", "": "comment"}),
        "comment dash": ("comment", {"-": "comment dashes", "": "comment"}),
        "comment dashes": ("comment", {"-": "comment dashes", ">": "comment end", "": "comment"}),
        "comment end": ("comment", _CONTENT),
        "cdata": ("cdata section", {"]": "cdata one", "": "cdata"}),
        "cdata one": ("cdata section", {"]": "cdata two", "": "cdata"}),
        "cdata two": ("cdata section", {"]": "cdata two", ">": "cdata end", "": "cdata"}),
        "cdata end": ("cdata section", _CONTENT),
        "pi": ("processing instruction", {"?": "pi mark", "": "pi"}),
        "pi mark": ("processing instruction", {"?": "pi mark", ">": "pi end", "": "pi"}),
        "pi end": ("processing instruction", _CONTENT),
        "entity": ("entity reference", {";": "entity end", " \t\r\n": "text", "<": "open", "&": "entity", "": "entity"}),
        "entity end": ("entity reference", _CONTENT),
    },
    {("bang dash", "comment"): 3, ("bang", "cdata"): 2, ("open", "pi"): 1},
)

_ANY = {" \t\r\n": "space", _WORD: "word", "0123456789": "number", '"': "double", "'": "single", "`": "template", "/": "slash", "": "mark"}
# Token classes of script; words are keywords or identifiers by ``KEYWORDS``.
SCRIPT = Automaton(
    {
        "space": (None, _ANY),
        "word": ("identifier", {**_ANY, "0123456789": "word"}),
        "number": ("number", {**_ANY, "0123456789": "number", _WORD: "number", ".": "number"}),
        "mark": ("punctuation", _ANY),
        "slash": ("punctuation", {**_ANY, "/": "line comment", "*": "block comment"}),
        "line comment": ("comment", {"\n": "space", "": "line comment"}),
        "block comment": ("comment", {"*": "star", "": "block comment"}),
        "star": ("comment", {"*": "star", "/": "comment end", "": "block comment"}),
        "comment end": ("comment", _ANY),
        **{
            name: ("string", {"\\": f"{name} escape", quote: "string end", "": name}) for name, quote in (("double", '"'), ("single", "'"), ("template", "`"))
        },
        **{f"{name} escape": ("string", {"": name}) for name in ("double", "single", "template")},
        "string end": ("string", _ANY),
    },
    {("slash", "line comment"): 1, ("slash", "block comment"): 1},
)
KEYWORDS = "async await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof interface let new null return static super switch this throw true try type typeof var void while with yield".split()


def lexed(docs: DataFrame, doc: str, text: str, automaton: Automaton, batch_chars: int = 4 << 20) -> DataFrame:
    """(doc, start, len, class, token): spans that cover each text once; a null or empty text has none."""
    ship(docs.sparkSession)
    kind = docs.schema[doc].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for (key, t), (starts, lengths, classes) in zip(rows, automaton.spans([t for _, t in rows])):
                for k in range(0, len(starts), 50_000):
                    s, n = starts[k : k + 50_000], lengths[k : k + 50_000]
                    tokens = [t[a : a + b] for a, b in zip(s.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(s), types[0]), pa.array(s, types[1]), pa.array(n, types[2]), pa.array(classes[k : k + 50_000], types[3]), pa.array(tokens, types[4])], names)

        names, rows, held = [doc, "start", "len", "class", "token"], [], 0
        for b in batches:
            for key, t in zip(*(c.to_pylist() for c in b.columns)):
                if t:
                    rows.append((key, t))
                    held += len(t)
                if held > batch_chars:
                    yield from flush(rows)
                    rows, held = [], 0
        yield from flush(rows)

    return docs.select(doc, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{doc}` {kind.simpleString()}, start long, len long, class string, token string")


def markup_spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Markup with the style of each span; text, quotes and what is between attributes have none."""
    return lexed(docs, doc, text, MARKUP).withColumn("style", xml_style(F.col("class")))


def script_spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Script with classes, words told apart, and the style of each span."""
    spans = lexed(docs, doc, text, SCRIPT)
    word = (F.col("class") == "identifier") & F.col("token").isin(*KEYWORDS)
    return spans.withColumn("class", F.when(word, "keyword").otherwise(F.col("class"))).withColumn("style", script_style(F.col("class")))
