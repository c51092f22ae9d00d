"""Monotone sequences and a three-level n-gram trie over them, in files that are mapped.

``Sequence`` holds n rising numbers up to u in about 2 + log2(u / n) bits each: the low
bits are packed, the high ones are a bit vector in which element i sets bit (high + i).
All calls take whole arrays of questions.

``Trie`` has four such levels and two tables of 16-bit codes (a code is a negative log10
probability times ``STEPS``):

* the middle words v of trigrams (u, v, w),
* under each v its successors w, with the code of p(w | v),
* under each v its predecessors u, that is the contexts (u, v), with the code of the
  weight that a word unseen there leaves to p(w | v),
* under each context its successors, each as its *place among the successors of v*,
  which is a small number, with the code of p(w | u, v).

The numbers below one parent rise; to make a level rise as a whole, the last number of
each parent is added to all that follow, and pointers to the parents' first children are a
sequence too.  A question (u, v, w) is answered by three successor searches: w below v gives
the place, u below v the context, the place below the context the code.
"""

from __future__ import annotations

import json
import mmap
import os

import numpy as np

STEPS = 2048
#: Questions asked at once: what they need stays in a processor's cache.
RUN = 1 << 15


def encoded(p: np.ndarray) -> np.ndarray:
    """The code of probabilities."""
    return np.rint(-STEPS * np.log10(p)).astype(np.int64)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.power(10.0, -np.asarray(code, np.float64) / STEPS)


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value in a row of bytes, with 8 bytes to spare."""
    out, shifts = [], np.arange(bits, dtype=np.uint64)
    for k in range(0, len(values), 1 << 16):
        out.append(((values[k : k + (1 << 16), None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
    flat = np.packbits(np.concatenate(out), bitorder="little") if out else np.zeros(0, np.uint8)
    return np.concatenate([flat, np.zeros(8, np.uint8)])


#: Where the set bit of each rank is in each byte.
_IN_BYTE = np.array([[([k for k in range(8) if byte >> k & 1] + [0] * 8)[rank] for rank in range(8)] for byte in range(256)], np.uint8).ravel()
_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the set bit of that rank (from 0) is in each 64-bit word: by sums over bytes, then within the byte."""
    word, rank = np.ascontiguousarray(word), rank.astype(np.uint64)
    sums = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _ONES  # byte k holds the set bits up to byte k
    full = ((rank * _ONES | _HIGHS) - sums) & _HIGHS  # bytes whose sum the rank reaches
    shift = np.bitwise_count(full).astype(np.uint64) << np.uint64(3)
    rank = rank - (((sums << np.uint64(8)) >> shift) & np.uint64(255))
    byte = (word >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3)) | rank]


class Sequence:
    """Rising numbers in Elias and Fano's form."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self._at = np.ndarray((max(1, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if len(low) >= 8 else None
        self._zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones.astype(np.int64)
        self._n_zeros = 64 * len(high) - n

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = np.ascontiguousarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(places[-1]) if n else 0) // 64 + 1
        high = np.zeros(words, np.uint64)
        if n:
            at, starts = np.unique(places >> 6, return_index=True)
            high[at] = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), starts)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1].astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, bits, _packed(values, bits), high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self._at[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at positions ``i``."""
        k = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        place = 64 * k + _select(self.high[k], i - self.ones[k].astype(np.int64))
        return (((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)).astype(np.int64)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many elements have a high part less than ``h``."""
        out = np.zeros(len(h), np.int64)
        out[h > 0] = self.n
        some = np.flatnonzero((h > 0) & (h <= self._n_zeros))
        rank = h[some] - 1
        k = np.searchsorted(self._zeros, rank, "right") - 1
        out[some] = np.minimum(self.n, 64 * k + _select(~self.high[k], rank - self._zeros[k]) - rank)
        return out

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the elements with high part ``h`` begin and end: behind a zero, and as long as set bits follow."""
        low = self._below(h)
        start = low + h
        inside = start < 64 * len(self.high)
        off = start & 63
        word = self.high[np.where(inside, start >> 6, 0)] >> off.astype(np.uint64)
        run = np.bitwise_count(word ^ (word + np.uint64(1))).astype(np.int64) - 1
        high = low + np.where(inside, run, 0)
        over = np.flatnonzero(inside & ((off + run >= 63) | (word == np.uint64((1 << 64) - 1))))  # the run may go on in the next word
        high[over] = self._below(h[over] + 1)
        return low, np.minimum(high, self.n)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first position in [begin, end) of an element not below ``value`` (end if there is none), and whether it is ``value``.

        The elements of the range rise strictly.
        """
        h, rest = value >> self.bits, (value & ((1 << self.bits) - 1)).astype(np.uint64)
        low, high = self._bucket(h)
        low, high = np.maximum(low, begin), np.minimum(high, end)
        high = np.maximum(np.minimum(low, end), high)
        low = np.minimum(low, end)
        last, open_ = high.copy(), np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < rest[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        hit = low < last  # so it has the high part
        some = np.flatnonzero(hit)
        hit[some] = self._low(low[some]) == rest[some]
        return low, hit

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]


class Level:
    """Children of parents 0 to P - 1: rising numbers below each, and pointers to each one's first."""

    def __init__(self, starts: Sequence, children: Sequence):
        self.starts, self.children = starts, children

    @classmethod
    def of(cls, starts: np.ndarray, values: np.ndarray) -> Level:
        """``starts`` has P + 1 entries; no parent is without a child."""
        if not len(values):
            return cls(Sequence.of(np.zeros(1)), Sequence.of(np.zeros(0)))
        last = values[starts[1:] - 1]
        base = np.concatenate([[0], np.cumsum(last)[:-1]])
        return cls(Sequence.of(starts), Sequence.of(values + np.repeat(base, np.diff(starts))))

    def search(self, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The number of the child ``value`` of each parent over the whole level, or -1."""
        out = np.full(len(parent), -1)
        if not self.children.n or not len(parent):
            return out
        known, which = _distinct(parent)
        begin, end = self.starts.get(known), self.starts.get(known + 1)
        base = np.where(begin > 0, self.children.get(np.maximum(begin - 1, 0)), 0)
        first, begin, end = base[which], begin[which], end[which]
        at, hit = self.children.find(value + first, begin, end)
        out[hit] = at[hit]
        return out

    def first(self, parent: np.ndarray) -> np.ndarray:
        return self.starts.get(parent)


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and which of them each is; what is in order already is not sorted."""
    if len(x) and (x[1:] >= x[:-1]).all():
        starts = _group_starts(x)
        return x[starts[:-1]], np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.unique(x, return_inverse=True)


class Trie:
    """The levels of a shard of trigrams, built by ``build`` or mapped by ``open``."""

    FORMS = ("middle", "follow.starts", "follow.children", "context.starts", "context.children", "third.starts", "third.children")

    def __init__(self, sequences: dict[str, Sequence], codes: dict[str, np.ndarray]):
        self.sequences, self.codes = sequences, codes
        self.middle = sequences["middle"]
        self.follow, self.context, self.third = (Level(sequences[f"{k}.starts"], sequences[f"{k}.children"]) for k in ("follow", "context", "third"))

    @classmethod
    def build(cls, pairs: tuple, contexts: tuple, triples: tuple) -> Trie:
        """``pairs`` (v, w, code) by (v, w); ``contexts`` (v, u, code) by (v, u); ``triples`` (v, u, number of their pair, code) by (v, u, w).

        Every v, (v, w) and (v, u) of the triples is in the others, and none else.
        """
        v, w, pair_code = pairs
        starts = _group_starts(v)
        middle = v[starts[:-1]]
        cv, cu, weight = contexts
        tv, tu, pair_of, code = triples
        place = pair_of - np.repeat(starts[:-1], np.diff(starts))[pair_of] if len(tv) else np.zeros(0, np.int64)
        levels = {"follow": Level.of(starts, w), "context": Level.of(_group_starts(cv), cu), "third": Level.of(_group_starts(tv, tu), place)}
        sequences = {"middle": Sequence.of(middle)} | {f"{k}.{part}": getattr(x, part) for k, x in levels.items() for part in ("starts", "children")}
        return cls(sequences, {"follow": pair_code.astype(np.uint16), "context": weight.astype(np.uint16), "third": code.astype(np.uint16)})

    def size(self) -> int:
        """Bytes of all levels."""
        return sum(a.nbytes for s in self.sequences.values() for a in s.parts()) + sum(c.nbytes for c in self.codes.values())

    def save(self, path: str) -> None:
        """One file: a line that describes the arrays, then the arrays at multiples of 64 bytes."""
        arrays = [a for k in self.FORMS for a in self.sequences[k].parts()] + [self.codes[k] for k in sorted(self.codes)]
        head = {"forms": [[self.sequences[k].n, self.sequences[k].bits] for k in self.FORMS], "arrays": [[a.dtype.str, len(a)] for a in arrays]}
        with open(path, "wb") as f:
            f.write(json.dumps(head).encode() + b"\n")
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 64))
                f.write(a.tobytes())

    @classmethod
    def open(cls, path: str, unlink: bool = False) -> Trie:
        """Map a saved trie; ``unlink`` removes its name, so that the file ends with the mapping."""
        with open(path, "rb") as f:
            line = f.readline()
            mapped, at = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), len(line)
        if unlink:
            os.unlink(path)
        head, arrays = json.loads(line), []
        for kind, n in head["arrays"]:
            at += -at % 64
            a = np.frombuffer(mapped, kind, n, at)
            arrays.append(a)
            at += a.nbytes
        parts = iter(arrays)
        sequences = {k: Sequence(n, bits, next(parts), next(parts), next(parts)) for k, (n, bits) in zip(cls.FORMS, head["forms"])}
        return cls(sequences, {k: next(parts) for k in ("context", "follow", "third")})

    def query(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of p(w | v), of the weight of context (u, v) and of p(w | u, v); -1 for what the trie has not."""
        found = tuple(np.full(len(u), -1) for _ in range(3))
        for k in range(0, len(u), RUN):
            part = slice(k, k + RUN)
            for out, codes in zip(found, self._query(u[part], v[part], w[part])):
                out[part] = codes
        return found

    def _query(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [np.full(len(u), -1) for _ in range(3)]
        if not self.middle.n or not len(u):
            return tuple(found)
        known, which = _distinct(v)
        at, hit = self.middle.find(known, np.zeros(len(known), np.int64), np.full(len(known), self.middle.n))
        number = np.full(len(known), -1)
        number[hit] = at[hit]
        parent = number[which]
        some = np.flatnonzero(parent >= 0)
        pair, context = np.full(len(u), -1), np.full(len(u), -1)
        pair[some] = self._once(self.follow, parent[some], w[some])
        context[some] = self._once(self.context, parent[some], u[some])
        has_pair, has_context = pair >= 0, context >= 0
        found[0][has_pair] = self.codes["follow"][pair[has_pair]]
        found[1][has_context] = self.codes["context"][context[has_context]]
        both = np.flatnonzero(has_pair & has_context)
        groups, at = _distinct(parent[both])
        place = pair[both] - (self.follow.first(groups)[at] if len(groups) else 0)
        third = self.third.search(context[both], place)
        seen = third >= 0
        found[2][both[seen]] = self.codes["third"][third[seen]]
        return tuple(found)

    @staticmethod
    def _once(level: Level, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """``search`` for neighbours that may repeat, each run asked once."""
        starts = _group_starts(parent, value)
        if len(starts) < 2:
            return np.zeros(0, np.int64)
        return np.repeat(level.search(parent[starts[:-1]], value[starts[:-1]]), np.diff(starts))
