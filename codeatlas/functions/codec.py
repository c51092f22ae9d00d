"""Descriptions as bits: a Huffman code over pairs of characters.

Characters are taken two by two, an odd one out with an end sign, and a text of even
length closes with a pair of end signs.  The first bit tells a coded text (0) from one
with other than ASCII characters, which is stored as UTF-8 behind a byte of ones.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable

END = "\0"


def pairs(text: str) -> list[str]:
    """The pairs of a text; the last one ends it."""
    out = [text[k : k + 2] for k in range(0, len(text) - 1, 2)]
    return [*out, text[-1] + END if len(text) % 2 else END + END]


def frequencies(texts: Iterable[str]) -> Counter:
    return Counter(p for t in texts if t.isascii() for p in pairs(t))


class Codec:
    """The code of a table of frequencies; equal tables give equal codes."""

    def __init__(self, counts: dict[str, int]):
        # Of equal weights the smallest pair goes first, so the order of the table does not matter.
        heap = [(n, p, p) for p, n in counts.items() if n > 0]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, first, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, first, (left, right)))
        self.root = heap[0][2] if heap else None
        #: Filled as bytes come; the nodes it knows by identity belong to ``root``.
        self.steps: dict[tuple[int, int], tuple[str, object, bool]] = {}
        self.bits: dict[str, str] = {}
        stack = [(self.root, "")] if heap else []
        while stack:
            node, bits = stack.pop()
            if isinstance(node, tuple):
                stack += [(node[0], bits + "0"), (node[1], bits + "1")]
            else:
                self.bits[node] = bits or "0"

    def compress(self, text: str) -> bytes:
        if not text.isascii() or any(p not in self.bits for p in pairs(text)):
            return b"\xff" + text.encode()
        bits = "0" + "".join([self.bits[p] for p in pairs(text)])
        return int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")

    def expand(self, data: bytes) -> str:
        """The text of coded bytes, a byte a step: a table tells what a node of the code and a byte give, and the node after it."""
        if data[0] & 1:
            return data[1:].decode()
        out, node, ended = [], None, False
        for byte in data:
            known = self.steps.get((id(node), byte))
            if known is None:
                known = self.steps[id(node), byte] = self._step(node, byte)
            text, node, ended = known
            out.append(text)
            if ended:
                return "".join(out)
        raise ValueError("a text without an end")

    def _step(self, node, byte: int) -> tuple[str, object, bool]:
        """What ``byte`` gives from ``node`` on: text, the next node, and whether the text has ended; None is before the first bit, which is none of the code."""
        text, first = [], 0
        if node is None:
            node, first = self.root, 1
        for k in range(first, 8):
            if isinstance(node, tuple):
                node = node[byte >> k & 1]
            if not isinstance(node, tuple):
                if END in node:
                    return "".join(text) + node.rstrip(END), node, True
                text.append(node)
                node = self.root
        return "".join(text), node, False
