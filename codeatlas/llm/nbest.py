"""N-best segmentation over a piece lattice, and decoding.

The lattice of a text has an arc for every vocabulary piece that occurs in it.  A
forward Viterbi pass gives each position the best score of reaching it; these are
exact heuristics for an A-star search from the end backwards, which therefore takes
out complete segmentations best first and follows no path that is not among the N
best.

No piece reaches over two neighbouring characters that the vocabulary has nowhere
side by side, so the lattice of a text is a chain of the lattices of the parts between
such pairs.  The forward pass runs over all new parts of a block of texts together, and
its results are kept in a bounded table.  It gives each part the score of its second
best path too, from which the chain tells the few parts whose alternatives can matter;
only these are searched backwards.  It is a map without a shuffle.

Scores: the vocabulary file is one of merges and carries ranks, not probabilities; a
piece of rank r has the Zipf probability 1 / ((r + 2) H).  A character outside the
vocabulary becomes its UTF-8 bytes, each less likely than any piece.  Ties are
broken by the earlier, then the smaller change against the best segmentation, and
within a part by the order of the search.

A null text is empty: one segmentation with no pieces.  Texts with the white space
mark U+2581 itself decode to spaces, as with any model of this kind, and say so in
``round_trip``.  A null id is carried as null, repeated rows are segmented each.
Empty tables give no rows.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import math
import struct
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, table

MODEL_FILE = "piece_bpe_32k.model"
N_BEST = 4
#: Parts that a worker keeps, their piece ids in all, and parts of whose other segmentations.
KEPT_PARTS, KEPT_IDS, KNOWN_PARTS = 250_000, 4_000_000, 20_000
#: Characters of a block of texts, parts looked up at a time, and characters up to which a part is passed with others.
BLOCK_CHARS, LOOK_UP, TOGETHER = 500_000, 200_000, 32
MARK = "▁"


class Lattice:
    """Vocabulary, scores and the search over one word."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL_FILE))
        size = model.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        #: The pieces as a trie by character; "" leads to the ids and score of the piece that ends there.
        self.root: dict = {}
        self.bytes: list[int] = [0] * 256
        #: Neighbouring characters that some piece holds; a text can be cut between any others.
        self.joined: set[str] = set()
        norm = math.log(math.log(size) + 0.5772)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[value := int(piece[3:5], 16)] = i
                self.surface[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                rank = min(-model.get_score(i), size)
                self.joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
                node = self.root
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[""] = ((i,), -math.log(rank + 2) - norm)
                self.surface[i] = piece.encode()
        self.single = {ch for ch, node in self.root.items() if "" in node}
        self.byte_score = -math.log(4 * size) - norm
        self._arrays()

    def _arrays(self) -> None:
        """The trie and the pairs of neighbours as arrays, by classes of characters."""
        plain, paired = sorted(self.single), sorted({ch for pair in self.joined for ch in pair})
        of, self.char_class, self.pair_class = {}, np.zeros(0x110000, np.uint16), np.zeros(0x110000, np.uint16)
        for k, ch in enumerate(plain, 1):
            of[ch] = self.char_class[ord(ch)] = k
        for k, ch in enumerate(paired, 1):
            self.pair_class[ord(ch)] = k
        self.pairs = np.zeros((len(paired) + 1, len(paired) + 1), bool)
        for one, two in self.joined:
            self.pairs[self.pair_class[ord(one)], self.pair_class[ord(two)]] = True
        self.width = len(plain) + 1
        nodes, steps, self.piece_score, self.piece_length = [(self.root, 0)], [], np.zeros(len(self.surface)), np.zeros(len(self.surface), np.int64)
        ends = []
        for number, (node, depth) in enumerate(nodes):  # grows while it is walked
            end = node.get("")
            ends.append(end[0][0] if end else -1)
            if end:
                self.piece_score[end[0][0]], self.piece_length[end[0][0]] = end[1], depth
            for ch, child in node.items():
                if ch in of:
                    steps.append((number * self.width + of[ch], len(nodes)))
                    nodes.append((child, depth + 1))
        steps.sort()
        self.node_piece = np.array(ends)
        self.step_keys = np.array([k for k, _ in steps] + [1 << 62])
        self.step_nodes = np.array([n for _, n in steps] + [0])

    def cut(self, word: str) -> list[str]:
        """Parts between which no piece reaches, so that their lattices are independent."""
        joined = self.joined
        at = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])] if at else [word]

    def _bytes(self, ch: str) -> tuple[tuple[int, ...], float] | None:
        """Ids and score of a character that is not a piece."""
        if ch in self.single:
            return None
        raw = ch.encode("utf-8", "surrogatepass")
        return tuple([self.bytes[x] for x in raw]), self.byte_score * len(raw)

    def forward(self, word: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """Arcs (start, ids, score) by their end, and the best score of reaching each position."""
        n = len(word)
        ending: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-math.inf] * n
        for start in range(n):
            node, end = self.root, start
            for ch in word[start:]:
                node = node.get(ch)
                if node is None:
                    break
                end += 1
                if "" in node:
                    ids, score = node[""]
                    ending[end].append((start, ids, score))
                    best[end] = max(best[end], best[start] + score)
            if rare := self._bytes(word[start]):
                ending[start + 1].append((start, *rare))
                best[start + 1] = max(best[start + 1], best[start] + rare[1])
        return ending, best

    def two_best(self, word: str) -> tuple[float, float, list[int]]:
        """The best score, the second best one, and the best's ids: the forward pass alone, before any search."""
        n, root, single = len(word), self.root, self.single
        first, second = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        back: list[tuple[int, tuple[int, ...]] | None] = [None] * (n + 1)
        for start in range(n):
            one, two, node, end = first[start], second[start], root, start
            for ch in word[start:]:
                node = node.get(ch)
                if node is None:
                    break
                end += 1
                found = node.get("")
                if found is not None:
                    total = one + found[1]
                    if total > first[end]:
                        second[end] = max(first[end], two + found[1])
                        first[end] = total
                        back[end] = (start, found[0])
                    elif total > second[end]:
                        second[end] = total
            if word[start] not in single:
                rare = self._bytes(word[start])
                total, end = one + rare[1], start + 1
                if total > first[end]:
                    second[end], first[end], back[end] = max(first[end], two + rare[1]), total, (start, rare[0])
                elif total > second[end]:
                    second[end] = total
        path, at = [], n
        while at:
            at, ids = back[at]
            path.append(ids)
        return first[n], second[n], [i for ids in reversed(path) for i in ids]

    def two_best_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``two_best`` of many parts: best scores, losses of the second best, pieces, and the ids one part after another."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        classes = self.char_class[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(lengths) - lengths
        together = (lengths <= TOGETHER) & (np.add.reduceat((classes == 0).astype(np.int64), begins) == 0)
        rows = np.flatnonzero(together)
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        best, loss, count = np.zeros(len(parts)), np.zeros(len(parts)), np.zeros(len(parts), np.int64)
        best[rows], loss[rows], count[rows], packed = self._forward_many(classes.astype(np.int64), begins[rows], lengths[rows])
        owner, ids = [np.repeat(rows, count[rows])], [packed]
        for k in np.flatnonzero(~together).tolist():
            best[k], second, found = self.two_best(parts[k])
            loss[k], count[k] = best[k] - second, len(found)
            owner.append(np.full(len(found), k))
            ids.append(np.array(found, np.int64))
        order = np.argsort(np.concatenate(owner), kind="stable")
        return best, loss, count, np.concatenate(ids)[order].astype("<u4")

    def _forward_many(self, classes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass over many parts side by side, the longest first: one step for each start and each piece length."""
        n, size = len(lengths), int(lengths[0]) if len(lengths) else 0
        first, second, back = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int64)
        first[0] = 0
        reach = [int(np.count_nonzero(lengths >= k)) for k in range(size + 1)]  # the rows that have so many characters come first
        for start in range(size):
            at, node = np.arange(reach[start + 1]), np.zeros(reach[start + 1], np.int64)
            for end in range(start + 1, size + 1):
                few = int(np.searchsorted(at, reach[end]))
                at, node = at[:few], node[:few]
                key = node * self.width + classes[begins[at] + end - 1]
                step = np.searchsorted(self.step_keys, key)
                found = self.step_keys[step] == key
                at, node = at[found], self.step_nodes[step[found]]
                if not len(at):
                    break
                piece = self.node_piece[node]
                ends = piece >= 0
                row, piece = at[ends], piece[ends]
                score = self.piece_score[piece]
                total, was, other = first[start, row] + score, first[end, row], second[end, row]
                better = total > was
                second[end, row] = np.where(better, np.maximum(was, second[start, row] + score), np.maximum(other, total))
                first[end, row] = np.where(better, total, was)
                back[end, row[better]] = piece[better]
        at, every = lengths.copy(), np.arange(n)
        best, loss, row, steps = first[at, every], first[at, every] - second[at, every], every, []
        while len(row):
            piece = back[at, row]
            steps.append((row, piece))
            at = at - self.piece_length[piece]
            row, at = row[at > 0], at[at > 0]
        if not steps:
            return best, loss, np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate([r for r, _ in reversed(steps)])
        order = np.argsort(owner, kind="stable")
        return best, loss, np.bincount(owner, minlength=n), np.concatenate([p for _, p in reversed(steps)])[order]

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the ``n`` best segmentations, best first; fewer if there are fewer."""
        ending, best = self.forward(word)
        # The agenda holds (estimate of the whole, number, position, score so far, ids behind as a chain).  Estimates are
        # exact and agenda entries stand for different segmentations, so entries beyond those still wanted can be dropped.
        agenda: list[tuple] = [(-best[-1], 0, len(word), 0.0, None)]
        number, out = 0, []
        while agenda:
            _, _, at, score, chain = agenda.pop(0)
            if at == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                out.append((score, tuple(ids)))
                if len(out) == n:
                    break
                continue
            wanted = n - len(out)
            for start, piece, arc in ending[at]:
                total = score + arc
                estimate = -(total + best[start])
                if len(agenda) < wanted:
                    number += 1
                    insort(agenda, (estimate, number, start, total, (piece, chain)))
                elif estimate < agenda[-1][0]:
                    number += 1
                    agenda.pop()
                    insort(agenda, (estimate, number, start, total, (piece, chain)))
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation: surfaces in a row, marks as spaces, without the leading one."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


#: Another segmentation of a part: what it loses, its ids, and how many pieces more it has.
Other = tuple[float, bytes, int]


def pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def ways(losses: np.ndarray, others, n: int) -> list[tuple[float, tuple[tuple[int, Other], ...]]]:
    """The ``n`` least losses of a chain of parts, each with its changes (part, other) against the best, in text order.

    Only parts with the n - 1 least losses of their second best can change, and only for them ``others`` is asked.
    """
    few = min(n - 1, len(losses))
    if not few:
        return [(0.0, ())]
    limit = np.partition(losses, few - 1)[few - 1]
    where = np.flatnonzero(losses < limit).tolist()
    if limit < math.inf:  # ties in text order
        where += np.flatnonzero(losses == limit)[: few - len(where)].tolist()
    found: list[tuple[float, tuple[tuple[int, Other], ...]]] = [(0.0, ())]
    for p in sorted(where):
        more = [(total + other[0], (*way, (p, other))) for total, way in found for other in others(p)]
        found = sorted(found + more, key=lambda w: (w[0], [p for p, _ in w[1]]))[:n]
    return found


class Encoder:
    """N-best segmentation of whole texts; keeps the parts seen."""

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.n = lattice, n
        self.known: dict[str, list[Other]] = {}
        self.forget()

    def forget(self) -> None:
        """Drop what is kept of parts."""
        self.known.clear()
        self.index: dict[str, int] = {}
        self.best, self.loss, self.count, self.start, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _numbers(self, whole: str, bounds: np.ndarray) -> np.ndarray:
        """The rows of the parts of ``whole`` in the table, new ones added."""
        if len(self.index) > KEPT_PARTS or len(self.ids) > KEPT_IDS:
            self.forget()
        out = np.empty(len(bounds) - 1, np.int64)
        for k in range(0, len(out), LOOK_UP):
            at = bounds[k : k + LOOK_UP + 1].tolist()
            parts = [whole[a:b] for a, b in zip(at, at[1:])]
            if fresh := list(set(parts).difference(self.index)):
                best, loss, count, ids = self.lattice.two_best_many(fresh)
                self.index.update(zip(fresh, range(len(self.best), len(self.best) + len(fresh))))
                self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
                self.best, self.loss, self.count, self.ids = (np.concatenate(x) for x in ((self.best, best), (self.loss, loss), (self.count, count), (self.ids, ids)))
            out[k : k + len(parts)] = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        return out

    def others(self, part: str) -> list[Other]:
        """The second to n-th best segmentation of a part."""
        if (out := self.known.get(part)) is None:
            k = self.index[part]
            best, ids = self.best[k], self.ids[self.start[k] : self.start[k] + self.count[k]].tobytes()
            found = [(float(best - s), pack(other), len(other) - int(self.count[k])) for s, other in self.lattice.n_best(part, self.n)]
            out = [other for other in found if other[1] != ids][: self.n - 1]  # equals may come in another order
            if len(self.known) > KNOWN_PARTS:
                self.known.clear()
            if len(part) <= 64:
                self.known[part] = out
        return out

    def encode(self, text: str | None) -> list[tuple[float, bytes, int]]:
        """(score, little-endian 32-bit ids, pieces) of the N best segmentations, best first."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[tuple[float, bytes, int]]]:
        """``encode`` of each text of a block."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole, ends = "".join(marked), np.cumsum([len(m) for m in marked])
        if not whole:
            return [[(0.0, b"", 0)] for _ in texts]
        c = self.lattice.pair_class[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        apart = ~self.lattice.pairs[c[:-1], c[1:]]
        apart[ends[(ends > 0) & (ends < len(whole))] - 1] = True
        bounds = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(whole)]])
        rows = self._numbers(whole, bounds)
        count, losses, scores = self.count[rows], self.loss[rows], self.best[rows]
        stops = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[rows] - stops + count, count) + np.arange(stops[-1])].tobytes()
        out, a = [], 0
        for b in np.searchsorted(bounds, ends).tolist():
            if a == b:
                out.append([(0.0, b"", 0)])
                continue
            best, found = math.fsum(scores[a:b].tolist()), []
            begin, end = int(stops[a] - count[a]), int(stops[b - 1])
            for total, way in ways(losses[a:b], lambda p: self.others(whole[bounds[a + p] : bounds[a + p + 1]]), self.n):
                spliced, at, extra = [], begin, 0
                for p, other in way:
                    spliced += (ids[4 * at : 4 * int(stops[a + p] - count[a + p])], other[1])
                    at, extra = int(stops[a + p]), extra + other[2]
                spliced.append(ids[4 * at : 4 * end])
                found.append((best - total, b"".join(spliced), end - begin + extra))
            out.append(found)
            a = b
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None, n: int) -> Encoder:
    """One encoder for each worker process."""
    if (path, n) not in _ENCODERS:
        _ENCODERS[path, n] = Encoder(Lattice(path), n)
    return _ENCODERS[path, n]


SEGMENTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def ranked(coder: Encoder, text: str | None, found: list[tuple[float, bytes, int]] | None = None) -> Iterator[tuple[int, float, bytes, int, bool]]:
    """(rank, score, ids, pieces, whether the ids decode to the text) of the segmentations of a text (``found``, if they are known).

    Ids that spell the bytes of others which decode to the text do so too; where two begin and end alike, what is between tells.
    """
    surface, good = coder.lattice.surface, None

    def same(ids: np.ndarray) -> bool:
        nonlocal good
        if good is not None:
            few = min(len(ids), len(good))
            head = few if not (d := ids[:few] != good[:few]).any() else int(d.argmax())
            back = (ids[len(ids) - few + head :] != good[len(good) - few + head :])[::-1]
            tail = len(back) if not back.any() else int(back.argmax())
            one, two = (b"".join([surface[i] for i in x[head : len(x) - tail].tolist()]) for x in (ids, good))
            if one == two:
                return True
        try:
            if coder.lattice.decode(ids.tolist()) != (text or ""):
                return False
        except UnicodeDecodeError:
            return False
        good = ids
        return True

    for rank, (score, ids, pieces) in enumerate(coder.encode(text) if found is None else found, 1):
        yield rank, score, ids, pieces, same(np.frombuffer(ids, "<u4"))


def segment(docs: DataFrame, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document and rank (from 1): score, ids (little-endian 32-bit), pieces, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, coder = to_arrow_schema(SEGMENTED), encoder(path, n)

        def block(docs: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
            found = coder.encode_many([t for _, t in docs])
            out = [(doc, *row) for (doc, text), f in zip(docs, found) for row in ranked(coder, text, f)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        held, chars = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((doc, text))
                chars += len(text or "") + 20
                if chars > BLOCK_CHARS:
                    yield block(held)
                    held, chars = [], 0
        if held:
            yield block(held)
        release(coder.forget)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEGMENTED)


def op9_n_best_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, one row each, ids as their crc32."""
    return segment(table(spark, sf_dir, "documents")).select(
        "doc_id", "rank", F.round("score", 6).alias("score"), "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip"
    )


SQL: dict[str, str] = {}
QUERIES = {"op9_n_best_segmentation": op9_n_best_segmentation}
