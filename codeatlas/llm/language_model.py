"""Scoring of texts by a trigram model in Elias-Fano tries.

Tokens are the words of a text, A-Z lower-cased, and one end.  The model smooths each
order towards the next lower one by a Dirichlet prior, so probabilities add up to 1:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v w) + MU2 p(w)) / (c(v) + MU2)
    p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3)

with all counts of all training texts.  What a lower order passes on is quantised, in steps
of 1 / 2048 of a decade, so the score of a text is a whole number of steps, the same however
the work was cut.

Texts are cut into blocks.  A block numbers its own words; everything that leaves it is a
packed message of whole arrays, one for each shard.

1. *Words* go to the shard of their hash, which adds up their counts and gives them global
   numbers, frequent words small ones; each block gets numbers and counts back.
2. *Trigrams* (u, v, w) of all texts, with the text they are in and its part in the
   training counts, go to the shard of their middle word, where c(u v), c(v w) and c(u v w)
   are complete.  There the trie is built from the training trigrams, saved and mapped, all
   trigrams are looked up in it, and sums of steps by text go back.
3. Sums of a block meet what it knows of its texts.

A middle word with a good part of all tokens would be a hot shard.  Words that hold at least
``1 / (2 * shards)`` of the tokens (at most two a shard, found by a first pass) are
therefore split: pairs that begin with one take part in step 1 as words do, so c(v w) of a
hot v is known beforehand and its trigrams go to the shard of (v, u); where u is hot too,
c(u v w) is counted in step 1 as well and nothing is sent at all.  Results do not depend
on it.

Messages are as large as the block, shards hold about ``SHARD_BYTES`` of text whatever the
corpus holds, and a text of any length is cut into pieces that keep their two words of
context.  Rows are known by their place in the input, which must be a stored table.

A null text is empty and is its end alone; null ids are scored and never held out; repeated
rows count and are scored each.  Without training texts every token has probability 1.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, release, shuffle_width, table, written
from .elias_fano import STEPS, Trie, decoded, encoded
from .sharding import CRC_TABLE, crc_sql

#: Chosen on a fold of the training texts.
MU2, MU3 = 5000.0, 4.0
#: Text of a shard and of a block, tokens of a piece of a longer text.
SHARD_BYTES, BLOCK_BYTES, PIECE_TOKENS = 6 << 20, 5 << 20, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, and the end as the empty word.  Of bytes, only A-Z have lower case and only six are space."""
    return [*(text or b"").lower().split(), b""]


# Codes of the three orders, from exact counts.


def first_code(c: np.ndarray, n: int, types: int) -> np.ndarray:
    return encoded((c + 1) / (n + types + 1))


def weight_code(c: np.ndarray, mu: float) -> np.ndarray:
    """What a context seen ``c`` times leaves to the lower order."""
    return np.where(c > 0, encoded(mu / (c + mu)), 0)


def joined_code(c: np.ndarray, context: np.ndarray, lower: np.ndarray, mu: float) -> np.ndarray:
    """Of a word seen ``c`` times in a context seen ``context`` times; ``lower`` is its code one order below."""
    with np.errstate(divide="ignore"):
        return np.where(c > 0, encoded((np.maximum(c, 1) + mu * decoded(lower)) / (context + mu)), weight_code(context, mu) + lower)


# Messages.


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 (or of floats) in as few bytes as they need, byte planes apart, compressed."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        if a.dtype.kind != "f":
            most = int(a.max()) if len(a) else 0
            a = a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
        head.append(struct.pack("<cBq", a.dtype.kind.encode(), a.itemsize, len(a)))
        body.append(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1 + 10 * raw[0]
    for k in range(raw[0]):
        kind, size, n = struct.unpack_from("<cBq", raw, 1 + 10 * k)
        planes = np.frombuffer(raw, "u1", size * n, at).reshape(size, n)
        a = np.ascontiguousarray(planes.T).view(f"<{kind.decode()}{size}").ravel()
        out.append(a if kind == b"f" else a.astype(np.int64))
        at += size * n
    return out


def _message(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal key, which stand together; they are held only while their key lasts."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


# Blocks.


class Block(NamedTuple):
    """Pieces of texts as one stream of word numbers, each after its two words of context; word 0 is the boundary."""

    words: list[bytes]
    stream: np.ndarray
    sizes: np.ndarray
    rows: list[int]
    ids: list[int | None]
    train: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens proper in the stream, and the piece of each."""
        ends = np.cumsum(self.sizes)
        proper = np.ones(len(self.stream), bool)
        proper[ends - self.sizes] = proper[ends - self.sizes + 1] = False
        return np.flatnonzero(proper), np.repeat(np.arange(len(self.sizes)), self.sizes - 2)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """The columns of neighbours whose texts have up to ``size`` bytes; a longer text stands by itself."""
    held, total = [], 0
    for b in batches:
        start = 0
        for k, more in enumerate(pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()):
            if total and total + more >= size:
                yield _columns([*held, b.slice(start, k - start)])
                held, total, start = [], 0, k
            total += more + 1
        held.append(b.slice(start))
    if total:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(k) for b in batches]) for k in range(3)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, and how many each text has: those of ``tokens``, without an object for each."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())  # Arrow's ASCII functions treat bytes alone
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().view(pa.binary())
    full = pc.not_equal(pc.binary_length(words), 0)  # a space at either end leaves an empty word
    before = np.cumsum([0, *pc.list_value_length(split).to_pylist()])
    sums = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), np.diff(sums[before])


def _listed(words: pa.Array) -> list[bytes]:
    """The words as objects, which is several times as fast by way of one joined text."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
    return joined[0].as_py().split(b"\n") if len(words) else []


def _cuts(words: pa.Array, sizes: np.ndarray, piece: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(words, which places of the stream they take, stream lengths): all texts at once, or pieces of a single long one with two words of context."""
    if len(sizes) > 1 or len(words) < piece:
        ends = np.cumsum(sizes + 3)  # two boundaries before the words, an end behind them
        taken = np.ones(ends[-1], bool)
        taken[ends - 1] = taken[ends - sizes - 2] = taken[ends - sizes - 3] = False
        yield words, taken, sizes + 3
        return
    for k in range(0, len(words) + 1, piece):
        left, last = max(0, k - 2), k + piece > len(words)
        part, ahead = words.slice(left, k + piece - left), 2 - (k - left)
        taken = np.ones(ahead + len(part) + last, bool)
        taken[:ahead] = False
        if last:
            taken[-1] = False
        yield part, taken, np.array([len(taken)])


def blocks(batches: Iterator[pa.RecordBatch], part: int, block_bytes: int = BLOCK_BYTES, piece: int = PIECE_TOKENS) -> Iterator[tuple[int, Block]]:
    """Numbered blocks of (id, train, text) rows; the same for the same rows."""
    number, row = part << 32, part << 33
    for ids, train, texts in _runs(batches, block_bytes):
        words, sizes = _words(texts)
        rows, ids, train = list(range(row, row + len(sizes))), ids.to_pylist(), train.to_numpy(zero_copy_only=False).astype(bool)
        for found, taken, lengths in _cuts(words, sizes, piece):
            found = found.dictionary_encode()
            stream = np.zeros(len(taken), np.int64)
            stream[taken] = found.indices.to_numpy().astype(np.int64) + 1
            yield number, Block([b"", *_listed(found.dictionary)], stream, lengths, rows, ids, train)
            number += 1
        row += len(sizes)


class Hot(NamedTuple):
    """Pairs that begin with a hot word, and trigrams that begin with two, of a block; and where they stand."""

    pairs: np.ndarray  # rows (v, w)
    pair_counts: np.ndarray
    pair_keys: np.ndarray
    triples: np.ndarray  # rows (u, v, w)
    triple_counts: np.ndarray
    both: np.ndarray  # of each token: is it predicted from two hot words
    triple_of: np.ndarray  # of the tokens in ``both``


def hot_items(u: np.ndarray, v: np.ndarray, w: np.ndarray, learn: np.ndarray, hot: np.ndarray, n_words: int) -> Hot:
    from_hot, both = hot[v], hot[u] & hot[v]
    keys = np.concatenate([v[from_hot] * n_words + w[from_hot], u[both] * n_words + v[both]])
    weights = np.concatenate([learn[from_hot], np.zeros(int(both.sum()))])
    pair_keys, which = np.unique(keys, return_inverse=True)
    rank = np.cumsum(hot) - 1  # of a hot word
    n_hot = max(1, int(hot.sum()))
    triples, triple_of = np.unique((rank[u[both]] * n_hot + rank[v[both]]) * n_words + w[both], return_inverse=True)
    names = np.flatnonzero(hot)
    first, rest = np.divmod(triples, n_words * n_hot)
    second, third = np.divmod(rest, n_words)
    split = np.stack([names[first], names[second], third], 1) if len(triples) else np.zeros((0, 3), np.int64)
    return Hot(
        np.stack(np.divmod(pair_keys, n_words), 1),
        np.bincount(which, weights, len(pair_keys)).astype(np.int64),
        pair_keys,
        split,
        np.bincount(triple_of, learn[both], len(triples)).astype(np.int64),
        both,
        triple_of,
    )


def _trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, piece) of each token proper."""
    at, piece = block.places()
    return block.stream[at - 2], block.stream[at - 1], block.stream[at], piece


def _shards_of(words: list[bytes], found: Hot, shards: int) -> np.ndarray:
    """The shard of each item of a block: by the checksums of its words, which pairs and triples mix."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pair = (h[found.pairs[:, 0]] * _MIX) ^ h[found.pairs[:, 1]]
    triple = (((h[found.triples[:, 0]] * _MIX) ^ h[found.triples[:, 1]]) * _MIX) ^ h[found.triples[:, 2]]
    mixed = np.concatenate([h, (pair * _MIX) >> np.uint64(32), (triple * _MIX) >> np.uint64(32)])
    return (mixed % np.uint64(shards)).astype(np.int64)


def _items(block: Block, found: Hot) -> list[bytes]:
    words = block.words
    return words + [words[v] + b" " + words[w] for v, w in found.pairs.tolist()] + [words[u] + b" " + words[v] + b" " + words[w] for u, v, w in found.triples.tolist()]


def _sorted_parts(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in order) of each shard that occurs."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(shard[at[0]]), at


# What tasks do.


def _candidates(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Words with a hot share of a run of texts, and (without a word) the tokens of each run."""

    for _, _, texts in _runs(batches, BLOCK_BYTES):
        words, sizes = _words(texts)
        found, n = words.dictionary_encode(), len(words) + len(sizes)
        counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
        often = np.flatnonzero(counts * 2 * shards >= n)
        rows = [(None, n), *zip(found.dictionary.take(pa.array(often)).to_pylist(), counts[often].tolist())]
        if len(sizes) * 2 * shards >= n:
            rows.append((b"", len(sizes)))
        yield _message(rows, ["word", "n"], [pa.binary(), pa.int64()])
    release()


def _ask(batches: Iterator[pa.RecordBatch], shards: int, hot: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """(shard, block, words, counts): the words, hot pairs and hot triples of each block, with their training counts."""
    for number, block in blocks(batches, TaskContext.get().partitionId()):
        u, v, w, piece = _trigrams(block)
        learn = block.train[piece]
        found = hot_items(u, v, w, learn, np.fromiter(map(hot.__contains__, block.words), bool, len(block.words)), len(block.words))
        items = _items(block, found)
        counts = np.concatenate([np.bincount(w[learn], minlength=len(block.words)), found.pair_counts, found.triple_counts])
        rows = []
        for shard, at in _sorted_parts(_shards_of(block.words, found, shards)):
            rows.append((shard, number, zstandard.compress(b"\n".join([items[k] for k in at.tolist()]), 1), pack(counts[at])))
        yield _message(rows, ["shard", "block", "words", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])
    release()


def _answer(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(block, shard, data, types, tokens): numbers and counts for each block in the order it asked, and the totals of each shard once."""
    for shard, rows in _groups(batches, 0):
        listed = [pc.split_pattern(pa.array([zstandard.decompress(packed)], pa.binary()), pattern="\n").flatten() for _, _, packed, _ in rows]
        bounds = np.cumsum([0, *map(len, listed)])
        found = pa.concat_arrays(listed).dictionary_encode()
        del listed
        which, words = found.indices.to_numpy(), found.dictionary
        total = np.bincount(which, np.concatenate([unpack(counts)[0] for _, _, _, counts in rows]), len(words)).astype(np.int64)
        singles = np.flatnonzero(~pc.match_substring(words, " ").to_numpy(zero_copy_only=False))
        by = pa.table({"n": total[singles], "word": words.take(pa.array(singles))})
        singles = singles[pc.sort_indices(by, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()]
        numbers = np.zeros(len(words), np.int64)
        numbers[singles] = np.arange(len(singles)) * shards + shard
        known = total[singles]
        out = [(-1, shard, None, int((known > 0).sum()), int(known.sum()))]
        for (_, block, _, _), a, b in zip(rows, bounds, bounds[1:]):
            out.append((block, shard, pack(numbers[which[a:b]], total[which[a:b]]), None, None))
        yield _message(out, ["block", "shard", "data", "types", "tokens"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])
    release()


def _streams(batches: Iterator[pa.RecordBatch], shards: int, hot: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """(block, shard -1, data): a block without its words, but with the shard of each of its items."""
    for number, block in blocks(batches, TaskContext.get().partitionId()):
        u, v, w, piece = _trigrams(block)
        is_hot = np.fromiter(map(hot.__contains__, block.words), bool, len(block.words))
        found = hot_items(u, v, w, block.train[piece], is_hot, len(block.words))
        null = np.array([i is None for i in block.ids])
        ids = np.array([0 if i is None else i for i in block.ids], np.int64).view(np.uint64)
        data = pack(np.array([len(block.words)]), np.flatnonzero(is_hot), block.stream, block.sizes, np.array(block.rows), ids, null, block.train, _shards_of(block.words, found, shards))
        yield _message([(number, -1, data)], ["block", "shard", "data"], [pa.int64(), pa.int32(), pa.binary()])
    release()


def _numbered(rows: list[tuple]) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block, which words are hot, and number and count of each item, from a block's stream and its answers."""
    n, hot_words, stream, sizes, where, ids, null, train, shard = unpack(rows[0][2])
    hot = np.zeros(int(n[0]), bool)
    hot[hot_words] = True
    ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist())]
    numbers, counts = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
    answers = {r[1]: r[2] for r in rows[1:]}
    for k, at in _sorted_parts(shard):
        numbers[at], counts[at] = unpack(answers[k])  # arrays of another length would be those of another block, and raise
    return Block([b""] * len(hot), stream, sizes, where.tolist(), ids, train.astype(bool)), hot, numbers, counts


def _precise_sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``x``; runs are not empty."""
    return np.add.reduceat(x.astype(np.longdouble), np.cumsum(sizes) - sizes).astype(np.float64) if len(x) else np.zeros(0)


def _send(batches: Iterator[pa.RecordBatch], shards: int, n: int, types: int) -> Iterator[pa.RecordBatch]:
    """(shard, kind, block, data): the texts of each block (kind 0), with what is known without the tries, and trigrams (kind 1)."""
    for number, rows in _groups(batches, 0):
        block, hot, numbers, c = _numbered(rows)
        n_words, pieces = len(hot), len(block.sizes)
        u, v, w, piece = _trigrams(block)
        learn = block.train[piece]
        found = hot_items(u, v, w, learn, hot, n_words)
        pair_c, triple_c = c[n_words : n_words + len(found.pairs)], c[n_words + len(found.pairs) :]
        first = first_code(c[:n_words], n, types)

        def pair_count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return pair_c[np.searchsorted(found.pair_keys, a * n_words + b)]

        both = found.both
        bu, bv, bw = u[both], v[both], w[both]
        code2 = joined_code(pair_count(bv, bw), c[bv], first[bw], MU2)
        context = np.where((bu == 0) & (bv == 0), c[0], pair_count(bu, bv))  # both boundaries: any text begins so
        code = joined_code(triple_c[found.triple_of], context, code2, MU3)
        sums = np.bincount(piece[both], code, pieces).astype(np.int64)
        texts = pack(
            np.array(block.rows), np.array([0 if i is None else i for i in block.ids], np.int64).view(np.uint64), np.array([i is None for i in block.ids]), np.bincount(piece, minlength=pieces),
            np.bincount(piece, c[w] > 0, pieces).astype(np.int64), _precise_sums(np.log10(c[w] + 1.0), block.sizes - 2), sums,
        )
        out = [(number % shards, 0, number, texts)]

        rest = ~both
        u, v, w, piece = u[rest], v[rest], w[rest], piece[rest]
        key = (v * n_words + u) * n_words + w  # below 2^62, as BLOCK_BYTES of text hold fewer than 1.4 million distinct words
        order = np.argsort(key)  # equal trigrams of one text that do not meet are just sent twice
        key, piece = key[order], piece[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(key)))
        pick = order[at]
        u, v, w, piece = u[pick], v[pick], w[pick], piece[at]
        given = np.zeros(len(v), np.int64)  # 1 + the code of p(w | v) where v is hot
        h = hot[v]
        given[h] = 1 + joined_code(pair_count(v[h], w[h]), c[v[h]], first[w[h]], MU2)
        mixed = numbers[v].astype(np.uint64) * _MIX
        mixed = np.where(h, (mixed ^ numbers[u].astype(np.uint64)) * _MIX, mixed)
        shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        tagged = piece * 2 + block.train[piece]
        for k, at in _sorted_parts(shard):
            cv, cu, cw = v[at], u[at], w[at]
            out.append((k, 1, number, pack(numbers[cv], numbers[cu], numbers[cw], first[cw], c[cv], given[at], tagged[at], times[at])))
        yield _message(out, ["shard", "kind", "block", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])
    release()


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the rank of each."""
    most = int(x.max()) if len(x) else 0
    if most >= 1 << 25:
        return np.unique(x, return_inverse=True)
    seen = np.zeros(most + 1, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[x].astype(np.int64)


class Shard(NamedTuple):
    """The distinct trigrams of a shard in order of (v, u, w), their training counts, and which of them each entry is."""

    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    first: np.ndarray
    middle_count: np.ndarray
    given: np.ndarray
    count: np.ndarray
    which: np.ndarray


def gather(columns: list[np.ndarray]) -> Shard:
    v, u, w, first, middle, given, tagged, times = columns
    (vs, rv), (us, ru), (ws, rw) = _ranks(v), _ranks(u), _ranks(w)
    if len(vs) * len(us) * len(ws) < 1 << 62:
        key = (rv * len(us) + ru) * len(ws) + rw
    else:
        key = np.unique(rv * len(us) + ru, return_inverse=True)[1] * len(ws) + rw
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    pick = order[at]
    count = np.bincount(which, times * (tagged & 1), len(at)).astype(np.int64)
    return Shard(v[pick], u[pick], w[pick], first[pick], middle[pick], given[pick] - 1, count, which)


def build_trie(s: Shard) -> Trie:
    """The trie of the training trigrams of a shard."""
    v, u, w, first, middle, given, c = (x[s.count > 0] for x in (s.v, s.u, s.w, s.first, s.middle_count, s.given, s.count))
    if not len(v):
        none = np.zeros(0, np.int64)
        return Trie.build((none,) * 3, (none,) * 3, (none,) * 4)
    # (v, w) pairs, and the code of each: given where v is hot, else from the sum of its trigrams.
    ws, rw = _ranks(w)
    vs, rv = _ranks(v)
    key = rv * len(ws) + rw
    pairs, pair_of = np.unique(key, return_inverse=True)
    one = np.empty(len(pairs), np.int64)
    one[pair_of] = np.arange(len(v))
    summed = np.bincount(pair_of, c, len(pairs))
    pair_code = np.where(given[one] >= 0, given[one], joined_code(summed, middle[one], first[one], MU2))
    # (v, u) contexts, which stand together.
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    starts, context_of = np.flatnonzero(new), np.cumsum(new) - 1
    context = np.add.reduceat(c, starts)
    code = joined_code(c, context[context_of], pair_code[pair_of], MU3)
    return Trie.build((v[one], w[one], pair_code), (v[starts], u[starts], weight_code(context, MU3)), (v, u, pair_of, code))


def codes(trie: Trie, s: Shard) -> np.ndarray:
    """The code of every distinct trigram of the shard, by the trie."""
    pair, weight, third = trie.query(s.u, s.v, s.w)
    pair = np.where(s.given >= 0, s.given, np.where(pair >= 0, pair, weight_code(s.middle_count, MU2) + s.first))
    return np.where(third >= 0, third, np.maximum(weight, 0) + pair)


def _mapped(trie: Trie) -> Trie:
    """The trie from a file below the worker's scratch folder, which ends with its mapping."""
    dirs = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    handle, path = tempfile.mkstemp(suffix=".trie", dir=dirs[0] if dirs else None)
    os.close(handle)
    try:
        trie.save(path)
    except BaseException:
        os.unlink(path)
        raise
    return Trie.open(path, unlink=True)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, kind, data): texts as they are, and steps by piece of each block that sent trigrams."""
    names, types = ["block", "kind", "data"], [pa.int64(), pa.int32(), pa.binary()]
    for _, rows in _groups(batches, 0):
        for _, kind, block, data in rows:
            if kind == 0:
                yield _message([(block, 0, data)], names, types)
        sent = [(block, unpack(data)) for _, kind, block, data in rows if kind == 1]
        del rows[:]
        if not sent:
            continue
        columns = [np.concatenate([a[k] for _, a in sent]) for k in range(8)]
        bounds = np.cumsum([0, *(len(a[0]) for _, a in sent)])
        numbers = [block for block, _ in sent]
        del sent
        s = gather(columns)
        step = codes(_mapped(build_trie(s)), s)[s.which] * columns[7]
        piece = columns[6] >> 1
        out = []
        for block, a, b in zip(numbers, bounds, bounds[1:]):
            sums = np.bincount(piece[a:b], step[a:b]).astype(np.int64)
            out.append((block, 1, pack(sums)))
        del s, step, piece, columns
        yield _message(out, names, types)
    release()


def _gather_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, 0):
        where, ids, null, n, known, base, steps = unpack(rows[0][2])
        for _, _, data in rows[1:]:
            more = unpack(data)[0]
            steps[: len(more)] += more
        yield pa.RecordBatch.from_arrays(
            [pa.array(where), pa.array(ids, mask=null.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(steps)], ["row", "doc_id", "n_tokens", "n_known", "logs", "steps"]
        )
    release()


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score) of each row of the stored table ``docs``.

    ``learn`` says of a row whether the model learns from it.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("binary").alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(width, -(-size // SHARD_BYTES))

    counted = rows.mapInArrow(lambda b: _candidates(b, shards), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted, "lm-frequent")
    total = (counted.filter("word is null").first() or [None, 0])[1]
    # A word counts only in blocks where it has a hot share, so at most 2 * shards can reach that share of all tokens.
    hot = frozenset(bytes(r["word"]) for r in counted.filter(F.col("word").isNotNull() & (F.col("n") * 2 * shards >= total)).collect())

    asked = rows.mapInArrow(lambda b: _ask(b, shards, hot), "shard int, block long, words binary, counts binary")
    asked = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    answers = written(asked.mapInArrow(lambda b: _answer(b, shards), "block long, shard int, data binary, types long, tokens long"), "lm-words")
    types, n = (x or 0 for x in answers.agg(F.sum("types"), F.sum("tokens")).first())

    streams = rows.mapInArrow(lambda b: _streams(b, shards, hot), "block long, shard int, data binary")
    numbered = streams.unionByName(answers.filter("block >= 0").select("block", "shard", "data")).repartition(width, "block").sortWithinPartitions("block", "shard")
    sent = numbered.mapInArrow(lambda b: _send(b, shards, n, types), "shard int, kind int, block long, data binary")
    scored = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "block").mapInArrow(_score, "block long, kind int, data binary")
    texts = scored.repartition(width, "block").sortWithinPartitions("block", "kind")
    pieces = texts.mapInArrow(_gather_texts, "row long, doc_id long, n_tokens long, n_known long, logs double, steps long")
    summed = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "steps")))
    return summed.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + types + 1)))).alias("base_score"),
        (-F.col("steps") / F.lit(float(STEPS))).alias("score"),
    )


def op12_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those whose crc32 modulo 7 is not 2."""
    held_out = in_fold("doc_id", 7, 2)
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 7).alias("base_score"), "score")


def _code_sql(p: str) -> str:
    return f"cast(round(-{STEPS} * log10({p})) as bigint)"


def _joined_sql(c: str, context: str, lower: str, mu: float) -> str:
    kept = f"case when {context} > 0 then {_code_sql(f'{mu} / ({context} + {mu})')} else 0 end + {lower}"
    return f"case when {c} > 0 then {_code_sql(f'({c} + {mu} * pow(10.0, -{lower} / {STEPS}.0)) / ({context} + {mu})')} else {kept} end"


SQL = {
    "op12_elias_fano_scores": f"""
with {CRC_TABLE},
docs as materialized (
  select row_number() over () as row, doc_id, coalesce({crc_sql("encode(cast(doc_id as varchar))")} % 7 = 2, false) as held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') as words
  from documents, crc_table),
placed as (select row, held_out, words, unnest(range(1, len(words) + 1)) as k from docs),
grams as materialized (
  select row, held_out, words[k] as w, case when k > 1 then words[k - 1] else '' end as v, case when k > 2 then words[k - 2] else '' end as u from placed),
ones as materialized (select w, count(*) as c from grams where not held_out group by w),
pairs as materialized (select v, w, count(*) as c from grams where not held_out group by v, w),
contexts as materialized (select u, v, count(*) as c from grams where not held_out group by u, v),
triples as materialized (select u, v, w, count(*) as c from grams where not held_out group by u, v, w),
totals as materialized (select cast(coalesce(sum(c), 0) as bigint) as n, count(*) as types from ones),
counted as (
  select g.row, coalesce(a.c, 0) as c1, coalesce(m.c, 0) as cv, coalesce(b.c, 0) as c2, coalesce(x.c, 0) as cuv, coalesce(t.c, 0) as c3, n, types
  from grams g cross join totals
  left join ones a on a.w = g.w left join ones m on m.w = g.v
  left join pairs b on b.v = g.v and b.w = g.w
  left join contexts x on x.u = g.u and x.v = g.v
  left join triples t on t.u = g.u and t.v = g.v and t.w = g.w),
one as (select *, {_code_sql("(c1 + 1) / (n + types + 1)")} as k1 from counted),
two as (select *, {_joined_sql("c2", "cv", "k1", MU2)} as k2 from one),
three as (select *, {_joined_sql("c3", "cuv", "k2", MU3)} as k3 from two),
summed as (
  select row, count(*) as n_tokens, cast(count(*) filter (where c1 > 0) as bigint) as n_known, fsum(log10(c1 + 1)) - count(*) * log10(any_value(n + types + 1)) as base, sum(k3) as steps from three group by row)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, round(base, 7) as base_score, -cast(steps as double) / {STEPS} as score
from summed join docs using (row) cross join totals""",
}
QUERIES = {"op12_elias_fano_scores": op12_elias_fano_scores}
