"""Online packing of token sequences by the sum-of-squares rule.

Each document becomes its token ids and the closing id 0.  Whole windows are cut
off first; what is left is placed into the fill level that minimises the sum of
squared counts of partially filled windows, kept in an array by level.  Levels
then stay evenly used, so later documents find a gap of their size.  When open
windows hold more than ``OPEN_TOKENS`` (documents of little over half a window never
fill any), and when a task's stream ends, the emptiest of them are cut up to complete
the fullest, so that a task pads one window at most.

Every task packs its own rows in one pass without a shuffle; at any time it holds
``OPEN_TOKENS`` and one document.  A retry of a task gives the same windows, since ids and
order depend on the partition alone.  Sequence ids are (partition << 40) + number.

Ids are those of ``byte_bpe_50k.json``.  The merges run on the rank file of the same
vocabulary, several times as fast, and ids of a word with its leading
space are kept in a bounded cache: a space before a non-space always begins a new
piece of the splitting pattern, so text cut there encodes part by part.  An added
token of the vocabulary that stands in a text gets its one id, as in the tokenizer;
``ByteBpe.encode`` alone takes it as ordinary text.

A null text is empty and gives the one id 0.  A null id is carried as null.
Repeated rows are packed as often as they occur.  Empty tables give no rows.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, table

WINDOW = 1024
CLOSING_ID = 0
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The vocabulary's added tokens.
ADDED = {"<|endoftext|>": 50256}
CACHE_ENTRIES = 200_000
#: Tokens that open windows may hold, where each piece counts as ``PIECE_TOKENS`` more.
OPEN_TOKENS, PIECE_TOKENS = 2_000_000, 32


class _Cache(dict):
    """Text to the little-endian 32-bit ids of ``lead + text``."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, text: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = np.array(self.encode(self.lead + text), "<u4").tobytes()
        if len(text) <= 64:
            self[text] = ids
        return ids


class ByteBpe:
    """Encodes texts to bytes of little-endian unsigned 32-bit ids."""

    _odd_space = re.compile(r" (?:\s|\Z)")
    _before_word = re.compile(r"(?= \S)")

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        path = f"{folder}/{RANK_FILE}" if folder else public_tokenizers.path(RANK_FILE)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.spaced = _Cache(encoding.encode_ordinary, ""), _Cache(encoding.encode_ordinary, " ")

    _added = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")

    def encode_added(self, text: str) -> bytes:
        """The ids with those of added tokens, around which the text is encoded part by part."""
        parts = self._added.split(text)
        if len(parts) == 1:
            return self.encode(text)
        return b"".join([np.array([ADDED[x]], "<u4").tobytes() if k % 2 else self.encode(x) for k, x in enumerate(parts) if x])

    def forget(self) -> None:
        """Drop what is kept of words."""
        self.plain.clear()
        self.spaced.clear()

    def encode(self, text: str) -> bytes:
        if self._odd_space.search(text):
            return b"".join([self.plain[u] for u in self._before_word.split(text) if u])
        first, *rest = text.split(" ")
        return b"".join([self.plain[first] if first else b"", *map(self.spaced.__getitem__, rest)])


_ENCODERS: dict[str | None, ByteBpe] = {}


def encoder(folder: str | None = None) -> ByteBpe:
    """One encoder for each worker process."""
    if folder not in _ENCODERS:
        _ENCODERS[folder] = ByteBpe(folder)
    return _ENCODERS[folder]


class SumOfSquares:
    """Places sizes below ``window`` online; full windows are handed out at once.

    A piece is (document row, start, ids, document tokens).
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self._empty()

    def _empty(self) -> None:
        window = self.window
        #: Open windows by level.
        self.count = np.zeros(window + 1, np.int64)
        #: What one more open window at a level adds to the sum; a full one adds nothing.
        self.gain = np.ones(window + 1, np.int64)
        self.gain[window] = 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        #: What open windows hold, as ``OPEN_TOKENS`` counts it.
        self.held = 0

    def _shift(self, level: int, by: int) -> None:
        if 0 < level < self.window:
            self.count[level] += by
            self.gain[level] += 2 * by

    def level_for(self, size: int) -> int:
        """The level to place at; 0 opens a window.  Ties go to the fullest."""
        last = self.window - size
        here = self.count[1 : last + 1]
        change = np.where(here > 0, self.gain[1 + size : last + 1 + size] - 2 * here + 1, np.iinfo(np.int64).max)
        best = last - int(np.argmin(change[::-1])) if last else 0
        return best if best and change[best - 1] <= self.gain[size] else 0

    def place(self, piece: tuple, size: int) -> list | None:
        """The window as a list of pieces if this one fills it."""
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        self._shift(level, -1)
        if level + size == self.window:
            self.held -= level + PIECE_TOKENS * len(window)
            return [*window, piece]
        window.append(piece)
        self.held += size + PIECE_TOKENS
        self._open(window, level + size)
        return None

    def _open(self, window: list[tuple], level: int) -> None:
        self._shift(level, 1)
        self.open[level].append(window)

    def drain(self, last: bool = True) -> Iterator[list]:
        """The open windows, the emptiest cut up to complete the fullest; one that is left over stays open but for the ``last`` time."""
        left = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        self._empty()
        lo, hi = 0, len(left) - 1
        pending: list[tuple] = []
        rest: list[tuple] = []
        while lo <= hi:
            level, window = left[lo]
            lo += 1
            while level < self.window:
                if not pending:
                    if lo > hi:
                        break
                    pending = left[hi][1]
                    hi -= 1
                row, start, ids, total = pending.pop()
                room = 4 * (self.window - level)
                window.append((row, start, ids[:room], total))
                level += min(len(ids), room) // 4
                if len(ids) > room:
                    pending.append((row, start + room // 4, ids[room:], total))
            if level < self.window:
                rest = window
            else:
                yield window
        rest = rest or pending
        if rest and last:
            yield rest
        elif rest:
            size = sum(len(ids) for _, _, ids, _ in rest) // 4
            self.held = size + PIECE_TOKENS * len(rest)
            self._open(rest, size)


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_rows(rows: Iterator[tuple[int | None, str | None]], window: int, encode, open_tokens: int = OPEN_TOKENS) -> Iterator[list[tuple]]:
    """Windows of (doc_id, start, ids, document tokens) for a stream of rows."""
    packer, closing, step = SumOfSquares(window), np.array([CLOSING_ID], "<u4").tobytes(), 4 * window
    for doc, text in rows:
        ids = encode(text or "") + closing
        total = len(ids) // 4
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield [(doc, at // 4, ids[at : at + step], total)]
        if whole < len(ids):
            full = packer.place((doc, whole // 4, ids[whole:], total), (len(ids) - whole) // 4)
            if full is not None:
                yield full
            elif packer.held > open_tokens:
                yield from packer.drain(last=False)
    yield from packer.drain()


def pack_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Pieces with their token ids (``ids``: little-endian unsigned 32-bit)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PIECE)
        base = TaskContext.get().partitionId() << 40
        rows = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        out: list[tuple] = []
        coder = encoder(folder)
        for number, pieces in enumerate(pack_rows(rows, window, coder.encode_added)):
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, ids, total, base + number, offset))
                offset += n
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release(coder.forget)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, PIECE)


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


SQL: dict[str, str] = {}
QUERIES = {"op5_sum_of_squares_packing": op5_sum_of_squares_packing}
