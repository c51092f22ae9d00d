"""Exact deduplication by Grace hashing.

1. Each task combines its own rows first: an open-addressing table per block of
   bounded bytes finds rows of equal content, so that of a group of copies one
   row per block goes on, with its count and its best id.
2. These rows are dealt to partitions by the SHA-256 of the normalised content.
3. A task that gets more content than its table may hold partitions its records
   by further bits of the hash into spill files, recursively, until a bucket
   fits; each bucket is then read into an open-addressing table, whose probes
   compare complete content, never digests alone.  Spill files are zstd
   compressed scratch of the one task that writes and reads them, as Spark's own
   sorter has it; they end with the task, and a retry starts anew.

Contents are equal when identical after lower-casing A-Z only; null counts as
the empty text.  Of equal contents the row with the largest id stays.  A null id
sorts below all others; among rows with equal content and equal id the first in
(block, position) order stays, so exactly one row of every group does.  Empty
tables give no rows; empty and very long texts are ordinary contents (a content
larger than the table's limit gets a bucket of its own).  ``dedup_rows`` keeps
all columns of its input whatever their names; ``classes`` reads only the two
named.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, shuffle_width, table, written

#: Content bytes and rows of one block of the combining pass.
BLOCK_BYTES, BLOCK_ROWS = 48 << 20, 50_000
#: Bytes of contents and records that the table of one bucket may hold.
TABLE_BYTES = 64 << 20
#: What an entry of a table takes besides content and record.
ENTRY_BYTES = 200
#: Hash bits, and so files, of one level of partitioning.
LEVEL_BITS = 4
_NULL_ID = -(1 << 63)


def normalise(text: str | None) -> bytes:
    """The content compared: UTF-8 with A-Z lowered (``bytes.lower`` leaves other letters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class OpenTable:
    """Open addressing with linear probing; equal keys have equal digest and equal complete content."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self.contents)

    def add(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """The entry's number, and whether it is new."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[24:32], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots = [-1] * size
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[24:32], "little") & (size - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (size - 1)
            self.slots[at] = entry


class _Spill:
    """Length-prefixed records in one compressed file."""

    _HEAD = struct.Struct("<II")

    def __init__(self, path: str):
        self.path, self.bytes, self.keys = path, 0, set()
        self._file = open(path, "wb")
        self._out = zstandard.ZstdCompressor(level=1).stream_writer(self._file)

    def put(self, head: bytes, content: bytes, digest: bytes) -> None:
        self._out.write(self._HEAD.pack(len(head), len(content)))
        self._out.write(head)
        self._out.write(content)
        self.bytes += len(content)
        if len(self.keys) < 2:
            self.keys.add(digest)

    def close(self) -> None:
        self._out.close()
        self._file.close()

    def read(self) -> Iterator[tuple[bytes, bytes]]:
        with open(self.path, "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as src:
            while len(head := src.read(self._HEAD.size)) == self._HEAD.size:
                a, b = self._HEAD.unpack(head)
                yield src.read(a), src.read(b)
        os.unlink(self.path)


class GraceTable:
    """Groups records by complete content within bounded memory.

    ``add`` takes a digest, the content and an opaque record; ``groups`` yields
    lists of the records that share a content, folded by ``fold(old, new)``.
    """

    def __init__(self, fold, table_bytes: int = TABLE_BYTES, level: int = 0, scratch: str | None = None):
        self.fold, self.limit, self.level = fold, table_bytes, level
        self.table, self.records, self.held = OpenTable(), [], 0
        self.scratch, self._own, self.files = scratch, None, None

    def _bucket(self, digest: bytes) -> int:
        bits = int.from_bytes(digest[:16], "big")
        return (bits >> (128 - LEVEL_BITS * (self.level + 1))) & ((1 << LEVEL_BITS) - 1)

    def add(self, digest: bytes, content: bytes, record: bytes) -> None:
        if self.files is not None:
            self.files[self._bucket(digest)].put(digest + record, content, digest)
            return
        entry, new = self.table.add(digest, content)
        if new:
            self.records.append(record)
            self.held += len(content) + len(record) + ENTRY_BYTES
        else:
            old = self.records[entry]
            before = len(old)
            self.records[entry] = folded = self.fold(old, record)
            self.held += len(folded) - before
        # A bucket of a single digest cannot be split further; distinct contents of one digest do not occur in practice.
        if self.held > self.limit and len(self.table) > 1 and LEVEL_BITS * (self.level + 1) <= 128:
            self._spill()

    def _spill(self) -> None:
        if self.scratch is None:
            self._own = tempfile.TemporaryDirectory(prefix="grace-")
            self.scratch = self._own.name
        self.files = []
        for k in range(1 << LEVEL_BITS):
            fd, path = tempfile.mkstemp(dir=self.scratch, prefix=f"l{self.level}b{k}-")
            os.close(fd)
            self.files.append(_Spill(path))
        for digest, content, record in zip(self.table.digests, self.table.contents, self.records):
            self.files[self._bucket(digest)].put(digest + record, content, digest)
        self.table, self.records, self.held = OpenTable(), [], 0

    def groups(self) -> Iterator[tuple[bytes, bytes, bytes]]:
        """(digest, content, folded record) of each distinct content."""
        try:
            if self.files is None:
                yield from zip(self.table.digests, self.table.contents, self.records)
                return
            for f in self.files:
                f.close()
            for f in self.files:
                part = GraceTable(self.fold, self.limit, self.level + 1, self.scratch)
                for head, content in f.read():
                    part.add(head[:32], content, head[32:])
                yield from part.groups()
        finally:
            if self._own is not None:
                self._own.cleanup()


_FORM = "<qqqq"  # best id, rows, block, position
_FORM_BYTES = struct.calcsize(_FORM)


def _fold(a: bytes, b: bytes) -> bytes:
    """Counts add up; the larger id wins, then the earlier block and position."""
    x, y = struct.unpack_from(_FORM, a), struct.unpack_from(_FORM, b)
    n = x[1] + y[1]
    best, tail = (y, b) if (y[0], -y[2], -y[3]) > (x[0], -x[2], -x[3]) else (x, a)
    return struct.pack(_FORM, best[0], n, best[2], best[3]) + tail[_FORM_BYTES :]


def _blocks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str):
    """Rows of a task in blocks of bounded size: (block key, [(position, id, raw, row)])."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    block, held, number, seen = [], 0, 0, 0
    for batch in batches:
        ids, texts = batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()
        for k, (i, t) in enumerate(zip(ids, texts)):
            raw = (t or "").encode("utf-8", "surrogatepass")
            block.append((seen, _NULL_ID if i is None else i, raw, (batch, k)))
            held, seen = held + len(raw), seen + 1
            if held >= BLOCK_BYTES or len(block) >= BLOCK_ROWS:
                yield part + number, block
                block, held, number = [], 0, number + 1
    if block:
        yield part + number, block


MEMBER = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("rep_block", T.LongType()),
        T.StructField("rep_pos", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("sha256", T.BinaryType()),
        T.StructField("rows", T.LongType()),
        T.StructField("best_id", T.LongType()),
        T.StructField("best_pos", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(MEMBER)
    for key, block in _blocks(batches, "doc_id", "text"):
        seen, entries, sums = OpenTable(), [], []
        for pos, i, raw, _ in block:
            content = raw.lower()
            digest = hashlib.sha256(content).digest()
            e, new = seen.add(digest, content)
            if new:
                sums.append([0, i, pos, pos])
            s = sums[e]
            s[0] += 1
            if i > s[1]:
                s[1], s[2] = i, pos
            entries.append(e)
        out, size = [], 0
        for (pos, i, _, _), e in zip(block, entries):
            rows, best, best_pos, first = sums[e]
            lead = pos == first
            out.append((None if i == _NULL_ID else i, key, first, pos, seen.digests[e], rows if lead else None, best if lead else None, best_pos if lead else None, seen.contents[e] if lead else None))
            size += len(seen.contents[e]) if lead else 100
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


CLASS = T.StructType(
    [
        T.StructField("rep_block", T.LongType()),
        T.StructField("rep_pos", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("keep_block", T.LongType()),
        T.StructField("keep_pos", T.LongType()),
    ]
)
_REP_FORM = "<qq"
_PLACE = "<qq"  # batch and row in a scratch file


def _fold_listing(a: bytes | bytearray, b: bytes) -> bytearray:
    """As _fold, and the (block, position) of every combined row is kept behind the record, which grows in place."""
    a = a if isinstance(a, bytearray) else bytearray(a)
    a[:_FORM_BYTES] = _fold(bytes(a[:_FORM_BYTES]), b[:_FORM_BYTES])
    a += b[_FORM_BYTES:]
    return a


def _grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, grace = to_arrow_schema(CLASS), GraceTable(_fold_listing)
    for batch in batches:
        for block, pos, digest, rows, best, best_pos, content in zip(*(batch.column(c).to_pylist() for c in ("rep_block", "rep_pos", "sha256", "rows", "best_id", "best_pos", "content"))):
            grace.add(digest, content, struct.pack(_FORM, best, rows, block, best_pos) + struct.pack(_REP_FORM, block, pos))
    out = []
    for _, _, record in grace.groups():
        best, rows, block, pos = struct.unpack_from(_FORM, record)
        keep = None if best == _NULL_ID else best
        for rep in struct.iter_unpack(_REP_FORM, record[_FORM_BYTES :]):
            out.append((*rep, keep, rows, block, pos))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    del grace
    release()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    combined = written(rows.mapInArrow(_combine, MEMBER), "exact-combined")
    found = (
        combined.filter(F.col("content").isNotNull())
        .select("rep_block", "rep_pos", "sha256", "rows", "best_id", "best_pos", "content")
        .repartition(shuffle_width(spark), "sha256")
        .mapInArrow(_grace, CLASS)
    )
    return combined.select("doc_id", "rep_block", "rep_pos", "position", "sha256").join(found, ["rep_block", "rep_pos"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("rep_block") == F.col("keep_block")) & (F.col("position") == F.col("keep_pos"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    The row itself travels with its digest, so the kept rows come from the task that
    compares them and no join back to the input is needed.  There it waits in a
    compressed scratch file, and the Grace table holds its place in that file.
    """
    spark, schema = docs.sparkSession, docs.schema
    own = []
    for name in ("digest", "record"):
        while name in schema.fieldNames() or name in own:
            name += "_"
        own.append(name)
    carried = T.StructType([*(T.StructField(name, T.BinaryType()) for name in own), *schema.fields])
    text_at, id_at = schema.fieldNames().index(text_col), schema.fieldNames().index(id_col)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(carried)
        names = [f"c{k}" for k in range(len(schema.fields))]
        plain = (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        for key, block in _blocks(plain, names[id_at], names[text_at]):
            seen, sums = OpenTable(), []
            for pos, i, raw, row in block:
                content = raw.lower()
                e, new = seen.add(hashlib.sha256(content).digest(), content)
                if new:
                    sums.append([0, i, pos, row])
                sums[e][0] += 1
                if i > sums[e][1]:
                    sums[e][1:] = [i, pos, row]
            picks: dict[int, tuple[pa.RecordBatch, list]] = {}
            for e, (n, i, pos, (batch, k)) in enumerate(sums):
                picks.setdefault(id(batch), (batch, []))[1].append((k, seen.digests[e], struct.pack(_FORM, i, n, key, pos)))
            for batch, chosen in picks.values():
                taken = batch.take(pa.array([k for k, _, _ in chosen]))
                heads = [pa.array([d for _, d, _ in chosen], pa.binary()), pa.array([r for _, _, r in chosen], pa.binary())]
                yield pa.RecordBatch.from_arrays([*heads, *(c.cast(f.type) for c, f in zip(taken.columns, list(out)[2:]))], schema=out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, grace = to_arrow_schema(schema), GraceTable(_fold)
        with tempfile.TemporaryFile(prefix="grace-rows-") as file:
            with pa.ipc.new_stream(file, out, options=pa.ipc.IpcWriteOptions(compression="zstd")) as spool:
                for number, batch in enumerate(batches):
                    spool.write_batch(pa.RecordBatch.from_arrays(batch.columns[2:], schema=out))
                    texts = batch.column(2 + text_at)
                    for k, (digest, record) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                        grace.add(digest, normalise(texts[k].as_py()), record + struct.pack(_PLACE, number, k))
            places = np.sort(np.array([number << 32 | k for _, _, record in grace.groups() for number, k in [struct.unpack_from(_PLACE, record, _FORM_BYTES)]], np.int64))
            file.seek(0)
            with pa.ipc.open_stream(file) as rows:
                for number, batch in enumerate(rows):
                    a, b = np.searchsorted(places, [number << 32, number + 1 << 32])
                    if a < b:
                        yield batch.take(pa.array(places[a:b] & 0xFFFFFFFF))
        del grace
        release()

    return docs.mapInArrow(lead, carried).repartition(shuffle_width(spark), own[0]).mapInArrow(keep, schema)


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among ``documents``: one row per document, dropped ones too."""
    return classes(table(spark, sf_dir, "documents"))


SQL = {
    "op3_grace_dedup": """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as content from documents)
select doc_id, max(doc_id) over (partition by content) as keep_id,
       count(*) over (partition by content) as group_size,
       row_number() over (partition by content order by doc_id desc nulls last) = 1 as kept,
       sha256(content) as text_sha256
from t""",
}
QUERIES = {"op3_grace_dedup": op3_grace_dedup}
