"""Removal of repeated passages of lines.

A rolling hash over the hashes of the last ``SPAN`` lines ends a chunk where its value
is divisible by ``MEAN_LINES``, so that boundaries move with the content: an insertion
shifts the chunks behind it but does not change them.  Chunks of at least
``MIN_LINES`` lines that occur more than once anywhere are removed but for the first
occurrence, in the order of (id, row, line).  That is all ``remove_repeated`` does.

Boundaries do not fall on the ends of passages, so chunks alone leave the ends of most
of them, and all of those too short to hold a whole chunk (138 of 153 measured ones).
``remove_passages``, which the query runs, therefore adds to the chunks the pairs of
neighbouring lines and the lines of over ``LINE_WORDS`` words, as units of the same
kind: a line goes if it lies in a unit that also stands earlier without overlapping,
which takes out every repeated run of two or more lines to its ends.  Lines are
compared byte by byte first: Grace tables hold the complete bytes of all distinct
lines, and a digest that ever stood for two different lines takes part in no unit.
Every line removed has a copy that stays, but a run may stay in parts: where one of
its lines goes with an earlier run, that line's copy is elsewhere.  There lines are
compared without their line break, so a passage that ends a text is found too.

In ``remove_repeated``, within a task equal chunks are combined first, byte by byte, and one row per
distinct chunk and block goes on.  These are dealt by digest to Grace tables, which
compare complete bytes and spill what does not fit; only repeated chunks come out.
Occurrences meet them by digest, in a join of stored tables that AQE can split where
a chunk is very common, and each document's removals (bounded by the document) meet
its text by row number.  A digest that ever stood for two different contents would
keep all its chunks.

A null text is empty, has no lines and stays null.  Line breaks stay with their
lines, so what is not removed is kept byte for byte; a last line without one is a
line of its own kind.  A null id sorts before all others.  Repeated rows are copies:
their chunks stay once.  Empty tables give no rows.  Columns other than the two
named are ignored.  The input must be a stored table, whose rows keep their order
between two scans, since row numbers tie removals to texts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, shuffle_width, table, written
from .exact_dedup import GraceTable, OpenTable

SPAN, MEAN_LINES, MIN_LINES = 3, 4, 2
#: A line of more words than these is a passage by itself.
LINE_WORDS = 50
DIGEST_BYTES = 16
BLOCK_BYTES, BLOCK_CHUNKS, BLOCK_LINES, LINE_TABLE_BYTES = 24 << 20, 50_000, 200_000, 16 << 20
_BASE, _MASK, _NULL_ID = 0x9E3779B97F4A7C15, (1 << 64) - 1, -(1 << 63)


def cuts(hashes: list[int], span: int = SPAN, mean: int = MEAN_LINES) -> list[int]:
    """Where chunks end, in lines: content-defined, and at the end of the text."""
    drop = pow(_BASE, span, 1 << 64)
    out, rolling = [], 0
    for k, h in enumerate(hashes):
        rolling = rolling * _BASE + h & _MASK
        if k >= span:
            rolling = rolling - hashes[k - span] * drop & _MASK
        if (rolling >> 32) % mean == 0:
            out.append(k + 1)
    return out if not hashes or out and out[-1] == len(hashes) else [*out, len(hashes)]


def chunks(text: str | None, span: int = SPAN, mean: int = MEAN_LINES) -> list[tuple[bytes, int]]:
    """(bytes, lines) of the chunks of a text, which in a row give the text."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    ends = cuts([xxhash.xxh3_64_intdigest(line) for line in lines], span, mean)
    return [(b"".join(lines[a:b]), b - a) for a, b in zip([0, *ends], ends)]


MEMBER = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("digest", T.BinaryType())])
LEAD = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("count", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("first_row", T.LongType()), T.StructField("first_chunk", T.IntegerType()), T.StructField("content", T.BinaryType())]
)
REPEATED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first_row", T.LongType()), T.StructField("first_chunk", T.IntegerType())])
_FORM = "<qqqi"  # count, then the first occurrence: id, row, chunk


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _multi(batches: Iterator[pa.RecordBatch], min_lines: int, span: int, mean: int):
    for b in batches:
        for row, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            for k, (content, lines) in enumerate(chunks(text, span, mean)):
                if lines >= min_lines:
                    yield row, doc, k, content


def _fold(a: bytes, b: bytes) -> bytes:
    x, y = struct.unpack(_FORM, a), struct.unpack(_FORM, b)
    return struct.pack(_FORM, x[0] + y[0], *min(x[1:], y[1:]))


def remove_repeated(docs: DataFrame, min_lines: int = MIN_LINES, span: int = SPAN, mean: int = MEAN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, removed_chunks, removed_lines, clean_text), one row per input row."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = to_arrow_schema(MEMBER), []
        for row, doc, k, content in _multi(batches, min_lines, span, mean):
            out.append((row, doc, k, hashlib.sha256(content).digest()))
            if len(out) >= 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(LEAD)

        def flush(seen: OpenTable, records: list[bytes]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for digest, content, record in zip(seen.digests, seen.contents, records):
                out.append((digest, *struct.unpack(_FORM, record), content))
                size += len(content)
                if size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

        seen, records, held = OpenTable(), [], 0
        for row, doc, k, content in _multi(batches, min_lines, span, mean):
            e, new = seen.add(hashlib.sha256(content).digest(), content)
            record = struct.pack(_FORM, 1, _NULL_ID if doc is None else doc, row, k)
            if new:
                records.append(record)
                held += len(content)
            else:
                records[e] = _fold(records[e], record)
            if held > BLOCK_BYTES or len(records) > BLOCK_CHUNKS:
                yield from flush(seen, records)
                seen, records, held = OpenTable(), [], 0
        yield from flush(seen, records)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, grace, out = to_arrow_schema(REPEATED), GraceTable(_fold), []
        for b in batches:
            for digest, count, doc, row, k, content in zip(*(c.to_pylist() for c in b.columns)):
                grace.add(digest, content, struct.pack(_FORM, count, doc, row, k))
        for digest, _, record in grace.groups():
            count, _, row, k = struct.unpack(_FORM, record)
            if count > 1:
                out.append((digest, row, k))
                if len(out) >= 20_000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    occurrences = written(rows.mapInArrow(members, MEMBER), "line-chunks").select("row", "chunk", "digest")
    found = rows.mapInArrow(leads, LEAD).repartition(shuffle_width(spark), "digest").mapInArrow(repeated, REPEATED)
    # One row per digest, or the digest stands for several contents and is left alone.
    sole = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("first_row").alias("first_row"), F.first("first_chunk").alias("first_chunk"))
    sole = written(sole.filter("n = 1").drop("n"), "line-repeated")
    later = occurrences.join(sole, "digest").filter((F.col("row") != F.col("first_row")) | (F.col("chunk") != F.col("first_chunk")))
    removals = written(later.groupBy("row").agg(F.collect_list("chunk").alias("gone")), "line-removals")

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed_chunks", T.LongType()), T.StructField("removed_lines", T.LongType()), T.StructField("clean_text", T.StringType())]
    )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        for b in batches:
            out = []
            for doc, text, gone in zip(*(c.to_pylist() for c in b.columns)):
                parts, drop = chunks(text, span, mean), set(gone or ())
                kept = text if not drop else b"".join([c for k, (c, _) in enumerate(parts) if k not in drop]).decode("utf-8", "surrogatepass")
                out.append((doc, text, sum(n for _, n in parts), len(drop), sum(n for k, (_, n) in enumerate(parts) if k in drop), kept))
            if out:
                yield _batch(out, out_schema)

    return rows.join(removals, "row", "left").select("doc_id", "text", "gone").mapInArrow(clean, schema)


def text_lines(text: str | None) -> list[bytes]:
    """The lines of a text without their line breaks; what follows the last break is a line unless empty."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines if lines[-1] else lines[:-1]


def _digest(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()[:DIGEST_BYTES]


LINE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("content", T.BinaryType())])
UNIT = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("line", T.LongType()), T.StructField("lines", T.IntegerType()), T.StructField("key", T.BinaryType())])
CLEAN = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed_chunks", T.LongType()), T.StructField("removed_lines", T.LongType()), T.StructField("clean_text", T.StringType())]
)


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines of each block of texts."""
    schema = to_arrow_schema(LINE)

    def flush(seen: dict[bytes, bytes]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for content, digest in seen.items():
            out.append((digest, content))
            size += len(content) + DIGEST_BYTES
            if size > 4 << 20:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    seen, held = {}, 0
    for b in batches:
        for text in b.column(0).to_pylist():
            for line in text_lines(text):
                if line not in seen:
                    seen[line] = _digest(line)
                    held += len(line)
            if held > BLOCK_BYTES or len(seen) > BLOCK_LINES:
                yield from flush(seen)
                seen, held = {}, 0
    yield from flush(seen)


def _clashes(batches: Iterator[pa.RecordBatch], table_bytes: int = LINE_TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """The digests that stand for more than one line, by complete bytes."""
    grace, out, known, bucket = GraceTable(lambda old, new: old, table_bytes), [], set(), None
    for b in batches:
        for digest, content in zip(*(c.to_pylist() for c in b.columns)):
            grace.add(digest + digest, content, b"")
    spilled = grace.files is not None
    for digest, _, _ in grace.groups():
        if spilled and (now := grace._bucket(digest)) != bucket:  # a digest has all its lines in one bucket
            known, bucket = set(), now
        if digest in known:
            out.append((digest[:DIGEST_BYTES],))
        known.add(digest)
    if out:
        yield _batch(out, to_arrow_schema(T.StructType([LINE["digest"]])))


def _key(digests: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(digests))


def _units(batches: Iterator[pa.RecordBatch], clashes: frozenset[bytes], words: int) -> Iterator[pa.RecordBatch]:
    """Chunks, pairs of lines, and long lines, by the number of their first line and of their lines."""
    schema = to_arrow_schema(UNIT)

    def batch() -> pa.RecordBatch:
        columns = [np.repeat(np.array(c, "i8"), sizes) for c in (rows, docs)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*columns, at, long, keys), schema)], schema=schema)

    rows, docs, sizes, at, long, keys = [], [], [], [], [], []
    for b in batches:
        for row, doc, text in zip(*(c.to_pylist() for c in b.columns)):
            lines, before = text_lines(text), len(keys)
            digests = list(map(_digest, lines))
            ends = cuts([int.from_bytes(d[:8], "little") for d in digests])
            units = [(a, e - a) for a, e in zip([0, *ends], ends) if e - a >= max(MIN_LINES, 3)]  # a chunk of two lines is a pair
            units += [(k, 2) for k in range(len(lines) - 1)]
            units += [(k, 1) for k, line in enumerate(lines) if len(line) > 2 * words and len(line.split(None, words)) > words]
            if clashes and not clashes.isdisjoint(digests):
                units = [(k, n) for k, n in units if clashes.isdisjoint(digests[k : k + n])]
            keys += [digests[k] if n == 1 else _key(digests[k : k + n]) for k, n in units]
            at += [k for k, _ in units]
            long += [n for _, n in units]
            rows.append(row)
            docs.append(_NULL_ID if doc is None else doc)
            sizes.append(len(keys) - before)
            if len(keys) >= 20_000:
                yield batch()
                rows, docs, sizes, at, long, keys = [], [], [], [], [], []
    if keys:
        yield batch()
    release()


def _without(text: str | None, units: list[tuple[int, int]] | None) -> tuple[int, int, int, str | None]:
    """(lines, runs removed, lines removed, what stays) of a text whose units (first line, lines) are repeated."""
    lines = text_lines(text)
    gone = {k for line, n in units or () for k in range(line, line + n)}
    if not gone:
        return len(lines), 0, 0, text
    ends = [b"\n"] * (len(lines) - 1) + [b"\n" if text.endswith("\n") else b""]
    kept = b"".join([line + end for k, (line, end) in enumerate(zip(lines, ends)) if k not in gone])
    return len(lines), sum(k - 1 not in gone for k in gone), len(gone), kept.decode("utf-8", "surrogatepass")


def remove_passages(docs: DataFrame, words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``remove_repeated``, with pairs of lines and long lines beside the chunks; ``removed_chunks`` counts the runs removed."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    distinct = rows.select("text").mapInArrow(_distinct_lines, LINE).repartition(shuffle_width(spark), "digest")
    # In practice none; what is left out for them is named in the module's text.
    clashes = frozenset(bytes(r["digest"]) for r in distinct.mapInArrow(_clashes, T.StructType([LINE["digest"]])).collect())

    units = written(rows.mapInArrow(lambda batches: _units(batches, clashes, words), UNIT), "line-units")
    first = units.groupBy("key", "lines").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "line")).alias("first"))
    first = written(first.filter("n > 1").select("key", "lines", F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line")), "line-repeated")
    met = units.select("row", "line", "lines", "key").join(first, ["key", "lines"])
    later = met.filter((F.col("row") != F.col("first_row")) | (F.col("line") >= F.col("first_line") + F.col("lines")))
    removals = written(later.groupBy("row").agg(F.collect_list(F.struct("line", "lines")).alias("units")), "line-removals")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(CLEAN)
        for b in batches:
            out = [(doc, text, *_without(text, units and [(u["line"], u["lines"]) for u in units])) for doc, text, units in zip(*(c.to_pylist() for c in b.columns))]
            if out:
                yield _batch(out, schema)
        release()

    # The same join at every size: removals grow with the documents.
    return rows.join(removals.hint("merge"), "row", "left").select("doc_id", "text", "units").mapInArrow(clean, CLEAN)


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the repeated passages of lines: one row per document."""
    cleaned = remove_passages(table(spark, sf_dir, "documents"))
    clean = F.coalesce(F.col("clean_text").cast("binary"), F.lit(b""))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "removed_chunks",
        "removed_lines",
        F.octet_length(clean).cast("long").alias("clean_bytes"),
        F.sha2(clean, 256).alias("clean_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op10_line_chunk_dedup": op10_line_chunk_dedup}
