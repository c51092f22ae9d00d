"""Interleaved document sequences.

HTML is parsed into the ordered list of its text blocks and media references.
Stored media are found by digest, and a resolved sequence keeps every item at its
position with its own caption, whether or not the reference could be resolved.

Media of ``documents``: the UTF-8 text, padded with spaces to a positive multiple
of 192 bytes, is the sample data of a binary pixmap of 64 RGB pixels a row with
8-bit samples, a lossless image format whose stored form is the payload behind a
short header.

Digests are SHA-256 of the stored form.  Equal media are stored once per block of a
task, compressed for transport.  A digest first finds the row that keeps its medium, in
a join of small rows; the payloads then move once, dealt evenly by those rows, and meet
the references to them, which AQE splits where a third of all documents refer to one.

A null text or page is empty.  A page without content gives an empty sequence, a
reference that is not a digest or is unknown stays unresolved.  A null id is
carried as null, since sequences are told apart by row number.  Repeated rows are
resolved each.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, table, written

ROW_BYTES = 192
WIDTH = ROW_BYTES // 3
#: Stored bytes that a task holds to find equal media.
BLOCK_BYTES = 24 << 20
SCHEME = "sha256:"

ITEM = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("media_ref", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)
_MEDIA = {"img", "video", "audio", "source", "embed"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"}
_SILENT = {"script", "style", "template", "noscript", "head"}


class _Sequence(HTMLParser):
    """Text blocks and media in document order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "media_ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
            return
        if self.silent or tag in _INLINE:
            return
        if tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1]["in"] = True
            return
        if not (self.figures and self.figures[-1]["in"]):
            self.flush()
        if tag == "figure":
            self.figures.append({"media": [], "caption": [], "in": False})
        attrs = dict(attrs)
        if tag in _MEDIA and attrs.get("src"):
            item = {"kind": "media", "text": None, "media_ref": attrs["src"], "caption": attrs.get("alt") or None}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent or tag in _INLINE:
            return
        elif tag == "figcaption" and self.figures:
            self.figures[-1]["in"] = False
        elif tag == "figure" and self.figures:
            figure = self.figures.pop()
            caption = " ".join("".join(figure["caption"]).split())
            for item in figure["media"]:
                item["caption"] = caption or item["caption"]
            self.flush()
        elif not (self.figures and self.figures[-1]["in"]):
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.figures[-1]["caption"] if self.figures and self.figures[-1]["in"] else self.text).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Items of a page in order, each with its position."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    while parser.figures:
        parser.handle_endtag("figure")
    parser.flush()
    return [{"position": k, **item} for k, item in enumerate(parser.items)]


def sequences(pages: DataFrame, row_col: str, html_col: str, *carry: str) -> DataFrame:
    """(row, items) for each page, and the columns that it carries."""
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("items", T.ArrayType(ITEM)), *(pages.schema[c] for c in carry)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            items = pa.array([parse_sequence(h) for h in b.column(1).to_pylist()], schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), items, *b.columns[2:]], schema=schema)
        release()

    return pages.select(F.col(row_col).cast("long").alias("row"), F.col(html_col).alias("html"), *carry).mapInArrow(parse, out)


def _items(seqs: DataFrame, *carry: str) -> DataFrame:
    """One row per item with the digest it refers to, if it does."""
    ref = F.col("item.media_ref")
    digest = F.when(ref.startswith(SCHEME), F.substring(ref, len(SCHEME) + 1, 64))
    return seqs.select("row", *carry, F.explode_outer("items").alias("item")).withColumn("digest", digest)


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """One row per item: (row, item, and the columns of ``media`` by ``digest``), unresolved ones with nulls."""
    return _items(seqs).join(media, "digest", "left")


def references(seqs: DataFrame, *carry: str) -> DataFrame:
    """The media items of sequences that refer to a digest (binary): row, position, caption, digest, and what is carried."""
    refs = _items(seqs, *carry).filter(F.col("digest").isNotNull())
    return refs.select("row", "item.position", "item.caption", F.unhex("digest").alias("digest"), *carry)


def resolve_payloads(refs: DataFrame, store: DataFrame) -> DataFrame:
    """``refs`` with ``media``, the payload that ``store`` (row, digest, media) keeps for their digest, or null."""
    kept = store.filter(F.col("media").isNotNull())
    keepers = kept.groupBy("digest").agg(F.min("row").alias("keeper"))
    # Unknown digests get keys of their own, which match nothing and spread.
    placed = refs.join(keepers, "digest", "left").withColumn("keeper", F.coalesce("keeper", -1 - F.col("row")))
    return placed.join(kept.select(F.col("row").alias("keeper"), "media"), "keeper", "left").drop("keeper")


def interleave(resolved: DataFrame, value: str) -> DataFrame:
    """Sequences again: items in order with ``value`` (a column of the media) beside each.  Groups are single documents."""
    entry = F.struct("item.position", "item.kind", "item.text", "item.media_ref", "item.caption", F.col(value).alias(value))
    return resolved.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), entry))).alias("items"))


def encode_pixmap(payload: bytes) -> bytes:
    """The stored form of whole rows of 64 RGB pixels."""
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW_BYTES) + payload


def decode_pixmap(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or len(samples) != 3 * width * height:
        raise ValueError("not a stored pixmap")
    return width, height, samples


STORED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("html", T.StringType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("media", T.BinaryType()),
    ]
)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pages that refer to their stored media (compressed); media is null where an earlier row of the block has it."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(STORED)
        row, held, known = TaskContext.get().partitionId() << 40, 0, set()
        for b in batches:
            out, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows = max(1, -(-len(raw) // ROW_BYTES))
                stored = encode_pixmap(raw.ljust(rows * ROW_BYTES, b" "))
                digest = hashlib.sha256(stored).hexdigest()
                stored = stored if digest in known else bz2.compress(stored)
                page = f'<article><figure><img src="{SCHEME}{digest}"><figcaption>{len(raw)} bytes</figcaption></figure><p>{rows} rows</p></article>'
                out.append((row, doc, len(raw), page, bytes.fromhex(digest), None if digest in known else stored))
                if digest not in known:
                    known.add(digest)
                    held, size = held + len(stored), size + len(stored)
                if held > BLOCK_BYTES:
                    held, known = 0, set()
                row += 1
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, STORED)


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def payload_features(resolved: DataFrame) -> DataFrame:
    """One row per reference (doc_id, n_bytes, position, caption, digest, media), from the payload that it was resolved to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FEATURES)
        for b in batches:
            out = []
            for doc, n, position, caption, digest, media in zip(*(c.to_pylist() for c in b.columns)):
                stored = bz2.decompress(media)
                width, height, samples = decode_pixmap(stored)
                found = hashlib.sha256(stored).hexdigest()
                if found != digest.hex():
                    raise ValueError(f"stored media {digest.hex()} reads back as {found}")
                feature = f"pos={position};caption={caption};{width}x{height};blank={samples.count(32)}"
                out.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), found, feature))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release()

    return resolved.select("doc_id", "n_bytes", "position", "caption", "digest", "media").mapInArrow(read, FEATURES)


def op8_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as media and read back through their interleaved sequences: one row per document."""
    stored = written(store_documents(table(spark, sf_dir, "documents")), "media-store")
    seqs = sequences(stored, "row", "html", "doc_id", "n_bytes")
    return payload_features(resolve_payloads(references(seqs, "doc_id", "n_bytes"), stored.select("row", "digest", "media")))


def _sql() -> str:
    from .sharding import CRC_TABLE, crc_sql

    return f"""
with {CRC_TABLE},
t as (
  select doc_id, coalesce(text, '') as text, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
         greatest(1, (strlen(coalesce(text, '')) + {ROW_BYTES - 1}) // {ROW_BYTES}) as h from documents),
p as (select *, text || repeat(' ', cast(h * {ROW_BYTES} - n_bytes as int)) as payload from t),
s as (select *, encode('P6' || chr(10) || '{WIDTH} ' || h || chr(10) || '255' || chr(10) || payload) as stored, encode(payload) as pb from p),
u as (select *, unhex(substr(hex(pb), cast(2 * (octet_length(pb) - 16) + 1 as bigint), 32)) as tail from s)
select doc_id, n_bytes, cast(octet_length(pb) as bigint) as payload_bytes, sha256(pb) as payload_sha256,
       cast({crc_sql("tail")} as bigint) as tail_crc32, cast(octet_length(stored) as bigint) as media_bytes, sha256(stored) as media_sha256,
       'pos=0;caption=' || n_bytes || ' bytes;{WIDTH}x' || h || ';blank=' || (length(payload) - length(replace(payload, ' ', ''))) as feature
from u, crc_table"""


SQL = {"op8_interleaved_media": _sql()}
QUERIES = {"op8_interleaved_media": op8_interleaved_media}
