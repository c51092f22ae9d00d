"""WARC archives with revisit resolution.

``write_deduplicated`` takes captures, shuffles their headers (never payloads) by
payload digest, joins every revisit to its original response and writes archives
with fresh headers: one response per payload, revisit records for the others.
``read_archives`` parses the files again by their Content-Length and checks each
payload against its digest.

Archives are written by Spark's own text writer, record by record, so they commit
like any other output and work on every store that Spark reaches; they are read
with the binary file source.  A record ends with two line breaks, which is just
what the writer puts after each line.

The shuffle by digest carries a few dozen bytes a row and its largest ids are
combined before it.  Groups of one payload that hold many rows meet their winner
in a join of two stored tables, so AQE can split them.  Payloads move once, by
row number, evenly, into as many files as their bytes ask for; a file is compressed
as one member, so records are read from its beginning.

Captures: row (unique long), page_id long, uri string, record_type string
('response', or 'revisit' for a capture that carries a digest but no payload),
payload binary, digest string, payload_bytes long.  In each group of equal digests
and lengths the response with the largest page_id stays; a null page_id is
smallest and ties go to the larger row.  Payloads of fewer than ``min_bytes`` bytes
are always responses.  A revisit whose original is missing stays a revisit without
reference.  A null payload is empty, a null uri becomes a urn of the row, and
control characters and spaces of a uri are percent-encoded so that they cannot end
a header.  Empty tables give no records.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import new_folder, release, shuffle_width, table, written

MIN_PAYLOAD_BYTES = 0
#: Bytes of one archive file before compression, and of the headers of a record, about; a file is read as a whole.
ARCHIVE_BYTES, HEADER_BYTES = 128 << 20, 600
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 bits, or 8 digits, at a time."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as captured responses, stored with the numbers of their rows, which thus are the same whenever they are read."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(uri_col).cast("string").alias("uri"),
        F.lit("response").alias("record_type"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    return written(rows, "warc-captures")


def resolve(headers: DataFrame, min_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """Headers with the page and row that each one repeats (null: it is the original)."""
    key = ["digest", "payload_bytes"]
    best = F.max(F.when(F.col("record_type") == "response", F.struct("page_id", "row")))
    originals = written(
        headers.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(*key)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("best").isNotNull())
        .select(*key, F.col("best.page_id").alias("origin_page"), F.col("best.row").alias("origin_row")),
        "warc-originals",
    )
    joined = headers.join(originals, key, "left")
    repeats = (F.col("origin_row") != F.col("row")) & F.col("origin_row").isNotNull()
    return joined.select(
        "row",
        "payload_bytes",
        F.when(repeats, F.col("origin_page")).alias("refers_page"),
        F.when(repeats, F.col("origin_row")).alias("refers_row"),
        F.when(repeats | (F.col("record_type") == "revisit"), "revisit").otherwise("response").alias("resolved_type"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def write_deduplicated(caps: DataFrame, path: str, min_bytes: int = MIN_PAYLOAD_BYTES, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the archives of ``caps`` to the folder ``path``; returns it."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved = written(resolve(caps.select("row", "page_id", "record_type", "digest", "payload_bytes"), min_bytes), "warc-resolved")
    stored = F.when(F.col("resolved_type") == "response", F.col("payload_bytes")).otherwise(0) + HEADER_BYTES
    size = resolved.agg(F.coalesce(F.sum(stored), F.lit(0))).first()[0]
    # Numbers of rows deal evenly, so files differ in size by little more than their largest record.
    dealt = caps.drop("record_type", "payload_bytes").repartition(max(shuffle_width(caps.sparkSession), -(-size // archive_bytes)), "row")
    rows = dealt.join(resolved, "row")
    kept = F.col("resolved_type") == "response"
    urn = lambda c: F.concat(F.lit("<urn:x-row:"), c.cast("string"), F.lit(">"))
    uri = F.coalesce(F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:x-row:"), F.col("row").cast("string")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"),
        _header("Content-Length", F.col("payload_bytes")),
        F.lit(_END),
    )
    body = F.when(kept, F.col("payload").cast("string")).otherwise(F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _header("WARC-Type", F.col("resolved_type")),
        _header("WARC-Record-ID", urn(F.col("row"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(kept, F.lit("")).otherwise(
            F.concat(
                _header("WARC-Profile", F.lit(PROFILE)),
                _header("WARC-Refers-To", urn(F.col("refers_row"))),
                _header("X-Refers-To-Page", F.col("refers_page")),
            )
        ),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}"),
        _header("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(_END),
        http,
        body,
    )
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", _END * 2).text(path)
    return path


RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to_record", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a binary stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("headers end with the file")
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(length := int(headers["content-length"]))
        if len(block) != length:
            raise ValueError("block ends with the file")
        yield headers, block


def _record(headers: dict[str, str], block: bytes, payload_too: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    size = int(headers.get("x-payload-length", len(payload)))
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
        size = len(payload)
    number = lambda name: int(headers[name]) if name in headers else None
    return (headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-date"), number("x-page-id"), size, digest, headers.get("warc-refers-to"), number("x-refers-to-page"), payload if payload_too else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``path``, payloads checked against their digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(RECORD)
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                    for headers, block in parse_records(io.BufferedReader(stream, 1 << 16)):
                        out.append(_record(headers, block, payloads))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, RECORD)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through deduplicated archives and back: one row per page."""
    path = write_deduplicated(captures(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op2_warc_revisits": """
with t as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (
  select *, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1)), '') as payload_digest,
         row_number() over (partition by h order by page_id desc nulls last) as place,
         first_value(page_id) over (partition by h order by page_id desc nulls last) as top
  from t)
select page_id, payload_bytes, payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type,
       case when place > 1 then top end as refers_to
from d""",
}
QUERIES = {"op2_warc_revisits": op2_warc_revisits}
