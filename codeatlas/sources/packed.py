"""Packed symbol files as a data source of Spark: ``spark.read.format("packed_symbols").load(path)``.

A file is a count of rows and the rows, whose lengths vary, so nothing in it tells where
a row begins.  Beside it stands a file of sync points (``.sync``): for each block of rows
its offset and the least and greatest assembly number in it, as whole numbers of 64 bits.
A file is cut into ranges of bytes; the task of a range reads the blocks that begin
within it, so one file is the work of many tasks and the driver sees names and sizes only.

* Columns: a schema given to the reader prunes; descriptions are expanded only if asked for.
* Filters on ``assembly_number`` leave out blocks, where the session allows data sources
  written in Python to take filters (``spark.sql.python.filterPushdown.enabled``) and the
  option ``pushdown`` is ``true``; Spark applies them once more to the rows.
* Writing: each task writes files of its own names, and the commit writes one manifest of
  the files that belong to the table, with the table of pairs that descriptions are coded
  with.  What a lost attempt left behind is in no manifest.
* Files of other origin have no manifest: all files of the folder are read then, those
  without sync points by one task each; ``index_files`` makes these points.

An empty table is a manifest without files.  Paths are opened by Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.codec import Codec
from ..functions.ids import varint_decode, varint_encode

FORMAT = "packed_symbols"
SCHEMA = "assembly_number int, glyph int, name string, symbol_id string, description string"
NAMES = ("assembly_number", "glyph", "name", "symbol_id", "description")
#: Bytes of the count of rows that a file begins with.
HEADER = 4
MANIFEST = "_manifest-"
#: Rows of a block, bytes after which a task begins another file, and bytes of a reader's range.
BLOCK_ROWS, FILE_BYTES, SPLIT_BYTES = 1_024, 64 << 20, 8 << 20


def encode_row(assembly: int, glyph: int, name: str, symbol: str, description: str, codec: Codec | None) -> bytes:
    n, d = name.encode(), codec.compress(description) if codec else description.encode()
    return b"".join((varint_encode(assembly), varint_encode(len(n)), n, bytes.fromhex(symbol), varint_encode(len(d)), d, varint_encode(glyph)))


def decode_rows(data: bytes, at: int, codec: Codec | None, described: bool = True) -> Iterator[tuple]:
    """Rows from ``at`` to the end of ``data``, each with the place behind it as the last value."""
    while at < len(data):
        assembly, at = varint_decode(data, at)
        size, at = varint_decode(data, at)
        name, at = data[at : at + size].decode(), at + size
        symbol, at = data[at : at + 8].hex(), at + 8
        size, at = varint_decode(data, at)
        description, at = data[at : at + size], at + size
        glyph, at = varint_decode(data, at)
        if described:
            description = codec.expand(description) if codec else description.decode()
        yield assembly, glyph, name, symbol, description, at


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it; ``file:/x`` is a way to write ``file:///x``."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return arrow_fs.FileSystem.from_uri(path)


def _read(files: arrow_fs.FileSystem, path: str, start: int = 0, end: int | None = None) -> bytes:
    with files.open_input_file(path) as f:
        f.seek(start)
        return f.read(None if end is None else end - start)


def _save(files: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as out:
        out.write(data)


@lru_cache(maxsize=2)
def _codec(root: str, manifest: str) -> Codec | None:
    """The code of a manifest's files; manifests are never changed."""
    files, base = _opened(root)
    counts = json.loads(_read(files, f"{base}/{manifest}"))["counts"]
    return Codec(counts) if counts else None


class Sync:
    """The sync points of rows that are added one by one."""

    def __init__(self, block_rows: int):
        self.block_rows, self.rows, self.points = block_rows, 0, []

    def add(self, offset: int, assembly: int) -> None:
        if self.rows % self.block_rows == 0:
            self.points.append([offset, assembly, assembly])
        else:
            last = self.points[-1]
            last[1], last[2] = min(last[1], assembly), max(last[2], assembly)
        self.rows += 1

    def data(self) -> bytes:
        return np.array(self.points, "<i8").tobytes()


@dataclass
class Range(InputPartition):
    """The blocks of ``file`` that begin within [start, end); all of a file without sync points."""

    file: str
    size: int
    start: int
    end: int
    manifest: str | None
    synced: bool


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PackedReader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], split_bytes: int):
        self.root, self.columns, self.split_bytes = root, columns, split_bytes
        self.filters: list[Filter] = []

    def partitions(self) -> list[Range]:
        files, base = _opened(self.root)
        listed = {i.base_name: i.size for i in files.get_file_info(arrow_fs.FileSelector(base)) if i.is_file}
        manifests = sorted(n for n in listed if n.startswith(MANIFEST))
        chosen = [(f, m) for m in manifests for f in json.loads(_read(files, f"{base}/{m}"))["files"]]
        if not manifests:
            chosen = [(n, None) for n in sorted(listed) if not n.endswith(".sync") and n[0] not in "._"]
        out = []
        for name, manifest in chosen:
            synced, size = f"{name}.sync" in listed, listed[name]
            step = self.split_bytes if synced else max(size, 1)
            out += [Range(name, size, at, min(at + step, size), manifest, synced) for at in range(0, size, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a table without partitions
            return
        files, base = _opened(self.root)
        path = f"{base}/{part.file}"
        codec = _codec(self.root, part.manifest) if part.manifest else None
        if not part.synced:
            yield self._batch(_read(files, path), HEADER, codec)
            return
        points = np.frombuffer(_read(files, f"{path}.sync"), "<i8").reshape(-1, 3)
        ends = np.append(points[1:, 0], part.size)
        mine = (points[:, 0] >= part.start) & (points[:, 0] < part.end) & self._may_hold(points[:, 1], points[:, 2])
        for k in np.flatnonzero(mine):
            yield self._batch(_read(files, path, int(points[k, 0]), int(ends[k])), 0, codec)

    def _may_hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which blocks can hold rows that pass the filters taken."""
        keep = np.ones(len(low), bool)
        for f in self.filters:
            v = f.value
            if isinstance(f, EqualTo):
                keep &= (low <= v) & (high >= v)
            elif isinstance(f, In):
                keep &= np.any([(low <= x) & (high >= x) for x in v if x is not None] or [np.zeros(len(low), bool)], axis=0)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                keep &= high > v if isinstance(f, GreaterThan) else high >= v
            else:
                keep &= low < v if isinstance(f, LessThan) else low <= v
        return keep

    def _batch(self, data: bytes, at: int, codec: Codec | None) -> pa.RecordBatch:
        described = "description" in self.columns
        values = list(zip(*decode_rows(data, at, codec, described))) or [()] * 6
        types = {"assembly_number": pa.int32(), "glyph": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(values[NAMES.index(c)], types.get(c, pa.string())) for c in self.columns], names=self.columns)


class FilteringReader(PackedReader):
    """The reader that takes filters; each is left to Spark as well, since blocks hold other rows too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        taken = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, taken) and f.attribute == ("assembly_number",) and getattr(f, "value", None) is not None:
                self.filters.append(f)
            yield f


class PackedWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool, counts: str, block_rows: int, file_bytes: int):
        self.root, self.overwrite, self.counts, self.block_rows, self.file_bytes = root, overwrite, counts, block_rows, file_bytes

    def write(self, rows) -> Written:
        files, base = _opened(self.root)
        files.create_dir(base, recursive=True)
        counts = json.loads(self.counts)
        codec = Codec(counts) if counts else None
        names: list[str] = []
        body, sync = bytearray(), Sync(self.block_rows)

        def close() -> None:
            names.append(f"{uuid.uuid4().hex}.bin")
            _save(files, f"{base}/{names[-1]}.sync", sync.data())
            _save(files, f"{base}/{names[-1]}", sync.rows.to_bytes(HEADER, "little") + body)

        for r in rows:
            sync.add(HEADER + len(body), r["assembly_number"])
            body += encode_row(*(r[c] for c in NAMES), codec)
            if len(body) >= self.file_bytes:
                close()
                body, sync = bytearray(), Sync(self.block_rows)
        if sync.rows:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _opened(self.root)
        files.create_dir(base, recursive=True)
        old = [i.path for i in files.get_file_info(arrow_fs.FileSelector(base)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        manifest = {"files": [f for m in messages if m for f in m.files], "counts": json.loads(self.counts)}
        _save(files, f"{base}/{MANIFEST}{uuid.uuid4().hex}", json.dumps(manifest).encode())
        for path in old:
            files.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _opened(self.root)
        for name in (f for m in messages if m for f in m.files):
            files.delete_file(f"{base}/{name}")
            files.delete_file(f"{base}/{name}.sync")


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _option(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def reader(self, schema) -> PackedReader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else PackedReader
        return kind(self.options["path"], schema.names, self._option("split_bytes", SPLIT_BYTES))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite, self.options.get("counts", "{}"), self._option("block_rows", BLOCK_ROWS), self._option("file_bytes", FILE_BYTES))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)


def write_symbols(symbols: DataFrame, path: str, counts: dict[str, int] | None = None, **options) -> None:
    """The symbols in ranges of assembly, name and id, as files of the packed layout.

    ``counts`` is the table of pairs that descriptions are coded with, of 2^14 rows at most.  Null names and
    descriptions are written as empty ones.
    """
    register(symbols.sparkSession)
    rows = symbols.select(*NAMES).na.fill("", ["name", "description"])
    order = ["assembly_number", "name", "symbol_id"]
    n = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sorted_rows.write.format(FORMAT).mode("overwrite").options(counts=json.dumps(counts or {}), **options).save(path)


def read_symbols(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The symbols of a folder of packed files; ``columns`` prunes, filters on the assembly reach blocks where the session allows it."""
    register(spark)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    types = dict(c.split(" ") for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or NAMES)
    return spark.read.format(FORMAT).schema(schema).options(pushdown=allowed, **options).load(path)


def index_files(spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sync points for files of other origin: (file, blocks), once this is evaluated.  A file is walked once, by one task."""

    def run(batches):
        for b in batches:
            for p in b["path"]:
                files, file = _opened(p)
                data, sync, at = _read(files, file), Sync(block_rows), HEADER
                for row in decode_rows(data, at, None, described=False):
                    sync.add(at, row[0])
                    at = row[5]
                _save(files, f"{file}.sync", sync.data())
                b.loc[b["path"] == p, "blocks"] = len(sync.points)
            yield b.rename(columns={"path": "file"})[["file", "blocks"]].astype({"blocks": "int64"})

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path")
    return listed.mapInPandas(run, "file string, blocks long")
