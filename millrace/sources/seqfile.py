"""Hadoop sequence files as a Python data source: ``spark.read.format("millrace_sequence").schema(…).load(path)``.

Pairs of standard Writables, plain, record or block compressed when read (zlib, gzip, bzip2), plain when written. Files are
read in ranges from sync marker to sync marker. Each Spark type has one Writable; a column that may hold nulls can be
written as ObjectWritable, which has a null of its own.
"""

from __future__ import annotations

import bz2
import io
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import to_arrow_schema

from .files import RANGE, FilesWriter, Range, file_system, ranges

#: fixed values of the format: magic, escape of a sync marker, names of the classes
MAGIC, ESCAPE, PACKAGE = b"SEQ\x06", b"\xff\xff\xff\xff", "org.apache.hadoop.io."
_CODECS = {
    "DefaultCodec": lambda raw: zlib.decompress(raw),
    "DeflateCodec": lambda raw: zlib.decompress(raw),
    "GzipCodec": lambda raw: zlib.decompress(raw, 31),
    "BZip2Codec": bz2.decompress,
}
_CLASSES = {
    "boolean": "BooleanWritable",
    "double": "DoubleWritable",
    "float": "FloatWritable",
    "int": "IntWritable",
    "bigint": "LongWritable",
    "string": "Text",
    "binary": "BytesWritable",
    "void": "NullWritable",
}
_FIXED = {"BooleanWritable": ">?", "DoubleWritable": ">d", "FloatWritable": ">f", "IntWritable": ">i", "LongWritable": ">q", "ShortWritable": ">h", "ByteWritable": ">b"}
#: bytes between sync markers
SYNC_EVERY = 100_000


def read_vint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """A number of variable length, and the place behind it."""
    first = struct.unpack_from("b", raw, at)[0]
    if first >= -112:
        return first, at + 1
    size = -112 - first if first >= -120 else -120 - first
    n = int.from_bytes(raw[at + 1 : at + 1 + size], "big")
    return (n if first >= -120 else ~n), at + 1 + size


def vint(n: int) -> bytes:
    if -112 <= n <= 127:
        return struct.pack("b", n)
    raw = (n if n >= 0 else ~n).to_bytes(8, "big").lstrip(b"\0")
    return struct.pack("b", (-112 if n >= 0 else -120) - len(raw)) + raw


def _text(raw: bytes) -> bytes:
    return vint(len(raw)) + raw


def _short(name: str) -> bytes:
    return struct.pack(">H", len(name)) + name.encode()


def to_writable(kind: str, value) -> bytes:
    if kind in _FIXED:
        return struct.pack(_FIXED[kind], value)
    if kind == "Text":
        return _text(value.encode("utf-8"))
    if kind == "BytesWritable":
        return struct.pack(">i", len(value)) + bytes(value)
    if kind == "NullWritable":
        return b""
    raise TypeError(f"no Writable named {kind}")


def from_writable(kind: str, raw: bytes):
    if kind in _FIXED:
        return struct.unpack(_FIXED[kind], raw)[0]
    if kind == "Text":
        return raw[read_vint(raw)[1] :].decode("utf-8")
    if kind == "BytesWritable":
        return raw[4:]
    if kind in ("VIntWritable", "VLongWritable"):
        return read_vint(raw)[0]
    if kind == "NullWritable":
        return None
    if kind == "ObjectWritable":
        names, at = [], 0
        for _ in range(2):
            size = struct.unpack_from(">H", raw, at)[0]
            names.append(raw[at + 2 : at + 2 + size].decode())
            at += 2 + size
        return None if names[1].endswith("$NullInstance") else from_writable(names[1].removeprefix(PACKAGE), raw[at:])
    raise TypeError(f"no reader for {kind}")


def to_object(kind: str, value) -> bytes:
    """An ObjectWritable around a Writable, or its null."""
    name = PACKAGE + kind
    if value is None:
        return _short(f"{PACKAGE}Writable") + _short(f"{PACKAGE}ObjectWritable$NullInstance") + _short(name)
    return _short(name) * 2 + to_writable(kind, value)


def header(kinds: tuple[str, str], sync: bytes) -> bytes:
    return MAGIC + b"".join(_text((PACKAGE + k).encode()) for k in kinds) + b"\0\0" + struct.pack(">i", 0) + sync


class File:
    """Header and records of a stream."""

    def __init__(self, stream):
        self.stream = stream
        if self._take(4)[:3] != b"SEQ":
            raise ValueError("not a sequence file")
        self.kinds = tuple(self._name().removeprefix(PACKAGE) for _ in range(2))
        self.compressed, self.blocks = self._take(2)
        self.codec = _CODECS[self._name().rpartition(".")[2]] if self.compressed else None
        for _ in range(struct.unpack(">i", self._take(4))[0] * 2):
            self._name()
        self.sync = self._take(16)
        self.first = stream.tell()

    def _take(self, n: int) -> bytes:
        raw = self.stream.read(n)
        if len(raw) < n:
            raise EOFError("a sequence file is cut off")
        return raw

    def _vint(self) -> int:
        first = self._take(1)
        more = struct.unpack("b", first)[0]
        size = 0 if more >= -112 else -112 - more if more >= -120 else -120 - more
        return read_vint(first + self._take(size))[0]

    def _name(self) -> str:
        return self._take(self._vint()).decode("utf-8")

    def _start(self, start: int) -> int | None:
        """The place of the first sync marker at or behind ``start``; the records behind the header have none."""
        if start <= self.first:
            return self.first
        mark, held, at = ESCAPE + self.sync, b"", start
        self.stream.seek(start)
        while chunk := self.stream.read(1 << 20):
            held += chunk
            hit = held.find(mark)
            if hit >= 0:
                return at + hit
            at += max(0, len(held) - 19)
            held = held[-19:]
        return None

    def _block(self):
        n = self._vint()
        key_sizes, keys, value_sizes, values = (self.codec(self._take(self._vint())) for _ in range(4))
        k = v = kp = vp = 0
        for _ in range(n):
            size, kp = read_vint(key_sizes, kp)
            key, k = keys[k : k + size], k + size
            size, vp = read_vint(value_sizes, vp)
            value, v = values[v : v + size], v + size
            yield key, value

    def pairs(self, start: int, end: int):
        """Raw pairs of the sections whose sync marker (or the header) lies in [start, end)."""
        at = self._start(start)
        if at is None:
            return
        self.stream.seek(at)
        while raw := self.stream.read(4):
            if raw == ESCAPE:
                if at >= end and at != self.first:
                    return
                if self._take(16) != self.sync:
                    raise ValueError("a sync marker does not match")
                if self.blocks:
                    yield from self._block()
            else:
                size, key_size = struct.unpack(">i", raw)[0], struct.unpack(">i", self._take(4))[0]
                body = self._take(size)
                value = body[key_size:]
                yield body[:key_size], self.codec(value) if self.codec else value
            at = self.stream.tell()

    def values(self, start: int, end: int):
        a, b = self.kinds
        return ((from_writable(a, k), from_writable(b, v)) for k, v in self.pairs(start, end))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, size: int):
        self.path, self.schema, self.size = path, schema, size

    def partitions(self):
        return ranges(self.path, self.size)

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = file_system(part.uri)
        arrow = to_arrow_schema(self.schema)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        with fs.open_input_file(part.path) as stream:
            rows = []
            for pair in File(io.BufferedReader(stream, 1 << 20)).values(part.start, part.end):
                rows.append(pair)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class _Writer(FilesWriter):
    suffix = ".seq"

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, nulls: bool):
        super().__init__(path, schema, overwrite)
        self.nulls = nulls
        for f in schema.fields:
            if f.dataType.simpleString() not in _CLASSES:
                raise TypeError(f"no Writable for {f.dataType.simpleString()}")

    def dump(self, out, batches):
        kinds = [_CLASSES[f.dataType.simpleString()] for f in self.schema.fields]
        sync = uuid.uuid4().bytes
        out.write(header(tuple("ObjectWritable" if self.nulls else k for k in kinds), sync))
        held = bytearray()
        for batch in batches:
            columns = []
            for kind, column in zip(kinds, batch.columns):
                if self.nulls:
                    columns.append([to_object(kind, x) for x in column.to_pylist()])
                elif column.null_count and kind != "NullWritable":
                    raise ValueError("a null has no Writable; write the table with nulls=True")
                else:
                    columns.append([to_writable(kind, x) for x in column.to_pylist()])
            for k, v in zip(*columns):
                held += struct.pack(">ii", len(k) + len(v), len(k)) + k + v
                if len(held) >= SYNC_EVERY:
                    out.write(bytes(held) + ESCAPE + sync)
                    held.clear()
        out.write(bytes(held))


class SequenceSource(DataSource):
    """Options: ``path``, ``range`` (bytes a task), ``nulls`` (write ObjectWritables, which may be null)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_sequence"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("range", RANGE)))

    def writer(self, schema: T.StructType, overwrite: bool):
        return _Writer(self.options["path"], schema, overwrite, self.options.get("nulls", "false") == "true")
