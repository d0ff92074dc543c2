"""Avro container files as a Python data source: ``spark.read.format("millrace_avro").load(path)``.

Files are read in ranges: a range starts at the first sync marker after its offset, so large files are shared
out over tasks. Codecs: null and deflate. Named types, enums, fixed, logical types (dates, timestamps, decimals) and
unions are read and written. A reader schema (option ``reader``) projects, promotes and fills in defaults while decoding; files
of other schemas in the folder are resolved to it, or to the schema of the first file. Each task writes one file under a
temporary name; the commit renames them, and only then removes what an overwrite replaces. Any file system of pyarrow serves.

Rows are never built: numbers, dates, timestamps, decimals and texts are encoded column by column with numpy, and decoding
appends plain numbers to columns that become Arrow arrays. ``encode`` and ``reading`` do the rest, value by value.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import to_arrow_schema

from ..types import from_avro, linked, members, to_avro
from .files import RANGE, FilesWriter, Range, file_system, files_of, ranges

MAGIC = b"Obj\x01"
ROWS_IN_BLOCK = 2000


def _long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


_EPOCH = datetime.datetime(1970, 1, 1)
_EXACT = decimal.Context(prec=60)


def _logical(schema: dict, value):
    """The plain number or bytes of a date, time or decimal."""
    logical = schema["logicalType"]
    if isinstance(value, datetime.datetime):
        micros = (value.replace(tzinfo=None) - (value.utcoffset() or datetime.timedelta()) - _EPOCH) // datetime.timedelta(microseconds=1)
        return micros // 1000 if logical.endswith("millis") else micros
    if isinstance(value, datetime.date):
        return value.toordinal() - _EPOCH.toordinal()
    if isinstance(value, decimal.Decimal):
        n = int(value.scaleb(schema.get("scale", 0), _EXACT))
        return n.to_bytes(schema.get("size", (n.bit_length() + 8) // 8), "big", signed=True)
    return value


def encode(schema, value, out: bytearray) -> None:
    """Appends ``value`` in Avro binary form (``schema`` is linked)."""
    if isinstance(schema, list):
        if value is None:
            _long(out, schema.index("null"))
            return
        rest = members(schema)
        k = 0
        if len(rest) > 1:
            k, value = next((i, x) for i, x in enumerate(value.values()) if x is not None)
        _long(out, schema.index(rest[k]))
        encode(rest[k], value, out)
        return
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, dict) and "logicalType" in schema:
        value = _logical(schema, value)
    if kind == "null":
        return
    if kind == "boolean":
        out.append(bool(value))
    elif kind in ("int", "long"):
        _long(out, int(value))
    elif kind == "float":
        out += struct.pack("<f", value)
    elif kind == "double":
        out += struct.pack("<d", value)
    elif kind in ("bytes", "string"):
        raw = value.encode("utf-8") if isinstance(value, str) else bytes(value)
        _long(out, len(raw))
        out += raw
    elif kind == "enum":
        _long(out, schema["symbols"].index(value))
    elif kind == "fixed":
        if len(value) != schema["size"]:
            raise ValueError(f"{schema['name']} has {schema['size']} bytes, not {len(value)}")
        out += bytes(value)
    elif kind == "record":
        for f in schema["fields"]:
            encode(f["type"], value[f["name"]], out)
    elif kind == "array":
        if value:
            _long(out, len(value))
            for x in value:
                encode(schema["items"], x, out)
        out.append(0)
    elif kind == "map":
        items = list(value.items() if isinstance(value, dict) else value)
        if items:
            _long(out, len(items))
            for k, x in items:
                encode("string", k, out)
                encode(schema["values"], x, out)
        out.append(0)
    else:
        encode(kind, value, out)


#: the bytes that each row has of a part of its encoding, and those of all rows, one after the other
Part = tuple[np.ndarray, np.ndarray]


def _varints(values: np.ndarray) -> Part:
    n = ((values << 1) ^ (values >> 63)).view(np.uint64)
    sizes = np.ones(len(n), np.int64)
    for k in range(1, 10):
        sizes += n >= np.uint64(1 << 7 * k)
    at = np.arange(sizes.max(initial=1))
    digits = (n[:, None] >> (7 * at).astype(np.uint64) & np.uint64(0x7F)).astype(np.uint8)
    digits[at < sizes[:, None] - 1] |= 0x80
    return sizes, digits[at < sizes[:, None]]


def _equal_sizes(values: np.ndarray, size: int) -> Part:
    return np.full(len(values), size, np.int64), np.ascontiguousarray(values).view(np.uint8)


def _plain(schema, column: pa.Array) -> list[Part] | None:
    """The parts of a column without nulls, if its Arrow type is the usual one of ``schema``."""
    kind, logical = (schema["type"], schema.get("logicalType")) if isinstance(schema, dict) else (schema, None)
    t, n = column.type, len(column)
    if logical is None:
        if kind in ("int", "long") and pa.types.is_signed_integer(t):
            return [_varints(column.cast(pa.int64()).to_numpy())]
        if kind == "boolean" and pa.types.is_boolean(t):
            return [_equal_sizes(column.to_numpy(zero_copy_only=False), 1)]
        if kind == "float" and pa.types.is_float32(t):
            return [_equal_sizes(column.to_numpy().astype("<f4"), 4)]
        if kind == "double" and pa.types.is_float64(t):
            return [_equal_sizes(column.to_numpy().astype("<f8"), 8)]
        if kind in ("string", "bytes") and (pa.types.is_string(t) or pa.types.is_binary(t)):
            sizes = pc.binary_length(column).to_numpy().astype(np.int64)
            _, ends, data = column.buffers()
            first = np.frombuffer(ends, np.int32)[column.offset] if n else 0
            data = np.frombuffer(data or b"", np.uint8)[first : first + sizes.sum()]
            return [_varints(sizes), (sizes, data)]
    elif kind == "int" and logical == "date" and pa.types.is_date32(t):
        return [_varints(column.cast(pa.int32()).cast(pa.int64()).to_numpy())]
    elif kind == "long" and logical.removeprefix("local-") in ("timestamp-micros", "timestamp-millis") and pa.types.is_timestamp(t) and t.unit == "us":
        micros = column.cast(pa.int64()).to_numpy()
        return [_varints(micros // 1000 if logical.endswith("millis") else micros)]
    elif kind == "bytes" and logical == "decimal" and pa.types.is_decimal128(t) and t.scale == schema.get("scale", 0) and "size" not in schema:
        low, high = np.frombuffer(column.buffers()[1] or b"", "<i8")[2 * column.offset : 2 * (column.offset + n)].reshape(n, 2).T
        if (high == low >> 63).all() and (low > -(2**63)).all():
            sizes = np.ones(n, np.int64)
            for k in range(1, 8):
                sizes += np.abs(low) >= 1 << 8 * k - 1
            digits = low.astype(">i8").view(np.uint8).reshape(n, 8)
            return [_varints(sizes), (sizes, digits[np.arange(8) >= 8 - sizes[:, None]])]
    return None


def _parts(schema, column: pa.Array) -> list[Part]:
    """The encoding of a column, in parts that follow each other in a row."""
    rest = members(schema) if isinstance(schema, list) else []
    if len(rest) == 1 and len(schema) < 64 and ("null" in schema or not column.null_count):
        parts = _plain(rest[0], column.drop_null())
        if parts is not None:
            there = column.is_valid().to_numpy(zero_copy_only=False)
            branch = np.where(there, 2 * schema.index(rest[0]), 2 * schema.index("null") if "null" in schema else 0)
            out = [_equal_sizes(branch.astype(np.uint8), 1)]
            for some, data in parts:
                sizes = np.zeros(len(column), np.int64)
                sizes[there] = some
                out.append((sizes, data))
            return out
    elif not rest and not column.null_count and (parts := _plain(schema, column)) is not None:
        return parts
    out, ends = bytearray(), [0]
    for x in column.to_pylist():
        encode(schema, x, out)
        ends.append(len(out))
    return [(np.diff(ends), np.frombuffer(out, np.uint8))]


def _joined(parts: list[Part], rows: int) -> bytes:
    """The parts of each row together, row after row."""
    sizes = sum((sizes for sizes, _ in parts), np.zeros(rows, np.int64))
    at = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.uint8)
    for sizes, data in parts:
        first = np.cumsum(sizes) - sizes
        if len(data) > 64 * rows:  # long values are copied one by one
            for a, b, n in zip(at.tolist(), first.tolist(), sizes.tolist()):
                out[a : a + n] = data[b : b + n]
        else:
            out[np.repeat(at - first, sizes) + np.arange(len(data))] = data
        at = at + sizes
    return out.tobytes()


def encoded(schema, batch: pa.RecordBatch, bare: bool) -> bytes:
    """The rows of a batch in Avro binary form: records, or with ``bare`` the values of its only column."""
    if bare:
        return _joined(_parts(schema, batch.column(0)), batch.num_rows)
    if _kind(schema) == "record":
        return _joined([p for f in schema["fields"] for p in _parts(f["type"], batch.column(f["name"]))], batch.num_rows)
    out = bytearray()
    for row in batch.to_pylist():
        encode(schema, row, out)
    return bytes(out)


class Decoder:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise EOFError("an Avro value is cut off")
        return self.raw[self.at - n : self.at]

    def _blocks(self):
        while n := self.long():
            if n < 0:
                self.long()
            yield from range(abs(n))

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema["type"] if isinstance(schema, dict) else schema
        if kind == "null":
            return None
        if kind == "boolean":
            return self.take(1) != b"\0"
        if kind in ("int", "long"):
            return self.long()
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "bytes":
            return self.take(self.long())
        if kind == "string":
            return self.take(self.long()).decode("utf-8")
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if kind == "array":
            return [self.value(schema["items"]) for _ in self._blocks()]
        if kind == "map":
            return [(self.value("string"), self.value(schema["values"])) for _ in self._blocks()]
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind == "fixed":
            return self.take(schema["size"])
        return self.value(kind)


#: fixed values: what the rules of schema resolution let a reader take for a written type
_PROMOTED = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


def _kind(schema) -> str:
    return schema["type"] if isinstance(schema, dict) else "union" if isinstance(schema, list) else schema


def _matches(w, r) -> bool:
    a, b = _kind(w), _kind(r)
    if a in ("enum", "fixed", "record") and a == b:
        return w["name"].rpartition(".")[2] == r["name"].rpartition(".")[2] or a == "record"
    return a == b or b in _PROMOTED.get(a, ())


def _default(value, r):
    """The default of a field, which a schema gives as JSON."""
    if isinstance(r, list):
        if value is None:
            return None
        rest = members(r)
        got = _default(value, rest[0])
        return got if len(rest) == 1 else {f"member{i}": got if i == 0 else None for i in range(len(rest))}
    kind = _kind(r)
    if kind in ("bytes", "fixed"):
        return value.encode("latin-1")
    if kind == "record":
        return {f["name"]: _default(value[f["name"]] if f["name"] in value else f["default"], f["type"]) for f in r["fields"]}
    if kind == "array":
        return [_default(x, r["items"]) for x in value]
    if kind == "map":
        return [(k, _default(x, r["values"])) for k, x in value.items()]
    return value


def reading(w, r):
    """A function from a Decoder at a value of schema ``w`` to that value as schema ``r`` has it (both linked)."""
    if isinstance(w, list):
        branches = []
        for b in w:
            try:
                branches.append(reading(b, r))
            except TypeError as e:  # an error only for values of this branch

                def fail(d, e=e):
                    raise e

                branches.append(fail)
        return lambda d: branches[d.long()](d)
    if isinstance(r, list):
        if w == "null" and "null" in r:
            return lambda d: None
        rest = members(r)
        k = next((i for i, b in enumerate(rest) if _kind(b) == _kind(w) and _matches(w, b)), None)
        k = next((i for i, b in enumerate(rest) if _matches(w, b)), None) if k is None else k
        if k is None:
            raise TypeError(f"{_kind(w)} is none of {[_kind(b) for b in rest]}")
        one = reading(w, rest[k])
        if len(rest) == 1:
            return one
        none = {f"member{i}": None for i in range(len(rest))}
        return lambda d: {**none, f"member{k}": one(d)}
    a, b = _kind(w), _kind(r)
    if not _matches(w, r):
        raise TypeError(f"{a} cannot be read as {b}")
    if a == "record":
        return _record(w, r)
    if a == "array":
        item = reading(w["items"], r["items"])
        return lambda d: [item(d) for _ in d._blocks()]
    if a == "map":
        value = reading(w["values"], r["values"])
        return lambda d: [(d.take(d.long()).decode("utf-8"), value(d)) for _ in d._blocks()]
    if a == "enum":
        known = [s if s in r["symbols"] else r.get("default") for s in w["symbols"]]
        return lambda d: known[d.long()]
    if a == "fixed" and w["size"] != r["size"]:
        raise TypeError(f"{w['name']} has {w['size']} bytes, not {r['size']}")
    logical = r.get("logicalType") if isinstance(r, dict) else None
    if logical == "decimal":
        scale = r.get("scale", 0)
        size = (lambda d: w["size"]) if a == "fixed" else (lambda d: d.long())

        return lambda d: decimal.Decimal(int.from_bytes(d.take(size(d)), "big", signed=True)).scaleb(-scale, _EXACT)
    if logical in ("timestamp-millis", "local-timestamp-millis"):
        return lambda d: d.long() * 1000
    if b in ("float", "double") and a in ("int", "long"):
        return lambda d: float(d.long())
    if b == "string" and a == "bytes":
        return lambda d: d.take(d.long()).decode("utf-8")
    if b == "bytes" and a == "string":
        return lambda d: d.take(d.long())
    return lambda d: d.value(w)


def _resolved(w, r, way) -> tuple[list[tuple], dict]:
    """For each written field the name that the reader has for it (or None) and ``way(written type, read type)``; defaults."""
    steps, taken = [], set()
    by_name = {n: f for f in r["fields"] for n in (*f.get("aliases", ()), f["name"])}
    for f in w["fields"]:
        target = by_name.get(f["name"])
        if target is None:
            steps.append((None, way(f["type"], f["type"])))
        else:
            steps.append((target["name"], way(f["type"], target["type"])))
            taken.add(target["name"])
    missing = [f for f in r["fields"] if f["name"] not in taken]
    if bare := [f["name"] for f in missing if "default" not in f]:
        raise TypeError(f"{bare} are not in the file and have no default")
    return steps, {f["name"]: _default(f["default"], f["type"]) for f in missing}


def _record(w, r):
    steps, defaults = _resolved(w, r, reading)

    def value(d):
        out = dict(defaults)
        for name, step in steps:
            x = step(d)
            if name is not None:
                out[name] = x
        return out

    return value


def _long_at(raw: bytes, at: int) -> tuple[int, int]:
    b = raw[at]
    if b < 0x80:
        return (b >> 1) ^ -(b & 1), at + 1
    n, shift = b & 0x7F, 7
    while True:
        at += 1
        b = raw[at]
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return (n >> 1) ^ -(n & 1), at + 1
        shift += 7


def _numbers_at(raw: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The numbers that begin at these positions; those that are not ``there`` are of no meaning."""
    out = np.zeros(len(at), np.uint64)
    more = there.copy()
    for k in range(10):
        b = raw[np.minimum(at + k, len(raw) - 1)]
        out |= np.where(more, b & 0x7F, 0).astype(np.uint64) << np.uint64(7 * k)
        if k == 9 and (b[more] > 1).any():
            raise OverflowError("a number has more than 64 bits")
        more &= b > 0x7F
        if not more.any():
            break
    return (out >> np.uint64(1)).view(np.int64) ^ -(out & np.uint64(1)).view(np.int64)


def stepping(w, r):
    """Like ``reading``, as a function of (bytes, position, append) that appends a value and returns the position behind it.

    The values are those of ``reading``, but for decimals their digits as an integer, and for numbers their positions.
    """
    if isinstance(w, list):
        branches = []
        for b in w:
            try:
                branches.append(stepping(b, r))
            except TypeError as e:  # an error only for values of this branch

                def fail(raw, at, put, e=e):
                    raise e

                branches.append(fail)

        def union(raw, at, put):
            k = raw[at]
            if k & 0x81:
                k, at = _long_at(raw, at)
                return branches[k](raw, at, put)
            return branches[k >> 1](raw, at + 1, put)

        return union
    if isinstance(r, list):
        if w == "null" and "null" in r:

            def null(raw, at, put):
                put(None)
                return at

            return null
        if len(rest := members(r)) == 1:
            return stepping(w, rest[0])
    a, b, logical = _kind(w), _kind(r), r.get("logicalType") if isinstance(r, dict) else None
    one = reading(w, r)
    if logical == "decimal":

        def digits(raw, at, put):
            n, at = (w["size"], at) if a == "fixed" else _long_at(raw, at)
            end = at + n
            put(int.from_bytes(raw[at:end], "big", signed=True))
            return end

        return digits
    if a in ("int", "long") and b in ("int", "long"):

        def number(raw, at, put):
            put(at)
            while raw[at] > 0x7F:
                at += 1
            return at + 1

        return number
    if a == b == "double":

        def double(raw, at, put):
            put(_DOUBLE(raw, at)[0])
            return at + 8

        return double
    if a in ("string", "bytes") and b in ("string", "bytes"):

        def text(raw, at, put):
            n, at = _long_at(raw, at)
            put(raw[at : at + n].decode("utf-8") if b == "string" else raw[at : at + n])
            return at + n

        return text

    def other(raw, at, put):
        d = Decoder(raw)
        d.at = at
        put(one(d))
        return d.at

    return other


_DOUBLE = struct.Struct("<d").unpack_from


def _array(values: list, raw: bytes, r, kind: pa.DataType) -> pa.Array:
    """A column of what ``stepping`` appends, for the read type ``r``."""
    if isinstance(r, list):
        r = rest[0] if len(rest := members(r)) == 1 else r
    logical = r.get("logicalType") if isinstance(r, dict) else None
    if logical == "decimal":
        return _decimals(values, r.get("scale", 0), kind)
    if not values or _kind(r) not in ("int", "long"):
        return pa.array(values, type=kind)
    at = pa.array(values, type=pa.int64())
    there = at.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.where(there, _numbers_at(np.frombuffer(raw, np.uint8), at.fill_null(0).to_numpy(), there), 0)
    if logical in ("timestamp-millis", "local-timestamp-millis"):
        if (np.abs(numbers) > (2**63 - 1) // 1000).any() or (numbers == -(2**63)).any():
            raise OverflowError("a time has more than 64 bits of microseconds")
        numbers *= 1000
    out = pa.array(numbers, mask=~there)
    if pa.types.is_date32(kind):
        return out.cast(pa.int32()).cast(kind)
    if pa.types.is_integer(kind) or pa.types.is_timestamp(kind):
        return out.cast(kind)
    return pa.array(out.to_pylist(), type=kind)


def _decimals(values: list, scale: int, kind: pa.DataType) -> pa.Array:
    try:
        digits = pa.array(values, type=pa.int64())
    except (OverflowError, pa.ArrowInvalid):
        digits = None
    if digits is not None and pa.types.is_decimal128(kind) and kind.scale == scale:
        low = digits.fill_null(0).to_numpy()
        if not len(low) or (-(10**kind.precision) < low.min().item() and low.max().item() < 10**kind.precision):
            words = np.stack([low, low >> 63], axis=1).astype("<i8")
            return pa.Array.from_buffers(kind, len(low), [digits.buffers()[0], pa.py_buffer(words.tobytes())], digits.null_count)
    return pa.array([None if n is None else decimal.Decimal(n).scaleb(-scale, _EXACT) for n in values], type=kind)


def decoding(written, read, arrow: pa.Schema):
    """A function from the number of rows of a block and its bytes to a batch (both schemas linked)."""
    records = _kind(read) == "record"
    if records and _kind(written) != "record":
        one = reading(written, read)

        def by_row(n, raw):
            d = Decoder(raw)
            rows = [one(d) for _ in range(n)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow], schema=arrow)

        return by_row
    steps, defaults = _resolved(written, read, stepping) if records else ([(arrow[0].name, stepping(written, read))], {})
    kinds = {f["name"]: f["type"] for f in read["fields"]} if records else {arrow[0].name: read}
    last = {name: k for k, (name, _) in enumerate(steps)}

    def by_column(n, raw):
        values = {name: [] for name in last if name is not None}
        puts = [(step, values[name].append if name is not None and last[name] == k else _passed) for k, (name, step) in enumerate(steps)]
        at = 0
        for _ in range(n):
            for step, put in puts:
                at = step(raw, at, put)
        if at > len(raw):
            raise EOFError("an Avro value is cut off")
        columns = []
        for f in arrow:
            if f.name in values:
                columns.append(_array(values[f.name], raw, kinds[f.name], f.type))
            else:
                columns.append(pa.array([defaults.get(f.name)] * n, type=f.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return by_column


def _passed(value) -> None:
    """Drops a value."""


def header(schema, codec: str, sync: bytes) -> bytes:
    out = bytearray(MAGIC)
    encode({"type": "map", "values": "bytes"}, {"avro.schema": json.dumps(schema), "avro.codec": codec}, out)
    return bytes(out) + sync


def read_header(stream) -> tuple[object, str, bytes, int]:
    """Schema, codec, sync marker and size of the header."""
    size = 1 << 16
    while True:
        stream.seek(0)
        raw = stream.read(size)
        if raw[:4] != MAGIC:
            raise ValueError("not an Avro container file")
        d = Decoder(raw)
        d.at = 4
        try:
            meta = dict(d.value({"type": "map", "values": "bytes"}))
            sync = d.take(16)
        except (EOFError, IndexError):
            if len(raw) < size:
                raise
            size *= 4
            continue
        return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), sync, d.at


def block(rows: int, raw: bytes, codec: str, sync: bytes) -> bytes:
    if codec == "deflate":
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = engine.compress(raw) + engine.flush()
    out = bytearray()
    _long(out, rows)
    _long(out, len(raw))
    return bytes(out) + raw + sync


def _stream_long(stream) -> int | None:
    n = shift = 0
    while True:
        b = stream.read(1)
        if not b:
            return None
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def blocks(stream, codec: str, sync: bytes, first: int, start: int, end: int):
    """(rows, bytes) of the blocks whose sync marker in front lies in [start, end); the other arguments are of the header."""
    if start <= first:
        at = first
    else:
        at, held = start - 16, b""
        stream.seek(at)
        while True:
            chunk = stream.read(1 << 20)
            if not chunk:
                return
            held += chunk
            hit = held.find(sync)
            if hit >= 0:
                at += hit + 16
                break
            at += len(held) - 15
            held = held[-15:]
    stream.seek(at)
    while at < end or (at == first and start <= first):
        n = _stream_long(stream)
        if n is None:
            return
        raw = stream.read(_stream_long(stream))
        if stream.read(16) != sync:
            raise ValueError("a sync marker does not match")
        at = stream.tell()
        if codec == "deflate":
            raw = zlib.decompress(raw, -15)
        elif codec != "null":
            raise ValueError(f"codec {codec} is not supported")
        yield n, raw


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, size: int, avro):
        self.path, self.schema, self.size, self.avro = path, schema, size, avro

    def partitions(self):
        return ranges(self.path, self.size)

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = file_system(part.uri)
        arrow = to_arrow_schema(self.schema)
        with fs.open_input_file(part.path) as stream:
            written, *head = read_header(stream)
            batch = decoding(linked(written), linked(self.avro), arrow)
            for rows, raw in blocks(stream, *head, part.start, part.end):
                yield batch(rows, raw)


class _Writer(FilesWriter):
    suffix = ".avro"

    def __init__(self, path: str, schema: T.StructType, codec: str, overwrite: bool, bare: bool, avro=None):
        super().__init__(path, schema, overwrite)
        self.codec, self.bare, self.avro = codec, bare, avro

    def dump(self, out, batches):
        kind = self.schema.fields[0].dataType if self.bare else self.schema
        shown, sync = self.avro or to_avro(kind, nullable=self.bare and self.schema.fields[0].nullable), uuid.uuid4().bytes
        schema = linked(shown)
        out.write(header(shown, self.codec, sync))
        for batch in batches:
            for part in (batch.slice(k, ROWS_IN_BLOCK) for k in range(0, batch.num_rows, ROWS_IN_BLOCK)):
                out.write(block(part.num_rows, encoded(schema, part, self.bare), self.codec, sync))


class AvroSource(DataSource):
    """Options: ``path``, ``codec`` (deflate or null), ``bare`` (write the only column without a record), ``range`` (bytes),
    ``reader`` and ``writer`` (Avro schemas as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "millrace_avro"

    def _avro(self):
        """The reader schema: as given, else that of the first file."""
        if "reader" in self.options:
            return json.loads(self.options["reader"])
        fs, files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        with fs.open_input_file(files[0].path) as stream:
            return read_header(stream)[0]

    def schema(self) -> T.StructType:
        avro = self._avro()
        kind = from_avro(avro)
        return kind if _kind(linked(avro)) == "record" else T.StructType([T.StructField("value", kind)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("range", RANGE)), self._avro())

    def writer(self, schema: T.StructType, overwrite: bool):
        bare = self.options.get("bare", "false") == "true"
        return _Writer(self.options["path"], schema, self.options.get("codec", "deflate"), overwrite, bare, json.loads(self.options.get("writer", "null")))


def dumps(rows: list, schema, codec: str = "null", sync: bytes = b"0123456789abcdef") -> bytes:
    """A whole container file in memory, for tests and small files."""
    body, kind = bytearray(), linked(schema)
    for r in rows:
        encode(kind, r, body)
    return header(schema, codec, sync) + (block(len(rows), bytes(body), codec, sync) if rows else b"")


def loads(raw: bytes, reader=None) -> list:
    stream = io.BytesIO(raw)
    written, *head = read_header(stream)
    one = reading(linked(written), linked(written if reader is None else reader))
    out = []
    for rows, body in blocks(stream, *head, 0, len(raw)):
        d = Decoder(body)
        out += [one(d) for _ in range(rows)]
    return out
