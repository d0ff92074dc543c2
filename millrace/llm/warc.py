"""WARC archives: writing, normalising monolithic gzip files, reading back by a sidecar index.

``write_archives`` writes one monolithic gzip stream a task. ``normalise`` inflates each such file once, as a
stream, rewrites every record as a gzip member of its own and writes a sidecar with one JSON line a record
(offset, length, type, digest). ``read_archives`` follows the sidecar: any record can be read alone.

Files go to the folder given (any file system of pyarrow), under a name of the attempt first and then renamed,
so a task that is run again leaves the same files. A null html is an empty payload. Of equal payloads of at
least 100 bytes, rows of the smallest page_id are responses and the others revisit it; where all ids of such
a payload are null, all are responses. A revisit names the record of its page (WARC-Refers-To). Control characters of a
url are percent-encoded. Memory: one record and its line of the sidecar when writing, about 8 MB of records when reading;
each file is a task of its own. Repeated rows are records each. Without pages there is no file and no row. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, remove, saved, scratch, tidied

LEAST = 100
#: payloads that occur more than once, up to which their table is broadcast (about 100 bytes each)
BROADCAST_ROWS = 200_000
CHUNK = 1 << 20


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


class _Publish:
    """An output stream under a temporary name, renamed at the end."""

    def __init__(self, uri: str):
        self.fs, self.path = _file_system(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            try:
                self.fs.move(self.temporary, self.path)
            except OSError:  # some file systems don't replace what an attempt before has left
                if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
                    raise
                self.fs.delete_file(self.path)
                self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


def record_id(page_id, digest: str) -> str:
    """The same page and payload always have the same name, so a revisit can tell that of its response."""
    return f"<urn:uuid:{uuid.UUID(bytes=sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the headers only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _inflated(stream):
    """The content of a gzip file of one or many members, chunk by chunk."""
    engine = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(chunk)
            chunk = engine.unused_data
    if not engine.eof:
        raise EOFError("the gzip stream is cut off")


def records(chunks):
    """(raw record, its headers) of a stream of WARC bytes."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        held.extend(part)
        return True

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held:
                    raise EOFError("a record is cut off")
                return
        head = _headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise EOFError("a record is cut off")
        yield bytes(held[:size]), head
        del held[:size]


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which payloads repeat is found from digests alone."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = saved(
        p.where(F.octet_length("html") >= LEAST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "repeated",
    )
    small = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = p.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    return out.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes a monolithic gzip file for each task with rows; returns the saved table (path, n_records)."""
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        path, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with _Publish(path) as out:
            engine = zlib.compressobj(level, wbits=31)
            batch = first
            while batch is not None:
                for k in range(batch.num_rows):
                    page_id, url, html, digest, refers_to = (c[k].as_py() for c in batch.columns)
                    out.write(engine.compress(record(page_id, url, html.encode("utf-8"), digest, refers_to)))
                    n += 1
                batch = next(batches, None)
            out.write(engine.flush())
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=schema)

    return saved(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n_records long"), "written")


def _each_file(paths: DataFrame) -> DataFrame:
    """One file a task: as many ranges as there are files, whose names differ. There is a short row for each file."""
    return paths.repartitionByRange(max(1, paths.count()), "path")


def normalise(paths: DataFrame, level: int = 1) -> DataFrame:
    """Rewrites each file of ``path`` with a member a record and a sidecar; returns (path, index, n_records)."""

    def start():
        def work(files):
            rows = []
            for path in files:
                target = path.removesuffix(".warc.gz") + ".members.warc.gz"
                index = target + ".jsonl"
                fs, at = _file_system(path)
                offset = n = 0
                with fs.open_input_stream(at, compression=None) as source, _Publish(target) as out, _Publish(index) as side:
                    for raw, head in records(_inflated(source)):
                        engine = zlib.compressobj(level, wbits=31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        entry = {"offset": offset, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"], "digest": head["warc-payload-digest"]}
                        side.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                        n += 1
                rows.append((target, index, n))
            return list(map(list, zip(*rows)))

        return work

    return saved(map_columns(_each_file(paths), ["path"], "path string, index string, n_records long", start), "normalised")


def read_record(source, entry: dict) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that a line of the sidecar describes."""
    source.seek(entry["offset"])
    raw = zlib.decompress(source.read(entry["length"]), wbits=31)
    head_end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:head_end])
    block = raw[head_end + 4 : head_end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record, read through the sidecar. A payload that doesn't match its digest fails the task."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist()):
                fs, at = _file_system(path)
                fs2, side = _file_system(index)
                rows, size = [], 0
                with fs.open_input_file(at) as source, fs2.open_input_stream(side, compression=None) as lines:
                    for line in io.TextIOWrapper(lines, encoding="utf-8", newline="\n"):
                        head, payload = read_record(source, json.loads(line))
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        kind, n = head["warc-type"], int(head["x-payload-bytes"])
                        if kind == "response" and (len(payload) != n or sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload does not match its digest")
                        ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page")]
                        rows.append((ids[0], n, digest, kind, ids[1], head["warc-target-uri"], payload if kind == "response" else None))
                        size += len(payload) + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _each_file(files).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back all pages; what was read is a saved table, and the archives are removed."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    try:
        with tidied():
            files = normalise(write_archives(with_references(pages), folder))
            out = read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
            return saved(out, "records", keep=True)
    finally:
        remove(spark, folder.rpartition("/")[0])
