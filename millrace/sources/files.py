"""What the file formats of this folder share: files cut into ranges, and writers that publish when all tasks have succeeded."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

#: bytes that a task reads
RANGE = 64 << 20


def file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def files_of(path: str):
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [info]
    found = fs.get_file_info(pafs.FileSelector(at))
    return fs, sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


class Range(InputPartition):
    def __init__(self, uri: str, path: str, start: int, end: int):
        self.uri, self.path, self.start, self.end = uri, path, start, end


def ranges(path: str, size: int) -> list[Range]:
    """The files of a folder in pieces; a piece without a path stands for none."""
    _, files = files_of(path)
    return [Range(path, f.path, s, min(f.size, s + size)) for f in files for s in range(0, max(f.size, 1), size)] or [Range(path, "", 0, 0)]


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class FilesWriter(DataSourceArrowWriter):
    """A file a task, in a folder of the run first. The commit moves them; only then goes what an overwrite replaces."""

    suffix = ""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.run = uuid.uuid4().hex
        fs, at = file_system(path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound and files_of(path)[1]:
            raise FileExistsError(path)

    def dump(self, out, batches) -> None:
        """Writes the batches of a task to a stream."""
        raise NotImplementedError

    def write(self, iterator):
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/_temporary-{self.run}", recursive=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        with fs.open_output_stream(f"{at}/_temporary-{self.run}/{name}", compression=None) as out:
            self.dump(out, iterator)
        return Written(name)

    def commit(self, messages):
        fs, at = file_system(self.path)
        old = files_of(self.path)[1] if self.overwrite else []
        for m in messages:
            if m is not None:
                fs.move(f"{at}/_temporary-{self.run}/{m.name}", f"{at}/{m.name}")
        for f in old:
            fs.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages):
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/_temporary-{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_temporary-{self.run}")
