"""A Spark data source over the files of a folder: names and sizes, and on request the digest of their content.

The folder is listed without reading content. Files are dealt into partitions of about PARTITION_BYTES (a larger file is
one by itself) or PARTITION_FILES, and a task streams each of its files through the digest in blocks of BLOCK_BYTES, so a
file of any size takes bounded memory. Hidden files (names that begin with a dot or underscore) are left out, as in
Spark's own file sources.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, PARTITION_FILES, BLOCK_BYTES = 256 << 20, 10_000, 4 << 20


@dataclass
class Files(InputPartition):
    """Paths and sizes that one task reads."""

    files: list[tuple[str, int]]


def open_store(path: str):
    """The file system of a path or address and the path in it; an error where only Spark reads it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


class FileReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, digest: bool):
        self.path, self.pattern, self.digest = path, pattern, digest

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(root) :].strip("/").split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and fnmatch.fnmatchcase(f.base_name, self.pattern))
        parts, held, size = [], [], 0
        for path, length in files:
            if held and (len(held) >= PARTITION_FILES or self.digest and size + length > PARTITION_BYTES):
                parts.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length
        return [*parts, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str | None]]:
        store, _ = open_store(self.path)
        for path, length in partition.files:
            yield path, length, self.sha256(store, path) if self.digest else None

    @staticmethod
    def sha256(store, path: str) -> str:
        digest = hashlib.sha256()
        with store.open_input_stream(path, buffer_size=0) as stream:
            while block := stream.read(BLOCK_BYTES):
                digest.update(block)
        return digest.hexdigest()


class FileSource(DataSource):
    """``spark.read.format("cellframe_files").option("pattern", "*.tif").option("digest", "true").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "cellframe_files"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], self.options.get("pattern", "*"), self.options.get("digest", "false").lower() == "true")
