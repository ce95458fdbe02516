"""Uploaded originals in a folder: listed in tasks, and looked into by range.

Sizes are known from the listing, and of an original only its first bytes are
needed, so what is read grows with the number of files and not with their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ledgerlane import fixed
from ledgerlane.session import spread
from ledgerlane.sources.payloads import check_originals

#: bytes that tell the type of a file
HEAD = 12
#: files a task has open at once; each costs a request, not bandwidth
AT_ONCE = 16
#: rows of a listing that leave a task together
LISTED = 10_000

LISTING = "path string, length long"


class Folder(InputPartition):
    """One folder to list: with everything below it, or its own files only."""

    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Listing(DataSourceReader):
    def __init__(self, folder: str, depth: int):
        self.folder, self.depth = folder, depth

    def partitions(self) -> list[Folder]:
        files, root = pa.fs.FileSystem.from_uri(self.folder)
        found, level = [], [root]
        for _ in range(self.depth):
            found += [Folder(path, False) for path in level]
            level = [i.path for path in level for i in files.get_file_info(pa.fs.FileSelector(path)) if i.type == pa.fs.FileType.Directory]
        return found + [Folder(path, True) for path in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = pa.fs.FileSystem.from_uri(self.folder)
        waiting, rows = [partition.path], []
        while waiting:
            for i in files.get_file_info(pa.fs.FileSelector(waiting.pop())):
                if i.type == pa.fs.FileType.Directory and partition.deep:
                    waiting.append(i.path)
                elif i.type == pa.fs.FileType.File:
                    rows.append((i.path, i.size))
            while len(rows) >= LISTED or (rows and not waiting):
                some, rows = rows[:LISTED], rows[LISTED:]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64())], names=["path", "length"])


class FileListing(DataSource):
    """``path, length`` of all files below a folder.

    The driver lists folders down to ``depth`` levels (1: those directly below,
    say one for each owner), each of which is listed further by a task.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> _Listing:
        return _Listing(self.options["path"], int(self.options.get("depth", "1")))


def list_files(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """``path, length`` of every file below ``folder``; no file is opened."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("depth", str(depth)).load(folder)


def read_heads(files: DataFrame, folder: str, size: int = HEAD) -> DataFrame:
    """``files`` (with a ``path`` below ``folder``) and ``content``, the first
    ``size`` bytes of each; null for a file that is gone by now.

    Files are dealt evenly first, so a folder that holds a third of them is
    read by all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(folder)

        def head(path: str) -> bytes | None:
            try:
                with system.open_input_file(path) as file:
                    return file.read_at(min(size, file.size()), 0)
            except FileNotFoundError:
                return None

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                heads = pa.array(pool.map(head, batch.column("path").to_pylist()), type=pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, heads], names=[*batch.schema.names, "content"])

    schema = StructType(files.schema.fields).add("content", "binary")
    return spread(files, "path").mapInArrow(run, schema)


def scan_originals(spark: SparkSession, folder: str, manifest: DataFrame, depth: int = 1, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """``check_originals`` over a folder whose files are named by document.

    ``manifest``: document_id, content_type, byte_size.  Only files of the
    declared and accepted size are opened: any other is refused for its size.
    A document without a file is empty; a file without a document is no row.
    Of several files of one document, the one with the smallest path counts.
    """
    named = F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("document_id")
    files = list_files(spark, folder, depth).select(named, "path", "length")
    files = files.groupBy("document_id").agg(F.min_by(F.struct("path", "length"), "path").alias("f")).select("document_id", "f.path", "f.length")
    declared = manifest.select("document_id", "byte_size")
    opened = files.join(declared, "document_id").filter((F.col("length") == F.col("byte_size")) & F.col("length").between(1, max_bytes)).select("document_id", "path").distinct()
    heads = read_heads(opened, folder).select("document_id", "content")
    return check_originals(files.select("document_id", "length").join(heads, "document_id", "left"), manifest)


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``path`` (below ``folder``) and ``content`` as files; how many.

    A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = f"{root}/{path}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    return files.select("path", "content").mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0
