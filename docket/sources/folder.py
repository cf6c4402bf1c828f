"""Folder listing as a Python data source (R01): entries are listed in tasks, not on the driver.

``binaryFile`` collects the status of every file on the driver and leaves out names that
begin with ``_`` or ``.`` and files of no bytes. Here a folder is one partition of the scan:
its entries stream out of the task in Arrow batches, every entry whose name ends with the
suffix is kept whatever else it is called, and a folder so named or an empty file comes
through the extraction as an unreadable entry, with its error. Several folders (a corpus cut
by prefix) are as many partitions; nothing is listed below them.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docket.session import ship_package
from docket.sources.docx import EXTRACT_DDL, docx_text

ENTRY_DDL = "path string, filename string, is_folder boolean, length bigint"
_ENTRY_ARROW = pa.schema([("path", pa.string()), ("filename", pa.string()), ("is_folder", pa.bool_()),
                          ("length", pa.int64())])


def _local(path: str) -> str | None:
    """The local path of ``file:`` addresses and plain paths; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else path


def entries(folder: str) -> Iterator[tuple[str, str, bool, int | None]]:
    """``(path, name, is_folder, bytes)`` of what lies directly in a folder; a folder has no bytes."""
    local = _local(folder)
    if local is not None:
        with os.scandir(local) as found:
            for e in found:
                is_folder = e.is_dir()
                try:
                    length = None if is_folder else e.stat().st_size
                except OSError:  # a dangling link, or a file that went away: reading it will say so
                    length = None
                yield f"{folder.rstrip('/')}/{e.name}", e.name, is_folder, length
        return
    from pyarrow import fs as pafs

    system, base = pafs.FileSystem.from_uri(folder)
    for info in system.get_file_info(pafs.FileSelector(base, recursive=False)):
        is_folder = info.type == pafs.FileType.Directory
        yield f"{folder.rstrip('/')}/{info.base_name}", info.base_name, is_folder, None if is_folder else info.size


def read_bytes(path: str) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as fh:
            return fh.read()
    from pyarrow import fs as pafs

    system, place = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(place) as fh:
        return fh.read()


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], suffix: str, batch_rows: int):
        self.folders, self.suffix, self.batch_rows = folders, suffix, batch_rows

    def partitions(self):
        return [_Folder(f) for f in self.folders]

    def read(self, partition):
        rows = []
        for entry in entries(partition.value):
            if not entry[1].endswith(self.suffix):
                continue
            rows.append(entry)
            if len(rows) >= self.batch_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY_ARROW)],
                                                 schema=_ENTRY_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY_ARROW)],
                                             schema=_ENTRY_ARROW)


class FolderSource(DataSource):
    """Format ``folder``. Options: ``path`` (folders, one a line), ``suffix``, ``batchRows``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return ENTRY_DDL

    def reader(self, schema):
        folders = [f for f in self.options.get("path", "").split("\n") if f]
        if not folders:
            raise ValueError("the folder source needs a path")
        return FolderReader(folders, self.options.get("suffix", ""), int(self.options.get("batchRows", "10000")))


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark's own sources would give it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def list_folder(spark: SparkSession, folders: str | list[str], suffix: str = ".docx") -> DataFrame:
    """``(path, filename, is_folder, length)`` of every entry whose name ends with ``suffix``.

    The suffix is case-sensitive. A folder that does not exist fails the read.
    """
    ship_package(spark)
    spark.dataSource.register(FolderSource)
    folders = [folders] if isinstance(folders, str) else folders
    where = "\n".join(qualified(spark, f) for f in folders)
    return spark.read.format("folder").option("suffix", suffix).option("path", where).load()


_ROWS, _CHARS = 256, 1 << 22  # of texts held before they are sent on


def _extract_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "filename", "text", "error"]
    rows, size = [], 0
    for pdf in batches:
        for path, name in zip(pdf["path"], pdf["filename"]):  # one file's bytes in memory at a time
            try:
                row = (path, name, docx_text(read_bytes(path)), None)
            except Exception as e:  # quarantine, never fail the task
                row = (path, name, None, f"{type(e).__name__}: {e}")
            rows.append(row)
            size += len(row[2] or "")
            if len(rows) >= _ROWS or size >= _CHARS:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def read_listed(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(path, filename, text, error)`` of listed files, dealt out by a hash of the path."""
    # by number: the adaptive plan would put the few bytes of thousands of names into one task
    partitions = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "filename").repartition(partitions, "path").mapInPandas(_extract_files, EXTRACT_DDL)


def read_docx_files(spark: SparkSession, folders: str | list[str], suffix: str = ".docx",
                    partitions: int | None = None) -> DataFrame:
    """R01 + R02 + R03: ``(path, filename, text, error)`` for every entry that ends with ``suffix``.

    The listing's narrow rows are dealt out by a hash of the path (``partitions`` tasks, or the
    session's shuffle partitions), so the tasks that open files do not follow the folders.
    """
    return read_listed(list_folder(spark, folders, suffix), partitions)
