"""A Spark data source that lists files: folders are listed in tasks, and nothing but folder names passes the driver.

The driver lists the root and its folders only, ``depth`` levels deep; each folder at that depth is a partition that one task lists to the bottom, and the folders above are listed flat. Rows are
made in batches as a folder is read. Files without bytes are rows like others. Any store that Arrow can open by its address works: local disks, HDFS, S3, GCS.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000


def _opened(root: str):
    """File system, path in it, and what an address of the store begins with."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/") or "/", "file:"
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/"), root.rstrip("/").removesuffix(path.rstrip("/"))


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FileListReader(DataSourceReader):
    def __init__(self, root: str, depth: int):
        self.root, self.depth = root, depth

    def partitions(self) -> list[_Folder]:
        from pyarrow import fs

        system, path, _ = _opened(self.root)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        level, out = [path], []
        for _ in range(self.depth):
            out += [_Folder(p, False) for p in level]
            level = sorted(i.path for p in level for i in system.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.Directory)
        return out + [_Folder(p, True) for p in level]

    def read(self, folder: _Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _, prefix = _opened(self.root)
        waiting, rows = [folder.path], []
        while waiting:  # folder by folder, so that a task holds one folder's names at most
            for i in system.get_file_info(fs.FileSelector(waiting.pop())):
                if i.type == fs.FileType.Directory:
                    waiting += [i.path] * folder.deep
                elif i.type == fs.FileType.File:
                    rows.append((prefix + i.path, i.size, i.mtime_ns // 1000 if i.mtime_ns else None))
                if len(rows) >= BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        path, length, changed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(changed, pa.timestamp("us", "UTC"))], ["path", "length", "modified"])


class FileList(DataSource):
    """``spark.read.format("file_list").option("depth", 2).load(root)``: ``path, length, modified`` of every file below a folder."""

    @classmethod
    def name(cls) -> str:
        return "file_list"

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema) -> FileListReader:
        return FileListReader(self.options["path"], int(self.options.get("depth", "1")))


def list_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``path, length, modified`` of every file below ``root``, listed in as many tasks as it has folders down to ``depth``. A root that is not there is an error; an empty one gives no rows."""
    spark.dataSource.register(FileList)
    return spark.read.format("file_list").option("depth", depth).load(root)
