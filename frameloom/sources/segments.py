"""Video segments as a Python Data Source: a folder whose files count once they are whole.

A file is whole when it isn't empty and its size is the same at two looks in a row; until then it waits. What has been seen
and what was whole are the stream's offsets, so a restart neither loses nor repeats a file. Offsets hold the names of the
files in the folder, as many as its retention leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "path string, length long, mtime long"
#: What video files are called, in any case.
EXTENSIONS = ("mp4", "mov", "avi", "mkv", "m4v", "webm")


def listed(path: str, extensions: tuple[str, ...]) -> dict[str, list[int]]:
    """Files under the path, in any store that Arrow reads, as [size, time of change]; none where the folder isn't there."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return {f.path: [f.size, int(f.mtime.timestamp()) if f.mtime else 0] for f in found if f.type == fs.FileType.File and f.base_name.rpartition(".")[2].lower() in extensions}


class SegmentStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, extensions: tuple[str, ...]):
        self.path, self.extensions = path, extensions

    def initialOffset(self) -> dict:
        return {"waiting": {}, "whole": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = listed(self.path, self.extensions)
        known = {p: v for p, v in start["whole"].items() if p in now}
        fresh = {p: v for p, v in now.items() if p not in known and v[0] > 0 and start["waiting"].get(p) == v[0]}
        waiting = {p: v[0] for p, v in now.items() if p not in known and p not in fresh}
        end = {"waiting": waiting, "whole": known | fresh}
        return iter([(p, *v) for p, v in sorted(fresh.items())]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(p, *v) for p, v in sorted(end["whole"].items()) if p not in start["whole"]])

    def commit(self, end: dict) -> None:
        pass


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, extensions: tuple[str, ...]):
        self.path, self.extensions = path, extensions

    def partitions(self):
        return [InputPartition((p, *v)) for p, v in sorted(listed(self.path, self.extensions).items()) if v[0] > 0]

    def read(self, partition) -> Iterator[tuple]:
        # without a file there is one empty partition
        return iter([partition.value] if partition is not None and partition.value is not None else [])


class Segments(DataSource):
    """Options: path, and extensions (comma-separated) if not those of video files."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def _of(self) -> tuple[str, tuple[str, ...]]:
        return self.options["path"], tuple(self.options.get("extensions", ",".join(EXTENSIONS)).lower().split(","))

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(*self._of())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return SegmentStreamReader(*self._of())


def register(spark: SparkSession) -> None:
    """Make the format "segments" known to the session."""
    spark.dataSource.register(Segments)
