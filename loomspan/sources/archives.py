"""Zip archives as a data source: members are rows, ranges of them partitions, and filters on names are pushed down.

Only the directory at an archive's end is read to plan. A filter on member (equal, in, starts or ends with) or on path leaves
the other members out of the partitions, so that nothing else of an archive is opened; what is left of a filter Spark applies
itself. Files are reached by pyarrow's file systems, whose paths all executors must see."""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, member string, n_bytes bigint, content binary"
#: Bytes of members, as they are outside the archive, that a partition has, about; members above the other are left out.
RANGE, MOST = 64 << 20, 256 << 20


@dataclass
class Members(InputPartition):
    """A range of an archive's members."""

    path: str
    names: tuple[str, ...]


def open_archive(path: str) -> zipfile.ZipFile:
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(place))


def archives_at(path: str) -> list[str]:
    """The archive at a path, or all in a folder."""
    scheme, sep, rest = path.partition("://")
    system, place = fs.FileSystem.from_uri(path) if sep else (fs.LocalFileSystem(), path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".zip"))
    return [path.rstrip("/") + "/" + posixpath.basename(f) for f in found]


def safe_members(archive: zipfile.ZipFile, most: int) -> Iterator[zipfile.ZipInfo]:
    """Members that stay in the folder that they would be unpacked to, and are not too large."""
    for info in archive.infolist():
        name = posixpath.normpath(info.filename)
        if not (info.is_dir() or name.startswith(("/", "..")) or info.file_size > most):
            yield info


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range, self.most = options["path"], int(options.get("range", RANGE)), int(options.get("most", MOST))
        self.tests: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            test = None
            if column in ("path", "member"):
                if isinstance(f, EqualTo):
                    test = lambda x, v=f.value: x == v
                elif isinstance(f, In):
                    test = lambda x, v=frozenset(f.value): x in v
                elif isinstance(f, StringStartsWith):
                    test = lambda x, v=f.value: x.startswith(v)
                elif isinstance(f, StringEndsWith):
                    test = lambda x, v=f.value: x.endswith(v)
            if test:
                self.tests.append((column, test))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(test(value) for c, test in self.tests if c == column)

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for path in archives_at(self.path):
            if not self._wanted("path", path):
                continue
            try:
                archive = open_archive(path)
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # a broken archive has no members; one too short cannot be sought in
                continue
            names, size = [], 0
            with archive:
                for info in safe_members(archive, self.most):
                    if self._wanted("member", posixpath.normpath(info.filename)):
                        if names and size + info.file_size > self.range:
                            out.append(Members(path, tuple(names)))
                            names, size = [], 0
                        names.append(info.filename)
                        size += info.file_size
            if names:
                out.append(Members(path, tuple(names)))
        return out or [Members("", ())]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.names:
            return
        with open_archive(partition.path) as archive:
            for name in partition.names:
                content = archive.read(name)
                columns = [pa.array([partition.path]), pa.array([posixpath.normpath(name)]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "member", "n_bytes", "content"])


class Archives(DataSource):
    """spark.read.format("archives").load(path): (path, member, n_bytes, content) of the zip archives at a path."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register_archives(spark: SparkSession) -> None:
    """Makes format("archives") known to a session, and lets filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
