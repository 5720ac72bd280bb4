"""Archives as a Spark data source: ``spark.read.format("gridarchive")``.

Options: ``path`` (folder of the archives), ``list`` (a file that names them; without
it all ``.tar`` files of the folder) and ``partitionBytes``. Rows are planes
``(archive_path, record_name, var, level, dims, fill, values)``.

Archives are split into byte ranges, as Parquet files are: a partition reads the
entries that begin in its range. Filters on ``record_name``, ``var`` and ``level``
(equality and ``IN``) are pushed into the reader, so an entry of another record is
not opened, and of an entry only the header and the planes asked for are read.
``register`` sets ``spark.sql.python.filterPushdown.enabled``, without which Spark
refuses a reader that takes filters.
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gridframe.session import is_local_uri, local_path
from gridframe.sources import archives, extents

SCHEMA = "archive_path string, record_name string, var string, level int, dims array<int>, fill float, values array<float>"
_ARROW = pa.schema([("archive_path", pa.string()), ("record_name", pa.string()), ("var", pa.string()), ("level", pa.int32()),
                    ("dims", pa.list_(pa.int32())), ("fill", pa.float32()), ("values", pa.list_(pa.float32()))])
PARTITION_BYTES = 256 << 20
_PUSHED = ("record_name", "var", "level")


class ByteRange(InputPartition):
    """The entries of an archive whose headers begin in [begin, end)."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


def _names(folder: str) -> list[str]:
    if is_local_uri(folder):
        return sorted(os.listdir(local_path(folder)))
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(folder)
    return sorted(f.base_name for f in filesystem.get_file_info(fs.FileSelector(inner)))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        self.listing = options.get("list")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in _PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def _paths(self) -> list[str]:
        if self.listing:
            with archives._open(self.listing) as fh:
                names = [line.strip() for line in fh.read().decode().splitlines()]
        else:
            names = [n for n in _names(self.root) if n.endswith(".tar")]
        return [f"{self.root.rstrip('/')}/{n}" for n in dict.fromkeys(names) if n]

    def partitions(self) -> list[ByteRange]:
        out = []
        for path in self._paths():
            with archives._open(path) as fh:
                size = fh.seek(0, 2)
            out += [ByteRange(path, at, min(size, at + self.bytes)) for at in range(0, size, self.bytes)]
        return out

    def _asked(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        with archives._open(partition.path) as fh, tarfile.open(fileobj=fh, mode="r:") as tar:
            for member in tar:  # headers only: the data of members is skipped over
                if member.offset >= partition.end:
                    break
                name = os.path.basename(member.name)
                if member.offset < partition.begin or not member.isfile() or not self._asked("record_name", name):
                    continue
                at = fh.tell()
                yield from self._entry(fh, partition.path, name, member.offset_data, member.size)
                fh.seek(at)

    def _entry(self, fh, path: str, name: str, offset: int, size: int) -> Iterator[pa.RecordBatch]:
        header = extents.read_header(fh, offset, size)
        chosen = [(var, *plane) for var in header.variables if self._asked("var", var)
                  for plane in extents.planes(header, var, offset, size) if self._asked("level", plane[0])]
        chosen.sort(key=lambda p: p[4])
        values = [v for v, _ in extents.read_runs(fh, [(p[4], p[5]) for p in chosen])]
        if chosen:
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * len(chosen)), pa.array([name] * len(chosen)), pa.array([p[0] for p in chosen]),
                pa.array([p[1] for p in chosen], pa.int32()), pa.array([p[2] for p in chosen], pa.list_(pa.int32())),
                pa.array([p[3] for p in chosen], pa.float32()), pa.array(values, pa.list_(pa.float32()))],
                schema=_ARROW)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark) -> None:
    """Make the format known to a session, which then pushes filters into Python
    sources, and the package to its workers."""
    from gridframe.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
