"""Extent index: where in an archive every level of every variable lies.

Headers say it all, so the index of an entry costs one small read. A plane is then
read by its own bytes; neighbouring extents of a file are read together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.session import ship_package
from gridframe.sources import archives, netcdf

HEADER_BYTES = 1 << 16
#: extents of a file that are no further apart are read together, up to so many bytes
GAP_BYTES = 1 << 16
READ_BYTES = 16 << 20

EXTENT_DDL = ("archive_path string, entry_idx int, record_name string, var string, level int, dims array<int>, "
              "fill float, begin long, n_bytes long, reason string")
_EXTENT = pa.schema([
    ("archive_path", pa.string()), ("entry_idx", pa.int32()), ("record_name", pa.string()), ("var", pa.string()), ("level", pa.int32()),
    ("dims", pa.list_(pa.int32())), ("fill", pa.float32()), ("begin", pa.int64()), ("n_bytes", pa.int64()), ("reason", pa.string())])
PLANE_DDL = "record_name string, var string, level int, dims array<int>, fill float, values array<float>, bytes_read long"


def read_header(fh, offset: int, size: int) -> netcdf.Dataset:
    """The header of the file at ``offset``: a small read, or longer ones while it is cut."""
    wanted = HEADER_BYTES
    while True:
        fh.seek(offset)
        raw = fh.read(min(wanted, size))
        if len(raw) < min(wanted, size):
            raise OSError(f"short read: {len(raw)} of {min(wanted, size)} bytes")
        try:
            return netcdf.loads(raw)
        except netcdf.NetCDFError as exc:
            if wanted >= size or "truncated" not in str(exc):
                raise
            wanted *= 8


def planes(ds: netcdf.Dataset, var: str, offset: int, size: int) -> list[tuple[int, list[int], float | None, int, int]]:
    """``(level, dims, fill, begin, n_bytes)`` of a float variable's levels; a 2-D one is level 0."""
    v = ds.variables.get(var)
    if v is None:
        raise netcdf.NetCDFError(f"missing variable {var}")
    if v.nc_type != 5 or len(v.shape) not in (2, 3):
        raise ValueError(f"{var} is not a float grid of rank 2 or 3")
    dims = [int(x) for x in v.shape[-2:]]
    n_bytes = 4 * dims[0] * dims[1]
    if v.is_record and len(v.shape) == 2:
        raise ValueError(f"{var} has its rows apart")
    step = ds.record_size if v.is_record else n_bytes
    fill = v.attrs.get("_FillValue")
    fill = None if fill is None else float(np.float32(np.asarray(fill).reshape(-1)[0]))
    out = [(k, dims, fill, offset + v.begin + k * step, n_bytes) for k in range(v.shape[0] if len(v.shape) == 3 else 1)]
    if out and out[-1][3] + n_bytes > offset + size:
        raise ValueError(f"{var} goes beyond its entry")
    return out


def _indexer(variables: list[str] | None):
    def run(batches):
        handles = {}
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("archive_path", "entry_idx", "record_name", "size", "data_offset")]
            for path, idx, name, size, offset in zip(*cols):
                try:
                    if path not in handles:
                        for old in handles.values():
                            old.close()
                        handles = {path: archives._open(path)}
                    ds = read_header(handles[path], offset, size)
                except Exception as exc:  # noqa: BLE001 - a damaged entry is a row with its reason
                    rows.append((path, idx, name, None, None, None, None, None, None, f"{type(exc).__name__}: {exc}"))
                    continue
                for var in variables or list(ds.variables):
                    try:
                        rows += [(path, idx, name, var, *plane, None) for plane in planes(ds, var, offset, size)]
                    except ValueError as exc:
                        rows.append((path, idx, name, var, None, None, None, None, None, str(exc)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_EXTENT)], schema=_EXTENT)
        for old in handles.values():
            old.close()

    return run


def extent_index(manifest: DataFrame, variables: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per entry, variable and level: shape, fill value, first byte in the
    archive and length. Entries without a readable header, and variables that are
    absent or no float grid, are a row with the reason."""
    ship_package(manifest.sparkSession)
    manifest, n = archives._sized(manifest, partitions)
    entries = archives._listed(manifest).select("archive_path", "entry_idx", "record_name", "size", "data_offset")
    return entries.repartition(n, "archive_path", "entry_idx").sortWithinPartitions("archive_path", "data_offset").mapInArrow(
        _indexer(variables), EXTENT_DDL)


def read_runs(opened, extents: list[tuple[int, int]]):
    """Values of the extents (begin, n_bytes) of one file, in rising order, and the bytes
    that the read of each cost (0 if an earlier one brought it along)."""
    at = 0
    while at < len(extents):
        first, last = extents[at][0], at
        end = first + extents[at][1]
        while last + 1 < len(extents) and extents[last + 1][0] - end <= GAP_BYTES and extents[last + 1][0] + extents[last + 1][1] - first <= READ_BYTES:
            last += 1
            end = max(end, extents[last][0] + extents[last][1])
        opened.seek(first)
        raw = opened.read(end - first)
        if len(raw) < end - first:
            raise OSError(f"short read: {len(raw)} of {end - first} bytes")
        for k in range(at, last + 1):
            begin, n_bytes = extents[k]
            yield np.frombuffer(raw, ">f4", n_bytes // 4, begin - first).astype(np.float32), end - first if k == at else 0
        at = last + 1


def _plane_reader(batches):
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("archive_path", "record_name", "var", "level", "dims", "fill", "begin", "n_bytes")}
        at = 0
        while at < batch.num_rows:
            path, upto = cols["archive_path"][at], at
            while upto < batch.num_rows and cols["archive_path"][upto] == path:
                upto += 1
            rows = range(at, upto)
            with archives._open(path) as fh:
                values = list(read_runs(fh, [(cols["begin"][i], cols["n_bytes"][i]) for i in rows]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(cols[c][at:upto], _EXTENT.field(c).type) for c in ("record_name", "var", "level", "dims", "fill")),
                 pa.array([v for v, _ in values], pa.list_(pa.float32())), pa.array([n for _, n in values], pa.int64())],
                names=["record_name", "var", "level", "dims", "fill", "values", "bytes_read"])
            at = upto


def read_planes(extents: DataFrame, partitions: int | None = None, rows_per_batch: int = 256) -> DataFrame:
    """The values of extents: ``(record_name, var, level, dims, fill, values, bytes_read)``.
    Extents are spread by entry and read in the order of the file; a file that
    shrank since it was indexed fails the job."""
    ship_package(extents.sparkSession)
    n = partitions or 4 * extents.sparkSession.sparkContext.defaultParallelism
    wanted = extents.where(F.col("reason").isNull()).repartition(n, "archive_path", F.floor(F.col("begin") / F.lit(READ_BYTES)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_per_batch):
                yield from _plane_reader([batch.slice(lo, rows_per_batch)])

    return wanted.sortWithinPartitions("archive_path", "begin").mapInArrow(run, PLANE_DDL)
