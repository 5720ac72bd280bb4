"""Minimal NetCDF classic (CDF-1 / CDF-2) codec for gridded float variables.

Reads the header (dimensions, attributes, variables), fixed-size and record
variables of the numeric types, and writes simple files with fixed-size
variables. Format: the public NetCDF classic file-format specification
(big-endian, 4-byte alignment). NetCDF-4 / HDF5 files are not supported.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass, field

import numpy as np

_ABSENT, _DIM, _VAR, _ATT = 0, 0x0A, 0x0B, 0x0C
_DTYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {np.dtype(v).str if k != 2 else "S1": k for k, v in _DTYPES.items()}


class NetCDFError(ValueError):
    pass


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    nc_type: int
    attrs: dict
    begin: int
    vsize: int
    is_record: bool = False


@dataclass
class Dataset:
    version: int
    numrecs: int
    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    data: bytes | memoryview = b""
    record_size: int = 0

    def read(self, name: str) -> np.ndarray:
        if name not in self.variables:
            raise NetCDFError(f"variable {name} not found")
        v = self.variables[name]
        dtype = np.dtype(_DTYPES[v.nc_type])
        if not v.is_record:
            count = int(np.prod(v.shape)) if v.shape else 1
            arr = np.frombuffer(self.data, dtype=dtype, count=count, offset=v.begin)
            return arr.reshape(v.shape)
        per_rec = int(np.prod(v.shape[1:])) if len(v.shape) > 1 else 1
        out = np.empty((self.numrecs, per_rec), dtype=dtype)
        for r in range(self.numrecs):
            out[r] = np.frombuffer(self.data, dtype=dtype, count=per_rec, offset=v.begin + r * self.record_size)
        return out.reshape([self.numrecs] + v.shape[1:])


class _Reader:
    def __init__(self, buf):
        self.buf, self.pos = memoryview(buf), 0

    def take(self, n):
        if self.pos + n > len(self.buf):
            raise NetCDFError("truncated header")
        out = self.buf[self.pos:self.pos + n]
        self.pos += n
        return out

    def int32(self):
        return struct.unpack(">i", self.take(4))[0]

    def int64(self):
        return struct.unpack(">q", self.take(8))[0]

    def name(self):
        n = self.int32()
        raw = bytes(self.take(n))
        self.take((4 - n % 4) % 4)
        return raw.decode("utf-8")

    def values(self, nc_type, n):
        if nc_type not in _DTYPES:
            raise NetCDFError(f"unsupported type {nc_type}")
        dtype = np.dtype(_DTYPES[nc_type])
        size = dtype.itemsize * n
        raw = bytes(self.take(size))
        self.take((4 - size % 4) % 4)
        if nc_type == 2:
            return raw.rstrip(b"\x00").decode("utf-8", "replace")
        return np.frombuffer(raw, dtype=dtype).astype(dtype.newbyteorder("="))

    def attrs(self):
        tag, n = self.int32(), self.int32()
        if tag not in (_ABSENT, _ATT):
            raise NetCDFError("bad attribute list")
        out = {}
        for _ in range(n):
            name = self.name()
            nc_type, count = self.int32(), self.int32()
            out[name] = self.values(nc_type, count)
        return out


def loads(buf: bytes) -> Dataset:
    """Parse a NetCDF classic file held in memory."""
    if len(buf) < 8 or bytes(buf[:3]) != b"CDF":
        raise NetCDFError("not a NetCDF classic file")
    version = buf[3]
    if version not in (1, 2):
        raise NetCDFError(f"unsupported NetCDF version byte {version}")
    r = _Reader(buf)
    r.take(4)
    numrecs = r.int32()
    tag, n = r.int32(), r.int32()
    if tag not in (_ABSENT, _DIM):
        raise NetCDFError("bad dimension list")
    dims, dim_names = {}, []
    for _ in range(n):
        name = r.name()
        dims[name] = r.int32()
        dim_names.append(name)
    gattrs = r.attrs()
    tag, n = r.int32(), r.int32()
    if tag not in (_ABSENT, _VAR):
        raise NetCDFError("bad variable list")
    ds = Dataset(version, numrecs, dims, gattrs, data=memoryview(buf))
    for _ in range(n):
        name = r.name()
        ndims = r.int32()
        ids = [r.int32() for _ in range(ndims)]
        attrs = r.attrs()
        nc_type, vsize = r.int32(), r.int32()
        begin = r.int32() if version == 1 else r.int64()
        names = [dim_names[i] for i in ids]
        is_record = bool(names) and dims[names[0]] == 0
        shape = [numrecs if (k == 0 and is_record) else dims[d] for k, d in enumerate(names)]
        ds.variables[name] = Variable(name, names, shape, nc_type, attrs, begin, vsize, is_record)
    recs = [v for v in ds.variables.values() if v.is_record]
    if len(recs) == 1:
        v = recs[0]
        ds.record_size = int(np.prod(v.shape[1:]) if len(v.shape) > 1 else 1) * np.dtype(_DTYPES[v.nc_type]).itemsize
    else:
        ds.record_size = sum(v.vsize for v in recs)
    return ds


def dumps(dims: dict[str, int], variables: list[tuple[str, list[str], np.ndarray, dict]], header_only: bool = False) -> bytes:
    """Write a CDF-1 file with fixed-size variables ``(name, dims, data, attrs)``; with
    ``header_only`` what stands before the data, of which only type and shape are read."""

    def name_bytes(s):
        raw = s.encode("utf-8")
        return struct.pack(">i", len(raw)) + raw + b"\x00" * ((4 - len(raw) % 4) % 4)

    def attr_bytes(attrs):
        if not attrs:
            return struct.pack(">ii", _ABSENT, 0)
        out = struct.pack(">ii", _ATT, len(attrs))
        for k, val in attrs.items():
            arr = np.atleast_1d(np.asarray(val))
            code = 2 if arr.dtype.kind in "SU" else _CODES[arr.dtype.newbyteorder(">").str]
            raw = arr.astype(_DTYPES[code]).tobytes() if code != 2 else str(val).encode()
            count = len(raw) if code == 2 else arr.size
            out += name_bytes(k) + struct.pack(">ii", code, count) + raw + b"\x00" * ((4 - len(raw) % 4) % 4)
        return out

    dim_names = list(dims)
    header = b"CDF\x01" + struct.pack(">i", 0)
    header += struct.pack(">ii", _DIM, len(dims)) if dims else struct.pack(">ii", _ABSENT, 0)
    for d in dim_names:
        header += name_bytes(d) + struct.pack(">i", dims[d])
    header += struct.pack(">ii", _ABSENT, 0)
    blobs, var_headers = [], []
    for name, vdims, data, attrs in variables:
        code = _CODES[data.dtype.newbyteorder(">").str]
        if not header_only:
            raw = np.ascontiguousarray(data).astype(_DTYPES[code]).tobytes()
            blobs.append(raw + b"\x00" * ((4 - len(raw) % 4) % 4))
        var_headers.append((name, vdims, attrs, code, -(-data.size * data.dtype.itemsize // 4) * 4))
    # header size is needed for the 'begin' offsets: compute with zeros first
    def var_list(begins):
        out = struct.pack(">ii", _VAR, len(var_headers)) if var_headers else struct.pack(">ii", _ABSENT, 0)
        for (name, vdims, attrs, code, size), begin in zip(var_headers, begins):
            out += name_bytes(name) + struct.pack(">i", len(vdims))
            out += b"".join(struct.pack(">i", dim_names.index(d)) for d in vdims)
            out += attr_bytes(attrs) + struct.pack(">iii", code, size, begin)
        return out

    base = len(header) + len(var_list([0] * len(var_headers)))
    begins, pos = [], base
    for *_, size in var_headers:
        begins.append(pos)
        pos += size
    return header + var_list(begins) + b"".join(blobs)
