"""Array expressions over record vectors (A8, A10, P7, M6 kernels).

Vectors are ``array<float>`` in row-major (C) order. Positions are 0-based
in the public API; Spark's ``slice`` is 1-based, which is handled here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ceil_div(a, b) -> Column:
    """Integer ceiling division (true ceiling, also when a < b)."""
    a = F.lit(a) if isinstance(a, int) else _col(a)
    b = F.lit(b) if isinstance(b, int) else _col(b)
    top = a + b - 1
    return ((top - F.pmod(top, b)) / b).cast("long")


def block_count(values, block_size: int) -> Column:
    """Number of ``block_size`` segments a vector is cut into."""
    return ceil_div(F.size(_col(values)), block_size)


def slice0(values, start, length) -> Column:
    """``values[start : start + length]`` with a 0-based start."""
    start_col = F.lit(start) if isinstance(start, int) else _col(start)
    length_col = F.lit(length) if isinstance(length, int) else _col(length)
    return F.slice(_col(values), start_col + 1, length_col)


def mask_equal(values, fill) -> Column:
    """Per-cell missing flag, ``value == fill``.

    The fill value is cast to float first: a double literal such as 1e20 is
    not equal to the same number stored as float. Spark compares NaN equal to
    NaN, so a NaN fill also masks NaN cells.
    """
    fill_col = (F.lit(fill) if isinstance(fill, (int, float)) else _col(fill)).cast("float")
    return F.transform(_col(values), lambda v: v == fill_col)


def dot(a, b) -> Column:
    """M6 kernel: sum(a[k] * b[k]) in double precision."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def dense_from_entries(entries, length, fill, value_type: str = "float") -> Column:
    """Dense array of ``length`` from sparse ``array<struct<k, value>>``
    (distinct 0-based ``k``); absent positions get ``fill``.

    Built as: present entries + one fill entry per absent position
    (``array_except``), sorted by ``k``. Everything is evaluated once per
    row; a map lookup inside a ``transform`` lambda would instead be
    re-evaluated for every element.
    """
    e = _col(entries)
    length_col = F.lit(length) if isinstance(length, int) else _col(length)
    fill_col = F.lit(fill).cast(value_type)
    keys = F.transform(e, lambda s: s["k"])
    missing = F.array_except(F.sequence(F.lit(0), length_col - 1), keys)
    filler = F.transform(missing, lambda k: F.struct(k.alias("k"), fill_col.alias("value")))
    typed = F.transform(e, lambda s: F.struct(s["k"].cast("int").alias("k"), s["value"].cast(value_type).alias("value")))
    return F.transform(F.array_sort(F.concat(typed, filler)), lambda s: s["value"])
