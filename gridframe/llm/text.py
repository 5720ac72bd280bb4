"""Shared pieces of the text operators: word hashes, splits, Arrow lists.

Words are maximal runs of letters, digits and marks, lower-cased. They are
split and hashed on the JVM side, so Python tasks get flat int64 arrays and
numpy works on whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.session import checkpoint_dir, scratch_path

WORD_BREAK = r"[^\p{L}\p{N}\p{M}]+"
#: rows of a Python batch: short, since one text may be very long
BATCH_ROWS = 256


def words(text: str | Column) -> Column:
    """Lower-cased words of a text in order; null and word-less texts give an empty array."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), WORD_BREAK), "")


def word_hashes(text: str | Column) -> Column:
    """64-bit hash of every word of a text, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def held_out(doc_id: str | Column) -> Column:
    """The held-out fifth: crc32 of the id as text, modulo 5, is 0 (null ids are not held out)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_rank(*cols: str | Column) -> Column:
    """A fixed pseudo-random number in [0, 1) per row, from its key."""
    return F.pmod(F.xxhash64(F.lit("gridframe sample"), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that neither a
    lost executor nor a second use recomputes what stands before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plain_names(n: int) -> list[str]:
    """Names for kept columns on their way through Arrow, which reads a dot as a path."""
    return [f"_gf_k{i}" for i in range(n)]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back; ``discard`` removes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables that nothing needs any more."""
    for df in tables:
        if df is not None:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def list_parts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of an Arrow list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        lengths = np.asarray(column.value_lengths().fill_null(0))
        offsets = np.zeros(len(column) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        return np.asarray(column.flatten()), offsets
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_grams(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams inside each list.

    Returns (hash, list number, position in the list) of every n-gram; lists
    shorter than n have none.
    """
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[:-1][doc] + pos
    src = flat.view(np.uint64) if flat.dtype == np.int64 else flat.astype(np.uint64)
    h = np.full(len(at), np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + src[at + k]
        h = mix64(h)
    return h.view(np.int64), doc, pos
