"""Parquet store of ``A^T`` segments, rows of ``A`` and column names
(S3, S6-S13, P3-P5, J4, R1-R4, O3, O5, U1).

Layout on disk:

* ``A^T``: ``partitionBy("chunk_id")`` (batches of records, the write unit of
  ingest). Inside a chunk the segments are clustered in two dimensions: a file
  holds a range of blocks for a bucket of records (``cluster_plan``), sorted on
  ``(record_name, block_id)``, in small row groups with Bloom filters on
  ``record_name``. A lookup reads the row groups of its record, a level slice
  those of its blocks, and per-cell aggregates (``A y``) combine map-side.
* ``A``: contiguous ``row_idx`` ranges, sorted.
* column names: Parquet ``(col_idx, record_name, ts)``; text export on demand.

Partition numbers are computed from the shape and given to Spark as they are
(``repartitionById``): nothing is sampled and no two ranges share a partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.schemas import COLUMN_NAMES, MATRIX_ROW

# Bytes of a clustered file, and of a row group in it.
TARGET_FILE_BYTES = 128 << 20
ROW_GROUP_BYTES = 16 << 20
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.bloom.filter.enabled#record_name": "true",
    "parquet.bloom.filter.expected.ndv#record_name": "10000",
}


@dataclass(frozen=True)
class ClusterPlan:
    """A chunk's segments as ``block_ranges`` x ``record_buckets`` files."""

    chunks: int
    block_ranges: int
    record_buckets: int
    blocks_per_range: int
    first_chunk: int = 0

    @property
    def partitions(self) -> int:
        return self.chunks * self.block_ranges * self.record_buckets

    def partition_id(self, block: Column, record: Column, chunk: Column | None) -> Column:
        in_range = F.least((block / self.blocks_per_range).cast("int"), F.lit(self.block_ranges - 1))
        bucket = F.pmod(F.xxhash64(record), F.lit(self.record_buckets)).cast("int")
        first = F.lit(0) if chunk is None else chunk - self.first_chunk
        return ((first * self.block_ranges + in_range) * self.record_buckets + bucket).cast("int")


def cluster_plan(n_records: int, n_cells: int, block_size: int, min_partitions: int, chunks: int = 1,
                 first_chunk: int = 0, target: int = TARGET_FILE_BYTES) -> ClusterPlan:
    """Ranges and buckets from the shape: files of about ``target`` bytes, as many
    block ranges as record buckets where the shape allows, at least
    ``min_partitions`` files over all chunks."""
    n_blocks = max(1, -(-n_cells // block_size))
    per_chunk = max(1, -(-n_records // chunks))
    wanted = max(-(-4 * per_chunk * n_cells // target), -(-min_partitions // chunks), 1)
    buckets = max(1, min(per_chunk, round(wanted ** 0.5)))
    ranges = max(1, min(n_blocks, -(-wanted // buckets)))
    buckets = max(1, min(per_chunk, -(-wanted // ranges)))  # few blocks: more buckets
    width = -(-n_blocks // ranges)
    return ClusterPlan(chunks, -(-n_blocks // width), buckets, width, first_chunk)


def clustered(segments: DataFrame, plan: ClusterPlan, chunk_col: str | None = None) -> DataFrame:
    """Deal segments out to their files: one exchange. Rows without a block (failures)
    are spread over all tasks."""
    chunk = F.col(chunk_col) if chunk_col else None
    spread = F.pmod(F.hash(*[c for c in ("archive_path", "entry_idx", "record_name") if c in segments.columns]), F.lit(plan.partitions))
    return segments.repartitionById(plan.partitions, F.when(
        F.col("block_id").isNull(), spread).otherwise(plan.partition_id(F.col("block_id"), F.col("record_name"), chunk)))


def write_segments(
    segments: DataFrame,
    path: str,
    chunk_col: str | None = "chunk_id",
    partitions: int | None = None,
    mode: str = "errorifexists",
    plan: ClusterPlan | None = None,
) -> None:
    """Write ``A^T`` segments, zstd, clustered by block.

    With a ``plan`` (the shape is known) files are block ranges x record buckets.
    Without one, hash partitioning on block and record bucket needs no pass over
    the input and leaves no block, however many records share it, to one task."""
    cols = ["record_name", "block_id", "values"] + ([chunk_col] if chunk_col else [])
    out = segments.select(*cols)
    if plan:
        out = clustered(out, plan, chunk_col)
    else:
        keys = ["block_id", F.pmod(F.xxhash64("record_name"), F.lit(16))]
        out = out.repartition(partitions, *keys) if partitions else out.repartition(*keys)
    out = out.sortWithinPartitions(*([chunk_col] if chunk_col else []), "record_name", "block_id")
    writer = out.write.mode(mode).options(**WRITE_OPTIONS)
    if chunk_col:
        writer = writer.partitionBy(chunk_col)
    writer.parquet(path)


def read_segments(spark: SparkSession, path: str, chunk_ids: list[int] | None = None) -> DataFrame:
    """The whole chunk family is one dataset; ``chunk_ids`` prunes
    partitions."""
    df = spark.read.parquet(path)
    if chunk_ids is not None:
        df = df.where(F.col("chunk_id").isin(list(chunk_ids)))
    return df


def row_range(n_rows: int, partitions: int, row_col: str = "row_idx") -> Column:
    """Number of the contiguous ``row_idx`` range a row lies in (row indexes are dense
    0..n_rows-1, so no sampling is needed to find the bounds)."""
    return F.least((F.col(row_col) * F.lit(partitions) / F.lit(max(1, n_rows))).cast("int"), F.lit(partitions - 1))


def write_matrix(rows: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists",
                 n_rows: int | None = None, in_ranges: bool = False) -> None:
    """Rows of ``A``, each file holding contiguous ``row_idx`` ranges,
    sorted. With ``n_rows`` the ranges are computed, not sampled (sampling
    would run the transpose twice). Rows that come in sorted ranges already
    (``matrix.transpose_ranges``; ``in_ranges``) are written where they are."""
    out = rows.select(*MATRIX_ROW.fieldNames())
    if in_ranges:
        out.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    if n_rows is not None:
        n = partitions or out.sparkSession.sparkContext.defaultParallelism
        out = out.repartitionById(n, row_range(n_rows, n))
    else:
        out = out.repartitionByRange(partitions, "row_idx") if partitions else out.repartitionByRange("row_idx")
    out.sortWithinPartitions("row_idx").write.mode(mode).option("compression", "zstd").parquet(path)


def write_column_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists", n_rows: int | None = None,
                        partitions: int | None = None) -> None:
    """Column chunks of ``A`` partitioned by record block; row ranges
    computed from ``n_rows`` when given (a task writes one range of every chunk
    it meets, so files are ranges x chunks at most)."""
    if n_rows is not None:
        n = partitions or chunks.sparkSession.sparkContext.defaultParallelism
        chunks = chunks.repartitionById(n, row_range(n_rows, n))
    else:
        chunks = chunks.repartitionByRange("rblock", "row_idx")
    chunks.sortWithinPartitions("rblock", "row_idx").write.mode(mode).partitionBy("rblock").option(
        "compression", "zstd"
    ).parquet(path)


def write_names(names: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ordered column-name table."""
    names.select(*COLUMN_NAMES.fieldNames()).repartitionByRange("col_idx").sortWithinPartitions(
        "col_idx"
    ).write.mode(mode).parquet(path)


def export_names_text(names: DataFrame, path: str) -> None:
    """S11 text form: one name per line in column order (ordered write)."""
    names.repartitionByRange("col_idx").sortWithinPartitions("col_idx").select("record_name").write.text(path)


def lookup_record(segments: DataFrame, record_name: str) -> DataFrame:
    """One record's segments; the equality reaches the Parquet scan
    as a pushed filter, which row-group statistics and Bloom filters answer.
    Empty when absent (no exception)."""
    return segments.where(F.col("record_name") == F.lit(record_name))


def semi_join_records(frame: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose ``record_name`` is in ``names`` (left semi join)."""
    return frame.join(names.select("record_name").distinct(), "record_name", "left_semi")


def pending_entries(manifest: DataFrame, ingested: DataFrame) -> DataFrame:
    """S3: archive entries not yet ingested (resume by left anti join)."""
    return manifest.join(ingested.select("archive_path", "entry_idx"), ["archive_path", "entry_idx"], "left_anti")


def export_record_long(segments: DataFrame, block_size: int, keep: tuple = ()) -> DataFrame:
    """Records in long form ``(record_name, pos, value)`` for export, with
    the columns named in ``keep`` carried along."""
    return segments.select(
        "record_name", "block_id", *keep, F.posexplode("values").alias("k", "value")
    ).select(
        "record_name", *keep, (F.col("block_id").cast("long") * block_size + F.col("k")).alias("pos"), "value"
    )


def write_record_export(segments: DataFrame, block_size: int, path: str, fmt: str = "json") -> None:
    """Write the long form as JSON lines or Parquet."""
    export_record_long(segments, block_size).write.mode("errorifexists").format(fmt).save(path)
