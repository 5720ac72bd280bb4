"""Stores compared by a tree of order-free hashes.

``block_prints`` gives two independent 64-bit hashes per block, taken once when a
store is written and kept beside it (``write_prints``), in buckets of records.
Digests of records, buckets and whole stores are the exclusive or of the hashes
below them, with their number, so the order of rows and files does not matter.
Two stores are compared from the top: buckets of equal digests are not opened
again, and values are read for unequal blocks only. Blocks count as equal if both
hashes are (128 bits); NaN equals NaN and -0.0 equals 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators import verify
from gridframe.session import checkpoint_dir

BUCKETS = 256
#: so many unequal records, at most, are named in the scan's filter
NAMED = 1000
EMPTY = "record_name string, n_a long, n_b long, n_mismatch long, l2 double"


def block_prints(segments: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, record_name, block_id, n, h1, h2) per row; no shuffle."""
    key = [F.col("record_name"), F.col("block_id").cast("long"), F.col("values").cast("array<float>")]
    return segments.select(
        F.pmod(F.xxhash64("record_name"), F.lit(buckets)).cast("int").alias("bucket"), "record_name", F.col("block_id").cast("long").alias("block_id"),
        F.lit(1).cast("long").alias("n"), F.xxhash64(F.lit(1), *key).alias("h1"), F.xxhash64(F.lit("second"), *reversed(key)).alias("h2"))


def digests(prints: DataFrame, *keys: str) -> DataFrame:
    """One digest per value of ``keys``: the number of blocks and the exclusive or of
    each hash, combined map-side. Without keys, that of the whole store."""
    return prints.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def write_prints(prints: DataFrame, path: str) -> None:
    """Block prints in folders of buckets, and the buckets' digests."""
    prints.repartition("bucket", F.pmod(F.xxhash64("block_id"), F.lit(8))).sortWithinPartitions("bucket", "record_name", "block_id").write.partitionBy(
        "bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    digests(prints.sparkSession.read.parquet(f"{path}/blocks"), "bucket").coalesce(1).write.parquet(f"{path}/buckets")


def _unequal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    sides = [x.select(*keys, F.struct("n", "h1", "h2").alias(name)) for x, name in ((a, "_x"), (b, "_y"))]
    return sides[0].join(sides[1], keys, "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y"))).select(*keys)


def unequal_blocks(spark: SparkSession, prints_a: str, prints_b: str) -> DataFrame:
    """(record_name, block_id) of the blocks in which two printed stores differ. Both
    must have been printed with the same number of buckets. The unequal
    buckets (a bounded list) prune the folders that are read."""
    buckets = [r[0] for r in _unequal(*(spark.read.parquet(f"{p}/buckets") for p in (prints_a, prints_b)), ["bucket"]).collect()]
    sides = [spark.read.parquet(f"{p}/blocks").where(F.col("bucket").isin(buckets) if buckets else F.lit(False)) for p in (prints_a, prints_b)]
    # a repeated block is one entry, as its digest with the number of rows
    return _unequal(*(digests(x, "record_name", "block_id") for x in sides), ["record_name", "block_id"])


def compare_printed(a: DataFrame, b: DataFrame, prints_a: str, prints_b: str, tol: float = 0.0) -> DataFrame:
    """Like ``verify.compare_segments``, for the unequal blocks of two printed stores:
    (record_name, n_a, n_b, n_mismatch, l2) of the records that differ, over the cells
    of their unequal blocks. Equal stores give no row and no value is read."""
    spark = a.sparkSession
    checkpoint_dir(spark)
    blocks = unequal_blocks(spark, prints_a, prints_b).checkpoint()
    some = [r[0] for r in blocks.select("record_name").distinct().limit(NAMED + 1).collect()]
    if not some:
        return spark.createDataFrame([], EMPTY)
    if len(some) <= NAMED:  # the scan's filter: row groups of other records are skipped by their Bloom filters
        a, b = (x.where(F.col("record_name").isin(some)) for x in (a, b))
    left, right = (x.join(blocks, ["record_name", "block_id"], "left_semi") for x in (a, b))
    return verify.compare_segments(left, right, tol)
