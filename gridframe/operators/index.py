"""Dense global indexes and size-checked broadcasts.

``dense_index`` numbers rows 0..n-1 in a sort order without moving all rows
into one task: a range-partitioned sort, a per-partition row count (one
number per partition, summed up on the driver) and a broadcast join of the
offsets (bounded by the number of partitions). The sorted, tagged rows are
checkpointed so the counts and the numbering see the same partitioning even
if executors are lost and the sort is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.session import checkpoint_dir

# Rows of a side we accept to broadcast (names, per-record scalars, offsets).
DEFAULT_BROADCAST_ROWS = 2_000_000
# Target bytes per shuffle partition for the large, size-predictable shuffles.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def partitions_for(spark, n_bytes: float, target: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for a shuffle of ``n_bytes``: ~``target`` bytes each,
    at least one per core of the cluster."""
    return max(spark.sparkContext.defaultParallelism, int(-(-n_bytes // target)))


def dense_index(df: DataFrame, order_by: list, index_col: str = "col_idx") -> DataFrame:
    """Add ``index_col`` = 0-based position of each row in ``order_by`` order.

    Ties are broken arbitrarily, so callers order by a unique key.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    cols = df.columns
    tagged = df.orderBy(*order_by).select(
        *cols,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_mono"),
    ).checkpoint(eager=True)
    # one (part, count) pair per partition: prefix sums on the driver, as
    # RDD.zipWithIndex does with its partition sizes
    counts = sorted((r[0], r[1]) for r in tagged.groupBy("_part").count().collect())
    starts, running = [], 0
    for part, n in counts:
        starts.append((part, running))
        running += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    # the part index occupies the upper 31 bits of monotonically_increasing_id
    local = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), 33)
    return tagged.join(F.broadcast(offsets), "_part").select(
        *cols, (F.col("_start") + local).cast("long").alias(index_col)
    )


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the side; otherwise leave the
    choice (shuffle join, or AQE's own runtime conversion) to Spark."""
    if df.count() <= max_rows:
        return F.broadcast(df)
    return df
