"""Rows of ``A`` that grow by columns (M2, S8, W1): a base and column chunks.

``A`` is cut into a fixed number of row parts when its store is created. An
``append`` transposes the new records alone and writes their columns as a chunk;
no earlier file is touched. Readers merge the chunks that the log names.
``compact`` turns them into one base, a row part at a time: a compaction that died
goes on with the parts it lacks, and counts only once its log row is written.

Layout: ``shape`` (one row), ``parts/commit_id=c/row_part=p`` (rows), ``names/commit_id=c``
(column names) and ``log`` (one row per commit, one file each). The log is metadata:
a row per append, no cell or record.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators import index, matrix, verify
from gridframe.sources import store
from gridframe.sources.ingest_log import _hadoop_path, table_exists

LOG_DDL = "seq long, commit_id string, first_col long, n_cols long, replaces array<string>"
SHAPE_DDL = "n_cells long, block_size int, row_parts int"


def create(spark: SparkSession, path: str, n_cells: int, block_size: int, row_parts: int) -> None:
    """An empty store for rows 0..n_cells-1 in ``row_parts`` contiguous parts."""
    if n_cells < 1 or row_parts < 1:
        raise ValueError("n_cells and row_parts are at least 1")
    spark.createDataFrame([(n_cells, block_size, min(row_parts, n_cells))], SHAPE_DDL).coalesce(1).write.parquet(f"{path}/shape")


def shape(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(cells, block size, row parts)"""
    return tuple(spark.read.parquet(f"{path}/shape").first())


def chunks(spark: SparkSession, path: str) -> list:
    """Log rows that count, by their first column: committed and not replaced."""
    if not table_exists(spark, f"{path}/log"):
        return []
    rows = spark.read.schema(LOG_DDL).parquet(f"{path}/log").collect()
    gone = {c for r in rows for c in r["replaces"]}
    live = sorted((r for r in rows if r["commit_id"] not in gone), key=lambda r: r["first_col"])
    at = 0
    for r in live:
        if r["first_col"] != at:
            raise verify.ValidationError(f"chunk {r['commit_id']} begins at column {r['first_col']}, not at {at}: two appends ran at once")
        at += r["n_cols"]
    return live


def _commit(spark: SparkSession, path: str, commit_id: str, first_col: int, n_cols: int, replaces: list[str]) -> None:
    seq = 0
    if table_exists(spark, f"{path}/log"):
        seq = spark.read.schema(LOG_DDL).parquet(f"{path}/log").agg(F.max("seq")).first()[0] + 1
    spark.createDataFrame([(seq, commit_id, first_col, n_cols, replaces)], LOG_DDL).coalesce(1).write.mode("append").parquet(f"{path}/log")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(col_idx, record_name, ts) of all columns. Compaction leaves the names where they are."""
    schema = "col_idx long, record_name string, ts timestamp"
    if not table_exists(spark, f"{path}/log"):
        return spark.createDataFrame([], schema)
    done = spark.read.schema(LOG_DDL).parquet(f"{path}/log").where(F.size("replaces") == 0).select("commit_id")
    return spark.read.parquet(f"{path}/names").join(F.broadcast(done), "commit_id", "left_semi").select("col_idx", "record_name", "ts")


def append(spark: SparkSession, path: str, segments: DataFrame, new_names: DataFrame) -> str:
    """Add the records of ``segments`` as the next columns; gives the commit's id.

    ``new_names`` is their own table (col_idx from 0, record_name, ts). Named and
    given records must be the same, complete and not none, and none may be stored already or
    come before a stored column by (ts, name): such a set needs a store of its
    own, and the call raises before it writes. Nothing counts until the commit.
    """
    n_cells, block_size, row_parts = shape(spark, path)
    live = chunks(spark, path)
    first = sum(r["n_cols"] for r in live)
    verify.require_order(new_names)
    key = F.struct(F.col("ts").isNull().alias("untimed"), "ts", "record_name")
    low, n_new = new_names.agg(F.min(key), F.count(F.lit(1))).first()
    high = names(spark, path).agg(F.max(key)).first()[0]
    if high is not None and not _after(low, high):
        raise verify.ValidationError(f"record {low['record_name']} does not come after the stored {high['record_name']}")
    verify.require_same_records(segments, new_names)
    verify.require_complete(segments, n_cells, block_size)
    commit_id = uuid.uuid4().hex
    wanted = index.partitions_for(spark, 4.0 * n_new * n_cells)
    parts = row_parts * max(1, -(-wanted // row_parts))  # ranges that lie inside the row parts
    if matrix.tile_plan(n_new, block_size)[1] >= n_new:
        rows = matrix.transpose_ranges(segments, new_names, block_size, n_cells, n_new, parts)
    else:
        rows = matrix.transpose(segments, new_names, block_size, n_cells=n_cells)
        rows = rows.repartitionById(parts, store.row_range(n_cells, parts)).sortWithinPartitions("row_idx")
    rows.withColumn("row_part", store.row_range(n_cells, row_parts)).write.partitionBy("row_part").option(
        "compression", "zstd").parquet(f"{path}/parts/commit_id={commit_id}")
    new_names.select((F.col("col_idx") + first).alias("col_idx"), "record_name", "ts", F.lit(commit_id).alias("commit_id")).write.mode(
        "append").partitionBy("commit_id").parquet(f"{path}/names")
    _commit(spark, path, commit_id, first, n_new, [])
    return commit_id


def _after(low, high) -> bool:
    """Does ``low`` come after ``high`` by (time, name), names without a time last?"""
    def key(row):
        return row["untimed"], row["ts"] or 0, row["record_name"]

    return key(low) > key(high)


def _rows(spark: SparkSession, path: str, commit_id: str, row_part: int | None) -> DataFrame:
    rows = spark.read.schema("row_idx long, values array<float>, row_part int").parquet(f"{path}/parts/commit_id={commit_id}")
    return (rows if row_part is None else rows.where(F.col("row_part") == row_part)).select("row_idx", "values")


def _merged(spark: SparkSession, path: str, live: list, row_part: int | None = None) -> DataFrame:
    if len(live) == 1:
        return _rows(spark, path, live[0]["commit_id"], row_part)
    out = None
    for i, r in enumerate(live):
        one = _rows(spark, path, r["commit_id"], row_part).withColumn("rblock", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return matrix.merge_column_chunks(out, n_records=sum(r["n_cols"] for r in live))


def read(spark: SparkSession, path: str, columns: tuple[int, int] | None = None, row_part: int | None = None) -> DataFrame:
    """Rows of ``A`` (row_idx, values): all columns, or those of ``columns`` (from, to; the
    end not included). Only the chunks that hold some are read, and only ``row_part``'s
    folder if given. One chunk needs no shuffle, more need one on ``row_idx``."""
    live = chunks(spark, path)
    n_cols = sum(r["n_cols"] for r in live)
    low, high = (0, n_cols) if columns is None else (max(0, columns[0]), min(n_cols, columns[1]))
    live = [r for r in live if r["first_col"] < high and r["first_col"] + r["n_cols"] > low]
    if not live:
        return spark.createDataFrame([], "row_idx long, values array<float>")
    rows = _merged(spark, path, live, row_part)
    skip = low - live[0]["first_col"]
    if skip == 0 and high - low == sum(r["n_cols"] for r in live):
        return rows
    return rows.select("row_idx", F.slice("values", skip + 1, high - low).alias("values"))


def compact(spark: SparkSession, path: str) -> str | None:
    """Merge all chunks into one base, a row part after the other, each a job that
    reads its part of every chunk. The base's id is that of the chunks it replaces, so a
    second call finds the parts that a dead one finished. Gives the id, or
    null if there is nothing to merge. Replaced files stay until ``vacuum``."""
    live = chunks(spark, path)
    if len(live) < 2:
        return None
    replaced = [r["commit_id"] for r in live]
    commit_id = "base-" + hashlib.sha256(",".join(replaced).encode()).hexdigest()[:24]
    for part in range(shape(spark, path)[2]):
        target = f"{path}/parts/commit_id={commit_id}/row_part={part}"
        done, fs = _hadoop_path(spark, f"{target}/_SUCCESS")
        if not fs.exists(done):
            _merged(spark, path, live, part).sortWithinPartitions("row_idx").write.mode("overwrite").option("compression", "zstd").parquet(target)
    _commit(spark, path, commit_id, 0, sum(r["n_cols"] for r in live), replaced)
    return commit_id


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the rows of replaced chunks and of appends and compactions that never
    committed; gives their number. Nothing may be reading or writing meanwhile."""
    keep = {r["commit_id"] for r in chunks(spark, path)}
    root, fs = _hadoop_path(spark, f"{path}/parts/commit_id=*")
    gone = [s.getPath() for s in fs.globStatus(root) or [] if s.getPath().getName().split("=", 1)[1] not in keep]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
