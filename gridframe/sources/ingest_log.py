"""Versioned ingest log: what of which archive counts.

A store has one log for batch and streaming conversions. A conversion takes the
listed archives whose *version* (size and modification time, or ``absent``) is not
the one the log holds, decodes them into partitions of its own and then appends one
log row per archive in a single file. Readers count a row of the store only if the
log's latest commit of its archive wrote it, so

* an archive that was mended, replaced or grown is read again, and what its earlier
  version left (segments and quarantine rows) no longer counts;
* a conversion that died before its commit left nothing that counts (``vacuum``
  removes it), and conversions never overwrite each other's partitions;
* an archive that is taken out (``forget``) gets a tombstone.

Layout under the store: ``decoded/status=s/chunk_id=k/commit_id=c`` holds segments
and failures, ``manifest`` the listed entries, ``log`` the commits.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators import index
from gridframe.session import ship_package
from gridframe.sources import archives, store

LOG_DDL = ("seq long, commit_id string, archive_path string, version string, chunk_id int, action string, "
           "n_records long, n_quarantined long")
ADDED, FORGOTTEN = "add", "forget"
ABSENT = "absent"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a readable Parquet dataset at ``path``?"""
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the path only
        return True
    except AnalysisException:
        return False


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


# --------------------------------------------------------------------------
# versions of the files
# --------------------------------------------------------------------------
def _version(path: str) -> str:
    try:
        if "://" not in path or path.startswith("file:"):
            info = os.stat("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
            return f"{info.st_size}:{info.st_mtime_ns}"
        from pyarrow import fs

        filesystem, inner = fs.FileSystem.from_uri(path)
        info = filesystem.get_file_info(inner)
        return ABSENT if info.type == fs.FileType.NotFound else f"{info.size}:{info.mtime_ns}"
    except OSError:
        return ABSENT


def _versions(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([_version(p) for p in batch.column("archive_path").to_pylist()], pa.string())],
            names=[*batch.schema.names, "version"])


def versions(paths: DataFrame) -> DataFrame:
    """``(archive_name, archive_path, version)``: the files as they are now."""
    ship_package(paths.sparkSession)
    return paths.select("archive_name", "archive_path").mapInArrow(
        _versions, "archive_name string, archive_path string, version string")


# --------------------------------------------------------------------------
# the log
# --------------------------------------------------------------------------
def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    path = f"{out_dir.rstrip('/')}/log"
    if table_exists(spark, path):
        return spark.read.schema(LOG_DDL).parquet(path)
    return spark.createDataFrame([], LOG_DDL)


def live(log: DataFrame) -> DataFrame:
    """The latest commit of every archive that is not forgotten."""
    row = F.struct("seq", "commit_id", "version", "chunk_id", "action", "n_records", "n_quarantined")
    last = log.groupBy("archive_path").agg(F.max(row).alias("x"))
    return last.select("archive_path", "x.*").where(F.col("action") == ADDED)


def live_rows(spark: SparkSession, decoded_path: str) -> DataFrame:
    """Rows of the store that count. A store without a log counts whole."""
    rows = spark.read.parquet(decoded_path)
    log_path = f"{decoded_path.rstrip('/').rsplit('/', 1)[0]}/log"
    if "commit_id" not in rows.columns or not table_exists(spark, log_path):
        return rows
    now = live(spark.read.schema(LOG_DDL).parquet(log_path)).select("archive_path", "commit_id")
    return rows.join(index.broadcast_if_small(now), ["archive_path", "commit_id"], "left_semi")


def pending(listed: DataFrame, log: DataFrame) -> DataFrame:
    """Listed archives (with ``version``) that the log holds in another version or not at all."""
    known = live(log).select("archive_path", "version")
    return listed.join(known, ["archive_path", "version"], "left_anti")


def _append(out_dir: str, rows: DataFrame) -> None:
    """One file per commit: a reader sees all of it or nothing."""
    typed = [F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in LOG_DDL.split(", "))]
    rows.select(*typed).coalesce(1).write.mode("append").parquet(f"{out_dir.rstrip('/')}/log")


def _next(log: DataFrame) -> tuple[int, int]:
    """(sequence number, chunk) that the next commit takes."""
    seq, chunk = log.agg(F.max("seq"), F.max("chunk_id")).first()
    return (0 if seq is None else seq + 1), (0 if chunk is None else chunk + 1)


# --------------------------------------------------------------------------
# conversions
# --------------------------------------------------------------------------
def ingest(spark: SparkSession, names: DataFrame, root: str, layout: DataFrame, out_dir: str, block_size: int,
           archives_per_chunk: int = 200, partitions: int | None = None, commit_id: str | None = None) -> int:
    """Decode the archives of ``names`` that the log lacks in their present version
    and commit them; returns how many. A ``commit_id`` of the caller's (a stream's
    batch) is committed once: a repeated call does nothing, and what an earlier
    call wrote without committing is removed first."""
    out_dir = out_dir.rstrip("/")
    log = read_log(spark, out_dir)
    if commit_id is None:
        commit_id = uuid.uuid4().hex
    elif not log.where(F.col("commit_id") == commit_id).isEmpty():
        return 0
    else:
        _remove(spark, f"{out_dir}/decoded", {commit_id})
    seq, first_chunk = _next(log)
    listed = versions(archives.archive_paths(names.distinct(), root))
    todo = index.dense_index(pending(listed, log), [F.col("archive_name")], "archive_rank")
    count = todo.count()
    if not count:
        return 0
    todo = todo.select("archive_path", "version", ((F.col("archive_rank") / archives_per_chunk).cast("int") + first_chunk).alias("chunk_id"))
    manifest_path = f"{out_dir}/manifest"
    # a folder per commit, so a repeated attempt replaces its own listing
    archives.expand_archives(todo).join(todo, "archive_path").write.mode("overwrite").parquet(f"{manifest_path}/commit_id={commit_id}")
    manifest = spark.read.parquet(manifest_path).where(F.col("commit_id") == commit_id)
    n_entries = manifest.count()
    spec = archives.layout_spec(layout)
    total = max(o + n for _, o, n, _ in spec)
    decoded = archives.decode_entries(manifest, layout, block_size, partitions, carry=["chunk_id"]).withColumn(
        "status", F.when(F.col("reason").isNull(), "ok").otherwise("quarantine")).withColumn("commit_id", F.lit(commit_id))
    plan = store.cluster_plan(n_entries, total, block_size, spark.sparkContext.defaultParallelism,
                              -(-count // archives_per_chunk), first_chunk)
    # one pass over the decoded rows: no sampling, which would decode the input twice
    (store.clustered(decoded, plan, "chunk_id").sortWithinPartitions("status", "chunk_id", "record_name", "block_id")
        .write.mode("append").partitionBy("status", "chunk_id", "commit_id").options(**store.WRITE_OPTIONS).parquet(f"{out_dir}/decoded"))
    mine = spark.read.parquet(f"{out_dir}/decoded").where(F.col("commit_id") == commit_id)
    done = mine.where((F.col("status") == "quarantine") | (F.col("block_id") == 0)).groupBy("archive_path").agg(
        F.count(F.when(F.col("status") == "ok", 1)).alias("n_records"), F.count(F.when(F.col("status") != "ok", 1)).alias("n_quarantined"))
    _append(out_dir, todo.join(done, "archive_path", "left").select(
        F.lit(seq).alias("seq"), F.lit(commit_id).alias("commit_id"), "archive_path", "version", "chunk_id", F.lit(ADDED).alias("action"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined")))
    return count


def forget(spark: SparkSession, names: DataFrame, root: str, out_dir: str) -> None:
    """Tombstones for the archives of ``names``: their records no longer count."""
    log = read_log(spark, out_dir)
    paths = archives.archive_paths(names.distinct(), root).select("archive_path")
    gone = live(log).join(paths, "archive_path", "left_semi")
    _append(out_dir, gone.select(F.lit(_next(log)[0]).alias("seq"), F.lit(uuid.uuid4().hex).alias("commit_id"), "archive_path", "version",
                                        "chunk_id", F.lit(FORGOTTEN).alias("action"), F.lit(0).alias("n_records"), F.lit(0).alias("n_quarantined")))


def _commit_folders(spark: SparkSession, decoded_path: str) -> list[tuple[str, object, object]]:
    """(commit_id, folder, file system) of the partitions on disk."""
    root, fs = _hadoop_path(spark, f"{decoded_path.rstrip('/')}/status=*/chunk_id=*/commit_id=*")
    found = fs.globStatus(root)
    return [(s.getPath().getName().split("=", 1)[1], s.getPath(), fs) for s in found or []]


def _remove(spark: SparkSession, decoded_path: str, commits: set[str]) -> int:
    folders = [f for f in _commit_folders(spark, decoded_path) if f[0] in commits]
    for _, folder, fs in folders:
        fs.delete(folder, True)
    return len(folders)


def vacuum(spark: SparkSession, out_dir: str) -> int:
    """Remove the partitions in which nothing counts any more: of commits that the log
    does not name, or whose every archive has a later version. Run it while no
    conversion is under way. Returns the number of partitions removed."""
    decoded = f"{out_dir.rstrip('/')}/decoded"
    keep = {r[0] for r in live(read_log(spark, out_dir)).select("commit_id").distinct().collect()}
    return _remove(spark, decoded, {c for c, _, _ in _commit_folders(spark, decoded)} - keep)
