"""End-to-end batch jobs (the original entry points, re-expressed).

* ``convert``    archives -> ``A^T`` segment store + quarantine (E1), resumable
* ``names``      store -> ordered column-name table (+ optional text export)
* ``transpose``  store + names -> rows of ``A`` (E2), blocked or SQL form
* ``grow``       records that the rows of ``A`` lack -> column chunks appended to them
* ``lookup`` / ``export_record`` / ``compare`` (E3)
* ``multiply``   ``A^T x`` and ``A y`` on the store

Store layout (under ``out_dir``): ``decoded/status=ok|quarantine/chunk_id=k``
holds segments and failure rows from one write; ``manifest`` the archive
entries; ``log`` which of them count; ``names`` and ``matrix`` the transpose outputs. All intermediate
state lives in these tables, so a lost executor only re-runs its tasks and
a lost job resumes from what is stored.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators import index, matrix, timeaxis, verify
from gridframe.schemas import DEFAULT_BLOCK_SIZE, DEFAULT_VARIABLES
from gridframe.sources import archives, growing, ingest_log, store


def convert(
    spark: SparkSession,
    root: str,
    file_list: str,
    layout: DataFrame,
    out_dir: str,
    block_size: int = DEFAULT_BLOCK_SIZE,
    archives_per_chunk: int = 200,
    partitions: int | None = None,
) -> dict:
    """Decode every listed archive into the segment store (see ``ingest_log``).

    * Archives that the log holds in their present version are left alone, so a
      longer list, a repeated line or a run after a failure does the missing work
      and no other; a mended, replaced or grown archive is read again, and what
      its earlier version left no longer counts.
    * Archives that cannot be listed, or whose listing breaks off, become
      quarantine rows with the reason, like entries that cannot be decoded.
    * A chunk holds ``archives_per_chunk`` archives, ranked by name within a run;
      every run, batch or streaming, writes chunks of its own.
    """
    out_dir = out_dir.rstrip("/")
    listed = archives.read_archive_list(spark, file_list)
    if listed.isEmpty():
        raise ValueError(f"{file_list} lists no archive")
    ingest_log.ingest(spark, listed, root, layout, out_dir, block_size, archives_per_chunk, partitions)
    counts = ingest_log.live(ingest_log.read_log(spark, out_dir)).agg(F.sum("n_records"), F.sum("n_quarantined")).first()
    return {"manifest": f"{out_dir}/manifest", "decoded": f"{out_dir}/decoded", "records": counts[0] or 0, "quarantined": counts[1] or 0}


def entries_done(spark: SparkSession, decoded_path: str) -> DataFrame:
    """One row per entry already in the store: block 0 of each decoded record
    (row groups skip on the block-sorted files) and the quarantine rows
    (partition pruning) -- never a scan of every segment."""
    done = ingest_log.live_rows(spark, decoded_path)
    return done.where(
        ((F.col("status") == "ok") & (F.col("block_id") == 0)) | (F.col("status") == "quarantine")
    ).select("archive_path", "entry_idx", "status")


def segments(spark: SparkSession, decoded_path: str) -> DataFrame:
    """The ``A^T`` store: good segments only (partition pruning on status)."""
    return ingest_log.live_rows(spark, decoded_path).where(F.col("status") == "ok").select(
        "record_name", "block_id", "values", "chunk_id"
    )


def quarantine(spark: SparkSession, decoded_path: str) -> DataFrame:
    return ingest_log.live_rows(spark, decoded_path).where(F.col("status") == "quarantine").select(
        "archive_path", "entry_idx", "record_name", "reason"
    )


def names(spark: SparkSession, decoded_path: str, out_path: str, order: str = "time", text_path: str | None = None) -> DataFrame:
    """Ordered column names of ``A`` (one row per record)."""
    recs = segments(spark, decoded_path).where(F.col("block_id") == 0).select("record_name")
    table = timeaxis.column_names(recs, order=order)
    store.write_names(table, out_path)
    if text_path:
        store.export_names_text(spark.read.parquet(out_path), text_path)
    return spark.read.parquet(out_path)


def transpose(
    spark: SparkSession,
    decoded_path: str,
    names_path: str,
    out_path: str,
    block_size: int = DEFAULT_BLOCK_SIZE,
    records_per_tile: int | None = None,
    method: str = "blocked",
) -> DataFrame:
    """Rows of ``A`` ``(row_idx, values)`` written sorted by ``row_idx``.

    Before any cell moves, the column order (V1), the equality of named and
    stored records (J1) and the completeness of every record are required.
    The blocked method plans its tiles from the shape (one shuffle unless a
    cell's column over all records exceeds the tile budget)."""
    seg = segments(spark, decoded_path)
    col_names = spark.read.parquet(names_path)
    verify.require_order(col_names)
    verify.require_same_records(seg, col_names)
    verify.require_complete(seg, stored_cells(spark, decoded_path, block_size), block_size)
    n_cells = stored_cells(spark, decoded_path, block_size)
    n_rec = col_names.count()
    parts = index.partitions_for(spark, 4.0 * n_rec * n_cells)
    if method == "blocked" and records_per_tile is None and matrix.tile_plan(n_rec, block_size)[1] >= n_rec:
        # tiles are dealt out by the ranges that the files hold: the only exchange of the matrix
        rows = matrix.transpose_ranges(seg, col_names, block_size, n_cells, n_rec, parts)
        store.write_matrix(rows, out_path, in_ranges=True)
        return spark.read.parquet(out_path)
    if method == "blocked":
        rows = matrix.transpose(seg, col_names, block_size, records_per_tile, n_cells)
    elif method == "sql":
        rows = matrix.transpose_sql(seg, col_names, block_size)
    else:
        raise ValueError("method is 'blocked' or 'sql'")
    store.write_matrix(rows, out_path, partitions=parts, n_rows=n_cells)
    return spark.read.parquet(out_path)


def grow(spark: SparkSession, decoded_path: str, out_path: str, block_size: int = DEFAULT_BLOCK_SIZE, order: str = "time",
         max_records: int | None = None, row_parts: int | None = None) -> DataFrame:
    """E2 by column chunks: the stored records that ``out_path`` (``sources.growing``,
    created if absent) does not hold yet become its next columns, in chunks of at
    most ``max_records``. Called again after more was converted, or after it died, it
    goes on with what is missing. Records that would come before a stored column
    raise. Gives the rows of all columns."""
    seg = segments(spark, decoded_path)
    if not ingest_log.table_exists(spark, f"{out_path}/shape"):
        n_cells = stored_cells(spark, decoded_path, block_size)
        n_rec = seg.where(F.col("block_id") == 0).count()
        growing.create(spark, out_path, n_cells, block_size, row_parts or index.partitions_for(spark, 4.0 * n_rec * n_cells))
    fresh = seg.where(F.col("block_id") == 0).select("record_name").join(growing.names(spark, out_path), "record_name", "left_anti")
    table = timeaxis.column_names(fresh, order=order)
    n_new = table.count()
    step = max_records or max(1, n_new)
    for low in range(0, n_new, step):
        mine = table.where((F.col("col_idx") >= low) & (F.col("col_idx") < low + step))
        growing.append(spark, out_path, store.semi_join_records(seg, mine), mine.withColumn("col_idx", F.col("col_idx") - low))
    return growing.read(spark, out_path)


def lookup(spark: SparkSession, decoded_path: str, record_name: str, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """One record in long form ``(record_name, pos, value)``."""
    return store.export_record_long(store.lookup_record(segments(spark, decoded_path), record_name), block_size)


def export_record(spark, decoded_path: str, record_name: str, out_path: str, block_size: int = DEFAULT_BLOCK_SIZE,
                  fmt: str = "json") -> None:
    """Write one record's cells as JSON lines (or Parquet)."""
    found = store.lookup_record(segments(spark, decoded_path), record_name)
    store.write_record_export(found, block_size, out_path, fmt)


def compare(spark, decoded_path: str, other: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Stored records against independently decoded vectors
    ``(record_name, values)`` (only the records present in ``other``)."""
    mine = store.semi_join_records(segments(spark, decoded_path), other)
    return verify.compare_segments(mine, matrix.segment(other, block_size))


def stored_cells(spark: SparkSession, decoded_path: str, block_size: int = DEFAULT_BLOCK_SIZE) -> int:
    """Cells of a stored record: whole blocks, and the last one's length."""
    seg = segments(spark, decoded_path)
    last_block = seg.agg(F.max("block_id")).first()[0]
    if last_block is None:
        return 0
    return last_block * block_size + seg.where(F.col("block_id") == last_block).agg(F.max(F.size("values"))).first()[0]


def multiply(spark, decoded_path: str, x_segments: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
             fill: float | None = None) -> DataFrame:
    """M6: ``A^T x`` (one number per record)."""
    return matrix.matvec(segments(spark, decoded_path), x_segments, block_size, fill=fill)


def multiply_transpose(spark, decoded_path: str, y: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE,
                       fill: float | None = None) -> DataFrame:
    """M7: ``A y`` (one number per cell)."""
    return matrix.matvec_transpose(segments(spark, decoded_path), y, block_size, fill=fill)


def _layout_from_json(spark, path: str) -> DataFrame:
    """Layout file: JSON list of ``[var, n_levels, n_lat, n_lon]`` in vector order."""
    from gridframe.operators import grid

    with open(path) as fh:
        specs = json.load(fh)
    variables = spark.createDataFrame(
        [(v, pos, int(d), int(la), int(lo)) for pos, (v, d, la, lo) in enumerate(specs)],
        "var string, var_pos int, n_levels int, n_lat int, n_lon int",
    )
    return grid.layout_offsets(variables)


def default_layout(n_lat: int, n_lon: int, pressure_levels: int) -> list[list]:
    """``[var, n_levels, n_lat, n_lon]`` of the default variables, in vector order: those
    on pressure levels have ``pressure_levels`` of them, the others one."""
    return [[v, pressure_levels if "_L100_" in v else 1, n_lat, n_lon] for v in DEFAULT_VARIABLES]


def main(argv=None) -> None:
    from gridframe.session import get_spark

    p = argparse.ArgumentParser(prog="gridframe")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("convert")
    c.add_argument("root"), c.add_argument("file_list"), c.add_argument("layout_json"), c.add_argument("out_dir")
    c.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    c.add_argument("--archives-per-chunk", type=int, default=200)
    y = sub.add_parser("layout", help="write the layout file of the default variables")
    y.add_argument("out_dir", metavar="layout_json")
    y.add_argument("--n-lat", type=int, default=361), y.add_argument("--n-lon", type=int, default=720)
    y.add_argument("--pressure-levels", type=int, default=37)
    n = sub.add_parser("names")
    n.add_argument("out_dir"), n.add_argument("--order", default="time"), n.add_argument("--text")
    t = sub.add_parser("transpose")
    t.add_argument("out_dir")
    t.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    t.add_argument("--records-per-tile", type=int, default=None)
    w = sub.add_parser("grow", help="append the records that out_dir/grown lacks as column chunks")
    w.add_argument("out_dir"), w.add_argument("--order", default="time"), w.add_argument("--max-records", type=int, default=None)
    w.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    w.add_argument("--compact", action="store_true", help="then merge all chunks into one base")
    m = sub.add_parser("multiply", help="A^T x for x given as Parquet (pos, value); writes (record_name, value)")
    m.add_argument("out_dir"), m.add_argument("x_path"), m.add_argument("target")
    m.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    m.add_argument("--fill", type=float, default=None)
    m.add_argument("--default", type=float, default=0.0, help="value of positions that x does not list")
    my = sub.add_parser("multiply-transpose", help="A y for y given as Parquet (record_name, y); writes (row_idx, value)")
    my.add_argument("out_dir"), my.add_argument("y_path"), my.add_argument("target")
    my.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    my.add_argument("--fill", type=float, default=None)
    f = sub.add_parser("forget", help="take the archives of a list out of the store")
    f.add_argument("root"), f.add_argument("file_list"), f.add_argument("out_dir")
    v = sub.add_parser("vacuum", help="remove partitions in which nothing counts any more")
    v.add_argument("out_dir")
    g = sub.add_parser("gaps", help="missing 6-hourly records on the time axis of the stored names")
    g.add_argument("out_dir"), g.add_argument("target"), g.add_argument("--step-hours", type=int, default=6)
    e = sub.add_parser("export")
    e.add_argument("out_dir"), e.add_argument("record_name"), e.add_argument("target")
    e.add_argument("--block-size", type=int, default=DEFAULT_BLOCK_SIZE)
    a = p.parse_args(argv)
    if a.cmd == "layout":
        with open(a.out_dir, "w") as fh:
            json.dump(default_layout(a.n_lat, a.n_lon, a.pressure_levels), fh)
        return
    spark = get_spark()
    d = a.out_dir.rstrip("/")
    if a.cmd == "convert":
        print(json.dumps(convert(spark, a.root, a.file_list, _layout_from_json(spark, a.layout_json), d,
                                 a.block_size, a.archives_per_chunk)))
    elif a.cmd == "forget":
        ingest_log.forget(spark, archives.read_archive_list(spark, a.file_list), a.root, d)
    elif a.cmd == "vacuum":
        print(json.dumps({"removed": ingest_log.vacuum(spark, d)}))
    elif a.cmd == "names":
        names(spark, f"{d}/decoded", f"{d}/names", a.order, a.text)
    elif a.cmd == "transpose":
        transpose(spark, f"{d}/decoded", f"{d}/names", f"{d}/matrix", a.block_size, a.records_per_tile)
    elif a.cmd == "grow":
        grow(spark, f"{d}/decoded", f"{d}/grown", a.block_size, a.order, a.max_records)
        if a.compact:
            growing.compact(spark, f"{d}/grown")
    elif a.cmd == "export":
        export_record(spark, f"{d}/decoded", a.record_name, a.target, a.block_size)
    elif a.cmd == "multiply":
        # the length is the store's, not that of the positions x happens to list
        n_cells = stored_cells(spark, f"{d}/decoded", a.block_size)
        x = matrix.vector_from_cells(spark.read.parquet(a.x_path), n_cells, a.block_size, a.default)
        multiply(spark, f"{d}/decoded", x, a.block_size, a.fill).write.parquet(a.target)
    elif a.cmd == "multiply-transpose":
        multiply_transpose(spark, f"{d}/decoded", spark.read.parquet(a.y_path), a.block_size, a.fill).write.parquet(a.target)
    elif a.cmd == "gaps":
        stamps = spark.read.parquet(f"{d}/names").where(F.col("ts").isNotNull())
        gaps = timeaxis.time_gaps(stamps, "ts", step_hours=a.step_hours)
        gaps.select(timeaxis.record_name_for("slot").alias("missing_record")).write.parquet(a.target)


if __name__ == "__main__":
    main()
