"""Matrix operators: segmentation, the two transposes, chunk merge, products.

Storage model. A record vector (a row of ``A^T``) can be far larger than a
Spark row should be, so it is kept as fixed-size segments
``(record_name, block_id, values[block_size])``; cell ``p`` of a record lives
in segment ``p div block_size`` at offset ``p mod block_size``. The global
row index of ``A`` is therefore pure arithmetic, ``block_id * block_size +
offset``, never the result of a sort over cells.

Column indexes of ``A`` (one per record) come from the column-name table
(see ``timeaxis.column_names``) and are attached with a size-checked
broadcast join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions.arrays import block_count, dense_from_entries
from gridframe.operators.index import broadcast_if_small, partitions_for
from gridframe.session import checkpoint_dir, ship_package

# Bytes of a broadcast side we accept per join (vector x of a product).
DEFAULT_BROADCAST_BYTES = 512 * 1024 * 1024


# --------------------------------------------------------------------------
# A11 segmentation
# --------------------------------------------------------------------------
def segment(vectors: DataFrame, block_size: int, keys=("record_name",), values: str = "values") -> DataFrame:
    """Cut whole vectors into ``block_size`` segments (narrow, no shuffle). An empty
    vector has no segment (``verify.check_lengths`` reports it)."""
    keys = list(keys)
    return vectors.where(F.size(values) > 0).select(
        *keys, values, F.explode(F.sequence(F.lit(0), block_count(values, block_size) - 1)).alias("block_id")
    ).select(
        *keys,
        F.col("block_id").cast("int").alias("block_id"),
        F.slice(values, F.col("block_id") * block_size + 1, F.lit(block_size)).alias("values"),
    )


def unsegment(segments: DataFrame, keys=("record_name",), partitions: int | None = None) -> DataFrame:
    """J6-style reassembly of whole vectors from segments.

    One group per vector: only for vectors that fit a row (lookups, exports,
    small layouts), never for the full-size records. Of these, pieces can be put
    together, with the piece among the ``keys``. ``partitions`` sizes the shuffle
    (default: Spark's setting, adjusted by AQE to the compressed size).
    """
    keys = list(keys)
    if partitions:
        segments = segments.repartition(partitions, *keys)
    return segments.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("block_id", "values"))).alias("_parts")
    ).select(*keys, F.flatten(F.transform("_parts", lambda p: p["values"])).alias("values"))


def matrix_shape(segments: DataFrame, names: DataFrame, block_size: int, n_cells: int | None = None) -> tuple[int, int]:
    """``(n_records, n_cells)``: the record count from the name table; the
    cell count if known (layout), else rounded up to whole blocks from one
    aggregate over ``block_id`` (cheap on a stored table: one column)."""
    if n_cells is None:
        n_blocks = segments.agg(F.max("block_id")).first()[0]
        n_cells = 0 if n_blocks is None else (n_blocks + 1) * block_size
    return names.count(), n_cells


def attach_col_idx(frame: DataFrame, names: DataFrame) -> DataFrame:
    """Record name -> column index of ``A``. A record that the names lack fails
    the job with its name; names without a record are found where the rows of ``A``
    are checked for their length."""
    joined = frame.join(broadcast_if_small(names.select("record_name", "col_idx")), "record_name", "left")
    return joined.withColumn("col_idx", required("col_idx", "has no column name").cast("long"))


def required(column: str, complaint: str):
    """A joined column that every record must have: null fails the job with the record."""
    message = F.concat(F.lit("record "), F.coalesce("record_name", F.lit("(null)")), F.lit(f" {complaint}"))
    return F.when(F.col(column).isNull(), F.raise_error(message)).otherwise(F.col(column))


# --------------------------------------------------------------------------
# M1 transpose in SQL form: explode cells, group by row index
# --------------------------------------------------------------------------
def transpose_sql(segments: DataFrame, names: DataFrame, block_size: int, *, fill: float | None = None,
                  n_cells: int | None = None) -> DataFrame:
    """``A^T`` segments -> rows of ``A`` ``(row_idx, values)``.

    Every cell travels once through the shuffle as ``(row_idx, col_idx,
    value)``; each output group holds one value per record. This is the
    explode-and-group method of the original, kept for small matrices and
    as a cross-check: it ships several times the bytes of
    ``transpose_blocked`` and its exchange follows
    ``spark.sql.shuffle.partitions`` (AQE coalesces it).

    With ``fill``, the value of absent cells, these stay behind and are put back
    where a row is built, so the exchange grows with the cells that are there and
    not with the shape of the matrix. The first cell of every segment travels in
    any case: a record whose segment is missing or repeated fails the job.
    """
    cells = attach_col_idx(segments, names).select(
        "col_idx", "block_id", F.posexplode("values").alias("_k", "value")
    )
    if fill is not None:
        cells = cells.where((F.col("_k") == 0) | ~F.col("value").eqNullSafe(F.lit(fill).cast("float")))
    # col_idx < 2^31 (one per record): an int keeps the shuffled structs small
    cells = cells.select(
        (F.col("block_id").cast("long") * block_size + F.col("_k")).alias("row_idx"),
        F.col("col_idx").cast("int").alias("col_idx"),
        "value",
    )
    if fill is None:
        return cells.groupBy("row_idx").agg(
            F.sort_array(F.collect_list(F.struct("col_idx", "value"))).alias("_p")
        ).select("row_idx", F.transform("_p", lambda s: s["value"]).alias("values"))
    spark = segments.sparkSession
    n_records, n_cells = matrix_shape(segments, names, block_size, n_cells)
    ship_package(spark)
    # a row without a present cell comes from the range; the partitions are those of the dense rows
    empty = spark.range(n_cells).select(F.col("id").alias("row_idx"), F.lit(None).cast("int").alias("col_idx"), F.lit(None).cast("float").alias("value"))
    entry = F.when(F.col("col_idx").isNotNull(), F.struct("col_idx", "value"))
    return cells.union(empty).repartition(partitions_for(spark, 4.0 * n_records * n_cells), "row_idx").groupBy("row_idx").agg(
        F.collect_list(entry).alias("_e")
    ).mapInArrow(_dense_rows(n_records, block_size, fill), "row_idx long, values array<float>")


def _dense_rows(n_records: int, block_size: int, fill: float, out_cells: int = 1 << 20):
    """Arrow kernel: the present cells of each row of ``A`` -> the whole row."""
    step = max(1, out_cells // max(1, n_records))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                n, row, entries = batch.num_rows, batch.column("row_idx").to_numpy(), batch.column("_e")
                flat = entries.flatten()
                at = pc.list_parent_indices(entries).to_numpy(zero_copy_only=False).astype(np.int64) * n_records
                at += flat.field("col_idx").to_numpy(zero_copy_only=False)
                held = np.bincount(at, minlength=n * n_records).reshape(n, n_records)
                bad = np.flatnonzero((held > 1).any(1) | ((row % block_size == 0) & (held == 0).any(1)))
                if len(bad):
                    raise ValueError(f"row {row[bad[0]]}: a record's segment is missing or repeated")
                values = flat.field("value")
                dense = np.full(n * n_records, fill, np.float32)
                dense[at] = values.to_numpy(zero_copy_only=False)
                mask = None
                if values.null_count:
                    mask = np.zeros(n * n_records, bool)
                    mask[at] = values.is_null().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.arange(0, n * n_records + 1, n_records, dtype=np.int32)) if n_records else pa.array(np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_idx"), pa.ListArray.from_arrays(offsets, pa.array(dense, pa.float32(), mask=mask))], names=["row_idx", "values"])

    return run


# --------------------------------------------------------------------------
# M2 blocked transpose: tiles of (block of cells) x (block of records)
# --------------------------------------------------------------------------
def _tile_transposer(records_per_tile: int, n_records: int | None = None):
    def transpose_tile(table: pa.Table) -> pa.Table:
        n = table.num_rows
        row0 = int(table.column("row0")[0].as_py())
        rblock = int(table.column("rblock")[0].as_py())
        col_idx = table.column("col_idx").to_numpy()
        first = rblock * records_per_tile
        expected = n if n_records is None else min(records_per_tile, n_records - first)
        if n != expected or not np.array_equal(np.sort(col_idx), np.arange(first, first + n)):
            raise ValueError(
                f"tile (row {row0}, record block {rblock}): records {col_idx.min()}..{col_idx.max()} in {n} rows, "
                f"expected {first}..{first + expected - 1} once each; a segment is missing or duplicated"
            )
        vals = table.column("values").combine_chunks()
        lengths = pc.list_value_length(vals).to_numpy(zero_copy_only=False)
        width = int(lengths[0])
        if (lengths != width).any():
            raise ValueError(f"tile (row {row0}, record block {rblock}): ragged segments {sorted(set(lengths.tolist()))}")
        dense = vals.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(n, width)
        tile = np.empty((width, n), dtype=np.float32)
        tile[:, col_idx - first] = dense.T
        offsets = pa.array(np.arange(0, width * n + 1, n, dtype=np.int32))
        out = pa.table({
            "row_idx": pa.array(row0 + np.arange(width, dtype=np.int64)),
            "rblock": pa.array(np.full(width, rblock, dtype=np.int32)),
            "values": pa.ListArray.from_arrays(offsets, pa.array(tile.ravel(), type=pa.float32())),
        })
        # hand the tile back in batches of about 4 MiB, not one tile-sized batch
        rows_per_batch = max(1, (4 << 20) // (4 * n))
        return pa.Table.from_batches(out.to_batches(max_chunksize=rows_per_batch), schema=out.schema)

    return transpose_tile


# Bytes of one transpose tile (input floats); the Python worker holds about
# three copies while transposing it.
DEFAULT_TILE_BYTES = 128 * 1024 * 1024


def tile_plan(n_records: int, block_size: int, max_tile_bytes: int = DEFAULT_TILE_BYTES) -> tuple[int, int]:
    """``(sub_block, records_per_tile)`` for a tile of at most
    ``max_tile_bytes``: all records in one tile when a single cell's record
    column fits (then no merge shuffle), with segments cut into sub-blocks
    so that sub_block x records stays in budget; else one cell per tile and
    record blocks of the budget."""
    per_cell = 4 * max(1, n_records)
    if per_cell <= max_tile_bytes:
        return min(block_size, max_tile_bytes // per_cell), max(1, n_records)
    return 1, max(1, max_tile_bytes // 4)


def transpose_blocked(
    segments: DataFrame,
    names: DataFrame,
    block_size: int,
    records_per_tile: int = 16384,
    partitions: int | None = None,
    n_cells: int | None = None,
    sub_block: int | None = None,
    n_records: int | None = None,
) -> DataFrame:
    """``A^T`` segments -> column chunks of ``A`` ``(row_idx, rblock, values)``.

    A tile is ``sub_block`` cells (default: the whole segment) x
    ``records_per_tile`` records, transposed with numpy on the executor.
    Segments are cut into sub-blocks by slicing (narrow, no shuffle). Tiles
    are all the same size except at the edges, so no key is hot. The one
    exchange is sized from the matrix shape (about 128 MiB per partition).
    Use ``merge_column_chunks`` for whole rows when there are several record
    blocks.
    """
    if partitions is None or n_records is None:
        n_records, n_cells = matrix_shape(segments, names, block_size, n_cells)
        partitions = partitions or partitions_for(segments.sparkSession, 4.0 * n_records * n_cells)
    ship_package(segments.sparkSession)
    sub = block_size if not sub_block or sub_block >= block_size else int(sub_block)
    tiles = attach_col_idx(segments, names).select(
        "block_id",
        (F.col("col_idx") / F.lit(records_per_tile)).cast("int").alias("rblock"),
        "col_idx",
        "values",
    )
    if sub < block_size:
        n_sub = -(-block_size // sub)
        tiles = tiles.select(
            "block_id", "rblock", "col_idx", "values", F.explode(F.sequence(F.lit(0), F.lit(n_sub - 1))).alias("_s")
        ).select(
            (F.col("block_id").cast("long") * block_size + F.col("_s") * sub).alias("row0"),
            "rblock", "col_idx",
            F.slice("values", F.col("_s") * sub + 1, F.lit(sub)).alias("values"),
        ).where(F.size("values") > 0)
    else:
        tiles = tiles.select(
            (F.col("block_id").cast("long") * block_size).alias("row0"), "rblock", "col_idx", "values"
        )
    return tiles.repartition(partitions, "row0", "rblock").groupBy("row0", "rblock").applyInArrow(
        _tile_transposer(records_per_tile, n_records),
        "row_idx long, rblock int, values array<float>",
    )


def transpose_ranges(segments: DataFrame, names: DataFrame, block_size: int, n_cells: int, n_records: int, partitions: int,
                     sub_block: int | None = None) -> DataFrame:
    """``A^T`` segments -> whole rows of ``A`` in sorted, contiguous ranges of ``row_idx``,
    one range per partition, for matrices whose tiles hold all records (``tile_plan``).

    The tiles are dealt out by range and sorted, and each is transposed as its rows
    stream by: the matrix moves once, and what comes out can be written as it is."""
    ship_package(segments.sparkSession)
    sub = min(block_size, sub_block or tile_plan(n_records, block_size)[0])
    n_sub = -(-block_size // sub)
    tiles = attach_col_idx(segments, names).select("block_id", "col_idx", "values", F.explode(F.sequence(F.lit(0), F.lit(n_sub - 1))).alias("_s")).select(
        (F.col("block_id").cast("long") * block_size + F.col("_s") * sub).alias("row0"), F.lit(0).alias("rblock"), "col_idx",
        F.slice("values", F.col("_s") * sub + 1, F.lit(sub)).alias("values")).where(F.size("values") > 0)
    in_range = F.least((F.col("row0") * F.lit(partitions) / F.lit(max(1, n_cells))).cast("int"), F.lit(partitions - 1))
    one_tile = _tile_transposer(max(1, n_records), n_records)

    def run(batches):
        held, row0 = [], None
        for batch in batches:
            starts = batch.column("row0").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and starts[a] != row0:
                    yield from one_tile(pa.Table.from_batches(held)).drop_columns(["rblock"]).to_batches()
                    held = []
                row0 = starts[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from one_tile(pa.Table.from_batches(held)).drop_columns(["rblock"]).to_batches()

    return tiles.repartitionById(partitions, in_range).sortWithinPartitions("row0").mapInArrow(run, "row_idx long, values array<float>")


def merge_column_chunks(chunks: DataFrame, partitions: int | None = None, n_records: int | None = None) -> DataFrame:
    """Stitch column chunks of ``A`` into whole rows on ``row_idx``.

    One shuffle (not one join per chunk); a group holds one segment per
    record block, i.e. one value per record in total. ``partitions`` sizes
    that shuffle (default: Spark's setting, adjusted by AQE). A row whose
    record blocks are not 0, 1, 2, ... once each, or that has not
    ``n_records`` values (if given), fails the job with its index.
    """
    if partitions:
        chunks = chunks.repartition(partitions, "row_idx")
    return chunks.groupBy("row_idx").agg(
        F.sort_array(F.collect_list(F.struct("rblock", "values"))).alias("_p")
    ).select("row_idx", "_p", F.flatten(F.transform("_p", lambda s: s["values"])).alias("_v")).select(
        "row_idx", _checked_row(n_records).alias("values"))


def _checked_row(n_records: int | None):
    blocks = F.transform("_p", lambda s: s["rblock"])
    whole = blocks == F.sequence(F.lit(0), F.size("_p") - 1)
    if n_records is not None:
        whole = whole & (F.size("_v") == n_records)
    message = F.concat(F.lit("row "), F.col("row_idx").cast("string"), F.lit(": record blocks "), F.to_json(blocks),
                       F.lit(" with "), F.size("_v").cast("string"), F.lit(" values; a block is missing or repeated"))
    return F.when(whole, F.col("_v")).otherwise(F.raise_error(message).cast("array<float>"))


def transpose(
    segments: DataFrame,
    names: DataFrame,
    block_size: int,
    records_per_tile: int | None = None,
    n_cells: int | None = None,
    max_tile_bytes: int = DEFAULT_TILE_BYTES,
) -> DataFrame:
    """Blocked transpose to whole rows of ``A``.

    By default the tile shape comes from ``tile_plan``: one shuffle, no
    merge, unless a single cell's column over all records exceeds the tile
    budget. An explicit ``records_per_tile`` forces record blocks (and the
    merge when there is more than one). ``n_cells`` (from the layout) saves
    a pass over computed segments."""
    n_records, n_cells = matrix_shape(segments, names, block_size, n_cells)
    partitions = partitions_for(segments.sparkSession, 4.0 * n_records * n_cells)
    if records_per_tile is None:
        sub, records_per_tile = tile_plan(n_records, block_size, max_tile_bytes)
    else:
        sub = block_size
    chunks = transpose_blocked(segments, names, block_size, records_per_tile, partitions, n_cells, sub, n_records)
    if n_records <= records_per_tile:
        return chunks.select("row_idx", "values")
    return merge_column_chunks(chunks, partitions, n_records)


def to_long(rows: DataFrame, row_col: str = "row_idx", col_col: str = "col_idx") -> DataFrame:
    """Rows of a matrix -> long form ``(row, col, value)``."""
    return rows.select(row_col, F.posexplode("values").alias(col_col, "value")).select(
        row_col, F.col(col_col).cast("long").alias(col_col), "value"
    )


# --------------------------------------------------------------------------
# Products (M5-M7, P10)
# --------------------------------------------------------------------------
def vector_segments(spark, values, block_size: int) -> DataFrame:
    """A small driver-side vector (tests, hand-made probes) as segments.
    Vectors that come from data are built distributed with
    ``vector_from_cells`` or ``column_means`` instead."""
    arr = np.asarray(values, dtype=np.float64)
    rows = [
        (b, arr[b * block_size:(b + 1) * block_size].tolist())
        for b in range(int(np.ceil(len(arr) / block_size)))
    ]
    return spark.createDataFrame(rows, "block_id int, values array<double>")


def vector_from_cells(cells: DataFrame, n_cells: int, block_size: int, default: float = 0.0) -> DataFrame:
    """A vector given as a table ``(pos, value)`` -> segments ``(block_id,
    values array<double>)``; absent positions, and blocks without any entry, get
    ``default``, so the vector always has its full length. A group is one block
    (at most ``block_size`` entries)."""
    n_blocks = -(-n_cells // block_size)
    last_len = n_cells - (n_blocks - 1) * block_size
    grouped = cells.select(
        (F.col("pos") / block_size).cast("int").alias("block_id"),
        F.struct((F.col("pos") % block_size).cast("int").alias("k"), F.col("value").cast("double").alias("value")).alias("e"),
    ).groupBy("block_id").agg(F.collect_list("e").alias("_e"))
    all_blocks = cells.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block_id"))
    length = F.when(F.col("block_id") == n_blocks - 1, F.lit(last_len)).otherwise(F.lit(block_size))
    none = F.array().cast("array<struct<k:int,value:double>>")
    return all_blocks.join(grouped, "block_id", "left").withColumn("_e", F.coalesce("_e", none)).select(
        "block_id", dense_from_entries("_e", length, default, "double").alias("values"))


# Blocks whose sums a task holds before it hands them on (8 KiB each at 1024 cells).
BLOCKS_IN_TASK = 4096


def _block_sums(fill: float | None, missing: bool):
    """Arrow kernel ``(block_id, w, values)`` -> ``(block_id, sums, n)``: one array per
    block and task (or per ``BLOCKS_IN_TASK`` blocks), added up with numpy."""
    f32 = None if fill is None else np.float32(fill)

    def flush(sums, counts):
        blocks = sorted(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([sums[b] for b in blocks], pa.list_(pa.float64())), pa.array([counts[b] for b in blocks], pa.int64())],
            names=["block_id", "sums", "n"])

    def run(batches):
        sums, counts = {}, {}
        for batch in batches:
            values = batch.column("values")
            flat = values.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))
            gone = None if f32 is None else np.isnan(flat) if np.isnan(f32) else flat == f32
            if missing:
                flat = gone.astype(np.float64)
            elif gone is not None:
                flat = np.where(gone, 0.0, flat.astype(np.float64))
            at = 0
            for block, w, end in zip(batch.column("block_id").to_pylist(), batch.column("w").to_pylist(), ends.tolist()):
                part = flat[at:end].astype(np.float64) * w
                at = end
                have = sums.get(block)
                if have is None:
                    sums[block], counts[block] = part, 1
                    continue
                if len(have) != len(part):
                    raise ValueError(f"block {block}: segments of {len(have)} and {len(part)} cells")
                have += part
                counts[block] += 1
            if len(sums) > BLOCKS_IN_TASK:
                yield flush(sums, counts)
                sums, counts = {}, {}
        if sums:
            yield flush(sums, counts)

    return run


def _merge_block_sums(table):
    lengths = pc.list_value_length(table.column("sums")).to_numpy()
    if (lengths != lengths[0]).any():
        raise ValueError(f"block {table.column('block_id')[0]}: segments of {sorted(set(lengths.tolist()))} cells")
    parts = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, int(lengths[0]))
    return pa.table({"block_id": table.column("block_id").slice(0, 1), "sums": pa.array([parts.sum(0)], pa.list_(pa.float64())),
                     "n": pa.array([int(pc.sum(table.column("n")).as_py())], pa.int64())})


def block_sums(rows: DataFrame, fill: float | None = None, missing: bool = False) -> DataFrame:
    """Sums of segments per block: ``(block_id, w, values)`` -> ``(block_id, sums
    array<double>, n)`` with ``sums[k]`` = sum of ``w * values[k]``, cells equal to
    ``fill`` counting as 0 (or, with ``missing``, sums of ``w`` over the cells that
    equal it). Arrays are added inside the tasks; what is shuffled is one array
    per task and block, and a group holds one block's."""
    ship_package(rows.sparkSession)
    partial = rows.select("block_id", F.col("w").cast("double").alias("w"), "values").mapInArrow(
        _block_sums(fill, missing), "block_id int, sums array<double>, n long")
    return partial.groupBy("block_id").applyInArrow(_merge_block_sums, "block_id int, sums array<double>, n long")


def column_means(segments: DataFrame, block_size: int) -> DataFrame:
    """Mean record vector as segments ``(block_id, values array<double>)``."""
    sums = block_sums(segments.select("block_id", F.lit(1.0).alias("w"), "values"))
    return sums.select("block_id", F.transform("sums", lambda v: v / F.col("n")).alias("values"))


def _dots(fill: float | None):
    """numpy dot products of Arrow batches ``(record_name, block_id, values, _x)``."""
    def run(batches):
        for batch in batches:
            v, x = batch.column(2), batch.column(3)
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            wrong = np.flatnonzero(np.nan_to_num(pc.list_value_length(x).to_numpy(zero_copy_only=False), nan=-1) != size)
            if len(wrong):
                i = int(wrong[0])
                raise ValueError(f"record {batch.column(0)[i]}, block {batch.column(1)[i]}: {size[i]} cells, but the vector's "
                                 f"block has {pc.list_value_length(x)[i]}")
            a = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if fill is not None:
                f32 = np.float32(fill)
                a[np.isnan(a) if np.isnan(f32) else a == f32] = 0.0
            starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            # a zero at the end, so that an empty last segment has a place to start
            terms = np.append(a * x.flatten().to_numpy(zero_copy_only=False), 0.0)
            sums = np.where(size > 0, np.add.reduceat(terms, starts), 0.0) if len(size) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], names=["record_name", "_d"])

    return run


def matvec(
    segments: DataFrame,
    x_segments: DataFrame,
    block_size: int,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    fill: float | None = None,
) -> DataFrame:
    """M6: ``A^T x``, one number per record ``(record_name, value)``.

    ``x`` is checkpointed (it is used twice) and joined to the segments on
    ``block_id``; every segment needs its block of ``x`` at full length (see
    ``vector_from_cells``), or the job fails with the record and block. While
    ``x`` (8 bytes per cell) is within ``max_broadcast_bytes`` it is broadcast;
    beyond, both sides are shuffled on the block, and AQE splits a block that
    many records share. Dot products are numpy's, one Arrow batch at a time;
    partial sums are combined map-side. Cells equal to ``fill`` count as 0.
    """
    spark = segments.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    x = x_segments.select("block_id", F.col("values").cast("array<double>").alias("_x")).checkpoint(eager=True)
    cells = x.agg(F.sum(F.size("_x"))).first()[0] or 0
    side = F.broadcast(x) if 8 * cells <= max_broadcast_bytes else x.hint("merge")
    joined = segments.select("record_name", "block_id", "values").join(side, "block_id", "left").select(
        "record_name", "block_id", "values", "_x")
    return joined.mapInArrow(_dots(fill), "record_name string, _d double").groupBy("record_name").agg(F.sum("_d").alias("value"))


def matvec_transpose(segments: DataFrame, y: DataFrame, block_size: int, fill: float | None = None,
                     default: float | None = None) -> DataFrame:
    """M7: ``A y``, one number per cell ``(row_idx, value)``.

    ``y`` has one number per record ``(record_name, y)``; it is broadcast
    after a row count. Arrays are summed per block inside the tasks
    (``block_sums``), and only the final sums become one row per cell. Cells
    equal to ``fill`` count as 0. A record without a ``y`` counts with ``default``,
    or fails the job with its name if there is none.
    """
    scaled = segments.join(broadcast_if_small(y.select("record_name", F.col("y").cast("double").alias("y"))), "record_name", "left")
    weight = required("y", "has no y").cast("double") if default is None else F.coalesce("y", F.lit(float(default)))
    sums = block_sums(scaled.select("block_id", weight.alias("w"), "values"), fill)
    return sums.select("block_id", F.posexplode("sums").alias("k", "value")).select(
        (F.col("block_id").cast("long") * block_size + F.col("k")).alias("row_idx"), "value")


def indexed_rows(segments: DataFrame, names: DataFrame) -> DataFrame:
    """``A^T`` as an indexed row matrix: row number = the
    record's column index (date order), values widened to double; kept as
    segments ``(row, block_id, values array<double>)``."""
    return attach_col_idx(segments, names).select(
        F.col("col_idx").alias("row"), "block_id", F.col("values").cast("array<double>").alias("values")
    )
