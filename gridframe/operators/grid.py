"""Grid operators: layout, flatten / un-flatten, slices, masks, missing-data
summaries (A1-A11, P6, P7, W3, G4-G6, J5).

Positions in a record vector follow the layout table: variable ``v`` at level
``l`` starts at ``offset`` and holds ``n_lat * n_lon`` cells in row-major
order, so cell (l, i, j) of a 3-D variable is at
``var_offset + (l * n_lat + i) * n_lon + j`` (A1/A2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions.arrays import mask_equal  # noqa: F401  (re-exported)
from gridframe.operators import matrix
from gridframe.session import ship_package


# --------------------------------------------------------------------------
# W3 layout
# --------------------------------------------------------------------------
def layout_offsets(variables: DataFrame, max_group_length: int | None = None) -> DataFrame:
    """Layout table from ``(var, var_pos, n_levels, n_lat, n_lon)``.

    One row per variable level with its ``offset`` and ``length``, in
    ``(var_pos, level)`` order. With ``max_group_length``, ``group_id`` numbers
    groups of at most so many cells (see ``layout_groups``).

    A running sum over the variables (metadata: one row per variable), as an
    expression; the levels are exploded from it.
    """
    before = Window.orderBy("var_pos", "var").rowsBetween(Window.unboundedPreceding, -1)
    cells = F.col("n_levels").cast("long") * F.col("n_lat") * F.col("n_lon")
    spans = variables.select("var", "var_pos", "n_levels", "n_lat", "n_lon").withColumn(
        "_o", F.coalesce(F.sum(cells).over(before), F.lit(0)).cast("long"))
    plane = F.col("n_lat").cast("long") * F.col("n_lon")
    levels = spans.where(F.col("n_levels") > 0).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("n_levels").cast("int") - 1)))
    layout = levels.select(
        "var", F.col("var_pos").cast("int").alias("var_pos"), "level", F.col("n_lat").cast("int").alias("n_lat"),
        F.col("n_lon").cast("int").alias("n_lon"), (F.col("_o") + F.col("level") * plane).alias("offset"), plane.alias("length"),
    )
    return layout_groups(layout, max_group_length) if max_group_length else layout


def _next_fit(bound: int):
    """Arrow fold over the layout's rows in order, with the open group as its state."""
    import pyarrow as pa

    def run(batches):
        group, used, current = -1, 0, None
        for batch in batches:
            ids = []
            for var, length, whole in zip(*(batch.column(c).to_pylist() for c in ("var", "length", "_whole"))):
                if length > bound:
                    raise ValueError(f"a level of {var} has {length} cells, groups hold {bound}")
                if whole > bound:  # split by level
                    size, current = length, None
                elif var != current:
                    size, current = whole, var
                else:
                    size = 0  # came with the variable's first level
                if group < 0 or used + size > bound:
                    group, used = group + 1, 0
                used += size
                ids.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int32())], names=[*batch.schema.names[:-1], "group_id"])

    return run


def layout_groups(layout: DataFrame, max_group_length: int) -> DataFrame:
    """``group_id`` of every layout row, next fit in vector order: a variable joins
    the open group or, where it does not fit, opens the next. A variable larger
    than ``max_group_length`` is split between its levels; a single level that is
    larger fails. No group exceeds the bound. The layout is metadata (a row per
    variable level), so one task folds it."""
    ship_package(layout.sparkSession)
    sized = layout.withColumn("_whole", F.sum("length").over(Window.partitionBy("var", "var_pos")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in layout.schema.fields)
    return sized.coalesce(1).sortWithinPartitions("var_pos", "var", "level").select(*layout.columns, "_whole").mapInArrow(
        _next_fit(int(max_group_length)), f"{ddl}, group_id int")


def variable_spans(layout: DataFrame) -> DataFrame:
    """One row per variable: ``(var, var_pos, offset, length, dims)``."""
    return layout.groupBy("var", "var_pos").agg(
        F.min("offset").alias("offset"),
        F.sum("length").cast("long").alias("length"),
        F.array(F.count(F.lit(1)).cast("int"), F.first("n_lat").cast("int"), F.first("n_lon").cast("int")).alias("dims"),
    )


# --------------------------------------------------------------------------
# A3 records from variables: straight into segments
# --------------------------------------------------------------------------
def fill_missing_variables(grid_vars: DataFrame, layout: DataFrame, fill: float) -> DataFrame:
    """Give every record every layout variable; an absent one is all ``fill``.

    Absent pairs are found per record from the set of variables it has
    (bounded by the variable count), never from a records x variables cross
    product."""
    spans = variable_spans(layout)
    all_vars = [r["var"] for r in spans.select("var").orderBy("var").collect()]
    have = grid_vars.groupBy("record_name").agg(F.collect_set("var").alias("_have"))
    absent = have.select(
        "record_name",
        F.explode(F.array_except(F.array(*[F.lit(v) for v in all_vars]), F.col("_have"))).alias("var"),
    ).join(F.broadcast(spans.select("var", "dims", "length")), "var").select(
        "record_name", "var", "dims", F.lit(fill).cast("float").alias("fill"),
        F.array_repeat(F.lit(fill).cast("float"), F.col("length").cast("int")).alias("values"),
    )
    return grid_vars.select("record_name", "var", "dims", "fill", "values").unionByName(absent)


def to_record_segments(grid_vars: DataFrame, layout: DataFrame, block_size: int) -> DataFrame:
    """A1-A3: variables ``(record_name, var, values)`` -> record segments.

    Each variable is cut into the pieces that fall into each block of the
    record vector; a group is one segment (``block_size`` floats at most),
    so no whole record vector is ever built in one row. A variable of another
    length than the layout's, and a block whose pieces leave a gap or overlap
    (a variable that is absent or given twice), fail the job with the record;
    ``fill_missing_variables`` supplies absent variables.
    """
    total = variable_spans(layout).agg(F.sum("length")).first()[0] or 0
    following = F.lead("offset", 1, 0).over(Window.orderBy("offset"))  # metadata: one row per variable
    spans = F.broadcast(variable_spans(layout).select("var", F.col("offset").alias("_o"), F.col("length").alias("_n"), following.alias("_next")))
    v = grid_vars.join(spans, "var")
    first = (F.col("_o") / block_size).cast("long")
    last = ((F.col("_o") + F.col("_n") - 1) / block_size).cast("long")
    sized = F.when(F.size("values") == F.col("_n"), F.col("values")).otherwise(F.raise_error(F.concat(
        F.lit("record "), F.col("record_name"), F.lit(": variable "), F.col("var"), F.lit(" has "), F.size("values").cast("string"),
        F.lit(" cells, the layout expects "), F.col("_n").cast("string"))).cast("array<float>"))
    pieces = v.select("record_name", "_o", "_n", sized.alias("values"), F.explode(
        F.array_union(F.sequence(first, last), F.array((F.col("_next") / block_size).cast("long")))).alias("block_id"))
    start = F.greatest(F.col("block_id") * block_size - F.col("_o"), F.lit(0))
    end = F.least(F.col("_n"), (F.col("block_id") + 1) * block_size - F.col("_o"))
    pieces = pieces.select(
        "record_name",
        F.col("block_id").cast("int").alias("block_id"),
        (F.col("_o") + start - F.col("block_id") * block_size).alias("_at"),
        F.when(end > start, F.slice("values", (start + 1).cast("int"), (end - start).cast("int"))).otherwise(
            F.array().cast("array<float>")).alias("_piece"),
    )
    # every variable also names the block in which the next one begins (the last one: block 0) by an
    # empty piece, so a variable whose blocks would all be absent shows as a block without cells
    # each piece must begin where the one before it ends, from 0 to the block's length
    end = F.aggregate("_p", F.lit(0).cast("long"), lambda at, s: F.when(s["_at"] == at, at + F.size(s["_piece"])).otherwise(F.lit(-1).cast("long")))
    wanted = F.least(F.lit(block_size).cast("long"), F.lit(int(total)) - F.col("block_id").cast("long") * block_size)
    whole = F.flatten(F.transform("_p", lambda s: s["_piece"]))
    message = F.concat(F.lit("record "), F.col("record_name"), F.lit(", block "), F.col("block_id").cast("string"),
                       F.lit(": a variable is absent or given twice"))
    return pieces.groupBy("record_name", "block_id").agg(
        F.sort_array(F.filter(F.collect_list(F.struct("_at", "_piece")), lambda s: F.size(s["_piece"]) > 0)).alias("_p")
    ).select("record_name", "block_id", F.when(end == wanted, whole).otherwise(F.raise_error(message).cast("array<float>")).alias("values"))


# --------------------------------------------------------------------------
# Un-flattening and slicing (all narrow, no shuffle)
# --------------------------------------------------------------------------
def unflatten_2d(vectors: DataFrame, n_lat: int, n_lon: int, offset: int = 0, var: str = "var") -> DataFrame:
    """A5: a 2-D variable stored row-major at ``offset`` -> cells (i, j)."""
    part = F.slice("values", offset + 1, n_lat * n_lon)
    cells = vectors.select("record_name", F.posexplode(part).alias("pos", "value"))
    return cells.select(
        "record_name", F.lit(var).alias("var"), F.lit(0).alias("level"),
        (F.col("pos") / n_lon).cast("int").alias("i"), (F.col("pos") % n_lon).cast("int").alias("j"), "value",
    )


def unflatten_3d(vectors: DataFrame, depth: int, n_lat: int, n_lon: int, offset: int = 0, var: str = "var") -> DataFrame:
    """(depth, lat, lon) row-major -> cells (level, i, j)."""
    plane = n_lat * n_lon
    part = F.slice("values", offset + 1, depth * plane)
    cells = vectors.select("record_name", F.posexplode(part).alias("pos", "value"))
    return cells.select(
        "record_name", F.lit(var).alias("var"),
        (F.col("pos") / plane).cast("int").alias("level"),
        ((F.col("pos") % plane) / n_lon).cast("int").alias("i"),
        (F.col("pos") % n_lon).cast("int").alias("j"), "value",
    )


def flatten_cells(cells: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """A1/A2 in long form: cell (level, i, j) -> position in its variable."""
    return cells.withColumn(
        "pos", ((F.col("level") * n_lat + F.col("i")) * n_lon + F.col("j")).cast("long")
    )


def permute_axes(vectors: DataFrame, depth: int) -> DataFrame:
    """A variable stored as [h, w, d] (d fastest) -> ``depth`` rows of
    ``h*w`` values: row k holds element k of every cell, in cell order."""
    planes = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: F.when(
        F.size("values") > k, F.transform(F.sequence(k, F.size("values") - 1, F.lit(depth)), lambda i: F.get("values", i))).otherwise(
        F.array().cast("array<float>")))
    return vectors.select("record_name", F.posexplode(planes).alias("k", "values"))


def level_slice(vectors: DataFrame, level: int, n_lat: int, n_lon: int, offset: int = 0) -> DataFrame:
    """One level of a 3-D variable as its own (n_lat x n_lon) vector."""
    plane = n_lat * n_lon
    return vectors.select(
        "record_name", F.slice("values", offset + level * plane + 1, plane).alias("values")
    )


def column_range(vectors: DataFrame, start: int, end: int) -> DataFrame:
    """Cells ``[start, end)`` of every vector."""
    return vectors.select("record_name", F.slice("values", start + 1, end - start).alias("values"))


# --------------------------------------------------------------------------
# Missing data
# --------------------------------------------------------------------------
def missing_mask(vectors: DataFrame, fill: float) -> DataFrame:
    """Boolean mask vector, true where the cell equals the fill value."""
    return vectors.select("record_name", mask_equal("values", fill).alias("mask"))


def _layers(layout: DataFrame, block_size: int) -> DataFrame:
    """Layout rows (metadata) once per block they touch."""
    return layout.select("var", "level", "n_lat", "n_lon", "offset", "length", F.explode(F.sequence(
        (F.col("offset") / block_size).cast("long"), ((F.col("offset") + F.col("length") - 1) / block_size).cast("long"))).alias("block_id")).withColumn(
        "block_id", F.col("block_id").cast("int"))


def missing_census_segments(segments: DataFrame, layout: DataFrame, block_size: int, fill: float) -> DataFrame:
    """G5 on the stored segments: missing cells are counted as arrays per block;
    only the counts, one per cell of the grid, meet the layout."""
    counts = matrix.block_sums(segments.select("block_id", F.lit(1.0).alias("w"), "values"), fill, missing=True)
    cells = counts.select("block_id", "n", F.posexplode("sums").alias("k", "m")).select(
        "block_id", (F.col("block_id").cast("long") * block_size + F.col("k")).alias("pos"), "n", "m")
    local = F.col("pos") - F.col("offset")
    return cells.join(F.broadcast(_layers(layout, block_size)), "block_id").where(
        (F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("length"))).select(
        "var", "level", (local / F.col("n_lon")).cast("int").alias("i"), (local % F.col("n_lon")).cast("int").alias("j"),
        F.col("m").cast("long").alias("n_missing"), F.col("n").alias("n_records"))


def missing_any_segments(segments: DataFrame, layout: DataFrame, block_size: int, fill: float) -> DataFrame:
    """G6 on the stored segments: per segment and variable the missing cells are
    counted in the array, then added up per record."""
    spans = variable_spans(layout).select("var", F.col("offset").alias("_o"), F.col("length").alias("_n"))
    touched = spans.select("var", "_o", "_n", F.explode(F.sequence(
        (F.col("_o") / block_size).cast("long"), ((F.col("_o") + F.col("_n") - 1) / block_size).cast("long"))).alias("block_id")).withColumn(
        "block_id", F.col("block_id").cast("int"))
    base = F.col("block_id").cast("long") * block_size
    first = F.greatest(F.col("_o") - base, F.lit(0)).cast("int")
    last = F.least(F.col("_o") + F.col("_n") - base, F.size("values").cast("long")).cast("int")
    gone = F.size(F.filter(F.slice("values", first + 1, F.greatest(last - first, F.lit(0))), lambda v: v == F.lit(fill).cast("float")))
    return segments.join(F.broadcast(touched), "block_id").select("record_name", "var", gone.cast("long").alias("m")).groupBy(
        "record_name", "var").agg((F.sum("m") > 0).alias("any_missing"), F.sum("m").alias("n_missing"))


def segment_range(segments: DataFrame, start: int, length: int, block_size: int) -> DataFrame:
    """P7 on the store: cells ``start .. start + length - 1`` as ``(record_name, pos,
    value)``. Only the blocks of the range are read (a filter that reaches the scan)."""
    lo, hi = start // block_size, (start + max(length, 1) - 1) // block_size
    pos = F.col("block_id").cast("long") * block_size + F.col("k")
    return segments.where(F.col("block_id").between(lo, hi)).select("record_name", "block_id", F.posexplode("values").alias("k", "value")).select(
        "record_name", pos.alias("pos"), "value").where(F.col("pos").between(start, start + length - 1))


def segment_level(segments: DataFrame, layout: DataFrame, var: str, level: int, block_size: int) -> DataFrame:
    """P6/A5 on the store: one level of a variable as cells ``(record_name, var, level, i,
    j, value)``; only the blocks it lies in are read."""
    found = layout.where((F.col("var") == var) & (F.col("level") == level)).first()
    if found is None:
        raise ValueError(f"the layout has no level {level} of {var}")
    cells = segment_range(segments, int(found["offset"]), int(found["length"]), block_size)
    local = F.col("pos") - F.lit(int(found["offset"]))
    return cells.select("record_name", F.lit(var).alias("var"), F.lit(level).alias("level"),
                        (local / F.lit(found["n_lon"])).cast("int").alias("i"), (local % F.lit(found["n_lon"])).cast("int").alias("j"), "value")


# --------------------------------------------------------------------------
# J5 variable groups
# --------------------------------------------------------------------------
def join_variable_groups(groups: list[DataFrame]) -> DataFrame:
    """Full outer join of per-group record vectors on ``record_name``.

    ``groups[g]`` has ``(record_name, values)``. The result has the
    concatenated ``values`` (null unless every group is present) and the
    list of absent group ids."""
    joined = None
    for g, df in enumerate(groups):
        part = df.select("record_name", F.col("values").alias(f"_g{g}"))
        joined = part if joined is None else joined.join(part, "record_name", "full_outer")
    names = [f"_g{g}" for g in range(len(groups))]
    absent = F.filter(
        F.array(*[F.when(F.col(n).isNull(), F.lit(g)) for g, n in enumerate(names)]), lambda x: x.isNotNull()
    )
    return joined.select(
        "record_name",
        F.concat(*[F.col(n) for n in names]).alias("values"),
        absent.alias("missing_groups"),
    )


def _scatter_segments(keys, block_size: int, n_blocks: int, last_len: int, fill: float, out_rows: int = 256):
    """Arrow kernel: sparse ``(k, value)`` entries per segment -> dense
    segments, one vectorised numpy scatter per batch. The partition holds
    every block of its records, so blocks no entry touched are emitted at
    the end as all-fill segments (in batches of ``out_rows``)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def lengths_of(block_id):
        if len(block_id) and block_id.max() >= n_blocks:
            raise ValueError(f"a position lies in block {block_id.max()} of {n_blocks}: outside the record")
        return np.where(block_id == n_blocks - 1, last_len, block_size).astype(np.int64)

    def make_batch(key_arrays, block_id, dense, lengths):
        offsets = np.zeros(len(block_id) + 1, dtype=np.int64)
        np.cumsum(lengths, out=offsets[1:])
        values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(dense, pa.float32()))
        return pa.RecordBatch.from_arrays(
            list(key_arrays) + [pa.array(block_id.astype(np.int32)), values], names=list(keys) + ["block_id", "values"]
        )

    def run(batches):
        seen = {}
        key_types = None
        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            entries = batch.column("_e")
            block_id = batch.column("block_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = lengths_of(block_id)
            starts = np.zeros(len(block_id) + 1, dtype=np.int64)
            np.cumsum(lengths, out=starts[1:])
            dense = np.full(int(starts[-1]), fill, dtype=np.float32)
            flat = entries.flatten()
            if len(flat):
                parent = pc.list_parent_indices(entries).to_numpy(zero_copy_only=False)
                k = flat.field("k").to_numpy(zero_copy_only=False).astype(np.int64)
                v = flat.field("value").to_numpy(zero_copy_only=False)
                outside = np.flatnonzero((k < 0) | (k >= lengths[parent]) | (block_id[parent] < 0))
                at = starts[parent] + k
                if len(outside) or len(np.unique(at)) != len(at):
                    i = int(outside[0]) if len(outside) else int(np.flatnonzero(np.bincount(at)[at] > 1)[0])
                    row = int(parent[i])
                    who = ", ".join(str(batch.column(c)[row]) for c in keys)
                    raise ValueError(f"record {who}: position {block_id[row] * block_size + k[i]} is "
                                     f"{'outside the record' if len(outside) else 'given twice'}")
                dense[at] = v
            for key, b in zip(zip(*(batch.column(c).to_pylist() for c in keys)), block_id.tolist()):
                mask = seen.get(key)
                if mask is None:
                    mask = seen[key] = np.zeros(n_blocks, dtype=bool)
                mask[b] = True
            yield make_batch([batch.column(c) for c in keys], block_id, dense, lengths)
        pending_keys, pending_blocks = [], []
        for key, mask in seen.items():
            for b in np.flatnonzero(~mask).tolist():
                pending_keys.append(key)
                pending_blocks.append(b)
                if len(pending_blocks) == out_rows:
                    yield _fill_batch(pending_keys, pending_blocks, key_types)
                    pending_keys, pending_blocks = [], []
        if pending_blocks:
            yield _fill_batch(pending_keys, pending_blocks, key_types)

    def _fill_batch(key_rows, blocks, key_types):
        block_id = np.asarray(blocks, dtype=np.int64)
        lengths = lengths_of(block_id)
        dense = np.full(int(lengths.sum()), fill, dtype=np.float32)
        key_arrays = [pa.array([r[i] for r in key_rows], key_types[i]) for i in range(len(keys))]
        return make_batch(key_arrays, block_id, dense, lengths)

    return run


def cells_to_segments(
    cells: DataFrame, n_cells: int, block_size: int, fill: float, keys=("record_name",), partitions: int | None = None
) -> DataFrame:
    """A1-A3 from sparse cells ``(record_name, pos, value)``: dense segments
    of a fixed-length vector, absent cells = ``fill``. A position outside the
    vector, or given twice for a record, fails the job with the record.

    A group is one segment (at most ``block_size`` cells). Blocks with no
    cell at all are filled in by the kernel from the blocks each record has
    (bounded by the block count), not from a records x blocks cross
    product."""
    keys = list(keys)
    n_blocks = -(-n_cells // block_size)
    last_len = n_cells - (n_blocks - 1) * block_size
    c = cells.select(
        *keys,
        (F.col("pos") / block_size).cast("int").alias("block_id"),
        (F.col("pos") % block_size).cast("int").alias("k"),
        F.col("value").cast("float").alias("value"),
    )
    # Partition by record: the grouping below reuses this exchange, and each
    # partition sees all blocks of its records, so the kernel also emits the
    # blocks without any cell. At least one partition per core: the sparse
    # input is small next to the dense output, and AQE must not coalesce
    # the expansion into a handful of tasks.
    ship_package(cells.sparkSession)
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, partitions or 0)
    present = c.repartition(parts, *keys).groupBy(*keys, "block_id").agg(
        F.collect_list(F.struct("k", "value")).alias("_e")
    )
    key_ddl = ", ".join(f"{k} {present.schema[k].dataType.simpleString()}" for k in keys)
    return present.mapInArrow(
        _scatter_segments(keys, block_size, n_blocks, last_len, fill),
        f"{key_ddl}, block_id int, values array<float>",
    )


def join_variable_group_segments(
    grid_vars: DataFrame, layout: DataFrame, block_size: int, fill: float
) -> tuple[DataFrame, DataFrame]:
    """J5 at full size: variable groups joined back on the record.

    ``grid_vars`` holds ``(record_name, var, dims, fill, values)`` of all
    groups; ``layout`` carries ``group_id`` per variable. A group is present
    for a record when it has any of the group's variables; inside a present
    group, absent variables are all ``fill``. Returns ``(segments, report)``:
    segments of the records present in every group, and one report row per
    record with the sorted ids of the groups it lacks. Presence is a small
    per-record aggregate; no whole vectors are joined.
    """
    from gridframe.operators.index import broadcast_if_small

    var_groups = layout.select("var", "group_id").distinct()
    by_group: dict[int, list[str]] = {}
    for r in var_groups.collect():  # metadata: one row per variable
        by_group.setdefault(int(r["group_id"]), []).append(r["var"])
    group_ids = sorted(by_group)
    spans = variable_spans(layout)
    tagged = grid_vars.join(F.broadcast(var_groups), "var")
    have = tagged.groupBy("record_name", "group_id").agg(F.collect_set("var").alias("_have"))
    group_vars = F.create_map(*[x for g in group_ids for x in (F.lit(g), F.array(*[F.lit(v) for v in sorted(by_group[g])]))])
    absent = have.select(
        "record_name", F.explode(F.array_except(group_vars[F.col("group_id")], F.col("_have"))).alias("var")
    ).join(F.broadcast(spans.select("var", "length")), "var").select(
        "record_name", "var", F.array_repeat(F.lit(fill).cast("float"), F.col("length").cast("int")).alias("values")
    )
    present = have.groupBy("record_name").agg(F.collect_set("group_id").alias("_groups"))
    all_ids = F.array(*[F.lit(g) for g in group_ids])
    report = present.select(
        "record_name", F.array_sort(F.array_except(all_ids, F.col("_groups"))).alias("missing_groups")
    )
    complete = report.where(F.size("missing_groups") == 0).select("record_name")
    variables = tagged.select("record_name", "var", "values").unionByName(absent)
    variables = variables.join(broadcast_if_small(complete), "record_name", "left_semi")
    return to_record_segments(variables, layout, block_size), report


def project_variables(grid_vars: DataFrame, variables: list[str]) -> DataFrame:
    """Keep the named variables (a pushed ``IN`` filter on a stored
    table); their order in the vector comes from the layout, not this list."""
    return grid_vars.where(F.col("var").isin(list(variables)))
