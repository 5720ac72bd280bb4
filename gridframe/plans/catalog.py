"""Query catalogue: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the driver tables (``sf_dir``) and returns a DataFrame in
long form with explicitly typed, aliased columns, so the oracle SQL (tables
pre-registered as views) can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions.names import archive_name_for
from gridframe.operators import grid, matrix, timeaxis
from gridframe.operators.index import partitions_for
from gridframe.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Small blocks so the test tables span several segments and tiles.
BLOCK = 16
RECORDS_PER_TILE = 128


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return register


# Shared oracle fragments -----------------------------------------------------
_EMB = """
e AS (SELECT 'r' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS record_name, vec_id, label, embedding
      FROM embeddings),
n AS (SELECT record_name, row_number() OVER (ORDER BY record_name) - 1 AS col_idx FROM e),
c AS (SELECT record_name, unnest(embedding) AS value,
             unnest(generate_series(0, len(embedding) - 1)) AS pos FROM e)
"""

_EV = """
ev AS (SELECT strftime(date_trunc('hour', ts), 'pgbh02.gdas.%Y%m%d%H.grb2') AS record_name,
              date_trunc('hour', ts) AS hour, ts, event_type AS var,
              CAST(minute(ts) // 10 AS INTEGER) AS bin, value FROM events),
vars AS (SELECT var, row_number() OVER (ORDER BY var) - 1 AS var_pos FROM (SELECT DISTINCT var FROM ev)),
per_bin AS (SELECT record_name, var, bin, CAST(round(sum(value), 2) AS FLOAT) AS total,
                   CAST(count(*) AS FLOAT) AS cnt FROM ev GROUP BY record_name, var, bin),
recs AS (SELECT DISTINCT record_name FROM ev),
slots AS (SELECT r.record_name, v.var, v.var_pos, l.level, b.bin
          FROM recs r, vars v, range(2) l(level), range(6) b(bin)),
vec AS (SELECT s.record_name, s.var, s.var_pos, s.level, s.bin,
               CAST((s.var_pos * 2 + s.level) * 6 + s.bin AS BIGINT) AS pos,
               coalesce(CASE WHEN s.level = 0 THEN p.total ELSE p.cnt END, CAST(1e20 AS FLOAT)) AS value
        FROM slots s LEFT JOIN per_bin p
          ON p.record_name = s.record_name AND p.var = s.var AND p.bin = s.bin)
"""


def _transpose_oracle() -> str:
    return f"""
WITH {_EMB}
SELECT CAST(c.pos AS BIGINT) AS row_idx, CAST(n.col_idx AS BIGINT) AS col_idx,
       CAST(c.value AS DOUBLE) AS value
FROM c JOIN n USING (record_name)
"""


def _long_a(rows: DataFrame) -> DataFrame:
    return matrix.to_long(rows).select(
        F.col("row_idx").cast("long"), F.col("col_idx").cast("long"), F.col("value").cast("double")
    )


def _embedding_names(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    return vec, timeaxis.column_names(vec, order="name")


# M1 ------------------------------------------------------------------------
@query("transpose_sql", _transpose_oracle())
def q_transpose_sql(spark, sf_dir):
    vec, names = _embedding_names(spark, sf_dir)
    return _long_a(matrix.transpose_sql(matrix.segment(vec, BLOCK), names, BLOCK))


# M2 (one tile of records per cell block, no merge needed) --------------------
@query("transpose_blocked", _transpose_oracle())
def q_transpose_blocked(spark, sf_dir):
    vec, names = _embedding_names(spark, sf_dir)
    # a tile budget of 4 cells x all records: segments are cut into sub-blocks
    n_records = names.count()
    return _long_a(matrix.transpose(matrix.segment(vec, BLOCK), names, BLOCK, n_cells=64, max_tile_bytes=16 * n_records))


# M2 + M3 (several record blocks, merged on row index) ------------------------
@query("chunk_transpose_merge", _transpose_oracle())
def q_chunk_transpose_merge(spark, sf_dir):
    vec, names = _embedding_names(spark, sf_dir)
    chunks = matrix.transpose_blocked(matrix.segment(vec, BLOCK), names, BLOCK, RECORDS_PER_TILE, n_cells=64)
    return _long_a(matrix.merge_column_chunks(chunks))


# W1, O1 --------------------------------------------------------------------
@query("column_names_index", f"""
WITH {_EMB}
SELECT CAST(col_idx AS BIGINT) AS col_idx, record_name FROM n
""")
def q_column_names_index(spark, sf_dir):
    _, names = _embedding_names(spark, sf_dir)
    return names.select("col_idx", "record_name")


# F1, F4 --------------------------------------------------------------------
@query("record_name_to_ts", f"""
WITH {_EV}
SELECT record_name,
       epoch_ms(strptime(record_name, 'pgbh02.gdas.%Y%m%d%H.grb2')) AS ts_ms,
       regexp_replace(record_name, '\\.grb2$', '.nc') AS nc_name
FROM recs
""")
def q_record_name_to_ts(spark, sf_dir):
    recs = fx.event_hours(spark, sf_dir).select("record_name").distinct()
    return timeaxis.parse_record_time(recs).select("record_name", "ts_ms", "nc_name")


# O2, W1 --------------------------------------------------------------------
@query("chronological_index", f"""
WITH {_EV}
SELECT CAST(row_number() OVER (ORDER BY epoch_ms(strptime(record_name, 'pgbh02.gdas.%Y%m%d%H.grb2')),
                                        record_name) - 1 AS BIGINT) AS col_idx,
       record_name,
       epoch_ms(strptime(record_name, 'pgbh02.gdas.%Y%m%d%H.grb2')) AS ts_ms
FROM recs
""")
def q_chronological_index(spark, sf_dir):
    recs = fx.event_hours(spark, sf_dir).select("record_name")
    names = timeaxis.column_names(recs, order="time")
    return names.select("col_idx", "record_name", F.unix_millis("ts").alias("ts_ms"))


# W2 ------------------------------------------------------------------------
@query("time_gaps", f"""
WITH {_EV},
present AS (SELECT DISTINCT var, hour FROM ev),
bounds AS (SELECT var, min(hour) AS lo, max(hour) AS hi FROM present GROUP BY var),
cal AS (SELECT var, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM bounds)
SELECT cal.var AS var, strftime(cal.hour, 'pgbh02.gdas.%Y%m%d%H.grb2') AS missing_record
FROM cal ANTI JOIN present USING (var, hour)
""")
def q_time_gaps(spark, sf_dir):
    ev = fx.event_hours(spark, sf_dir)
    gaps = timeaxis.time_gaps(ev, "ts", step_hours=1, by=["var"])
    return gaps.select("var", fx.record_name_for("slot").alias("missing_record"))


# F5, P2, G2 ----------------------------------------------------------------
@query("archive_period", f"""
WITH {_EV},
hrs AS (SELECT DISTINCT hour FROM ev),
p AS (SELECT hour, CAST(least((day(hour) - 1) // 5, 5) AS INTEGER) AS period FROM hrs),
a AS (SELECT 'pgbh02.gdas.' || strftime(make_date(year(hour), month(hour), period * 5 + 1), '%Y%m%d') || '-' ||
             strftime(CASE WHEN period = 5 THEN last_day(hour)
                           ELSE make_date(year(hour), month(hour), period * 5 + 5) END, '%Y%m%d') || '.tar'
             AS archive_name FROM p)
SELECT archive_name,
       strftime(strptime(substr(archive_name, 13, 8), '%Y%m%d'), '%Y-%m-%d') AS first_day,
       strftime(strptime(substr(archive_name, 22, 8), '%Y%m%d'), '%Y-%m-%d') AS last_day,
       count(*) AS n_records
FROM a GROUP BY archive_name
""")
def q_archive_period(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    arch = timeaxis.archive_periods(ev, "ts")
    return arch.where(F.col("archive_name").endswith(".tar")).select(
        "archive_name",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
        "n_records",
    )


# W3 ------------------------------------------------------------------------
@query("layout_offsets", """
WITH vars AS (SELECT event_type AS var, row_number() OVER (ORDER BY event_type) - 1 AS var_pos
              FROM (SELECT DISTINCT event_type FROM events))
SELECT var, CAST(var_pos AS INTEGER) AS var_pos, CAST(l.level AS INTEGER) AS level,
       2 AS n_lat, 3 AS n_lon, CAST((var_pos * 2 + l.level) * 6 AS BIGINT) AS "offset",
       CAST(6 AS BIGINT) AS length, CAST((var_pos * 12) // 24 AS INTEGER) AS group_id
FROM vars, range(2) l(level)
""")
def q_layout_offsets(spark, sf_dir):
    return fx.event_layout(spark, sf_dir, max_group_length=24)


# A1-A3 ---------------------------------------------------------------------
@query("record_vectors", f"""
WITH {_EV}
SELECT record_name, pos, CAST(value AS DOUBLE) AS value FROM vec
""")
def q_record_vectors(spark, sf_dir):
    layout = fx.event_layout(spark, sf_dir)
    gv = grid.fill_missing_variables(fx.event_grid_vars(spark, sf_dir), layout, fx.FILL)
    seg = grid.to_record_segments(gv, layout, BLOCK)
    return seg.select(
        "record_name", "block_id", F.posexplode("values").alias("k", "value")
    ).select(
        "record_name",
        (F.col("block_id").cast("long") * BLOCK + F.col("k")).alias("pos"),
        F.col("value").cast("double").alias("value"),
    )


# ---------------------------------------------------------------------------
# Grid views of the embeddings
# ---------------------------------------------------------------------------
def _cells_out(cells: DataFrame) -> DataFrame:
    return cells.select(
        "record_name", "var", F.col("level").cast("int"), F.col("i").cast("int"), F.col("j").cast("int"),
        F.col("value").cast("double").alias("value"),
    )


@query("unflatten_2d", f"""
WITH {_EMB}
SELECT record_name, 'emb' AS var, 0 AS level, CAST(pos // 8 AS INTEGER) AS i, CAST(pos % 8 AS INTEGER) AS j,
       CAST(value AS DOUBLE) AS value
FROM c
""")
def q_unflatten_2d(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    return _cells_out(grid.unflatten_2d(vec, 8, 8, var="emb"))


@query("unflatten_3d", f"""
WITH {_EMB}
SELECT record_name, 'emb' AS var, CAST(pos // 16 AS INTEGER) AS level, CAST((pos % 16) // 4 AS INTEGER) AS i,
       CAST(pos % 4 AS INTEGER) AS j, CAST(value AS DOUBLE) AS value
FROM c
""")
def q_unflatten_3d(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    return _cells_out(grid.unflatten_3d(vec, 4, 4, 4, var="emb"))


@query("permute_axes", f"""
WITH {_EMB}
SELECT record_name, CAST(pos % 4 AS INTEGER) AS k, CAST(pos // 4 AS INTEGER) AS cell, CAST(value AS DOUBLE) AS value
FROM c
""")
def q_permute_axes(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    rows = grid.permute_axes(vec, depth=4)
    return rows.select("record_name", "k", F.posexplode("values").alias("cell", "value")).select(
        "record_name", "k", F.col("cell").cast("int"), F.col("value").cast("double")
    )


@query("level_slice", f"""
WITH {_EMB}
SELECT record_name, CAST((pos - 16) // 4 AS INTEGER) AS i, CAST(pos % 4 AS INTEGER) AS j,
       CAST(value AS DOUBLE) AS value
FROM c WHERE pos // 16 = 1
""")
def q_level_slice(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    lvl = grid.level_slice(vec, level=1, n_lat=4, n_lon=4)
    return lvl.select("record_name", F.posexplode("values").alias("p", "value")).select(
        "record_name", (F.col("p") / 4).cast("int").alias("i"), (F.col("p") % 4).cast("int").alias("j"),
        F.col("value").cast("double"),
    )


@query("column_range", f"""
WITH {_EMB}
SELECT record_name, CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value FROM c WHERE pos >= 20 AND pos < 36
""")
def q_column_range(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    part = grid.column_range(vec, 20, 36)
    return part.select("record_name", F.posexplode("values").alias("p", "value")).select(
        "record_name", (F.col("p") + 20).cast("long").alias("pos"), F.col("value").cast("double")
    )


# ---------------------------------------------------------------------------
# Missing data on the event grids
# ---------------------------------------------------------------------------
def _event_segments(spark, sf_dir):
    layout = fx.event_layout(spark, sf_dir)
    gv = grid.fill_missing_variables(fx.event_grid_vars(spark, sf_dir), layout, fx.FILL)
    return layout, grid.to_record_segments(gv, layout, BLOCK)


@query("missing_mask", f"""
WITH {_EV}
SELECT record_name, pos, value = CAST(1e20 AS FLOAT) AS is_missing FROM vec
""")
def q_missing_mask(spark, sf_dir):
    _, seg = _event_segments(spark, sf_dir)
    masked = seg.select("record_name", "block_id", grid.mask_equal("values", fx.FILL).alias("mask"))
    return masked.select("record_name", "block_id", F.posexplode("mask").alias("k", "is_missing")).select(
        "record_name", (F.col("block_id").cast("long") * BLOCK + F.col("k")).alias("pos"), "is_missing"
    )


@query("missing_census", f"""
WITH {_EV}
SELECT var, CAST(level AS INTEGER) AS level, CAST(bin // 3 AS INTEGER) AS i, CAST(bin % 3 AS INTEGER) AS j,
       CAST(sum(CASE WHEN value = CAST(1e20 AS FLOAT) THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       count(*) AS n_records
FROM vec GROUP BY var, level, bin
""")
def q_missing_census(spark, sf_dir):
    layout, seg = _event_segments(spark, sf_dir)
    return grid.missing_census_segments(seg, layout, BLOCK, fx.FILL)


@query("missing_any", f"""
WITH {_EV}
SELECT record_name, var, bool_or(value = CAST(1e20 AS FLOAT)) AS any_missing,
       CAST(sum(CASE WHEN value = CAST(1e20 AS FLOAT) THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM vec GROUP BY record_name, var
""")
def q_missing_any(spark, sf_dir):
    layout, seg = _event_segments(spark, sf_dir)
    return grid.missing_any_segments(seg, layout, BLOCK, fx.FILL)


# ---------------------------------------------------------------------------
# J5 variable groups joined back on the record
# ---------------------------------------------------------------------------
GROUP_CELLS = 24


@query("variable_group_join", f"""
WITH {_EV},
grp AS (SELECT var, (var_pos * 12) // {GROUP_CELLS} AS g FROM vars),
pres AS (SELECT DISTINCT ev.record_name, grp.g FROM ev JOIN grp USING (var)),
allg AS (SELECT r.record_name, g.g FROM recs r, (SELECT DISTINCT g FROM grp) g),
miss AS (SELECT a.record_name,
                string_agg(CAST(a.g AS VARCHAR), ',' ORDER BY a.g) FILTER (WHERE p.g IS NULL) AS missing
         FROM allg a LEFT JOIN pres p USING (record_name, g) GROUP BY a.record_name),
tot AS (SELECT record_name, sum(CAST(value AS DOUBLE)) FILTER (WHERE value <> CAST(1e20 AS FLOAT)) AS total
        FROM vec GROUP BY record_name)
SELECT m.record_name, coalesce(m.missing, '') AS missing_groups,
       CAST(CASE WHEN m.missing IS NULL THEN (SELECT count(*) * 12 FROM vars) ELSE 0 END AS BIGINT) AS n_values,
       CASE WHEN m.missing IS NULL THEN round(t.total, 2) + 0.0 END AS total
FROM miss m JOIN tot t USING (record_name)
""")
def q_variable_group_join(spark, sf_dir):
    layout = fx.event_layout(spark, sf_dir, max_group_length=GROUP_CELLS)
    seg, report = grid.join_variable_group_segments(fx.event_grid_vars(spark, sf_dir), layout, BLOCK, fx.FILL)
    fill = F.lit(fx.FILL).cast("float")
    present = F.filter("values", lambda v: v != fill)
    sums = seg.groupBy("record_name").agg(
        F.sum(F.size("values")).cast("long").alias("n_values"),
        F.sum(F.aggregate(present, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))).alias("_t"),
    )
    return report.join(sums, "record_name", "left").select(
        "record_name",
        F.array_join(F.transform("missing_groups", lambda g: g.cast("string")), ",").alias("missing_groups"),
        F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"),
        (F.round("_t", 2) + F.lit(0.0)).alias("total"),
    )


# ---------------------------------------------------------------------------
# Store: chunked writes, union, counts, lookups, semi / anti joins
# ---------------------------------------------------------------------------
N_CHUNKS = 4


def _stored_embeddings(spark, sf_dir):
    """Write the embedding segments as a chunked store and read it back."""
    from gridframe.session import scratch_path
    from gridframe.sources import store

    vec = fx.embedding_vectors(spark, sf_dir)
    seg = matrix.segment(vec.withColumn("chunk_id", (F.col("vec_id") % N_CHUNKS).cast("int")), BLOCK,
                         keys=("record_name", "chunk_id"))
    path = scratch_path(spark, "embeddings-at")
    store.write_segments(seg, path)
    return store.read_segments(spark, path)


@query("chunk_union", f"""
WITH {_EMB}
SELECT CAST(e.vec_id % 4 AS INTEGER) AS chunk_id, c.record_name, CAST(c.pos AS BIGINT) AS pos,
       CAST(c.value AS DOUBLE) AS value
FROM c JOIN e USING (record_name)
""")
def q_chunk_union(spark, sf_dir):
    from gridframe.sources import store

    seg = _stored_embeddings(spark, sf_dir)
    return store.export_record_long(seg, BLOCK, keep=("chunk_id",)).select("chunk_id", "record_name", "pos", F.col("value").cast("double"))


@query("chunk_counts", """
SELECT CAST(vec_id % 4 AS INTEGER) AS chunk_id, count(*) AS n_records,
       CAST(sum(ceil(len(embedding) / 16)) AS BIGINT) AS n_segments
FROM embeddings GROUP BY 1
""")
def q_chunk_counts(spark, sf_dir):
    seg = _stored_embeddings(spark, sf_dir)
    return seg.groupBy("chunk_id").agg(
        F.countDistinct("record_name").alias("n_records"), F.count(F.lit(1)).alias("n_segments")
    )


@query("record_lookup", f"""
WITH {_EMB}
SELECT record_name, CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value
FROM c WHERE record_name = (SELECT min(record_name) FROM e)
""")
def q_record_lookup(spark, sf_dir):
    from gridframe.sources import store

    seg = _stored_embeddings(spark, sf_dir)
    first = seg.agg(F.min("record_name")).first()[0]
    found = store.lookup_record(seg, first)
    return store.export_record_long(found, BLOCK).select("record_name", "pos", F.col("value").cast("double"))


@query("record_semi_join", f"""
WITH {_EV}
SELECT record_name, pos, CAST(value AS DOUBLE) AS value FROM vec
WHERE record_name IN (SELECT record_name FROM ev WHERE var = 'purchase')
""")
def q_record_semi_join(spark, sf_dir):
    from gridframe.sources import store

    _, seg = _event_segments(spark, sf_dir)
    wanted = fx.event_hours(spark, sf_dir).where(F.col("var") == "purchase")
    picked = store.semi_join_records(seg, wanted)
    return store.export_record_long(picked, BLOCK).select("record_name", "pos", F.col("value").cast("double"))


_MANIFEST_SQL = """
hrs AS (SELECT DISTINCT hour, record_name FROM ev),
p AS (SELECT hour, record_name, CAST(least((day(hour) - 1) // 5, 5) AS INTEGER) AS period FROM hrs),
man AS (SELECT '/archives/pgbh02.gdas.' || strftime(make_date(year(hour), month(hour), period * 5 + 1), '%Y%m%d')
               || '-' || strftime(CASE WHEN period = 5 THEN last_day(hour)
                                       ELSE make_date(year(hour), month(hour), period * 5 + 5) END, '%Y%m%d')
               || '.tar' AS archive_path, record_name, hour FROM p),
manifest AS (SELECT archive_path,
                    CAST(row_number() OVER (PARTITION BY archive_path ORDER BY hour) - 1 AS INTEGER) AS entry_idx,
                    record_name FROM man)
"""


def _event_manifest(spark, sf_dir):
    from gridframe.sources import archives

    hours = fx.event_hours(spark, sf_dir).select("hour", "record_name").distinct()
    return archives.manifest_from_times(hours, "/archives", "hour")


@query("resume_anti_join", f"""
WITH {_EV}, {_MANIFEST_SQL}
SELECT archive_path, entry_idx, record_name FROM manifest
WHERE record_name NOT IN (SELECT record_name FROM ev WHERE var = 'purchase')
""")
def q_resume_anti_join(spark, sf_dir):
    from gridframe.sources import store

    manifest = _event_manifest(spark, sf_dir)
    done = fx.event_hours(spark, sf_dir).where(F.col("var") == "purchase").select("record_name").distinct()
    ingested = manifest.join(done, "record_name", "left_semi")
    return store.pending_entries(manifest, ingested).select("archive_path", "entry_idx", "record_name")


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------
@query("vector_length_check", f"""
WITH {_EV},
v AS (SELECT record_name, count(*) AS length FROM ev GROUP BY record_name)
SELECT record_name, length, (SELECT max(length) FROM v) AS expected, length = (SELECT max(length) FROM v) AS is_ok
FROM v
""")
def q_vector_length_check(spark, sf_dir):
    from gridframe.operators import verify

    # ragged records: an hour's event values
    lengths = fx.event_hours(spark, sf_dir).groupBy("record_name").agg(F.count("*").alias("length"))
    return verify.check_lengths(lengths).select("record_name", "length", "expected", "is_ok")


@query("duplicate_names", f"""
WITH {_EV}
SELECT record_name, count(*) AS n_copies FROM ev GROUP BY record_name HAVING count(*) > 1
""")
def q_duplicate_names(spark, sf_dir):
    from gridframe.operators import verify

    return verify.duplicate_names(fx.event_hours(spark, sf_dir))


# every tenth name takes its successor's index (a hole and a repeated index), and
# the last two of every hundred change places (out of order)
@query("order_check", f"""
WITH {_EV},
t AS (SELECT record_name, row_number() OVER (ORDER BY epoch_ms(strptime(record_name, 'pgbh02.gdas.%Y%m%d%H.grb2')), record_name) - 1 AS i FROM recs),
nm AS (SELECT record_name, CASE WHEN i % 10 = 4 THEN i + 1 WHEN i % 100 = 98 THEN i + 1 WHEN i % 100 = 99 THEN i - 1 ELSE i END AS col_idx FROM t),
pairs AS (SELECT n.*, p.record_name AS prev FROM nm n LEFT JOIN nm p ON p.col_idx + 1 = n.col_idx)
SELECT count(*) AS n, count(DISTINCT col_idx) AS n_distinct, min(col_idx) AS min_idx, max(col_idx) AS max_idx,
       CAST(sum(CASE WHEN prev > record_name THEN 1 ELSE 0 END) AS BIGINT) AS n_out_of_order,
       CAST(sum(CASE WHEN prev IS NULL AND col_idx > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_holes
FROM pairs
""")
def q_order_check(spark, sf_dir):
    from gridframe.operators import verify

    names = timeaxis.column_names(fx.event_hours(spark, sf_dir), order="time")
    i = F.col("col_idx")
    moved = F.when((i % 10 == 4) | (i % 100 == 98), i + 1).when(i % 100 == 99, i - 1).otherwise(i)
    return verify.check_order(names.withColumn("col_idx", moved))


# the other side differs in one cell of every fifth record and lacks the last block of every ninth
@query("compare_norm", f"""
WITH {_EMB},
o AS (SELECT c.record_name, c.pos, c.value AS a, e.vec_id,
             CASE WHEN e.vec_id % 9 = 0 AND c.pos >= 48 THEN NULL
                  WHEN e.vec_id % 5 = 0 AND c.pos = e.vec_id % 64 THEN CAST(c.value + CAST(1 AS FLOAT) AS FLOAT) ELSE c.value END AS b
      FROM c JOIN e USING (record_name))
SELECT record_name, count(*) AS n_a, count(b) AS n_b, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch,
       coalesce(sqrt(sum((CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) * (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)))), 0) AS l2
FROM o GROUP BY record_name
""")
def q_compare_norm(spark, sf_dir):
    from gridframe.operators import verify

    vec = fx.embedding_vectors(spark, sf_dir)
    # independent path: 3-D cells, re-flattened and re-assembled
    cells = grid.flatten_cells(grid.unflatten_3d(vec, 4, 4, 4), 4, 4)
    rebuilt = cells.groupBy("record_name").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_p")
    ).select("record_name", F.transform("_p", lambda s: s["value"]).alias("values"))
    i = F.substring("record_name", 2, 8).cast("long")
    one = F.lit(1).cast("float")
    changed = F.transform("values", lambda v, k: F.when((i % 5 == 0) & (k == i % 64), (v + one).cast("float")).otherwise(v))
    other = rebuilt.select("record_name", changed.alias("values"))
    theirs = matrix.segment(other, BLOCK).where(~((i % 9 == 0) & (F.col("block_id") >= 48 // BLOCK)))
    return verify.compare_segments(matrix.segment(vec, BLOCK), theirs)


# ---------------------------------------------------------------------------
# Products (M5-M7, P10)
# ---------------------------------------------------------------------------
@query("matvec", f"""
WITH {_EMB},
x AS (SELECT pos, avg(CAST(value AS DOUBLE)) AS xv FROM c GROUP BY pos)
SELECT record_name, round(sum(CAST(value AS DOUBLE) * xv), 6) + 0.0 AS value FROM c JOIN x USING (pos) GROUP BY record_name
""")
def q_matvec(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    seg = matrix.segment(vec, BLOCK)
    x = matrix.column_means(seg, BLOCK)
    out = matrix.matvec(seg, x, BLOCK)
    return out.select("record_name", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("matvec_transpose", f"""
WITH {_EMB}
SELECT CAST(pos AS BIGINT) AS row_idx, round(sum(CAST(value AS DOUBLE) * label), 6) + 0.0 AS value
FROM c JOIN e USING (record_name) GROUP BY pos
""")
def q_matvec_transpose(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    seg = matrix.segment(vec, BLOCK)
    y = vec.select("record_name", F.col("label").cast("double").alias("y"))
    out = matrix.matvec_transpose(seg, y, BLOCK)
    return out.select("row_idx", (F.round("value", 6) + F.lit(0.0)).alias("value"))


# ---------------------------------------------------------------------------
# Ingest (S1-S5, S13, S14, G2): the embeddings written as NetCDF grids in
# tar archives (100 records per archive), then listed, decoded and
# vectorised back through the same layout.
# ---------------------------------------------------------------------------
RECORDS_PER_ARCHIVE = 100


def _embedding_grid_layout(spark):
    variables = spark.createDataFrame(
        [("emb2d", 0, 1, 4, 8), ("emb3d", 1, 2, 4, 4)], "var string, var_pos int, n_levels int, n_lat int, n_lon int"
    )
    return grid.layout_offsets(variables)


def _written_archives(spark, sf_dir):
    """Write the archives and their list file; return (list path, root)."""
    from gridframe.session import scratch_path
    from gridframe.sources import archives

    root = scratch_path(spark, "archives")
    vec = fx.embedding_vectors(spark, sf_dir).select(
        F.concat(F.lit("emb-"), F.lpad((F.col("vec_id") / RECORDS_PER_ARCHIVE).cast("long").cast("string"), 6, "0"),
                 F.lit(".tar")).alias("archive_name"),
        "record_name", "values",
    )
    spec = [("emb2d", 0, 32, (4, 8)), ("emb3d", 32, 32, (2, 4, 4))]
    listing = f"{root}-list"
    archives.write_grid_archives(vec, root, spec).select("archive_name").write.text(listing)
    return listing, root


def _ingested(spark, sf_dir):
    from gridframe.sources import archives

    listing, root = _written_archives(spark, sf_dir)
    paths = archives.tar_only(archives.archive_paths(archives.read_archive_list(spark, listing), root))
    manifest = archives.expand_archives(paths)
    decoded = archives.decode_entries(manifest, _embedding_grid_layout(spark), BLOCK)
    return manifest, decoded


@query("ingest_archive", f"""
WITH {_EMB}
SELECT record_name, CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value FROM c
""")
def q_ingest_archive(spark, sf_dir):
    from gridframe.sources import archives, store

    _, decoded = _ingested(spark, sf_dir)
    good, _ = archives.split_quarantine(decoded)
    return store.export_record_long(good, BLOCK).select("record_name", "pos", F.col("value").cast("double"))


@query("archive_counts", f"""
SELECT 'emb-' || lpad(CAST(vec_id // {RECORDS_PER_ARCHIVE} AS VARCHAR), 6, '0') || '.tar' AS archive_name,
       count(*) AS n_entries
FROM embeddings GROUP BY 1
""")
def q_archive_counts(spark, sf_dir):
    manifest, _ = _ingested(spark, sf_dir)
    return manifest.groupBy(F.element_at(F.split("archive_path", "/"), -1).alias("archive_name")).agg(
        F.count(F.lit(1)).alias("n_entries")
    )


# ---------------------------------------------------------------------------
# The daily part matrix from lineitem: records = ship days, cells = parts,
# value = quantity shipped, absent = fill. It grows with the scale factor
# (2,499 x 20,000 = 50M cells at sf0.1) and drives the benchmark.
# ---------------------------------------------------------------------------
DAILY_BLOCK = 1024
# Segments of a record that are put together in one row on the way to an archive.
DAILY_PIECE = 64

_DAILY = """
d AS (SELECT strftime(date_trunc('day', l_shipdate), 'pgbh02.gdas.%Y%m%d00.grb2') AS record_name,
             l_partkey AS pos, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
dn AS (SELECT record_name, row_number() OVER (ORDER BY record_name) - 1 AS col_idx
       FROM (SELECT DISTINCT record_name FROM d)),
ds AS (SELECT pos, count(*) AS n_present, sum(q) AS total, sum(q * (col_idx + 1)) AS weighted
       FROM d JOIN dn USING (record_name) GROUP BY pos)
"""

_DAILY_A_ORACLE = f"""
WITH {_DAILY}
SELECT CAST(p.p_partkey AS BIGINT) AS row_idx, (SELECT count(*) FROM dn) AS n_values,
       coalesce(ds.n_present, 0) AS n_present, CAST(coalesce(ds.total, 0) AS DOUBLE) AS total,
       CAST(coalesce(ds.weighted, 0) AS DOUBLE) AS weighted
FROM part p LEFT JOIN ds ON ds.pos = p.p_partkey
"""


def daily_parts(spark, sf_dir) -> int:
    """Partitions for the dense daily matrix: its shuffled fill compresses so well that
    sizes measured at run time would put very much of it into one task."""
    n_days = fx.table(spark, sf_dir, "lineitem").select(F.date_trunc("day", F.col("l_shipdate"))).distinct().count()
    return partitions_for(spark, 4.0 * n_days * fx.part_count(spark, sf_dir))


def daily_segments(spark, sf_dir):
    n_cells = fx.part_count(spark, sf_dir)
    return grid.cells_to_segments(fx.daily_cells(spark, sf_dir), n_cells, DAILY_BLOCK, fx.FILL,
                                  partitions=daily_parts(spark, sf_dir))


def daily_names(spark, sf_dir):
    """Column names of the daily matrix, from the distinct ship days."""
    days = fx.table(spark, sf_dir, "lineitem").select(F.date_trunc("day", F.col("l_shipdate")).alias("day")).distinct()
    return timeaxis.column_names(days.select(fx.record_name_for("day").alias("record_name")), order="time")


def _a_summary(rows: DataFrame) -> DataFrame:
    fill = F.lit(fx.FILL).cast("float")
    present = F.filter("values", lambda v: v != fill)
    weighted = F.transform("values", lambda v, i: F.when(v != fill, v.cast("double") * (i + 1)).otherwise(0.0))
    return rows.select(
        F.col("row_idx").cast("long"),
        F.size("values").cast("long").alias("n_values"),
        F.size(present).cast("long").alias("n_present"),
        F.aggregate(present, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double")).alias("total"),
        F.aggregate(weighted, F.lit(0.0).cast("double"), lambda a, v: a + v).alias("weighted"),
    )


@query("daily_matrix", f"""
WITH {_DAILY}
SELECT record_name, CAST((SELECT max(p_partkey) + 1 FROM part) AS BIGINT) AS n_values,
       count(*) AS n_present, CAST(sum(q) AS DOUBLE) AS total
FROM d GROUP BY record_name
""")
def q_daily_matrix(spark, sf_dir):
    seg = daily_segments(spark, sf_dir)
    fill = F.lit(fx.FILL).cast("float")
    present = F.filter("values", lambda v: v != fill)
    return seg.groupBy("record_name").agg(
        F.sum(F.size("values")).cast("long").alias("n_values"),
        F.sum(F.size(present)).cast("long").alias("n_present"),
        F.sum(F.aggregate(present, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))).alias("total"),
    )


@query("daily_transpose_blocked", _DAILY_A_ORACLE)
def q_daily_transpose_blocked(spark, sf_dir):
    seg = daily_segments(spark, sf_dir)
    return _a_summary(matrix.transpose(seg, daily_names(spark, sf_dir), DAILY_BLOCK, n_cells=fx.part_count(spark, sf_dir)))


@query("daily_transpose_sql", _DAILY_A_ORACLE)
def q_daily_transpose_sql(spark, sf_dir):
    seg = daily_segments(spark, sf_dir)
    return _a_summary(matrix.transpose_sql(seg, daily_names(spark, sf_dir), DAILY_BLOCK, fill=fx.FILL, n_cells=fx.part_count(spark, sf_dir)))


@query("daily_matvec", f"""
WITH {_DAILY}
SELECT record_name, round(sum(q * p_retailprice), 2) + 0.0 AS value FROM d JOIN part ON d.pos = part.p_partkey
GROUP BY record_name
""")
def q_daily_matvec(spark, sf_dir):
    n_cells = fx.part_count(spark, sf_dir)
    seg = daily_segments(spark, sf_dir)
    price = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("value"))
    x = matrix.vector_from_cells(price, n_cells, DAILY_BLOCK)
    out = matrix.matvec(seg, x, DAILY_BLOCK, fill=fx.FILL)
    return out.select("record_name", (F.round("value", 2) + F.lit(0.0)).alias("value"))


@query("daily_matvec_transpose", f"""
WITH {_DAILY},
y AS (SELECT strftime(date_trunc('day', l_shipdate), 'pgbh02.gdas.%Y%m%d00.grb2') AS record_name, count(*) AS y
      FROM lineitem GROUP BY 1),
s AS (SELECT pos, sum(q * y) AS value FROM d JOIN y USING (record_name) GROUP BY pos)
SELECT CAST(p.p_partkey AS BIGINT) AS row_idx, round(CAST(coalesce(s.value, 0) AS DOUBLE), 2) + 0.0 AS value
FROM part p LEFT JOIN s ON s.pos = p.p_partkey
""")
def q_daily_matvec_transpose(spark, sf_dir):
    seg = daily_segments(spark, sf_dir)
    li = fx.table(spark, sf_dir, "lineitem")
    y = li.groupBy(fx.record_name_for(F.date_trunc("day", "l_shipdate")).alias("record_name")).agg(
        F.count(F.lit(1)).cast("double").alias("y")
    )
    out = matrix.matvec_transpose(seg, y, DAILY_BLOCK, fill=fx.FILL)
    return out.select("row_idx", (F.round("value", 2) + F.lit(0.0)).alias("value"))


# M5 ------------------------------------------------------------------------
@query("indexed_row_matrix", f"""
WITH {_EV}
SELECT CAST(n.col_idx AS BIGINT) AS "row", v.pos AS pos, CAST(v.value AS DOUBLE) AS value
FROM vec v JOIN (SELECT record_name,
                        row_number() OVER (ORDER BY epoch_ms(strptime(record_name, 'pgbh02.gdas.%Y%m%d%H.grb2'))) - 1
                        AS col_idx FROM recs) n USING (record_name)
""")
def q_indexed_row_matrix(spark, sf_dir):
    _, seg = _event_segments(spark, sf_dir)
    names = timeaxis.column_names(fx.event_hours(spark, sf_dir).select("record_name"), order="time")
    rows = matrix.indexed_rows(seg, names)
    return rows.select("row", "block_id", F.posexplode("values").alias("k", "value")).select(
        F.col("row").cast("long"), (F.col("block_id").cast("long") * BLOCK + F.col("k")).alias("pos"), "value"
    )


# A9, G6 at the source ---------------------------------------------------------
@query("ingest_describe", f"""
WITH {_EMB}
SELECT e.record_name, v.var, v.dims, CAST(1e20 AS FLOAT) AS fill, CAST(v.n AS BIGINT) AS n_cells,
       CAST(0 AS BIGINT) AS n_missing
FROM e, (VALUES ('emb2d', '4x8', 32), ('emb3d', '2x4x4', 32)) v(var, dims, n)
""")
def q_ingest_describe(spark, sf_dir):
    from gridframe.sources import archives

    manifest, _ = _ingested(spark, sf_dir)
    d = archives.describe_entries(manifest, ["emb2d", "emb3d"])
    return d.select(
        "record_name", "var",
        F.array_join(F.transform("dims", lambda x: x.cast("string")), "x").alias("dims"),
        "fill", "n_cells", "n_missing",
    )


# S1-S5, S13 at a larger record size: the daily matrix written as one tar per
# 5-day archive period (NetCDF grid per day), then listed and decoded -----------
def _daily_grid_shape(n_cells: int) -> tuple[int, int]:
    return 1, n_cells  # one row of parts, at every scale


@query("daily_ingest", ORACLE_SQL["daily_matrix"])
def q_daily_ingest(spark, sf_dir):
    from gridframe.session import scratch_path
    from gridframe.sources import archives, store

    n_cells = fx.part_count(spark, sf_dir)
    n_lat, n_lon = _daily_grid_shape(n_cells)
    seg, parts = daily_segments(spark, sf_dir), daily_parts(spark, sf_dir)
    root = scratch_path(spark, "daily-archives")
    # one group per archive period (at most six days), records in pieces of a fixed size
    pieces = matrix.unsegment(
        seg.withColumn("piece", (F.col("block_id") / DAILY_PIECE).cast("int")), ("record_name", "piece"), partitions=parts
    ).select(
        "record_name", "piece", "values",
        F.regexp_extract("record_name", r"(\d{8})00", 1).alias("_day"),
    ).select(
        "record_name", "piece", "values",
        archive_name_for(F.to_timestamp("_day", "yyyyMMdd")).alias("archive_name"),
    )
    listing = f"{root}-list"
    archives.write_grid_archives(pieces, root, [("qty", 0, n_cells, (n_lat, n_lon))], piece_col="piece", partitions=parts).select(
        "archive_name"
    ).write.text(listing)
    variables = spark.createDataFrame([("qty", 0, 1, n_lat, n_lon)],
                                      "var string, var_pos int, n_levels int, n_lat int, n_lon int")
    manifest = archives.expand_archives(archives.archive_paths(archives.read_archive_list(spark, listing), root))
    good, _ = archives.split_quarantine(
        archives.decode_entries(manifest, grid.layout_offsets(variables), DAILY_BLOCK)
    )
    fill = F.lit(fx.FILL).cast("float")
    present = F.filter("values", lambda v: v != fill)
    return good.groupBy("record_name").agg(
        F.sum(F.size("values")).cast("long").alias("n_values"),
        F.sum(F.size(present)).cast("long").alias("n_present"),
        F.sum(F.aggregate(present, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))).alias("total"),
    )


# S15, P6 at the source: level 1 of the 3-D variable, read from the archives ----
@query("ingest_level_slice", f"""
WITH {_EMB}
SELECT record_name, CAST((pos - 48) // 4 AS INTEGER) AS i, CAST(pos % 4 AS INTEGER) AS j,
       CAST(value AS DOUBLE) AS value
FROM c WHERE pos >= 48
""")
def q_ingest_level_slice(spark, sf_dir):
    from gridframe.sources import archives

    manifest, _ = _ingested(spark, sf_dir)
    plane = archives.read_variable(manifest, "emb3d", level=1).where(F.col("reason").isNull())
    return plane.select("record_name", F.posexplode("values").alias("p", "value")).select(
        "record_name", (F.col("p") / 4).cast("int").alias("i"), (F.col("p") % 4).cast("int").alias("j"),
        F.col("value").cast("double"),
    )


from gridframe.plans import catalog_store  # noqa: E402, F401  (registers its queries)
