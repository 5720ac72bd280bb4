"""Catalogue, second part: what is written and read back, and what must be caught.

Store writes (S8, S9, S11, S12), slices on the store (P6, P7), sparse vectors
(M6), damaged archives (S2, S14), resumed conversion (S3) and the checks a
transpose runs first (J1, V1, Q5).
"""

from __future__ import annotations

import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from gridframe.operators import grid, matrix, timeaxis, verify
from gridframe.plans import fixtures as fx
from gridframe.plans.catalog import (
    _EMB,
    BLOCK,
    RECORDS_PER_ARCHIVE,
    RECORDS_PER_TILE,
    _embedding_grid_layout,
    _long_a,
    _stored_embeddings,
    _transpose_oracle,
    _written_archives,
    query,
)
from gridframe.session import scratch_path
from gridframe.sources import archives, store


def _embedding_names(spark, sf_dir):
    return timeaxis.column_names(fx.embedding_vectors(spark, sf_dir).select("record_name"), order="name")


# S8 --------------------------------------------------------------------------
@query("stored_matrix", _transpose_oracle())
def q_stored_matrix(spark, sf_dir):
    seg = matrix.segment(fx.embedding_vectors(spark, sf_dir), BLOCK)
    path = scratch_path(spark, "matrix")
    store.write_matrix(matrix.transpose(seg, _embedding_names(spark, sf_dir), BLOCK, n_cells=64), path, n_rows=64)
    return _long_a(spark.read.parquet(path))


# Chunks of columns on disk, then merged from the store -----------------
@query("stored_column_chunks", _transpose_oracle())
def q_stored_column_chunks(spark, sf_dir):
    names = _embedding_names(spark, sf_dir)
    seg = matrix.segment(fx.embedding_vectors(spark, sf_dir), BLOCK)
    path = scratch_path(spark, "column-chunks")
    store.write_column_chunks(matrix.transpose_blocked(seg, names, BLOCK, RECORDS_PER_TILE, n_cells=64), path, n_rows=64)
    return _long_a(matrix.merge_column_chunks(spark.read.parquet(path), n_records=names.count()))


# S11 -------------------------------------------------------------------------
@query("stored_names", f"""
WITH {_EMB}
SELECT record_name, CAST(col_idx AS BIGINT) AS col_idx, record_name AS in_text FROM n
""")
def q_stored_names(spark, sf_dir):
    table, text = scratch_path(spark, "names"), scratch_path(spark, "names-text")
    store.write_names(_embedding_names(spark, sf_dir), table)
    store.export_names_text(spark.read.parquet(table), text)
    names = spark.read.parquet(table).select("record_name", F.col("col_idx").cast("long"))
    return names.join(spark.read.text(text).select(F.col("value").alias("in_text")), F.col("in_text") == F.col("record_name"), "left")


# S12 -------------------------------------------------------------------------
@query("stored_export", f"""
WITH {_EMB}
SELECT record_name, CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value FROM c
""")
def q_stored_export(spark, sf_dir):
    path = scratch_path(spark, "export")
    seg = _stored_embeddings(spark, sf_dir)
    store.write_record_export(seg, BLOCK, path, "parquet")
    return spark.read.parquet(path).select("record_name", "pos", F.col("value").cast("double"))


# P7 and P6 on the store: only the blocks of the range are read -------------------
@query("stored_column_range", f"""
WITH {_EMB}
SELECT record_name, CAST(pos AS BIGINT) AS pos, CAST(value AS DOUBLE) AS value FROM c WHERE pos BETWEEN 10 AND 41
""")
def q_stored_column_range(spark, sf_dir):
    return grid.segment_range(_stored_embeddings(spark, sf_dir), 10, 32, BLOCK).select("record_name", "pos", F.col("value").cast("double"))


@query("stored_level_slice", f"""
WITH {_EMB}
SELECT record_name, 'emb3d' AS var, 1 AS level, CAST((pos - 48) // 4 AS INTEGER) AS i, CAST(pos % 4 AS INTEGER) AS j,
       CAST(value AS DOUBLE) AS value
FROM c WHERE pos >= 48
""")
def q_stored_level_slice(spark, sf_dir):
    cells = grid.segment_level(_stored_embeddings(spark, sf_dir), _embedding_grid_layout(spark), "emb3d", 1, BLOCK)
    return cells.withColumn("value", F.col("value").cast("double"))


# M6 with a vector that has gaps, an empty last block and a default of its own ----
@query("matvec_sparse_x", f"""
WITH {_EMB},
x AS (SELECT p.pos, CASE WHEN p.pos % 3 <> 0 AND p.pos < 40 THEN p.pos / 10.0 ELSE 0.5 END AS xv FROM range(64) p(pos))
SELECT record_name, round(sum(CAST(value AS DOUBLE) * CAST(xv AS DOUBLE)), 6) + 0.0 AS value FROM c JOIN x USING (pos) GROUP BY record_name
""")
def q_matvec_sparse_x(spark, sf_dir):
    seg = matrix.segment(fx.embedding_vectors(spark, sf_dir), BLOCK)
    entries = spark.range(40).where("id % 3 <> 0").select(F.col("id").alias("pos"), (F.col("id") / 10).alias("value"))
    out = matrix.matvec(seg, matrix.vector_from_cells(entries, 64, BLOCK, default=0.5), BLOCK)
    return out.select("record_name", (F.round("value", 6) + F.lit(0.0)).alias("value"))


# what a transpose requires first -------------------------------------------------
@query("transpose_check", f"""
WITH {_EMB}
SELECT record_name, 'has no name' AS reason FROM e WHERE vec_id % 13 = 5
UNION ALL SELECT 'x' || record_name, 'is not stored' FROM e WHERE vec_id % 50 = 7
UNION ALL SELECT record_name, 'blocks 3' FROM e WHERE vec_id % 17 = 1
UNION ALL SELECT record_name, 'repeated segments (duplicate record name)' FROM e WHERE vec_id % 17 = 2
UNION ALL SELECT record_name, 'block ids inconsistent' FROM e WHERE vec_id % 17 = 3
UNION ALL SELECT record_name, 'last block length 15' FROM e WHERE vec_id % 17 = 4
""")
def q_transpose_check(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    names = _embedding_names(spark, sf_dir)
    i, b = F.substring("record_name", 2, 8).cast("long"), F.col("block_id")
    stale = names.where(i % 13 != 5).union(names.where(i % 50 == 7).withColumn("record_name", F.concat(F.lit("x"), "record_name")))
    seg = matrix.segment(vec, BLOCK)
    # of 17 records one lacks a block, one has one twice, one has block 1 in the place of block 2, and one a short end
    damaged = seg.where(~((i % 17 == 1) & (b == 2))).union(seg.where((i % 17 == 2) & (b == 1))).select(
        "record_name", F.when((i % 17 == 3) & (b == 2), 1).otherwise(b).alias("block_id"),
        F.when((i % 17 == 4) & (b == 3), F.slice("values", 1, 15)).otherwise(F.col("values")).alias("values"))
    return verify.record_differences(seg, stale).select("record_name", F.col("why").alias("reason")).union(
        verify.segment_completeness(damaged, 64, BLOCK).select("record_name", "reason"))


# Damaged archives ---------------------------------------------------------
CUT_AT, DAMAGED = 50, 7


def _damage(batches):
    """Copies of archives: of four in turn, one stays whole, one is cut inside the
    header of entry 50, one has an entry without its magic, one is not written."""
    for batch in batches:
        for source, target, n in zip(*(batch.column(c).to_pylist() for c in ("source", "target", "n"))):
            if n % 4 == 3:
                continue
            with archives._open(source) as fh:
                raw = bytearray(fh.read())
            with archives._open(source) as fh, tarfile.open(fileobj=fh, mode="r:") as tar:
                members = tar.getmembers()
            if n % 4 == 1 and len(members) > CUT_AT:
                raw = raw[:members[CUT_AT].offset + 100]
            if n % 4 == 2 and len(members) > DAMAGED:
                at = members[DAMAGED].offset_data
                raw[at:at + 4] = b"none"
            with archives._output(target) as out:
                out.write(bytes(raw))
        yield pa.RecordBatch.from_pydict({"target": batch.column("target")})


def _damaged_archives(spark, sf_dir):
    listing, root = _written_archives(spark, sf_dir)
    target = scratch_path(spark, "damaged")
    n = F.regexp_extract("archive_name", r"(\d+)", 1).cast("int")
    names = archives.read_archive_list(spark, listing)
    plan = names.select(F.concat(F.lit(f"{root}/"), "archive_name").alias("source"), F.concat(F.lit(f"{target}/"), "archive_name").alias("target"), n.alias("n"))
    plan.mapInArrow(_damage, "target string").write.format("noop").mode("overwrite").save()
    return names, target


_DAMAGED_SQL = f"""
d AS (SELECT record_name, vec_id, 'emb-' || lpad(CAST(vec_id // {RECORDS_PER_ARCHIVE} AS VARCHAR), 6, '0') || '.tar' AS archive_name,
             vec_id // {RECORDS_PER_ARCHIVE} AS a, vec_id % {RECORDS_PER_ARCHIVE} AS i FROM e),
whole AS (SELECT archive_name, a, count(*) AS n FROM d GROUP BY 1, 2),
entries AS (
SELECT archive_name, record_name, CASE WHEN a % 4 = 2 AND i = {DAMAGED} THEN 'entry' ELSE 'ok' END AS kind FROM d
WHERE a % 4 <> 3 AND NOT (a % 4 = 1 AND i >= {CUT_AT})
UNION ALL SELECT archive_name, '', 'listing' FROM whole WHERE a % 4 = 1 AND n > {CUT_AT}
UNION ALL SELECT archive_name, '', 'unreadable' FROM whole WHERE a % 4 = 3)
"""


@query("ingest_quarantine", f"""
WITH {_EMB}, {_DAMAGED_SQL}
SELECT archive_name, record_name, kind FROM entries
""")
def q_ingest_quarantine(spark, sf_dir):
    names, root = _damaged_archives(spark, sf_dir)
    manifest = archives.expand_archives(archives.archive_paths(names, root))
    decoded = archives.decode_entries(manifest, _embedding_grid_layout(spark), BLOCK)
    kind = (F.when(F.col("reason").isNull(), "ok").when(F.col("reason").startswith("listing ends"), "listing")
            .when(F.col("reason").startswith("unreadable archive"), "unreadable").otherwise("entry"))
    return decoded.where(F.col("reason").isNotNull() | (F.col("block_id") == 0)).select(
        F.element_at(F.split("archive_path", "/"), -1).alias("archive_name"), F.coalesce("record_name", F.lit("")).alias("record_name"), kind.alias("kind"))


# S3: a list, the same list longer and with a repeated line, and once more -----------
@query("convert_resume", f"""
WITH {_EMB}, {_DAMAGED_SQL}
SELECT CASE WHEN kind = 'ok' THEN 'ok' ELSE 'quarantine' END AS status, archive_name, count(*) AS n_entries
FROM entries GROUP BY 1, 2
""")
def q_convert_resume(spark, sf_dir):
    from gridframe.plans import jobs

    names, root = _damaged_archives(spark, sf_dir)
    out, lists = scratch_path(spark, "resumed"), scratch_path(spark, "lists")
    names.where("archive_name < 'emb-000002'").write.text(f"{lists}/a")
    names.union(names.where("archive_name < 'emb-000002'")).write.text(f"{lists}/b")
    for listing in ("a", "b", "b"):
        jobs.convert(spark, root, f"{lists}/{listing}", _embedding_grid_layout(spark), out, BLOCK, archives_per_chunk=1)
    done = jobs.entries_done(spark, f"{out}/decoded")
    return done.groupBy("status", F.element_at(F.split("archive_path", "/"), -1).alias("archive_name")).agg(F.count(F.lit(1)).alias("n_entries"))


from gridframe.plans import catalog_grown, catalog_sets  # noqa: E402, F401  (register their queries)
