"""Catalogue, third part: repaired archives (S3, S14), extents (S15, P6), variable
groups (W3), runs of missing times (W2, V3), missing cells as sets (G5) and the
projection of variables (P1)."""

from __future__ import annotations

import tarfile

import pyarrow as pa
from pyspark.sql import functions as F

from gridframe.operators import grid, missing, timeaxis
from gridframe.plans import fixtures as fx
from gridframe.plans.catalog import (
    _EMB,
    _EV,
    BLOCK,
    RECORDS_PER_ARCHIVE,
    _embedding_grid_layout,
    _event_segments,
    _written_archives,
    query,
)
from gridframe.plans.catalog_store import DAMAGED, _damaged_archives
from gridframe.session import scratch_path
from gridframe.sources import archives, extents, ingest_log

# entries that a replaced archive keeps
SHORTENED = 10


def _mend(batches):
    """Of four archives in turn: one is replaced by its first entries, a cut one and an
    absent one get their whole content, one stays damaged."""
    for batch in batches:
        for source, target, n in zip(*(batch.column(c).to_pylist() for c in ("source", "target", "n"))):
            if n % 4 == 2:
                continue
            with archives._open(source) as fh:
                raw = fh.read()
            if n % 4 == 0:
                with archives._open(source) as fh, tarfile.open(fileobj=fh, mode="r:") as tar:
                    members = tar.getmembers()
                if len(members) > SHORTENED:
                    raw = raw[:members[SHORTENED].offset] + bytes(2 * tarfile.BLOCKSIZE)
            with archives._output(target) as out:
                out.write(raw)
        yield pa.RecordBatch.from_pydict({"target": batch.column("target")})


# Converted, mended, replaced, partly forgotten, converted again -------------
@query("convert_repair", f"""
WITH {_EMB},
d AS (SELECT 'emb-' || lpad(CAST(vec_id // {RECORDS_PER_ARCHIVE} AS VARCHAR), 6, '0') || '.tar' AS archive_name,
             vec_id // {RECORDS_PER_ARCHIVE} AS a, vec_id % {RECORDS_PER_ARCHIVE} AS i FROM e)
SELECT CASE WHEN a % 4 = 2 AND i = {DAMAGED} THEN 'quarantine' ELSE 'ok' END AS status, archive_name, count(*) AS n_entries
FROM d WHERE NOT (a % 4 = 0 AND i >= {SHORTENED}) AND a % 8 <> 5
GROUP BY 1, 2
""")
def q_convert_repair(spark, sf_dir):
    from gridframe.plans import jobs

    names, root = _damaged_archives(spark, sf_dir)
    _, whole = _written_archives(spark, sf_dir)
    out, listing = scratch_path(spark, "repaired"), scratch_path(spark, "lists")
    names.write.text(listing)
    layout = _embedding_grid_layout(spark)
    jobs.convert(spark, root, listing, layout, out, BLOCK, archives_per_chunk=2)
    n = F.regexp_extract("archive_name", r"(\d+)", 1).cast("int")
    plan = names.select(F.concat(F.lit(f"{whole}/"), "archive_name").alias("source"), F.concat(F.lit(f"{root}/"), "archive_name").alias("target"), n.alias("n"))
    plan.mapInArrow(_mend, "target string").write.format("noop").mode("overwrite").save()
    jobs.convert(spark, root, listing, layout, out, BLOCK, archives_per_chunk=2)
    ingest_log.forget(spark, names.where(n % 8 == 5), root, out)
    done = jobs.entries_done(spark, f"{out}/decoded")
    return done.groupBy("status", F.element_at(F.split("archive_path", "/"), -1).alias("archive_name")).agg(F.count(F.lit(1)).alias("n_entries"))


# Planes by their own bytes ---------------------------------------------------
@query("extent_planes", f"""
WITH {_EMB}
SELECT record_name, CAST((pos - 32) // 16 AS INTEGER) AS level, CAST((pos % 16) // 4 AS INTEGER) AS i, CAST(pos % 4 AS INTEGER) AS j,
       CAST(value AS DOUBLE) AS value
FROM c WHERE pos >= 32
""")
def q_extent_planes(spark, sf_dir):
    listing, root = _written_archives(spark, sf_dir)
    manifest = archives.expand_archives(archives.archive_paths(archives.read_archive_list(spark, listing), root))
    found = extents.read_planes(extents.extent_index(manifest).where("var = 'emb3d'"))
    return found.select("record_name", "level", "dims", F.posexplode("values").alias("p", "value")).select(
        "record_name", "level", (F.col("p") / F.col("dims")[1]).cast("int").alias("i"), (F.col("p") % F.col("dims")[1]).cast("int").alias("j"),
        F.col("value").cast("double"))


# Next-fit groups, large variables split by level -----------------------------------
GROUP_CELLS = 40


@query("layout_groups", f"""
WITH RECURSIVE v AS (
    SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS var, s_suppkey AS var_pos, 1 + s_suppkey % 5 AS d, (1 + s_nationkey % 4) * 3 AS plane
    FROM supplier
), units AS (
    SELECT var, var_pos, -1 AS level, d * plane AS cells FROM v WHERE d * plane <= {GROUP_CELLS}
    UNION ALL SELECT var, var_pos, l.level, plane FROM v, range(5) l(level) WHERE d * plane > {GROUP_CELLS} AND l.level < d
), o AS (SELECT *, row_number() OVER (ORDER BY var_pos, level) AS n FROM units
), f AS (
    SELECT n, 0 AS g, cells AS used FROM o WHERE n = 1
    UNION ALL
    SELECT o.n, CASE WHEN f.used + o.cells > {GROUP_CELLS} THEN f.g + 1 ELSE f.g END,
           CASE WHEN f.used + o.cells > {GROUP_CELLS} THEN o.cells ELSE f.used + o.cells END
    FROM f JOIN o ON o.n = f.n + 1
)
SELECT v.var, CAST(l.level AS INTEGER) AS level, CAST(f.g AS INTEGER) AS group_id
FROM v JOIN range(5) l(level) ON l.level < v.d
JOIN o ON o.var = v.var AND (o.level = -1 OR o.level = l.level) JOIN f USING (n)
""")
def q_layout_groups(spark, sf_dir):
    s = fx.table(spark, sf_dir, "supplier")
    variables = s.select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("var"), F.col("s_suppkey").cast("int").alias("var_pos"),
                         (1 + F.col("s_suppkey") % 5).cast("int").alias("n_levels"), (1 + F.col("s_nationkey") % 4).cast("int").alias("n_lat"),
                         F.lit(3).alias("n_lon"))
    return grid.layout_offsets(variables, GROUP_CELLS).select("var", "level", "group_id")


# Gaps as islands ----------------------------------------------------------------
@query("time_gap_runs", f"""
WITH {_EV},
present AS (SELECT DISTINCT var, hour FROM ev),
bounds AS (SELECT var, min(hour) AS lo, max(hour) AS hi FROM present GROUP BY var),
cal AS (SELECT var, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM bounds),
gone AS (SELECT cal.var AS var, cal.hour AS hour FROM cal ANTI JOIN present USING (var, hour)),
island AS (SELECT var, hour, epoch_ms(hour) // 3600000 - row_number() OVER (PARTITION BY var ORDER BY hour) AS k FROM gone)
SELECT var, strftime(min(hour), 'pgbh02.gdas.%Y%m%d%H.grb2') AS first_missing,
       strftime(max(hour), 'pgbh02.gdas.%Y%m%d%H.grb2') AS last_missing, count(*) AS n_missing
FROM island GROUP BY var, k
""")
def q_time_gap_runs(spark, sf_dir):
    runs = timeaxis.time_gap_runs(fx.event_hours(spark, sf_dir), "ts", step_hours=1, by=["var"])
    return runs.select("var", fx.record_name_for("first_missing").alias("first_missing"), fx.record_name_for("last_missing").alias("last_missing"), "n_missing")


# Cells ever, always, sometimes missing; masks that records share -----------------------
@query("missing_patterns", f"""
WITH {_EV},
m AS (SELECT record_name, var, level, bin, value = CAST(1e20 AS FLOAT) AS gone FROM vec),
cells AS (SELECT var, level, bin, count(*) AS n, sum(CAST(gone AS INTEGER)) AS k FROM m GROUP BY var, level, bin),
sets AS (SELECT var, level, count(*) AS n_cells, sum(CAST(k > 0 AS INTEGER)) AS n_ever, sum(CAST(k = n AS INTEGER)) AS n_always
         FROM cells GROUP BY var, level),
masks AS (SELECT record_name, var, level, string_agg(CASE WHEN gone THEN '1' ELSE '0' END, '' ORDER BY bin) AS mask FROM m GROUP BY record_name, var, level),
counted AS (SELECT var, level, mask, count(*) AS n FROM masks GROUP BY var, level, mask),
shared AS (SELECT var, level, count(*) AS n_masks, max(n) AS n_shared FROM counted GROUP BY var, level)
SELECT var, CAST(level AS INTEGER) AS level, n_cells, CAST(n_ever AS BIGINT) AS n_ever, CAST(n_always AS BIGINT) AS n_always,
       CAST(n_ever - n_always AS BIGINT) AS n_sometimes, n_masks, n_shared
FROM sets JOIN shared USING (var, level)
""")
def q_missing_patterns(spark, sf_dir):
    layout, seg = _event_segments(spark, sf_dir)
    return missing.missing_patterns(seg, layout, BLOCK, fx.FILL)


# P1 ---------------------------------------------------------------------------------------
@query("projected_variables", f"""
WITH {_EV}
SELECT record_name, var, CAST(level * 6 + bin AS INTEGER) AS k, CAST(value AS DOUBLE) AS value FROM vec
WHERE var = 'purchase' AND record_name IN (SELECT record_name FROM ev WHERE var = 'purchase')
""")
def q_projected_variables(spark, sf_dir):
    chosen = grid.project_variables(fx.event_grid_vars(spark, sf_dir), ["purchase"])
    return chosen.select("record_name", "var", F.posexplode("values").alias("k", "value")).withColumn("value", F.col("value").cast("double"))


# The archives as a data source -------------------------------------------------------
@query("archive_source", f"""
WITH {_EMB}
SELECT record_name, CAST(pos % 16 AS INTEGER) AS k, CAST(value AS DOUBLE) AS value FROM c WHERE pos >= 48
""")
def q_archive_source(spark, sf_dir):
    from gridframe.sources import datasource

    listing, root = _written_archives(spark, sf_dir)
    datasource.register(spark)
    planes = spark.read.format("gridarchive").load(root).where("var = 'emb3d' AND level = 1")
    return planes.select("record_name", F.posexplode("values").alias("k", "value")).withColumn("value", F.col("value").cast("double"))
