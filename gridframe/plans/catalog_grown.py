"""Catalogue, fourth part: rows of A that grow by columns (M2, S8, W1) and stores compared
by fingerprints (V2, G7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridframe.operators import fingerprints, matrix, timeaxis
from gridframe.plans import fixtures as fx
from gridframe.plans.catalog import _EMB, BLOCK, _long_a, _transpose_oracle, query
from gridframe.session import scratch_path
from gridframe.sources import growing, store


# Three appends, a compaction between them, merged on read ------------------
@query("transpose_append", _transpose_oracle())
def q_transpose_append(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    names = timeaxis.column_names(vec, order="name")
    third = -(-names.count() // 3)
    path = scratch_path(spark, "grown")
    growing.create(spark, path, 64, BLOCK, row_parts=4)
    for i in range(3):
        mine = names.where((F.col("col_idx") / third).cast("int") == i)
        growing.append(spark, path, matrix.segment(vec.join(mine, "record_name", "left_semi"), BLOCK),
                       mine.withColumn("col_idx", F.col("col_idx") - i * third))
        if i == 1:
            growing.compact(spark, path)
    return _long_a(growing.read(spark, path))


# Two stores and their prints; values of unequal blocks only ----------------------
@query("fingerprint_compare", f"""
WITH {_EMB},
o AS (SELECT c.record_name, c.pos // {BLOCK} AS block, c.value AS a, e.vec_id,
             CASE WHEN e.vec_id % 9 = 0 AND c.pos >= 48 THEN NULL
                  WHEN e.vec_id % 5 = 0 AND c.pos = e.vec_id % 64 THEN CAST(c.value + CAST(1 AS FLOAT) AS FLOAT) ELSE c.value END AS b
      FROM c JOIN e USING (record_name)),
k AS (SELECT record_name, block FROM o GROUP BY 1, 2 HAVING bool_or(b IS NULL OR a <> b))
SELECT record_name, count(*) AS n_a, count(b) AS n_b, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch,
       coalesce(sqrt(sum((CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) * (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)))), 0) AS l2
FROM o JOIN k USING (record_name, block) GROUP BY record_name
""")
def q_fingerprint_compare(spark, sf_dir):
    vec = fx.embedding_vectors(spark, sf_dir)
    i = F.substring("record_name", 2, 8).cast("long")
    one = F.lit(1).cast("float")
    changed = F.transform("values", lambda v, k: F.when((i % 5 == 0) & (k == i % 64), (v + one).cast("float")).otherwise(v))
    theirs = matrix.segment(vec.select("record_name", changed.alias("values")), BLOCK).where(~((i % 9 == 0) & (F.col("block_id") >= 48 // BLOCK)))
    stored = []
    for label, seg in (("ours", matrix.segment(vec, BLOCK)), ("theirs", theirs)):
        path = scratch_path(spark, label)
        store.write_segments(seg, f"{path}/segments", chunk_col=None)
        kept = store.read_segments(spark, f"{path}/segments")
        fingerprints.write_prints(fingerprints.block_prints(kept, buckets=16), f"{path}/prints")
        stored.append((kept, f"{path}/prints"))
    (a, pa), (b, pb) = stored
    return fingerprints.compare_printed(a, b, pa, pb)
