"""Validation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.operators.index import broadcast_if_small
from gridframe.session import ship_package


def check_lengths(vectors: DataFrame, expected: int | None = None) -> DataFrame:
    """Per record its vector length and whether it matches.

    Accepts vectors or precomputed ``(record_name, length)`` rows.
    ``expected`` defaults to the longest vector seen (a global max, a
    one-row aggregate) instead of the first row's length."""
    if "length" in vectors.columns:
        sized = vectors.select("record_name", F.col("length").cast("long").alias("length"))
    else:
        sized = vectors.select("record_name", F.size("values").cast("long").alias("length"))
    if expected is None:
        expected = sized.agg(F.max("length")).first()[0] or 0
    sized = sized.withColumn("expected", F.lit(int(expected)).cast("long"))
    return sized.withColumn("is_ok", F.col("length") == F.col("expected"))


def length_summary(vectors: DataFrame) -> DataFrame:
    """``(n_records, min_length, max_length)`` of a vector table."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(F.size("values")).alias("min_length"),
        F.max(F.size("values")).alias("max_length"),
    )


def duplicate_names(records: DataFrame, name_col: str = "record_name") -> DataFrame:
    """Q5: record names that occur more than once, with their count."""
    return records.groupBy(F.col(name_col).alias("record_name")).agg(
        F.count(F.lit(1)).alias("n_copies")
    ).where(F.col("n_copies") > 1)


def split_valid(vectors: DataFrame, expected: int) -> tuple[DataFrame, DataFrame]:
    """Q5/Q6: (valid vectors, quarantine rows) before a transpose."""
    # copies are counted with a combining aggregate (a hot name stays cheap)
    # and only the duplicated names, after a size check, are joined back
    dups = duplicate_names(vectors).select("record_name", F.col("n_copies").alias("_copies"))
    counted = vectors.join(broadcast_if_small(dups), "record_name", "left")
    reason = (
        F.when(F.col("_copies").isNotNull(), F.lit("duplicate record name"))
        .when(F.size("values") != expected, F.concat(F.lit("length "), F.size("values").cast("string")))
    )
    tagged = counted.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).drop("_copies", "_reason")
    bad = tagged.where(F.col("_reason").isNotNull()).select(
        F.lit(None).cast("string").alias("archive_path"),
        F.lit(None).cast("int").alias("entry_idx"),
        "record_name",
        F.col("_reason").alias("reason"),
    )
    return good, bad


def check_order(names: DataFrame) -> DataFrame:
    """V1: is ``col_idx`` dense from 0 and increasing with (ts, name)?

    Neighbours are paired with an equi-join on ``col_idx - 1`` (distributed)
    rather than a window over the whole table."""
    prev = names.select(
        (F.col("col_idx") + 1).alias("col_idx"), F.col("ts").alias("_pts"), F.col("record_name").alias("_pname")
    )
    pairs = names.join(prev, "col_idx", "left")
    pts, ts, pname, name = F.col("_pts"), F.col("ts"), F.col("_pname"), F.col("record_name")
    # (ts, name) order with null times last, as column_names sorts
    prev_after = (
        F.when(pts.isNull() & ts.isNull(), pname > name)
        .when(pts.isNull(), F.lit(True))
        .when(ts.isNull(), F.lit(False))
        .otherwise((pts > ts) | ((pts == ts) & (pname > name)))
    )
    out_of_order = F.when(pname.isNotNull() & prev_after, 1).otherwise(0)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("col_idx").alias("n_distinct"),
        F.min("col_idx").alias("min_idx"),
        F.max("col_idx").alias("max_idx"),
        F.sum(out_of_order).cast("long").alias("n_out_of_order"),
        F.sum(F.when(pname.isNull() & (F.col("col_idx") > 0), 1).otherwise(0)).cast("long").alias("n_holes"),
    )


def _differences(tol: float):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            a, b = batch.column("_a"), batch.column("_b")
            na, nb = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            fa, fb = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (a, b))
            both = np.minimum(na, nb)
            row = np.repeat(np.arange(len(both)), both)
            k = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
            u, v = fa[(np.cumsum(na) - na)[row] + k], fb[(np.cumsum(nb) - nb)[row] + k]
            # NaN equals NaN (Q13); NaN against a number is a mismatch
            d = np.where((u == v) | (np.isnan(u) & np.isnan(v)), 0.0, u - v)
            wrong = ~(np.abs(d) <= tol)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_name"), pa.array(na), pa.array(nb), pa.array(np.bincount(row[wrong], minlength=len(both)).astype(np.int64)),
                 pa.array(np.bincount(row, d * d, minlength=len(both)).astype(np.float64))], names=["record_name", "na", "nb", "m", "s"])

    return run


def compare_segments(a: DataFrame, b: DataFrame, tol: float = 0.0) -> DataFrame:
    """Per record, compare two segment tables block by block.

    Full outer join on ``(record_name, block_id)``; the arrays are compared in
    numpy, so no cell becomes a row. Cells present on one side only are
    counted (``n_a``, ``n_b``); ``l2`` is the norm of the difference over
    shared cells."""
    ship_package(a.sparkSession)
    left = a.select("record_name", "block_id", F.col("values").cast("array<double>").alias("_a"))
    right = b.select("record_name", "block_id", F.col("values").cast("array<double>").alias("_b"))
    parts = left.join(right, ["record_name", "block_id"], "full_outer").select("record_name", "_a", "_b").mapInArrow(
        _differences(tol), "record_name string, na long, nb long, m long, s double")
    return parts.groupBy("record_name").agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum("m").alias("n_mismatch"), F.sqrt(F.sum("s")).alias("l2"))


def compare_vectors(a: DataFrame, b: DataFrame, tol: float = 0.0, block_size: int = 1024) -> DataFrame:
    """V2/G7 for tables of whole vectors ``(record_name, values)``: cut into segments
    and compared block by block."""
    from gridframe.operators.matrix import segment

    return compare_segments(segment(a, block_size), segment(b, block_size), tol)


class ValidationError(ValueError):
    """A matrix invariant does not hold; the message carries the counts."""


def require_uniform_length(vectors: DataFrame) -> int:
    """All vectors have one length (min == max); returns it or raises."""
    row = length_summary(vectors).first()
    if row["n_records"] and row["min_length"] != row["max_length"]:
        raise ValidationError(
            f"{row['n_records']} vectors with lengths {row['min_length']}..{row['max_length']}"
        )
    return int(row["max_length"] or 0)


def require_order(names: DataFrame) -> None:
    """V1: ``col_idx`` is 0..n-1 without holes and follows (ts, name);
    raises with the counts otherwise."""
    r = check_order(names).first()
    ok = (r["n"] == r["n_distinct"] and (r["n"] == 0 or (r["min_idx"] == 0 and r["max_idx"] == r["n"] - 1))
          and r["n_out_of_order"] == 0 and r["n_holes"] == 0)
    if not ok:
        raise ValidationError(
            f"column order: n={r['n']} distinct={r['n_distinct']} range={r['min_idx']}..{r['max_idx']} "
            f"out_of_order={r['n_out_of_order']} holes={r['n_holes']}"
        )


def segment_completeness(segments: DataFrame, n_cells: int, block_size: int) -> DataFrame:
    """Q5/Q6 on segmented vectors: records whose segments do not make one
    ``n_cells`` vector (missing, repeated or short segments).

    Counts per record use only ``record_name`` and ``block_id`` (the value
    column is not read); lengths are read for the last block only (a pushed
    filter that skips row groups on block-sorted files). Inner segments are
    length-checked by the tile transpose itself, which also checks each tile
    exactly. Returns ``(record_name, n_segments, last_length, reason)`` for
    the bad records only."""
    expected_blocks = -(-n_cells // block_size)
    last_block = expected_blocks - 1
    last_len = n_cells - last_block * block_size
    # combinable aggregates only (one partial row per record and partition);
    # a distinct count would shuffle every (record, block) pair
    counts = segments.groupBy("record_name").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.min("block_id").alias("_lo"),
        F.max("block_id").alias("_hi"),
        F.sum(F.col("block_id").cast("long")).alias("_sum"),
        # with count, sum and ends these tell 0,2,2,2,4 from 0,1,2,3,4
        F.bit_xor(F.xxhash64("block_id")).alias("_xor"),
        F.sum(F.col("block_id").cast("decimal(20,0)") * F.col("block_id")).alias("_squares"),
    )
    tails = segments.where(F.col("block_id") == last_block).groupBy("record_name").agg(
        F.max(F.size("values")).alias("last_length")
    )
    per_record = counts.join(tails, "record_name", "left")
    expected_sum = expected_blocks * (expected_blocks - 1) // 2
    expected_squares = (expected_blocks - 1) * expected_blocks * (2 * expected_blocks - 1) // 6
    expected_xor = segments.sparkSession.range(expected_blocks).agg(
        F.bit_xor(F.xxhash64(F.col("id").cast("int")))).first()[0]
    reason = (
        F.when(F.col("n_segments") > expected_blocks, F.lit("repeated segments (duplicate record name)"))
        .when(F.col("n_segments") < expected_blocks, F.concat(F.lit("blocks "), F.col("n_segments").cast("string")))
        .when((F.col("_lo") != 0) | (F.col("_hi") != last_block) | (F.col("_sum") != expected_sum)
              | (F.col("_squares") != F.lit(expected_squares).cast("decimal(38,0)")) | (F.col("_xor") != expected_xor),
              F.lit("block ids inconsistent"))
        .when(F.col("last_length") != last_len, F.concat(F.lit("last block length "), F.col("last_length").cast("string")))
    )
    return per_record.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "record_name", "n_segments", "last_length", "reason"
    )


def record_differences(segments: DataFrame, names: DataFrame) -> DataFrame:
    """``(record_name, why)`` of stored records without a name and of names
    without a stored record."""
    stored = segments.where(F.col("block_id") == 0).select("record_name").distinct()
    unnamed = stored.join(names, "record_name", "left_anti").select("record_name", F.lit("has no name").alias("why"))
    absent = names.select("record_name").distinct().join(stored, "record_name", "left_anti").select(
        "record_name", F.lit("is not stored").alias("why"))
    return unnamed.union(absent)


def require_same_records(segments: DataFrame, names: DataFrame, examples: int = 5) -> None:
    """The name table and the stored records are the same set (both ways);
    raises with counts and examples, since a transpose would otherwise lose
    records that have no name, or lack those that are only named."""
    wrong = record_differences(segments, names)
    sample = wrong.limit(examples).collect()
    if sample:
        listed = ", ".join(f"{r['record_name']} {r['why']}" for r in sample)
        raise ValidationError(f"names and stored records differ in {wrong.count()} records, e.g. {listed}")


def require_complete(segments: DataFrame, n_cells: int, block_size: int, examples: int = 5) -> None:
    """Raise with counts and a few record names unless every record's
    segments form one full vector (run before a transpose)."""
    bad = segment_completeness(segments, n_cells, block_size)
    sample = bad.select("record_name", "reason").limit(examples).collect()
    if sample:
        total = bad.count()
        listed = ", ".join(f"{r['record_name']} ({r['reason']})" for r in sample)
        raise ValidationError(f"{total} records with incomplete segments, e.g. {listed}")
