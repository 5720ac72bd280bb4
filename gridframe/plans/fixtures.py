"""Gridded records derived from the driver tables.

* ``embeddings`` as ``A^T``: record ``r`` + 8-digit ``vec_id``, vector =
  ``embedding`` (64 floats; seen as 8x8 in 2-D, 4x4x4 in 3-D, or 16x4).
* ``events`` as 6-hourly-style gridded records, one per hour: variable =
  ``event_type`` (sorted), a 3-D grid of 2 levels x 2 x 3 cells. The six
  cells are the ten-minute bins of the hour (i = bin div 3, j = bin mod 3);
  level 0 is the rounded sum of ``value``, level 1 the event count. A bin
  with no event is missing and holds the fill value; a type with no event in
  the hour is a missing variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions.arrays import dense_from_entries
from gridframe.functions.names import record_name_for
from gridframe.operators.grid import layout_offsets

# Fill value of the derived grids (stored as float).
FILL = 1e20
EVENT_LEVELS = 2
EVENT_LAT = 2
EVENT_LON = 3
EVENT_CELLS = EVENT_LEVELS * EVENT_LAT * EVENT_LON


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_record_name(vec_id) -> F.Column:
    return F.concat(F.lit("r"), F.lpad(F.col(vec_id).cast("string"), 8, "0"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_name, values, vec_id, label)``: the embeddings as ``A^T``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        embedding_record_name("vec_id").alias("record_name"),
        F.col("embedding").alias("values"),
        "vec_id",
        "label",
    )


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hourly record name and ten-minute bin."""
    ev = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts"))
    return ev.select(
        record_name_for(hour).alias("record_name"),
        hour.alias("hour"),
        "ts",
        F.col("event_type").alias("var"),
        (F.minute("ts") / 10).cast("int").alias("bin"),
        "value",
    )


def event_layout(spark: SparkSession, sf_dir: str, max_group_length: int | None = None) -> DataFrame:
    """Layout of the event records: one 2x2x3 variable per event type."""
    # the variable list is metadata: one name per event type
    types = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    variables = spark.createDataFrame(
        [(t, pos, EVENT_LEVELS, EVENT_LAT, EVENT_LON) for pos, t in enumerate(types)],
        "var string, var_pos int, n_levels int, n_lat int, n_lon int",
    )
    return layout_offsets(variables, max_group_length)


def event_grid_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 rows ``(record_name, var, dims, fill, values)`` for present
    (hour, type) pairs; absent bins hold the fill value."""
    per_bin = event_hours(spark, sf_dir).groupBy("record_name", "var", "bin").agg(
        F.round(F.sum("value"), 2).cast("float").alias("total"),
        F.count(F.lit(1)).cast("float").alias("n"),
    )
    entries = per_bin.select(
        "record_name", "var",
        F.struct(F.col("bin").alias("k"), F.col("total").alias("value")).alias("e0"),
        F.struct((F.col("bin") + EVENT_LAT * EVENT_LON).alias("k"), F.col("n").alias("value")).alias("e1"),
    )
    grouped = entries.groupBy("record_name", "var").agg(F.flatten(F.collect_list(F.array("e0", "e1"))).alias("_e"))
    return grouped.select(
        "record_name", "var",
        F.array(*[F.lit(d) for d in (EVENT_LEVELS, EVENT_LAT, EVENT_LON)]).alias("dims"),
        F.lit(FILL).cast("float").alias("fill"),
        dense_from_entries("_e", EVENT_CELLS, FILL).alias("values"),
    )


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as daily records: cell = part key, value = total quantity
    shipped that day (sparse; absent = fill)."""
    li = table(spark, sf_dir, "lineitem")
    per_day = li.groupBy(F.date_trunc("day", F.col("l_shipdate")).alias("day"), F.col("l_partkey").alias("pos")).agg(
        F.sum("l_quantity").alias("value")
    )
    return per_day.select(record_name_for("day").alias("record_name"), "pos", "value")


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """Cells per daily record: one per part (keys are dense from 0)."""
    return int(table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]) + 1
