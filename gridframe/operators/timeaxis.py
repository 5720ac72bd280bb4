"""Time axis of the records: names, order, column indexes, gaps (F1, F5, O1,
O2, W1, W2, G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions.names import (  # noqa: F401  (record_name_for re-exported)
    archive_first_day,
    archive_last_day,
    archive_name_for,
    decoded_name,
    record_name_for,
    record_time,
    utc_wall_clock,
)
from gridframe.operators.index import dense_index
from gridframe.session import checkpoint_dir, ship_package


def parse_record_time(names: DataFrame, name_col: str = "record_name") -> DataFrame:
    """add ``ts`` (UTC), ``ts_ms`` and the decoded-file name.

    Names that do not match the whole pattern get null times (Q12)."""
    return names.select(
        "*",
        record_time(name_col).alias("ts"),
        F.unix_millis(record_time(name_col)).alias("ts_ms"),
        decoded_name(name_col).alias("nc_name"),
    )


def column_names(records: DataFrame, order: str = "time", name_col: str = "record_name") -> DataFrame:
    """Ordered column-name table ``(col_idx, record_name, ts)``.

    ``order="time"`` sorts by (ts, name) with unparsable names last;
    ``order="name"`` sorts lexicographically (equal to time order for the
    fixed-width names). The index is dense, 0-based and computed without
    funnelling the names through one task.
    """
    names = records.select(F.col(name_col).alias("record_name")).distinct()
    names = names.select("record_name", record_time("record_name").alias("ts"))
    if order == "time":
        keys = [F.col("ts").asc_nulls_last(), F.col("record_name")]
    elif order == "name":
        keys = [F.col("record_name")]
    else:
        raise ValueError(f"order must be 'time' or 'name', not {order!r}")
    return dense_index(names, keys, "col_idx").select("col_idx", "record_name", "ts")


def _slot(ts, step_hours: int):
    """The slot a wall-clock time lies in (its beginning)."""
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=(F.hour(ts) / int(step_hours)).cast("int") * int(step_hours))


def off_slot_records(stamps: DataFrame, ts_col: str = "ts", step_hours: int = 6) -> DataFrame:
    """Rows whose hour (records are named by it) begins no slot of the regular axis."""
    ts = utc_wall_clock(stamps, ts_col)
    return stamps.where(_slot(ts, step_hours) != F.date_trunc("hour", ts))


def time_gaps(
    stamps: DataFrame,
    ts_col: str = "ts",
    step_hours: int = 6,
    by: list | None = None,
) -> DataFrame:
    """Slots of a regular time axis with no record, per ``by`` group.

    Slots are UTC wall-clock (``timestamp_ntz``) for instants and wall-clock
    inputs alike. The calendar runs from the first to the last record of each group; it is
    generated in coarse windows of 1024 steps, then expanded, so no array
    longer than 1024 slots is built. Missing slots are a left anti join of
    the calendar against the slots present. A record that does not lie on a
    slot (09:00 on a 6-hour axis) fills none; ``off_slot_records`` lists it.
    """
    by = list(by or [])
    step = F.expr(f"INTERVAL {int(step_hours)} HOURS")
    coarse = F.expr(f"INTERVAL {int(step_hours) * 1024} HOURS")
    if 24 % int(step_hours):
        raise ValueError("step_hours must divide 24")
    ts, slot = utc_wall_clock(stamps, ts_col), _slot(utc_wall_clock(stamps, ts_col), step_hours)
    slots = stamps.select(*by, slot.alias("slot"), (slot == F.date_trunc("hour", ts)).alias("on_slot")).distinct()
    present = slots.where("on_slot").drop("on_slot")
    bounds = slots.groupBy(*by).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    windows = bounds.select(*by, "hi", F.explode(F.sequence("lo", "hi", coarse)).alias("w"))
    calendar = windows.select(
        *by,
        F.explode(
            F.sequence("w", F.least("hi", F.col("w") + coarse - step), step)
        ).alias("slot"),
    )
    return calendar.join(present, by + ["slot"], "left_anti")


def _runs_in_partition(by_types, step_hours: int):
    """Arrow kernel over sorted (by..., slot): gaps between neighbours inside the
    partition, and its first and last row (``edge`` 0 and 1)."""
    import numpy as np
    import pyarrow as pa

    n_by = len(by_types)

    def run(batches):
        last = first = part = None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_by)))) if n_by else [()] * batch.num_rows
            slots = batch.column(n_by).to_numpy()
            part = batch.column(n_by + 1)[0].as_py()
            if not batch.num_rows:
                continue
            rows = []
            if first is None:
                first = (keys[0], int(slots[0]))
            elif keys[0] == last[0] and slots[0] > last[1] + 1:
                rows.append((keys[0], last[1], int(slots[0])))
            for i in np.flatnonzero(np.diff(slots) != 1):
                if keys[i] == keys[i + 1] and slots[i + 1] > slots[i] + 1:
                    rows.append((keys[i], int(slots[i]), int(slots[i + 1])))
            last = (keys[-1], int(slots[-1]))
            yield emit([(*k, a, b, part, None) for k, a, b in rows])
        if first is not None:
            yield emit([(*first[0], first[1], first[1], part, 0), (*last[0], last[1], last[1], part, 1)])

    def emit(rows):
        types = [*by_types, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = [f"k{i}" for i in range(n_by)] + ["before", "after", "part", "edge"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def time_gap_runs(stamps: DataFrame, ts_col: str = "ts", step_hours: int = 6, by: list | None = None) -> DataFrame:
    """W2/V3 as islands: ``(by..., first_missing, last_missing, n_missing)``, one row per
    unbroken run of slots without a record, with the slots and bounds of ``time_gaps``.

    No calendar is made, so a gap costs one row however long it is. The slots are
    sorted by range; a task compares neighbours, and what lies between two
    partitions follows from their edge rows, two per partition."""
    from pyspark.sql.pandas.types import to_arrow_type

    by = list(by or [])
    if 24 % int(step_hours):
        raise ValueError("step_hours must divide 24")
    spark = stamps.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    ts, slot = utc_wall_clock(stamps, ts_col), _slot(utc_wall_clock(stamps, ts_col), step_hours)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    number = F.expr(f"timestampdiff(HOUR, _epoch, _slot) div {int(step_hours)}")
    slots = stamps.select(*by, slot.alias("_slot"), epoch.alias("_epoch"), (slot == F.date_trunc("hour", ts)).alias("_on")).where(
        "_slot IS NOT NULL").select(*by, number.cast("long").alias("_s"), "_on").distinct()
    # markers just outside each group's bounds, so that slots missing at its ends are a run too
    bounds = slots.groupBy(*by).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).where("lo IS NOT NULL")
    marks = bounds.select(*by, F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("_s"))
    points = slots.where("_on").drop("_on").unionByName(marks).dropDuplicates()
    named = points.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "_s")
    keys = [f"k{i}" for i in range(len(by))]
    types = [to_arrow_type(named.schema[k].dataType) for k in keys]
    ddl = "".join(f"{k} {named.schema[k].dataType.simpleString()}, " for k in keys) + "before long, after long, part int, edge int"
    sorted_ = named.repartitionByRange(*keys, "_s").sortWithinPartitions(*keys, "_s")
    found = sorted_.select(*keys, "_s", F.spark_partition_id().alias("part")).mapInArrow(
        _runs_in_partition(types, step_hours), ddl).checkpoint(eager=True)
    edges = sorted(found.where("edge IS NOT NULL").collect(), key=lambda r: (r["part"], r["edge"]))  # two per partition
    between = [(*[a[k] for k in keys], a["after"], b["before"], a["part"], None) for a, b in zip(edges[1::2], edges[2::2])
               if all(a[k] == b[k] for k in keys) and b["before"] > a["after"] + 1]
    runs = found.where("edge IS NULL").union(spark.createDataFrame(between, found.schema))
    slot_at = lambda n: F.timestamp_add("HOUR", n * int(step_hours), epoch)
    return runs.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], slot_at(F.col("before") + 1).alias("first_missing"),
                       slot_at(F.col("after") - 1).alias("last_missing"), (F.col("after") - F.col("before") - 1).alias("n_missing"))


def archive_periods(stamps: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Archive of each record time, with the period parsed back from
    the name and the number of records per archive."""
    hours = stamps.select(F.date_trunc("hour", utc_wall_clock(stamps, ts_col)).alias("hour")).distinct()
    per_archive = hours.groupBy(archive_name_for("hour").alias("archive_name")).agg(
        F.count(F.lit(1)).alias("n_records")
    )
    return per_archive.select(
        "archive_name",
        archive_first_day("archive_name").alias("first_day"),
        archive_last_day("archive_name").alias("last_day"),
        "n_records",
    )
