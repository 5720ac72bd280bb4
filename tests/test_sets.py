"""Groups, gap runs, missing patterns, extents and refused inputs."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridframe.operators import grid, matrix, missing, timeaxis
from gridframe.sources import archives, extents, store

from test_plans import plan_of, shuffles

VARIABLES = "var string, var_pos int, n_levels int, n_lat int, n_lon int"


def layout_of(spark, *rows, bound=None):
    return grid.layout_offsets(spark.createDataFrame([(v, i, *shape) for i, (v, *shape) in enumerate(rows)], VARIABLES), bound)


# --- W3 ------------------------------------------------------------------------
def test_groups_stay_within_their_bound(spark):
    rnd = random.Random(2)
    rows = [(f"v{i}", rnd.randint(1, 9), rnd.randint(1, 4), rnd.randint(1, 5)) for i in range(60)]
    got = layout_of(spark, *rows, bound=50).collect()
    cells, groups = {}, {}
    for r in got:
        cells[r["group_id"]] = cells.get(r["group_id"], 0) + r["length"]
        groups.setdefault(r["var"], set()).add(r["group_id"])
    assert max(cells.values()) <= 50 and sorted(cells) == list(range(len(cells)))
    for v, levels, lat, lon in rows:  # only variables above the bound are split
        assert len(groups[v]) == 1 or levels * lat * lon > 50
    with pytest.raises(PySparkException):
        layout_of(spark, ("big", 1, 10, 10), bound=50).collect()


# --- W2 / V3 ---------------------------------------------------------------------
def brute_runs(stamps, step):
    out = []
    for by in {b for b, _ in stamps}:
        slots = [(t.replace(hour=t.hour // step * step, minute=0), t.hour % step == 0) for b, t in stamps if b == by]
        on, at, end, run = {s for s, ok in slots if ok}, min(s for s, _ in slots), max(s for s, _ in slots), []
        while at <= end + dt.timedelta(hours=step):
            if at <= end and at not in on:
                run.append(at)
            elif run:
                out.append((by, run[0], run[-1], len(run)))
                run = []
            at += dt.timedelta(hours=step)
    return sorted(out)


def test_gap_runs_equal_brute_force(spark):
    rnd = random.Random(3)
    day = dt.datetime(1979, 1, 1)
    stamps = [(b, day + dt.timedelta(hours=rnd.randrange(900))) for b in ("x", "y", "z") for _ in range(70)]
    stamps += [("one", day), ("off", day + dt.timedelta(hours=1)), ("off", day + dt.timedelta(hours=13)), ("x", stamps[0][1])]
    df = spark.createDataFrame(stamps, "g string, ts timestamp_ntz").repartition(6)
    for step in (1, 6):
        got = timeaxis.time_gap_runs(df, "ts", step, by=["g"]).collect()
        assert sorted(tuple(r) for r in got) == brute_runs(stamps, step)


def test_a_long_gap_is_one_row(spark):
    df = spark.createDataFrame([(dt.datetime(1, 1, 1),), (dt.datetime(9999, 1, 1),)], "ts timestamp_ntz")
    got = timeaxis.time_gap_runs(df, "ts", 1).collect()
    assert len(got) == 1 and got[0]["n_missing"] == (dt.datetime(9999, 1, 1) - dt.datetime(1, 1, 1)) // dt.timedelta(hours=1) - 1
    assert timeaxis.time_gap_runs(df.where("false"), "ts", 1).collect() == []


# --- G5 --------------------------------------------------------------------------
def test_missing_patterns_over_several_stretches(spark):
    rng = np.random.default_rng(4)
    n, plane, fill = 7, 40_000, 1e20
    data = rng.standard_normal((n, 2 * plane + 30)).astype(np.float32)
    data[:, 5], data[2, 39_999], data[3:, 35_000], data[1, plane + 3] = fill, fill, fill, fill
    vec = spark.createDataFrame([(f"r{i}", data[i].tolist()) for i in range(n)], "record_name string, values array<float>").repartition(3)
    layout = layout_of(spark, ("t", 2, 200, 200), ("s", 1, 5, 6))
    got = {(r["var"], r["level"]): tuple(r)[2:] for r in missing.missing_patterns(matrix.segment(vec, 1000), layout, 1000, fill).collect()}
    # records 0 and 1 lack cell 5 only, 2 also 39999, the others also 35000
    assert got == {("t", 0): (plane, 3, 1, 2, 3, 4), ("t", 1): (plane, 1, 0, 1, 2, 6), ("s", 0): (30, 0, 0, 0, 1, 7)}


# --- S15 / P6 ----------------------------------------------------------------------
def test_planes_cost_their_own_bytes(spark, tmp_dir, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((4, 6 + 9 * 5000)).astype(np.float32)
    rows = [("a.tar", f"r{i}", data[i].tolist()) for i in range(4)]
    root = os.path.join(tmp_dir, "raw")
    archives.write_grid_archives(spark.createDataFrame(rows, "archive_name string, record_name string, values array<float>"), root,
                                 [("cc", 0, 6, (2, 3)), ("t", 6, 9 * 5000, (9, 50, 100))]).collect()
    manifest = archives.expand_archives(spark.createDataFrame([(f"{root}/a.tar",)], "archive_path string"))
    index = extents.extent_index(manifest)
    assert index.groupBy("record_name", "var").count().count() == 8 and index.where("reason IS NOT NULL").isEmpty()
    got = extents.read_planes(index.where("var = 't' AND level IN (3, 4)")).collect()
    for r in got:
        at = 6 + r["level"] * 5000
        assert np.array_equal(np.array(r["values"], np.float32), data[int(r["record_name"][1:]), at:at + 5000]) and r["dims"] == [50, 100]
    assert sum(r["bytes_read"] for r in got) <= 8 * 20_000 + 4 * extents.GAP_BYTES  # neighbouring levels in one read
    assert extents.extent_index(manifest, ["none"]).where("reason = 'missing variable none'").count() == 4

    read = []
    real = archives._open

    class Counting:
        def __init__(self, fh):
            self.fh = fh

        def read(self, n=-1):
            raw = self.fh.read(n)
            read.append(len(raw))
            return raw

        def __getattr__(self, name):
            return getattr(self.fh, name)

    monkeypatch.setattr(archives, "_open", lambda p: Counting(real(p)))
    table = pa.Table.from_pylist([r.asDict() for r in manifest.drop("reason").collect()])
    out = [b for b in archives._variable_reader("t", 3)(table.to_batches())]
    assert [b.column("reason")[0].as_py() for b in out] == [None] * 4
    assert sum(read) <= 4 * (20_000 + extents.HEADER_BYTES)  # of 180,000 bytes an entry


# --- refused inputs ------------------------------------------------------------------
def test_absent_variable_that_fills_blocks(spark):
    layout = layout_of(spark, ("a", 1, 4, 4), ("b", 1, 4, 4), ("c", 1, 8, 8))
    values = {"a": [1.0] * 16, "b": [2.0] * 16, "c": [3.0] * 64}

    def build(names):
        rows = [("r1", v, values[v]) for v in names] + [("r2", v, values[v]) for v in "abc"]
        return grid.to_record_segments(spark.createDataFrame(rows, "record_name string, var string, values array<float>"), layout, 16)

    assert {r["record_name"]: r["n"] for r in build("abc").groupBy("record_name").agg(F.count("*").alias("n")).collect()} == {"r1": 6, "r2": 6}
    for names in ("a", "b", "c", "ab", "ac", "bc"):
        with pytest.raises(PySparkException, match="r1"):
            build(names).collect()


def test_unnamed_records_and_missing_y_are_refused(spark):
    vec = spark.createDataFrame([(f"r{i}", [float(i)] * 4) for i in range(3)], "record_name string, values array<float>")
    seg, names = matrix.segment(vec, 2), timeaxis.column_names(vec.where("record_name <> 'r1'"), order="name")
    for made in (matrix.transpose(seg, names, 2, n_cells=4), matrix.transpose_sql(seg, names, 2), matrix.indexed_rows(seg, names)):
        with pytest.raises(PySparkException, match="r1"):
            made.collect()
    y = spark.createDataFrame([("r0", 1.0), ("r2", 2.0)], "record_name string, y double")
    with pytest.raises(PySparkException, match="r1"):
        matrix.matvec_transpose(seg, y, 2).collect()
    assert {r["value"] for r in matrix.matvec_transpose(seg, y, 2, default=10.0).collect()} == {14.0}


# --- S6 / S8 ---------------------------------------------------------------------------
def test_transpose_in_ranges_moves_the_matrix_once(spark, tmp_dir):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((9, 70)).astype(np.float32)
    vec = spark.createDataFrame([(f"r{i}", data[i].tolist()) for i in range(9)], "record_name string, values array<float>").repartition(3)
    names = timeaxis.column_names(vec, order="name")
    rows = matrix.transpose_ranges(matrix.segment(vec, 16), names, 16, 70, 9, partitions=5, sub_block=4)
    assert shuffles(plan_of(rows)) == 2  # the fixture's own repartition, and one for the matrix
    store.write_matrix(rows, f"{tmp_dir}/a", in_ranges=True)
    back = spark.read.parquet(f"{tmp_dir}/a").withColumn("file", F.input_file_name()).collect()
    assert np.array_equal(np.array([r["values"] for r in sorted(back, key=lambda r: r["row_idx"])], np.float32), data.T)
    spans = sorted((min(g), max(g), len(g)) for g in ([r["row_idx"] for r in back if r["file"] == f] for f in {r["file"] for r in back}))
    assert len(spans) == 5 and all(b - a + 1 == n for a, b, n in spans)  # contiguous, no range shares a file
