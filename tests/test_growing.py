"""Rows of A that grow by columns, and stores compared by fingerprints."""

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import fingerprints, matrix, timeaxis, verify
from gridframe.sources import growing, store

CELLS, BLOCK = 21, 8


def records(spark, first, n):
    rng = np.random.default_rng(first)
    rows = [(f"r{first + i:05d}", rng.normal(size=CELLS).astype("f4").tolist()) for i in range(n)]
    vec = spark.createDataFrame(rows, "record_name string, values array<float>").repartition(3)
    return rows, matrix.segment(vec, BLOCK), timeaxis.column_names(vec, order="name")


def dense(rows):
    got = rows.collect()
    out = np.array([r["values"] for r in sorted(got, key=lambda r: r["row_idx"])], "f4")
    assert sorted(r["row_idx"] for r in got) == list(range(len(got)))
    return out


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/parts/**/*.parquet", recursive=True)}


@pytest.fixture()
def grown(spark, tmp_dir):
    path = f"{tmp_dir}/grown"
    growing.create(spark, path, CELLS, BLOCK, row_parts=3)
    return path


def test_appends_and_compaction_equal_one_transpose(spark, grown):
    assert growing.read(spark, grown).count() == 0 and growing.compact(spark, grown) is None
    want = np.zeros((CELLS, 0), "f4")
    for first, n in ((0, 7), (7, 1), (8, 12)):
        before = files(grown)
        rows, seg, names = records(spark, first, n)
        growing.append(spark, grown, seg, names)
        after = files(grown)
        assert before.items() <= after.items()  # no old file is touched
        want = np.hstack([want, np.array([v for _, v in rows], "f4").T])
        assert np.array_equal(dense(growing.read(spark, grown)), want)
    assert [r["record_name"] for r in growing.names(spark, grown).orderBy("col_idx").collect()] == [f"r{i:05d}" for i in range(20)]
    assert np.array_equal(dense(growing.read(spark, grown, columns=(5, 9))), want[:, 5:9])
    assert growing.compact(spark, grown).startswith("base-")
    assert len(growing.chunks(spark, grown)) == 1 and growing.vacuum(spark, grown) == 3
    assert np.array_equal(dense(growing.read(spark, grown)), want)
    assert "Exchange" not in growing.read(spark, grown)._jdf.queryExecution().executedPlan().toString()
    assert growing.names(spark, grown).count() == 20
    rows, seg, names = records(spark, 20, 2)  # a base grows like a chunk
    growing.append(spark, grown, seg, names)
    assert np.array_equal(dense(growing.read(spark, grown)), np.hstack([want, np.array([v for _, v in rows], "f4").T]))


def test_row_parts_and_columns_prune(spark, grown):
    for first in (0, 5):
        _, seg, names = records(spark, first, 5)
        growing.append(spark, grown, seg, names)
    some = growing.read(spark, grown, columns=(0, 3))
    assert len(some.inputFiles()) and all(growing.chunks(spark, grown)[0]["commit_id"] in f for f in some.inputFiles())
    parts = [[r["row_idx"] for r in growing.read(spark, grown, row_part=p).collect()] for p in range(3)]
    assert sorted(sum(parts, [])) == list(range(CELLS)) and all(sorted(p) == list(range(min(p), max(p) + 1)) for p in parts)


def test_a_dead_compaction_goes_on_and_a_dead_append_does_not_count(spark, grown, monkeypatch):
    want = []
    for first in (0, 4):
        rows, seg, names = records(spark, first, 4)
        growing.append(spark, grown, seg, names)
        want += [v for _, v in rows]
    merged, done = growing._merged, []

    def dies(spark, path, live, part=None):
        if part == 2:
            raise RuntimeError("lost")
        return merged(spark, path, live, part)

    monkeypatch.setattr(growing, "_merged", dies)
    with pytest.raises(RuntimeError):
        growing.compact(spark, grown)
    monkeypatch.setattr(growing, "_merged", lambda s, p, live, part=None: done.append(part) or merged(s, p, live, part))
    assert np.array_equal(dense(growing.read(spark, grown)), np.array(want, "f4").T)  # not committed: the chunks count
    done.clear()
    growing.compact(spark, grown)
    assert done == [2]
    assert np.array_equal(dense(growing.read(spark, grown)), np.array(want, "f4").T)
    # an append that died before its commit
    stray = f"{grown}/parts/commit_id=stray"
    shutil.copytree(glob.glob(f"{grown}/parts/commit_id=base-*")[0], stray)
    assert np.array_equal(dense(growing.read(spark, grown)), np.array(want, "f4").T)
    assert growing.vacuum(spark, grown) == 3 and not os.path.exists(stray)


def test_appends_that_cannot_count_are_refused(spark, grown):
    _, seg, names = records(spark, 10, 4)
    growing.append(spark, grown, seg, names)
    before = files(grown)
    for first in (0, 10, 12):  # earlier, the same, overlapping
        _, seg, names = records(spark, first, 4)
        with pytest.raises(verify.ValidationError, match="does not come after"):
            growing.append(spark, grown, seg, names)
    _, seg, names = records(spark, 20, 4)
    with pytest.raises(verify.ValidationError):
        growing.append(spark, grown, seg, names.where("col_idx < 3"))
    with pytest.raises(verify.ValidationError):
        growing.append(spark, grown, seg.where("block_id < 2 or record_name <> 'r00021'"), names)
    with pytest.raises(verify.ValidationError, match="column order"):
        growing.append(spark, grown, seg.limit(0), names.limit(0))
    assert files(grown) == before


# --- fingerprints -----------------------------------------------------------------------
def printed(spark, seg, path, buckets=4):
    store.write_segments(seg, f"{path}/segments", chunk_col=None)
    kept = store.read_segments(spark, f"{path}/segments")
    fingerprints.write_prints(fingerprints.block_prints(kept, buckets), f"{path}/prints")
    return kept, f"{path}/prints"


def test_equal_stores_are_known_without_their_values(spark, tmp_dir):
    _, seg, _ = records(spark, 0, 40)
    (a, pa), (b, pb) = printed(spark, seg, f"{tmp_dir}/a"), printed(spark, seg.repartition(5), f"{tmp_dir}/b")
    for d in ("a", "b"):
        shutil.rmtree(f"{tmp_dir}/{d}/segments")  # the values are not there any more
    assert fingerprints.compare_printed(a, b, pa, pb).collect() == []
    whole = [fingerprints.digests(spark.read.parquet(f"{p}/blocks")).first() for p in (pa, pb)]
    assert whole[0] == whole[1] and whole[0]["n"] == 40 * 3


def test_only_unequal_blocks_are_compared(spark, tmp_dir):
    _, seg, _ = records(spark, 0, 40)
    other = seg.where("record_name <> 'r00003' or block_id <> 2").where("record_name <> 'r00009'").withColumn(
        "values", F.when((F.col("record_name") == "r00005") & (F.col("block_id") == 1),
                         F.transform("values", lambda v, i: F.when(i == 2, v + F.lit(2).cast("float")).otherwise(v))).otherwise(F.col("values")))
    extra = seg.where("record_name = 'r00001' and block_id = 0")  # a repeated block
    (a, pa), (b, pb) = printed(spark, seg, f"{tmp_dir}/a"), printed(spark, other.union(extra), f"{tmp_dir}/b")
    blocks = {tuple(r) for r in fingerprints.unequal_blocks(spark, pa, pb).collect()}
    assert blocks == {("r00003", 2), ("r00009", 0), ("r00009", 1), ("r00009", 2), ("r00005", 1), ("r00001", 0)}
    got = {r["record_name"]: (r["n_a"], r["n_b"], r["n_mismatch"], round(r["l2"], 4)) for r in fingerprints.compare_printed(a, b, pa, pb).collect()}
    assert got["r00005"] == (8, 8, 1, 2.0) and got["r00003"] == (5, 0, 0, 0.0) and got["r00009"] == (21, 0, 0, 0.0)


def test_prints_treat_nan_and_zero_as_the_comparison_does(spark):
    rows = [("a", 0, [float("nan"), 0.0]), ("a", 0, [float("nan"), -0.0])]
    one, two = fingerprints.block_prints(spark.createDataFrame(rows, "record_name string, block_id int, values array<float>")).collect()
    assert one == two
