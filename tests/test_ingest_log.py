"""One log for batch and streaming conversions; repaired, replaced and forgotten archives."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import grid
from gridframe.plans import jobs
from gridframe.sources import archives, ingest_log, store
from gridframe.streaming import start_ingest

A, B = "pgbh02.gdas.19790201-19790205.tar", "pgbh02.gdas.19790206-19790210.tar"


def write(spark, root, archive, days, value=0.0):
    rows = [(archive, f"pgbh02.gdas.197902{d:02d}00.grb2", (np.arange(12) + 100 * d + value).astype(np.float32).tolist()) for d in days]
    archives.write_grid_archives(spark.createDataFrame(rows, "archive_name string, record_name string, values array<float>"),
                                 root, [("v", 0, 12, (3, 4))]).collect()


@pytest.fixture()
def setup(spark, tmp_dir):
    layout = grid.layout_offsets(spark.createDataFrame([("v", 0, 1, 3, 4)], "var string, var_pos int, n_levels int, n_lat int, n_lon int"))
    root, out, listing = (os.path.join(tmp_dir, d) for d in ("raw", "store", "list.txt"))

    def convert(*names):
        with open(listing, "w") as fh:
            fh.write("".join(f"{n}\n" for n in names))
        return jobs.convert(spark, root, listing, layout, out, block_size=5, archives_per_chunk=1)

    def stored():
        seg = jobs.segments(spark, f"{out}/decoded").collect()
        assert len({(r["record_name"], r["block_id"]) for r in seg}) == len(seg)
        return {r["record_name"][18:20]: r["values"][0] for r in seg if r["block_id"] == 0}

    return layout, root, out, convert, stored


def test_stream_then_batch_keeps_both(spark, tmp_dir, setup):
    layout, root, out, convert, stored = setup
    write(spark, root, A, [1, 2]), write(spark, root, B, [6, 7, 8])
    lists = os.path.join(tmp_dir, "lists")
    os.makedirs(lists)
    with open(os.path.join(lists, "a.txt"), "w") as fh:
        fh.write(A + "\n")
    start_ingest(spark, lists, root, layout, out, os.path.join(tmp_dir, "ckpt"), block_size=5).awaitTermination(300)
    assert sorted(stored()) == ["01", "02"]
    assert convert(B)["records"] == 5  # the streamed records count as well
    assert sorted(stored()) == ["01", "02", "06", "07", "08"]
    log = ingest_log.read_log(spark, out)
    assert log.select("chunk_id").distinct().count() == log.select("commit_id").distinct().count() == 2


def test_mended_replaced_and_forgotten(spark, setup):
    layout, root, out, convert, stored = setup
    write(spark, root, A, [1, 2, 3])
    whole = open(f"{root}/{A}", "rb").read()
    with open(f"{root}/{A}", "wb") as fh:
        fh.write(whole[:1500])  # ends inside the second header
    first = convert(A, B)
    assert first["quarantined"] >= 2  # the cut listing, and an archive that is not there
    assert convert(A, B) == first  # nothing changed: nothing is read again
    with open(f"{root}/{A}", "wb") as fh:
        fh.write(whole)
    write(spark, root, B, [6])
    again = convert(A, B)
    assert (again["records"], again["quarantined"]) == (4, 0)
    assert jobs.quarantine(spark, f"{out}/decoded").isEmpty()
    write(spark, root, B, [6, 7], value=0.5)
    assert convert(A, B)["records"] == 5 and stored() == {"01": 100, "02": 200, "03": 300, "06": 600.5, "07": 700.5}
    names = spark.createDataFrame([(A,)], "archive_name string")
    ingest_log.forget(spark, names, root, out)
    assert sorted(stored()) == ["06", "07"]
    assert ingest_log.vacuum(spark, out) > 0 and sorted(stored()) == ["06", "07"]
    assert convert(A, B)["records"] == 5  # a forgotten archive that is listed again comes back


def test_uncommitted_attempt_does_not_count(spark, setup, monkeypatch):
    layout, root, out, convert, stored = setup
    write(spark, root, A, [1, 2])
    names = spark.createDataFrame([(A,)], "archive_name string")
    real = ingest_log._append

    def die(*_):
        raise RuntimeError("the driver died before its commit")

    monkeypatch.setattr(ingest_log, "_append", die)
    with pytest.raises(RuntimeError):
        ingest_log.ingest(spark, names, root, layout, out, 5, commit_id="stream-x-0")
    monkeypatch.setattr(ingest_log, "_append", real)
    assert ingest_log.ingest(spark, names, root, layout, out, 5, commit_id="stream-x-0") == 1
    assert sorted(stored()) == ["01", "02"]
    assert ingest_log.ingest(spark, names, root, layout, out, 5, commit_id="stream-x-0") == 0  # committed once
    assert spark.read.parquet(f"{out}/manifest").count() == 2


def test_files_are_block_ranges_by_record_buckets(spark, tmp_dir):
    plan = store.cluster_plan(1000, 64 * 100, 64, min_partitions=12, chunks=1)
    assert plan.partitions >= 12 and plan.block_ranges * plan.blocks_per_range >= 100
    rows = spark.range(1000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_name"),
                                    F.explode(F.sequence(F.lit(0), F.lit(99))).alias("block_id"))
    ids = rows.select("record_name", "block_id", plan.partition_id(F.col("block_id"), F.col("record_name"), None).alias("p"))
    assert ids.agg(F.min("p"), F.max("p"), F.countDistinct("p")).first() == (0, plan.partitions - 1, plan.partitions)
    per_record = ids.groupBy("record_name").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0]
    assert per_record == plan.block_ranges  # a record lies in one bucket of every range
    seg = rows.where("block_id < 4").withColumn("values", F.array(F.lit(1.0).cast("float"))).withColumn("chunk_id", (F.xxhash64("record_name") % 2 + 1).cast("int").alias("c"))
    small = store.cluster_plan(1000, 4, 1, min_partitions=8, chunks=3)
    store.write_segments(seg.withColumn("chunk_id", F.col("chunk_id").cast("int")), f"{tmp_dir}/at", plan=small)
    files = [f for _, _, fs in os.walk(f"{tmp_dir}/at") for f in fs if f.endswith(".parquet")]
    assert 0 < len(files) <= small.partitions


def test_lookup_reads_row_groups_of_its_record(spark, tmp_dir):
    """Bloom filters and sorted row groups: a lookup's scan hands on few rows of others."""
    rows = spark.range(64).select(F.format_string("r%05d", "id").alias("record_name"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("block_id"),
                                  F.array_repeat(F.lit(1.0).cast("float"), 16).alias("values"))
    plan = store.cluster_plan(64, 32 * 16, 16, min_partitions=16)
    store.write_segments(rows, f"{tmp_dir}/at", chunk_col=None, plan=plan)
    assert plan.record_buckets > 1
    found = store.lookup_record(spark.read.parquet(f"{tmp_dir}/at"), "r00017")
    assert found.count() == 32
    node = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    text = node.toString()
    assert "EqualTo(record_name,r00017)" in text
    leaves = node.collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 32 <= read < 64 * 32 / 2
