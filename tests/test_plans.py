"""Plan regressions: the physical plans keep their scale properties."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridframe.operators import grid, matrix, timeaxis
from gridframe.plans import catalog as C
from gridframe.plans import fixtures as fx

from conftest import SF_SMALL


def shuffles(plan: str) -> int:
    """Shuffle exchanges in a formatted plan (broadcasts not counted)."""
    return len(re.findall(r"[-+] Exchange \(\d+\)", plan))


def scans(plan: str) -> int:
    return len(re.findall(r"\(\d+\) Scan parquet", plan))


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDFs


def test_blocked_transpose_one_sized_exchange(spark):
    vec = fx.embedding_vectors(spark, SF_SMALL)
    names = timeaxis.column_names(vec, order="name")
    plan = plan_of(matrix.transpose_blocked(matrix.segment(vec, 16), names, 16, 128, partitions=37, n_cells=64))
    assert shuffles(plan) == 1
    assert "hashpartitioning(row0#" in plan and ", 37)" in plan
    assert "BroadcastHashJoin" in plan  # names attached without shuffling segments
    assert "FlatMapGroupsInArrow" in plan


def test_cells_to_segments_single_exchange(spark):
    cells = fx.daily_cells(spark, SF_SMALL)
    plan = plan_of(grid.cells_to_segments(cells, 200, 64, fx.FILL))
    # one exchange for the per-day aggregate, one by record for the segments
    assert shuffles(plan) == 2
    assert scans(plan) == 1
    assert "MapInArrow" in plan


def test_matvec_broadcasts_x_and_combines(spark):
    vec = fx.embedding_vectors(spark, SF_SMALL)
    seg = matrix.segment(vec, 16)
    x = matrix.vector_segments(spark, [1.0] * 64, 16)
    plan = plan_of(matrix.matvec(seg, x, 16))
    assert "BroadcastHashJoin" in plan
    assert "partial_sum" in plan  # map-side combine before the shuffle


def test_column_pruning_on_scan(spark):
    plan = plan_of(C.QUERIES["record_name_to_ts"](spark, SF_SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan


def test_catalogue_plans_are_compact(spark):
    # every query plans in a bounded number of exchanges (reused ones included)
    for name, q in entry.queries().items():
        assert shuffles(plan_of(q(spark, SF_SMALL))) <= 20, name


def test_products_read_store_once(spark):
    vec = fx.embedding_vectors(spark, SF_SMALL)
    seg = matrix.segment(vec, 16)
    y = vec.select("record_name", F.col("label").cast("double").alias("y"))
    plan = plan_of(matrix.matvec_transpose(seg, y, 16))
    assert scans(plan) == 2  # segments + the broadcast y side


def test_chunk_selection_prunes_partitions(spark, tmp_dir):
    from gridframe.sources import store

    vec = fx.embedding_vectors(spark, SF_SMALL).withColumn("chunk_id", (F.col("vec_id") % 4).cast("int"))
    store.write_segments(matrix.segment(vec, 16, keys=("record_name", "chunk_id")), f"{tmp_dir}/at")
    two = store.read_segments(spark, f"{tmp_dir}/at", chunk_ids=[0, 1])
    plan = plan_of(two)
    assert re.search(r"PartitionFilters: \[chunk_id#\d+ IN \(0,1\)\]", plan)
    assert sorted(r[0] for r in two.select("chunk_id").distinct().collect()) == [0, 1]
    one = plan_of(store.lookup_record(store.read_segments(spark, f"{tmp_dir}/at"), "r00000007"))
    assert "PushedFilters: [IsNotNull(record_name), EqualTo(record_name,r00000007)]" in one
