import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import index, matrix, timeaxis
from gridframe.plans import fixtures as fx

from conftest import SF_SMALL


def _matrix(spark, n_rec=37, n_cells=53, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n_rec, n_cells)).astype(np.float32)
    rows = [(f"r{i:04d}", data[i].tolist()) for i in range(n_rec)]
    df = spark.createDataFrame(rows, "record_name string, values array<float>")
    return data, df


def _dense(rows, n):
    out = {}
    for r in rows:
        out[r["row_idx"]] = r["values"]
    return np.array([out[i] for i in range(n)], dtype=np.float32)


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(F.format_string("k%05d", (F.col("id") * 7919) % 1000).alias("k"))
    out = index.dense_index(df.repartition(7), [F.col("k")], "idx").collect()
    got = sorted((r["idx"], r["k"]) for r in out)
    assert [i for i, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_transposes_agree_with_numpy(spark):
    data, df = _matrix(spark)
    names = timeaxis.column_names(df, order="name")
    for block in (8, 53, 64):
        seg = matrix.segment(df, block)
        a_sql = _dense(matrix.transpose_sql(seg, names, block).collect(), data.shape[1])
        a_blk = _dense(matrix.transpose(seg, names, block, records_per_tile=1000).collect(), data.shape[1])
        # automatic plan with a tiny tile budget: sub-blocks of 3 cells x all records
        a_sub = _dense(matrix.transpose(seg, names, block, max_tile_bytes=3 * 4 * 37).collect(), data.shape[1])
        assert np.array_equal(a_sub, data.T)
        assert matrix.tile_plan(37, block, 3 * 4 * 37) == (min(3, block), 37)
        chunks = matrix.transpose_blocked(seg, names, block, records_per_tile=5)
        a_mrg = _dense(matrix.merge_column_chunks(chunks).collect(), data.shape[1])
        for a in (a_sql, a_blk, a_mrg):
            assert np.array_equal(a, data.T)


def test_transpose_twice_is_identity(spark):
    data, df = _matrix(spark, 11, 20, seed=1)
    names = timeaxis.column_names(df, order="name")
    a = matrix.transpose(matrix.segment(df, 6), names, 6, records_per_tile=4)
    # rows of A become records of a second A^T, named by row index
    at = a.select(F.format_string("c%05d", "row_idx").alias("record_name"), "values")
    names2 = timeaxis.column_names(at, order="name")
    back = matrix.transpose(matrix.segment(at, 3), names2, 3, records_per_tile=7).collect()
    assert np.array_equal(_dense(back, data.shape[0]), data)


def test_segment_unsegment(spark):
    data, df = _matrix(spark, 5, 23)
    back = {r["record_name"]: r["values"] for r in matrix.unsegment(matrix.segment(df, 4)).collect()}
    for i in range(5):
        assert np.array_equal(np.array(back[f"r{i:04d}"], np.float32), data[i])


def test_products_match_numpy(spark):
    data, df = _matrix(spark, 19, 41, seed=3)
    seg = matrix.segment(df, 8)
    x = np.linspace(-1, 1, 41)
    xs = matrix.vector_segments(spark, x, 8)
    for budget in (1 << 30, 8 * 8 * 2):  # whole broadcast, and passes of 2 blocks
        got = {r["record_name"]: r["value"] for r in matrix.matvec(seg, xs, 8, max_broadcast_bytes=budget).collect()}
        want = data.astype(np.float64) @ x
        assert np.allclose([got[f"r{i:04d}"] for i in range(19)], want, rtol=1e-12, atol=1e-12)
    y = spark.createDataFrame([(f"r{i:04d}", float(i)) for i in range(19)], "record_name string, y double")
    got = {r["row_idx"]: r["value"] for r in matrix.matvec_transpose(seg, y, 8).collect()}
    want = data.astype(np.float64).T @ np.arange(19.0)
    assert np.allclose([got[i] for i in range(41)], want)


def test_tile_rejects_ragged(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "record_name string, values array<float>")
    names = timeaxis.column_names(df, order="name")
    try:
        matrix.transpose(matrix.segment(df, 4), names, 4).collect()
    except Exception as exc:  # noqa: BLE001
        assert "ragged" in str(exc)
    else:
        raise AssertionError("ragged vectors must not transpose silently")


def test_embeddings_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["row_idx", "col_idx", "value"]
    n = fx.table(spark, SF_SMALL, "embeddings").count()
    assert df.count() == n * 64


def test_column_chunks_store_round_trip(spark, tmp_dir):
    from gridframe.sources import store

    data, df = _matrix(spark, 23, 17, seed=5)
    names = timeaxis.column_names(df, order="name")
    chunks = matrix.transpose_blocked(matrix.segment(df, 5), names, 5, records_per_tile=6)
    path = f"{tmp_dir}/chunks"
    store.write_column_chunks(chunks, path, n_rows=17)
    back = spark.read.parquet(path)
    assert sorted(r["rblock"] for r in back.select("rblock").distinct().collect()) == [0, 1, 2, 3]
    merged = _dense(matrix.merge_column_chunks(back).collect(), 17)
    assert np.array_equal(merged, data.T)
    store.write_matrix(matrix.merge_column_chunks(back), f"{tmp_dir}/a", n_rows=17, partitions=3)
    assert np.array_equal(_dense(spark.read.parquet(f"{tmp_dir}/a").collect(), 17), data.T)


def test_validators(spark):
    import pytest

    from gridframe.operators import verify

    _, df = _matrix(spark, 4, 6)
    assert verify.require_uniform_length(df) == 6
    ragged = df.unionByName(spark.createDataFrame([("x", [1.0])], "record_name string, values array<float>"))
    with pytest.raises(verify.ValidationError, match="lengths 1..6"):
        verify.require_uniform_length(ragged)
    names = timeaxis.column_names(df, order="name")
    verify.require_order(names.withColumn("ts", F.lit(None).cast("timestamp")))
    holes = names.withColumn("col_idx", F.col("col_idx") * 2).withColumn("ts", F.lit(None).cast("timestamp"))
    with pytest.raises(verify.ValidationError, match="holes"):
        verify.require_order(holes)


def test_matvec_equals_mllib_indexed_row_matrix(spark):
    from pyspark.mllib.linalg import DenseMatrix
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    data, df = _matrix(spark, 13, 21, seed=9)
    names = timeaxis.column_names(df, order="name")
    seg = matrix.segment(df, 8)
    x = np.linspace(0.5, 2.0, 21)
    ours = {r["row"]: r["value"] for r in
            matrix.matvec(seg, matrix.vector_segments(spark, x, 8), 8).join(
                names.select("record_name", F.col("col_idx").alias("row")), "record_name").collect()}
    rows = spark.sparkContext.parallelize([IndexedRow(i, data[i].astype(float).tolist()) for i in range(13)])
    product = IndexedRowMatrix(rows).multiply(DenseMatrix(21, 1, x.tolist()))
    mllib = {r.index: r.vector[0] for r in product.rows.collect()}
    assert set(ours) == set(mllib)
    assert max(abs(ours[i] - mllib[i]) for i in ours) < 1e-9


def test_transpose_refuses_wrong_columns(spark):
    """A record given twice while another lacks the block, and a missing last record."""
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "record_name string, col_idx long")
    rows = [("a", 0, [1.0, 2.0]), ("b", 0, [3.0, 4.0]), ("b", 0, [3.0, 4.0]), ("d", 0, [7.0, 8.0])]
    ddl = "record_name string, block_id int, values array<float>"
    for bad in (rows, rows[:2] + [("c", 0, [5.0, 6.0])]):
        with pytest.raises(Exception, match="missing or duplicated"):
            matrix.transpose(spark.createDataFrame(bad, ddl), names, 2, n_cells=2).collect()
    chunks = [(0, 0, [1.0, 2.0]), (0, 2, [5.0])]
    with pytest.raises(Exception, match="missing or repeated"):
        matrix.merge_column_chunks(spark.createDataFrame(chunks, "row_idx long, rblock int, values array<float>")).collect()


def test_products_need_whole_vectors(spark):
    seg = spark.createDataFrame([("a", 0, [1.0, 1.0]), ("a", 1, [1.0]), ("b", 0, [2.0, 2.0]), ("b", 1, [2.0])],
                                "record_name string, block_id int, values array<float>")
    cells = spark.createDataFrame([(0, 3.0)], "pos long, value double")
    x = matrix.vector_from_cells(cells, 3, 2, default=1.0)
    for budget in (1 << 20, 0):
        assert {tuple(r) for r in matrix.matvec(seg, x, 2, max_broadcast_bytes=budget).collect()} == {("a", 5.0), ("b", 10.0)}
    for short in (x.where("block_id = 0"), spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0])], "block_id int, values array<double>")):
        with pytest.raises(Exception, match="the vector's block has"):
            matrix.matvec(seg, short, 2).collect()
    y = spark.createDataFrame([("a", 1.0), ("b", 10.0)], "record_name string, y double")
    assert {tuple(r) for r in matrix.matvec_transpose(seg, y, 2, fill=2.0).collect()} == {(0, 1.0), (1, 1.0), (2, 1.0)}


def test_completeness_sees_repeated_blocks(spark):
    from gridframe.operators import verify

    seg = spark.createDataFrame([("a", b, [0.0] * 2) for b in (0, 2, 2, 2, 4)] + [("b", b, [0.0] * 2) for b in range(5)],
                                "record_name string, block_id int, values array<float>")
    assert [r["record_name"] for r in verify.segment_completeness(seg, 10, 2).collect()] == ["a"]
    names = spark.createDataFrame([("a",), ("z",)], "record_name string")
    assert {tuple(r) for r in verify.record_differences(seg, names).collect()} == {("b", "has no name"), ("z", "is not stored")}


def test_compare_counts_nan_as_equal(spark):
    nan = float("nan")
    ddl = "record_name string, values array<float>"
    a = spark.createDataFrame([("r", [1.0, nan, nan, 4.0]), ("s", [1.0])], ddl)
    b = spark.createDataFrame([("r", [1.0, nan, 3.0, 6.0]), ("t", [1.0, 2.0])], ddl)
    from gridframe.operators import verify

    got = {r["record_name"]: (r["n_a"], r["n_b"], r["n_mismatch"]) for r in verify.compare_vectors(a, b).collect()}
    assert got == {"r": (4, 4, 2), "s": (1, 0, 0), "t": (0, 2, 0)}


def test_empty_vectors_have_no_segment(spark):
    df = spark.createDataFrame([("a", []), ("b", [1.0])], "record_name string, values array<float>")
    assert [r["record_name"] for r in matrix.segment(df, 4).collect()] == ["b"]


def test_transpose_sql_leaves_absent_cells_behind(spark):
    """Only present cells are shuffled; rows without any, nulls and NaN come back as they were."""
    fill, nan = 1e20, float("nan")
    rows = [("r0", [1.0, fill, fill, None, fill]), ("r1", [fill, fill, fill, nan, 2.0])]
    vec = spark.createDataFrame(rows, "record_name string, values array<float>")
    names, seg = timeaxis.column_names(vec, order="name"), matrix.segment(vec, 2)
    made = matrix.transpose_sql(seg, names, 2, fill=fill, n_cells=5)
    want = {r["row_idx"]: [str(v) for v in r["values"]] for r in matrix.transpose_sql(seg, names, 2).collect()}
    assert {r["row_idx"]: [str(v) for v in r["values"]] for r in made.collect()} == want and len(want) == 5
    for broken in (seg.where("not (record_name = 'r1' and block_id = 1)"), seg.union(seg.where("record_name = 'r0'"))):
        with pytest.raises(Exception, match="missing or repeated"):
            matrix.transpose_sql(broken, names, 2, fill=fill, n_cells=5).collect()
