"""End to end: archives -> store -> names -> transpose -> lookup, with resume."""

import os

import numpy as np
from pyspark.sql import functions as F

from gridframe.operators import grid, matrix
from gridframe.plans import jobs
from gridframe.sources import archives, growing


def test_convert_transpose_lookup_resume(spark, tmp_dir):
    rng = np.random.default_rng(7)
    hours = [f"pgbh02.gdas.197901{d:02d}{h:02d}.grb2" for d in (1, 2, 3, 6, 7) for h in (0, 6, 12, 18)]
    data = rng.standard_normal((len(hours), 30)).astype(np.float32)
    vec = spark.createDataFrame(
        [(f"pgbh02.gdas.{'19790101-19790105' if i < 12 else '19790106-19790110'}.tar", n, data[i].tolist())
         for i, n in enumerate(hours)],
        "archive_name string, record_name string, values array<float>",
    )
    root = os.path.join(tmp_dir, "raw")
    spec = [("cc", 0, 6, (2, 3)), ("tmp", 6, 24, (4, 2, 3))]
    written = archives.write_grid_archives(vec, root, spec).collect()
    assert sorted(r["n_entries"] for r in written) == [8, 12]
    listing = os.path.join(tmp_dir, "list.txt")
    with open(listing, "w") as fh:
        fh.write("pgbh02.gdas.19790101-19790105.tar\n")
    variables = spark.createDataFrame([("cc", 0, 1, 2, 3), ("tmp", 1, 4, 2, 3)],
                                      "var string, var_pos int, n_levels int, n_lat int, n_lon int")
    layout = grid.layout_offsets(variables)
    out = os.path.join(tmp_dir, "store")
    first = jobs.convert(spark, root, listing, layout, out, block_size=8, archives_per_chunk=1)
    assert (first["records"], first["quarantined"]) == (12, 0)
    first_chunks = jobs.grow(spark, f"{out}/decoded", f"{out}/grown", 8, max_records=5)
    assert np.array_equal(np.array([r["values"] for r in first_chunks.orderBy("row_idx").collect()], np.float32), data[:12].T)
    # resume with a longer list: only the new archive is decoded
    with open(listing, "a") as fh:
        fh.write("pgbh02.gdas.19790106-19790110.tar\n")
        fh.write("pgbh02.gdas.19790101-19790105.tar\n")  # a repeated line
    second = jobs.convert(spark, root, listing, layout, out, block_size=8, archives_per_chunk=1)
    assert (second["records"], second["quarantined"]) == (20, 0)
    assert jobs.segments(spark, f"{out}/decoded").groupBy("record_name", "block_id").count().where("count > 1").count() == 0
    chunks = {r["record_name"][12:20]: r["chunk_id"] for r in
              jobs.segments(spark, f"{out}/decoded").select("record_name", "chunk_id").distinct().collect()}
    assert chunks["19790101"] == 0 and chunks["19790107"] == 1  # archive rank div archives_per_chunk
    third = jobs.convert(spark, root, listing, layout, out, block_size=8, archives_per_chunk=1)
    assert third["records"] == 20
    names = jobs.names(spark, f"{out}/decoded", f"{out}/names", text_path=f"{out}/names_txt")
    got = [r["record_name"] for r in names.orderBy("col_idx").collect()]
    assert got == hours
    text = [r["value"] for r in spark.read.text(f"{out}/names_txt").collect()]
    assert sorted(text) == sorted(hours)
    for method in ("blocked", "sql"):
        a = jobs.transpose(spark, f"{out}/decoded", f"{out}/names", f"{out}/matrix_{method}", 8, 7, method)
        rows = {r["row_idx"]: r["values"] for r in a.collect()}
        assert np.array_equal(np.array([rows[i] for i in range(30)], np.float32), data.T)
    jobs.main(["grow", out, "--block-size", "8", "--compact"])  # the later records follow as one more chunk
    grown = growing.read(spark, f"{out}/grown")
    assert [r["n_cols"] for r in growing.chunks(spark, f"{out}/grown")] == [20]
    assert np.array_equal(np.array([r["values"] for r in grown.orderBy("row_idx").collect()], np.float32), data.T)
    one = jobs.lookup(spark, f"{out}/decoded", hours[3], 8).orderBy("pos").collect()
    assert np.array_equal(np.array([r["value"] for r in one], np.float32), data[3])
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        jobs.lookup(spark, f"{out}/decoded", hours[3], 8).explain()
    plan = buf.getvalue()
    assert "PushedFilters: [IsNotNull(record_name), EqualTo(record_name," in plan
    assert "PartitionFilters: [isnotnull(status" in plan
    jobs.export_record(spark, f"{out}/decoded", hours[3], f"{out}/export", 8)
    assert spark.read.json(f"{out}/export").count() == 30
    other = spark.createDataFrame([(hours[0], data[0].tolist())], "record_name string, values array<float>")
    cmp = jobs.compare(spark, f"{out}/decoded", other).first()
    assert (cmp["n_a"], cmp["n_b"], cmp["n_mismatch"], cmp["l2"]) == (30, 30, 0, 0.0)
    x = matrix.vector_segments(spark, np.ones(30), 8)
    sums = {r["record_name"]: r["value"] for r in jobs.multiply(spark, f"{out}/decoded", x, 8).collect()}
    assert np.allclose([sums[h] for h in hours], data.astype(np.float64).sum(axis=1))
    y = names.select("record_name", F.lit(1.0).alias("y"))
    cells = {r["row_idx"]: r["value"] for r in jobs.multiply_transpose(spark, f"{out}/decoded", y, 8).collect()}
    assert np.allclose([cells[i] for i in range(30)], data.astype(np.float64).sum(axis=0))


def test_cli_flow(spark, tmp_dir):
    import json

    rng = np.random.default_rng(3)
    hours = [f"pgbh02.gdas.1979030{d}{h:02d}.grb2" for d in (1, 2) for h in (0, 6, 12, 18) if (d, h) != (1, 12)]
    data = rng.standard_normal((len(hours), 6)).astype(np.float32)
    vec = spark.createDataFrame([("pgbh02.gdas.19790301-19790305.tar", n, data[i].tolist()) for i, n in enumerate(hours)],
                                "archive_name string, record_name string, values array<float>")
    root = os.path.join(tmp_dir, "raw")
    archives.write_grid_archives(vec, root, [("v", 0, 6, (2, 3))]).collect()
    with open(os.path.join(tmp_dir, "list.txt"), "w") as fh:
        fh.write("pgbh02.gdas.19790301-19790305.tar\n")
    with open(os.path.join(tmp_dir, "layout.json"), "w") as fh:
        json.dump([["v", 1, 2, 3]], fh)
    out = os.path.join(tmp_dir, "out")
    jobs.main(["convert", root, os.path.join(tmp_dir, "list.txt"), os.path.join(tmp_dir, "layout.json"), out,
               "--block-size", "4"])
    jobs.main(["names", out])
    jobs.main(["transpose", out, "--block-size", "4"])
    a = {r["row_idx"]: r["values"] for r in spark.read.parquet(f"{out}/matrix").collect()}
    assert np.array_equal(np.array([a[i] for i in range(6)], np.float32), data.T)
    spark.createDataFrame([(i, 1.0) for i in range(6)], "pos long, value double").write.parquet(f"{tmp_dir}/x")
    jobs.main(["multiply", out, f"{tmp_dir}/x", f"{tmp_dir}/ax", "--block-size", "4"])
    ax = {r["record_name"]: r["value"] for r in spark.read.parquet(f"{tmp_dir}/ax").collect()}
    assert np.allclose([ax[h] for h in hours], data.astype(np.float64).sum(axis=1))
    jobs.main(["gaps", out, f"{tmp_dir}/gaps"])
    assert [r[0] for r in spark.read.parquet(f"{tmp_dir}/gaps").collect()] == ["pgbh02.gdas.1979030112.grb2"]
    jobs.main(["export", out, hours[0], f"{tmp_dir}/one", "--block-size", "4"])
    assert spark.read.json(f"{tmp_dir}/one").count() == 6


def test_default_layout(spark, tmp_dir):
    import json

    jobs.main(["layout", os.path.join(tmp_dir, "layout.json")])
    rows = json.load(open(os.path.join(tmp_dir, "layout.json")))
    assert len(rows) == 31 and sum(d * la * lo for _, d, la, lo in rows) == 54_843_120  # cells of a full record
