import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.operators import grid, matrix, verify
from gridframe.sources import archives, netcdf, store


def _layout(spark):
    v = spark.createDataFrame([("cc", 0, 1, 2, 3), ("tmp", 1, 2, 2, 3)],
                              "var string, var_pos int, n_levels int, n_lat int, n_lon int")
    return grid.layout_offsets(v)


def _nc(cc, tmp, drop=None, rank4=False, fill=np.float32(1e20)):
    variables = [("cc", ["lat", "lon"], cc, {"_FillValue": fill})]
    if rank4:
        variables.append(("tmp", ["one", "depth", "lat", "lon"], tmp.reshape(1, 2, 2, 3), {"_FillValue": fill}))
    else:
        variables.append(("tmp", ["depth", "lat", "lon"], tmp, {"_FillValue": fill}))
    variables = [v for v in variables if v[0] != drop]
    return netcdf.dumps({"one": 1, "depth": 2, "lat": 2, "lon": 3}, variables)


def _tar(path, entries, with_dir=True):
    with tarfile.open(path, "w") as tar:
        if with_dir:
            d = tarfile.TarInfo("sub")
            d.type = tarfile.DIRTYPE
            tar.addfile(d)
        for name, payload in entries:
            info = tarfile.TarInfo(f"sub/{name}")
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))


def test_layout_offsets(spark):
    rows = _layout(spark).orderBy("offset").collect()
    assert [(r["var"], r["level"], r["offset"], r["length"]) for r in rows] == [
        ("cc", 0, 0, 6), ("tmp", 0, 6, 6), ("tmp", 1, 12, 6)]


def test_ingest_with_quarantine(spark, tmp_dir):
    cc = np.arange(6, dtype=np.float32).reshape(2, 3)
    tmp = np.arange(12, dtype=np.float32).reshape(2, 2, 3) + 100
    _tar(os.path.join(tmp_dir, "a.tar"), [
        ("pgbh02.gdas.1979010100.grb2", _nc(cc, tmp)),
        ("pgbh02.gdas.1979010106.grb2", _nc(cc + 1, tmp + 1)),
        ("pgbh02.gdas.1979010112.grb2", _nc(cc, tmp, drop="tmp")),      # missing variable
        ("pgbh02.gdas.1979010118.grb2", b"corrupt bytes"),               # not decodable
        ("pgbh02.gdas.1979010200.grb2", _nc(cc, tmp, rank4=True)),       # rank 4
    ])
    with open(os.path.join(tmp_dir, "pgbh02.gdas.1979010300.grb2"), "wb") as fh:  # a plain file
        fh.write(_nc(cc + 2, tmp + 2))
    listing = os.path.join(tmp_dir, "list.txt")
    with open(listing, "w") as fh:
        fh.write("a.tar\npgbh02.gdas.1979010300.grb2\n")
    paths = archives.archive_paths(archives.read_archive_list(spark, listing), tmp_dir)
    manifest = archives.expand_archives(paths)
    m = sorted((os.path.basename(r["archive_path"]), r["entry_idx"], r["record_name"]) for r in manifest.collect())
    # the directory entry counts (entry 0) but is not a record
    assert m[0] == ("a.tar", 1, "pgbh02.gdas.1979010100.grb2")
    assert len(m) == 6
    desc = {(r["record_name"], r["var"]): r for r in archives.describe_entries(manifest, ["cc", "tmp"]).collect()}
    assert desc[("pgbh02.gdas.1979010100.grb2", "tmp")]["dims"] == [2, 2, 3]
    assert desc[("pgbh02.gdas.1979010100.grb2", "cc")]["n_missing"] == 0
    assert desc[("pgbh02.gdas.1979010112.grb2", "tmp")]["reason"] == "missing variable"
    assert desc[("pgbh02.gdas.1979010200.grb2", "tmp")]["dims"] == [1, 2, 2, 3]
    assert desc[("pgbh02.gdas.1979010118.grb2", None)]["reason"].startswith("NetCDFError")
    good, bad = archives.split_quarantine(archives.decode_entries(manifest, _layout(spark), 4))
    reasons = {r["record_name"]: r["reason"] for r in bad.collect()}
    assert set(reasons) == {"pgbh02.gdas.1979010112.grb2", "pgbh02.gdas.1979010118.grb2", "pgbh02.gdas.1979010200.grb2"}
    assert "missing variable tmp" in reasons["pgbh02.gdas.1979010112.grb2"]
    assert "rank 4" in reasons["pgbh02.gdas.1979010200.grb2"]
    from gridframe.operators import matrix

    vecs = {r["record_name"]: r["values"] for r in matrix.unsegment(good).collect()}
    assert set(vecs) == {"pgbh02.gdas.1979010100.grb2", "pgbh02.gdas.1979010106.grb2", "pgbh02.gdas.1979010300.grb2"}
    want = np.concatenate([cc.ravel(), tmp.ravel()])
    assert np.array_equal(np.array(vecs["pgbh02.gdas.1979010100.grb2"], np.float32), want)
    assert np.array_equal(np.array(vecs["pgbh02.gdas.1979010300.grb2"], np.float32), want + 2)
    # resume: nothing pending once every entry is accounted for
    done = good.select("archive_path", "entry_idx").unionByName(bad.select("archive_path", "entry_idx"))
    assert store.pending_entries(manifest, done).count() == 0
    assert store.pending_entries(manifest, good.select("archive_path", "entry_idx").distinct()).count() == 3


def test_mask_nan_fill_and_float_cast(spark):
    df = spark.createDataFrame([("r", [1.0, float("nan"), 1e20])], "record_name string, values array<float>")
    nan_mask = grid.missing_mask(df, float("nan")).first()["mask"]
    big_mask = grid.missing_mask(df, 1e20).first()["mask"]
    assert nan_mask == [False, True, False]
    assert big_mask == [False, False, True]


def test_cells_to_segments_fills_absent_blocks(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 9, 2.0), ("b", 5, 3.0)],
                                  "record_name string, pos long, value double")
    seg = grid.cells_to_segments(cells, 10, 4, -1.0)
    from gridframe.operators import matrix

    got = {r["record_name"]: r["values"] for r in matrix.unsegment(seg).collect()}
    assert got["a"] == [1.0] + [-1.0] * 8 + [2.0]
    assert got["b"] == [-1.0] * 5 + [3.0] + [-1.0] * 4


def test_split_valid_and_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, 2.0]), ("c", [3.0, 4.0])],
                               "record_name string, values array<float>")
    good, bad = verify.split_valid(df, 2)
    assert [r["record_name"] for r in good.collect()] == ["a"]
    assert sorted((r["record_name"], r["reason"]) for r in bad.collect()) == [
        ("b", "length 1"), ("c", "duplicate record name"), ("c", "duplicate record name")]
    lens = {r["record_name"]: r["is_ok"] for r in verify.check_lengths(df.where(F.col("record_name") != "c")).collect()}
    assert lens == {"a": True, "b": False}


def test_variable_group_join_reports_absent(spark):
    g0 = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "record_name string, values array<float>")
    g1 = spark.createDataFrame([("a", [3.0]), ("c", [4.0])], "record_name string, values array<float>")
    out = {r["record_name"]: (r["values"], r["missing_groups"]) for r in grid.join_variable_groups([g0, g1]).collect()}
    assert out == {"a": ([1.0, 3.0], []), "b": (None, [1]), "c": (None, [0])}


def test_segment_completeness(spark):
    import pytest

    from gridframe.operators import matrix

    df = spark.createDataFrame([("a", [1.0] * 10), ("b", [1.0] * 7), ("c", [2.0] * 10)],
                               "record_name string, values array<float>")
    seg = matrix.segment(df, 4)
    dup = seg.where(F.col("record_name") == "c").unionByName(seg)
    bad = {r["record_name"]: r["reason"] for r in verify.segment_completeness(dup, 10, 4).collect()}
    assert bad == {"b": "blocks 2", "c": "repeated segments (duplicate record name)"}
    with pytest.raises(verify.ValidationError, match="2 records with incomplete segments"):
        verify.require_complete(dup, 10, 4)
    verify.require_complete(seg.where(F.col("record_name") != "b"), 10, 4)


def test_segment_completeness_short_tail(spark):
    from gridframe.operators import matrix

    df = spark.createDataFrame([("a", [1.0] * 10), ("b", [1.0] * 9)], "record_name string, values array<float>")
    bad = {r["record_name"]: r["reason"] for r in verify.segment_completeness(matrix.segment(df, 4), 10, 4).collect()}
    assert bad == {"b": "last block length 1"}


def test_read_variable_level(spark, tmp_dir):
    cc = np.arange(6, dtype=np.float32).reshape(2, 3)
    tmp = np.arange(12, dtype=np.float32).reshape(2, 2, 3) + 100
    _tar(os.path.join(tmp_dir, "b.tar"), [("pgbh02.gdas.1979010100.grb2", _nc(cc, tmp)),
                                          ("pgbh02.gdas.1979010106.grb2", _nc(cc, tmp, drop="tmp"))])
    manifest = archives.expand_archives(spark.createDataFrame([(os.path.join(tmp_dir, "b.tar"),)], "archive_path string"))
    rows = {r["record_name"]: r for r in archives.read_variable(manifest, "tmp", level=1).collect()}
    good = rows["pgbh02.gdas.1979010100.grb2"]
    assert good["dims"] == [2, 3] and good["values"] == tmp[1].ravel().tolist() and good["reason"] is None
    assert rows["pgbh02.gdas.1979010106.grb2"]["reason"].startswith("NetCDFError")
    whole = archives.read_variable(manifest, "cc").where("reason IS NULL").first()
    assert whole["dims"] == [2, 3] and whole["fill"] == np.float32(1e20)


def test_one_archive_of_all_records(spark, tmp_dir):
    """Encoded by many tasks, committed once; a second attempt replaces the file."""
    vec = spark.createDataFrame([("all.tar", f"r{i:04d}", [float(i)] * 4) for i in range(300)],
                                "archive_name string, record_name string, values array<float>").repartition(8)
    written = archives.write_grid_archives(vec, tmp_dir, [("v", 0, 4, (2, 2))])
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "FlatMapGroups" not in plan
    for _ in range(2):
        assert [tuple(r) for r in written.collect()] == [("all.tar", os.path.join(tmp_dir, "all.tar"), 300)]
        assert os.listdir(tmp_dir) == ["all.tar"]
    listed = archives.expand_archives(spark.createDataFrame([(os.path.join(tmp_dir, "all.tar"),)], "archive_path string")).collect()
    assert [r["record_name"] for r in sorted(listed, key=lambda r: r["entry_idx"])] == [f"r{i:04d}" for i in range(300)]


def test_listing_reports_what_it_cannot_read(spark, tmp_dir):
    vec = spark.createDataFrame([("a.tar", f"r{i}", [1.0] * 4) for i in range(5)], "archive_name string, record_name string, values array<float>")
    archives.write_grid_archives(vec, tmp_dir, [("v", 0, 4, (2, 2))]).collect()
    path = os.path.join(tmp_dir, "a.tar")
    raw = open(path, "rb").read()
    third = [r for r in archives.expand_archives(spark.createDataFrame([(path,)], "archive_path string")).collect() if r["entry_idx"] == 3][0]
    cut = third["data_offset"] - 512
    cases = {"whole.tar": raw, "cut.tar": raw[:cut + 200], "bad.tar": raw[:cut] + b"x" * 300 + raw[cut + 300:], "empty.tar": b"",
             "header.tar": b"y" * 1024, "no-mark.tar": raw[:cut]}
    for name, data in cases.items():
        with open(os.path.join(tmp_dir, name), "wb") as fh:
            fh.write(data)
    paths = spark.createDataFrame([(os.path.join(tmp_dir, n),) for n in [*cases, "absent.tar"]], "archive_path string")
    got = {}
    for r in archives.expand_archives(paths).collect():
        got.setdefault(os.path.basename(r["archive_path"]), []).append(r["reason"] is None)
    assert sorted(got.pop("whole.tar")) == [True] * 5
    for name in ("cut.tar", "bad.tar", "no-mark.tar"):
        assert sorted(got.pop(name)) == [False, True, True, True], name
    assert got == {"empty.tar": [False], "header.tar": [False], "absent.tar": [False]}


def test_wrong_shapes_are_refused(spark):
    from gridframe.sources import netcdf

    spec = archives.layout_spec(grid.layout_offsets(spark.createDataFrame(
        [("v", 0, 1, 2, 3)], "var string, var_pos int, n_levels int, n_lat int, n_lon int")))
    fill = {"_FillValue": np.float32(1e20)}
    for shape, ok in (((2, 3), True), ((3, 2), False), ((1, 2, 3), True), ((6, 1), False)):
        names = [f"d{i}" for i in range(len(shape))]
        ds = netcdf.loads(netcdf.dumps(dict(zip(names, shape)), [("v", names, np.zeros(shape, np.float32), fill)]))
        if ok:
            assert archives.vectorize(ds, spec, 6).shape == (6,)
        else:
            with pytest.raises(ValueError, match="shape"):
                archives.vectorize(ds, spec, 6)


def test_placement_is_checked(spark):
    layout = grid.layout_offsets(spark.createDataFrame([("a", 0, 1, 2, 3), ("b", 1, 1, 2, 3)],
                                                       "var string, var_pos int, n_levels int, n_lat int, n_lon int"))
    ddl = "record_name string, var string, values array<float>"
    both = [("r", "a", [1.0] * 6), ("r", "b", [2.0] * 6)]
    assert grid.to_record_segments(spark.createDataFrame(both, ddl), layout, 4).count() == 3
    for rows in ([both[1]], [both[0]] * 2 + [both[1]], [("r", "a", [1.0] * 5), both[1]]):
        with pytest.raises(Exception, match="record r"):
            grid.to_record_segments(spark.createDataFrame(rows, ddl), layout, 4).collect()
    for cells in ([("r", 12, 1.0)], [("r", 3, 1.0), ("r", 3, 2.0)], [("r", -1, 1.0)]):
        with pytest.raises(Exception, match="outside the record|given twice"):
            grid.cells_to_segments(spark.createDataFrame(cells, "record_name string, pos long, value float"), 10, 4, 0.0).collect()


def test_archives_of_records_in_pieces(spark, tmp_dir):
    """Piece by piece the same files as from whole rows; a missing piece fails."""
    rows = [(f"a{i % 2}.tar", f"r{i}", [float(10 * i + k) for k in range(10)]) for i in range(5)]
    vec = spark.createDataFrame(rows, "archive_name string, record_name string, values array<float>")
    spec = [("v", 0, 4, (2, 2)), ("w", 4, 6, (6,))]
    archives.write_grid_archives(vec, f"{tmp_dir}/whole", spec).collect()
    pieces = matrix.segment(vec, 3, ("archive_name", "record_name")).withColumnRenamed("block_id", "piece").repartition(3)
    done = archives.write_grid_archives(pieces, f"{tmp_dir}/pieces", spec, piece_col="piece").collect()
    assert sorted((r["archive_name"], r["n_entries"]) for r in done) == [("a0.tar", 3), ("a1.tar", 2)]
    for name in ("a0.tar", "a1.tar"):
        assert open(f"{tmp_dir}/whole/{name}", "rb").read() == open(f"{tmp_dir}/pieces/{name}", "rb").read()
    for gone, said in ((1, "where piece 1"), (3, "fewer cells")):
        with pytest.raises(Exception, match=said):
            archives.write_grid_archives(pieces.where(f"record_name <> 'r2' or piece <> {gone}"), f"{tmp_dir}/bad", spec, piece_col="piece").collect()
