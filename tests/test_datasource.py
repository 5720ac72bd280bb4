"""The archive data source: byte ranges, pushed filters, bytes read."""

import os

import numpy as np

from gridframe.sources import archives, datasource

from test_plans import plan_of


def written(spark, tmp_dir):
    rng = np.random.default_rng(8)
    data = rng.standard_normal((12, 6 + 4 * 2000)).astype(np.float32)
    rows = [(f"a{i // 6}.tar", f"r{i:02d}", data[i].tolist()) for i in range(12)]
    root = os.path.join(tmp_dir, "raw")
    archives.write_grid_archives(spark.createDataFrame(rows, "archive_name string, record_name string, values array<float>"), root,
                                 [("cc", 0, 6, (2, 3)), ("t", 6, 8000, (4, 40, 50))]).collect()
    return root, data


def test_reads_every_plane_once_over_byte_ranges(spark, tmp_dir):
    root, data = written(spark, tmp_dir)
    datasource.register(spark)
    df = spark.read.format("gridarchive").option("partitionBytes", 50_000).load(root)
    assert df.rdd.getNumPartitions() == sum(-(-os.path.getsize(f"{root}/a{k}.tar") // 50_000) for k in (0, 1)) > 4
    got = {(r["record_name"], r["var"], r["level"]): r["values"] for r in df.collect()}
    assert len(got) == 12 * 5
    for i in range(12):
        assert np.array_equal(np.array(got[f"r{i:02d}", "cc", 0], np.float32), data[i, :6])
        for k in range(4):
            assert np.array_equal(np.array(got[f"r{i:02d}", "t", k], np.float32), data[i, 6 + 2000 * k:2006 + 2000 * k])


def test_filters_reach_the_reader(spark, tmp_dir):
    root, data = written(spark, tmp_dir)
    datasource.register(spark)
    df = spark.read.format("gridarchive").load(root).where("record_name = 'r07' AND var IN ('t') AND level IN (1, 2)")
    got = df.collect()
    plan = plan_of(df)
    assert sorted(r["level"] for r in got) == [1, 2] and {r["record_name"] for r in got} == {"r07"}
    scan = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert scan and "EqualTo(record_name,r07)" in scan[0]


def test_bytes_fall_with_the_filters(spark, tmp_dir, monkeypatch):
    root, _ = written(spark, tmp_dir)
    read, real = [], archives._open

    class Counting:
        def __init__(self, fh):
            self.fh = fh

        def read(self, n=-1):
            raw = self.fh.read(n)
            read.append(len(raw))
            return raw

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.fh.close()

        def __getattr__(self, name):
            return getattr(self.fh, name)

    monkeypatch.setattr(archives, "_open", lambda p: Counting(real(p)))

    def cost(*filters):
        reader = datasource.ArchiveReader({"path": root})
        kept = list(reader.pushFilters(list(filters)))
        read.clear()
        rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        return rows, sum(read), kept

    whole = cost()
    assert whole[0] == 60 and whole[2] == []
    record = cost(datasource.EqualTo(("record_name",), "r03"))
    level = cost(datasource.In(("var",), ("t",)), datasource.EqualTo(("level",), 2))
    assert record[0] == 5 and record[1] < whole[1] / 6
    assert level[0] == 12 and level[1] < whole[1]
    other = datasource.EqualTo(("archive_path",), "x")
    assert cost(other)[2] == [other]  # not ours to apply
