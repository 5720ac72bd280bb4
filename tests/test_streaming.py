import os

import numpy as np

from gridframe.operators import grid
from gridframe.plans import jobs
from gridframe.sources import archives
from gridframe.streaming import start_ingest


def test_incremental_ingest(spark, tmp_dir):
    rng = np.random.default_rng(11)
    names = [f"pgbh02.gdas.197902{d:02d}00.grb2" for d in range(1, 11)]
    data = rng.standard_normal((10, 12)).astype(np.float32)
    vec = spark.createDataFrame(
        [(f"pgbh02.gdas.{'19790201-19790205' if i < 5 else '19790206-19790210'}.tar", n, data[i].tolist())
         for i, n in enumerate(names)],
        "archive_name string, record_name string, values array<float>",
    )
    root = os.path.join(tmp_dir, "raw")
    archives.write_grid_archives(vec, root, [("v", 0, 12, (3, 4))]).collect()
    layout = grid.layout_offsets(spark.createDataFrame([("v", 0, 1, 3, 4)],
                                                       "var string, var_pos int, n_levels int, n_lat int, n_lon int"))
    lists, out, ckpt = (os.path.join(tmp_dir, d) for d in ("lists", "store", "ckpt"))
    os.makedirs(lists)
    with open(os.path.join(lists, "a.txt"), "w") as fh:
        fh.write("pgbh02.gdas.19790201-19790205.tar\n")
    start_ingest(spark, lists, root, layout, out, ckpt, block_size=5).awaitTermination(300)
    assert jobs.segments(spark, f"{out}/decoded").select("record_name").distinct().count() == 5
    with open(os.path.join(lists, "b.txt"), "w") as fh:
        fh.write("pgbh02.gdas.19790201-19790205.tar\npgbh02.gdas.19790206-19790210.tar\n")
    start_ingest(spark, lists, root, layout, out, ckpt, block_size=5).awaitTermination(300)
    seg = jobs.segments(spark, f"{out}/decoded")
    assert seg.select("record_name").distinct().count() == 10
    assert seg.count() == 10 * 3  # 12 cells in blocks of 5: no duplicates from the repeated archive
