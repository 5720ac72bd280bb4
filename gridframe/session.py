"""Session helpers: recommended configuration and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every gridframe job relies on. AQE re-plans joins and coalesces
# shuffle partitions at run time; the session zone is pinned so record names
# (which carry no zone) always mean UTC.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are gone (dense-index sorts) are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "gridframe", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the recommended settings.

    ``master`` is left to ``spark-submit`` unless given (tests and the bench
    pass ``local[N]``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses the session's ``spark.checkpoint.dir`` (or the directory already set
    on the context). Only a local-mode session without one gets a fresh
    folder of its own; a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridframe-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridframe/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so Python code in tasks can open the path."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


def is_local_uri(uri: str) -> bool:
    return uri.startswith("file:") or uri.startswith("/") or "://" not in uri


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gridframe`` importable in the Python workers (as
    ``spark-submit --py-files`` would): zip the package once per application
    and ``addPyFile`` it. Called by every operator that runs Python tasks."""
    import zipfile

    import gridframe

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(gridframe.__file__))
    base = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="gridframe-pyfiles-"), "gridframe.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, base))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
