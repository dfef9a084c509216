"""Spark session helpers.

Cluster settings (executors, memory, checkpoint folder) belong to whoever
submits the job; the helpers here only fill in what is unset so that the
same code runs in tests on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with quarry's defaults.

    ``master`` is only used when no session exists yet (tests / bench);
    on a cluster the submitter's master wins.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage by the
    submitter.  Only when it is unset (local tests) do we create one, so a
    machine-local folder is never used on a real cluster.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("QUARRY_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df, name: str = "table"):
    """Store an intermediate once and continue from the stored copy.

    The rows are written as Parquet under the shared checkpoint folder and
    read back: one computation (an RDD checkpoint would compute the input a
    second time for its write), lineage cut at the files, and later readers
    get Parquet column pruning.  Never ``localCheckpoint``: the files
    survive executor loss.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (pandas UDF closures refer
    to it): zip the package once per session and ``addPyFile`` it, which is
    how code reaches executors on a cluster too."""
    key = id(spark.sparkContext)
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pkg-", dir=os.environ.get("QUARRY_SCRATCH", "/tmp"))
    zpath = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg), "quarry")
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(key)
