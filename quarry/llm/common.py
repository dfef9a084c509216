"""Helpers shared by the training-data operators."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.session import checkpoint_dir, ship_package

#: Arrow batches handed to Python: at most so many rows and bytes, so that a
#: run of very long texts does not fill a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = "8m"
#: Seconds between two collections of the driver's garbage.
RELEASE_S = 10
_released = 0.0
#: Spark's setting by which an execution's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable in workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once under the shared checkpoint folder and go on
    from the files: lineage is cut, a lost executor costs no recomputation and
    later readers get column pruning.  The write's shuffle files go when it ends,
    not whenever the driver drops its plan; other plans that nothing refers to are released now and then."""
    global _released
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if time.monotonic() - _released >= RELEASE_S:  # a collection of the driver's garbage each time costs more than many small writes
        release(spark)
        _released = time.monotonic()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``store`` once no later plan reads it."""
    path = getattr(df, "_stored_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop unreferenced plans; their shuffle files go with them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What operators keep in a worker process for their later tasks.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What ``operator`` keeps in this worker process from task to task.  What others kept here is
    dropped and what they freed goes back to the system: Spark reuses its workers, whose memory would
    else hold the words and the largest batches of all operators that ran."""
    others = _kept.keys() - {operator}
    for other in others:
        del _kept[other]
    if others:
        give_back()
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Return freed memory to the system, which Arrow's and the C library's allocators hold on to."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))
