"""Structured Streaming forms of the incremental jobs.

Sources are file streams (new trace / event files arriving in a folder);
each job runs with ``trigger(availableNow=True)`` so a scheduled run drains
what has arrived and stops.  The caller names a folder; results, state and
progress live there, so the next run with the same folder (after a stop, a
crash or a lost executor) goes on where the last one ended.  Without a folder a
new one under the session's shared ``spark.checkpoint.dir`` is used.

Outputs go through ``foreachBatch`` into one Parquet folder a batch, named by
the batch id: a batch that is run again replaces its own folder.  In
``complete`` mode the newest folder is the result, in ``append`` mode all are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, cut_lineage


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A file stream over parquet event files (schema taken from the data); a
    batch takes all files that have arrived unless ``max_files`` limits it."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _batches(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(batch id, path) of the batch folders that were written whole."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for st in fs.listStatus(base):
        path = st.getPath()
        if path.getName().startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            found.append((int(path.getName()[6:]), path.toString()))
    return sorted(found)


def _drain(stream: DataFrame, folder: str, mode: str, write) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    q.awaitTermination()


def tool_health(events: DataFrame, window: str = "1 hour", slide: str | None = None,
                watermark: str = "2 hours") -> DataFrame:
    """Per event-time window and tool: calls, errors, success rate.
    Rows later than the watermark are dropped by the engine."""
    # the watermark must sit on the very column the window groups by
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = e.groupBy(w.alias("w"), F.col("event_type").alias("tool")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "tool", "n", "n_error",
                    F.round(1 - F.col("n_error") / F.col("n"), 6).alias("success_rate"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour",
             user: str = "user_id") -> DataFrame:
    """Session windows per user (a session ends after ``gap`` idle)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    g = e.groupBy(F.session_window("ts", gap).alias("s"), user).agg(F.count("*").alias("n_events"))
    return g.select(user, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def new_items(events: DataFrame, name: str, key: list[str], folder: str | None = None,
              order: tuple[str, ...] = ("ts", "event_id"), buckets: int = 64, merge_after: int = 16) -> DataFrame:
    """First arrival of each key, ever: keys seen in any earlier batch or run
    of ``folder`` are skipped, e.g. traces whose task was evaluated before.

    The seen keys are a table beside the stream, not operator state, so they
    outlive any watermark: ``keys/batch-<id>`` holds the keys that a batch saw first,
    by bucket of their hash.  A batch is reduced to one row a key, reads only the buckets it
    touches (at most ``buckets`` numbers reach the driver) and anti-joins them.  After ``merge_after``
    such folders a batch writes the keys of all of them with its own, and later batches begin there.  A batch
    that runs again sees only earlier ones and replaces its folders.

    Of several rows of a key in one batch the first by ``order`` stays; null key
    parts are equal to each other.  Empty batches add nothing.
    """
    spark = events.sparkSession
    base = folder or _scratch(spark, name)
    cols = events.columns

    def seen_folders(batch_id: int) -> list[str]:
        whole = [(i, p) for i, p in _batches(spark, f"{base}/merged") if i < batch_id][-1:]
        since = whole[0][0] if whole else -1
        return [p for _, p in whole] + [p for i, p in _batches(spark, f"{base}/keys") if since < i < batch_id]

    def skip_seen(batch: DataFrame, batch_id: int):
        first = cut_lineage(batch.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
                            .select(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket"), "_r.*"), name)
        folders = seen_folders(batch_id)
        new, seen = first, None
        for p in folders:
            part = spark.read.schema(first.select(*key, "_bucket").schema).option("basePath", p).parquet(p)
            seen = part if seen is None else seen.unionByName(part)
        if seen is not None:
            touched = [r[0] for r in first.select("_bucket").distinct().collect()]
            known = seen.where(F.col("_bucket").isin(touched)).alias("s")
            same = F.col("n._bucket") == F.col("s._bucket")
            for c in key:
                same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
            new = first.alias("n").join(known, same, "left_anti")
        new.drop("_bucket").write.mode("overwrite").parquet(f"{base}/result/batch-{batch_id:09d}")
        keys = spark.read.schema(events.schema).parquet(f"{base}/result/batch-{batch_id:09d}") \
            .select(*key, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket"))
        _by_bucket(keys, f"{base}/keys/batch-{batch_id:09d}")
        if len(folders) >= merge_after:
            _by_bucket(seen.unionByName(keys), f"{base}/merged/batch-{batch_id:09d}")

    _drain(events, base, "append", skip_seen)
    done = [p for _, p in _batches(spark, f"{base}/result")]
    return spark.read.schema(events.schema).parquet(*done) if done else spark.createDataFrame([], events.schema)


def _by_bucket(keys: DataFrame, path: str) -> None:
    keys.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def run_available_now(stream: DataFrame, name: str, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Drain what has arrived and return the result so far as a batch DataFrame.
    ``append`` emits a window once the watermark has closed it and keeps only
    open ones in its state; ``complete`` keeps and rewrites them all."""
    spark = stream.sparkSession
    base = folder or _scratch(spark, name)

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{base}/result/batch-{batch_id:09d}")

    _drain(stream, base, mode, write)
    done = [p for _, p in _batches(spark, f"{base}/result")]
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*(done if mode != "complete" else done[-1:]))


def cache_upsert_stream(requests: DataFrame, name: str, key: str = "hash",
                        order: tuple[str, ...] = ("timestamp", "event_id"), folder: str | None = None) -> DataFrame:
    """T4: last-write-wins cache maintained by micro-batches.

    Each batch reduces its rows to the latest per key (an aggregate), then
    writes a new snapshot = the newest earlier snapshot in storage with the
    batch's winners merged in (never an in-place update)."""
    spark = requests.sparkSession
    base = folder or _scratch(spark, name)

    def latest(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")) \
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])

    def upsert(batch: DataFrame, batch_id: int):
        merged = latest(batch)
        earlier = [p for i, p in _batches(spark, f"{base}/snapshots") if i < batch_id]
        if earlier:
            merged = latest(spark.read.parquet(earlier[-1]).unionByName(merged))
        merged.write.mode("overwrite").parquet(f"{base}/snapshots/batch-{batch_id:09d}")

    _drain(requests, base, "append", upsert)
    done = _batches(spark, f"{base}/snapshots")
    return spark.read.parquet(done[-1][1]) if done else spark.createDataFrame([], requests.schema)
