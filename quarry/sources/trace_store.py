"""Trace documents with evaluation write-back.

A store is a folder with
* ``messages/``: message rows, written once; a trace is spread over files by ``seq div chunk``;
* ``headers/<attempt>/bucket=<b>/``: one row a document, its metadata columns and
  ``evaluation`` (JSON text or null), bucketed by a hash of the trace id;
* ``commits/<version>``: one small JSON file a version that names the attempt each bucket is read from.

``write_evaluation`` writes only the buckets its evaluations fall into and then
renames the commit file into place, so a version appears whole or not at all: a
failed or interrupted write leaves the version before it, as do lost executors.
Of two writers of the same version the later one gets an error and may try again.

Cases: an evaluation replaces the document's earlier one; documents without one keep theirs; evaluations
of unknown or null traces are left out, as there is no document to hold them.  Of
several rows for one trace the largest JSON text stays.  Documents that repeat an id each get its
evaluation.  An empty evaluation table gives a new version equal to the last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
LEFT_OUT = ("file_name", "eval_steps")  # bookkeeping of the evaluation run, not part of a document


def _bucket(trace: str):
    return F.pmod(F.xxhash64(F.col(trace).cast("string")), F.lit(BUCKETS)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    p, fs = _hadoop(spark, f"{root}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, root: str, version: int | None) -> tuple[int, dict[int, str]]:
    version = versions(spark, root)[-1] if version is None else version
    p, fs = _hadoop(spark, f"{root}/commits/{version:010d}")
    f = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()
    return version, {int(b): a for b, a in json.loads(text).items()}


def _commit(spark: SparkSession, root: str, version: int, manifest: dict[int, str]) -> None:
    """Write the manifest beside its place, then rename it there; fails if the version is taken."""
    tmp, fs = _hadoop(spark, f"{root}/commits/.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    dst = jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{version:010d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # never overwrites
    context.rename(fs.makeQualified(tmp), fs.makeQualified(dst), plain)


def _write_headers(headers: DataFrame, root: str, trace: str) -> str:
    """Bucketed header files of one attempt; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    headers.withColumn("bucket", _bucket(trace)).repartition("bucket").write.mode("errorifexists") \
        .partitionBy("bucket").parquet(f"{root}/headers/{attempt}")
    return attempt


def create(messages: DataFrame, metadata: DataFrame, root: str, trace: str = "trace_id", chunk: int = 4096) -> None:
    """Version 1: ``messages`` (trace, seq, ...) and one ``metadata`` row a document, without evaluations."""
    spark = metadata.sparkSession
    messages.repartition(trace, F.floor(F.col("seq") / chunk)).write.mode("errorifexists").parquet(f"{root}/messages")
    attempt = _write_headers(metadata.withColumn("evaluation", F.lit(None).cast("string")), root, trace)
    # a bucket without files is read as empty
    _commit(spark, root, 1, {b: attempt for b in range(BUCKETS)})


def _read_headers(spark: SparkSession, root: str, manifest: dict[int, str], buckets) -> DataFrame:
    """Header rows of ``buckets``; each attempt's files are one scan pruned to its buckets."""
    out = None
    for attempt in sorted({manifest[b] for b in buckets}):
        mine = [b for b in buckets if manifest[b] == attempt]
        part = spark.read.parquet(f"{root}/headers/{attempt}").where(F.col("bucket").isin(mine)).drop("bucket")
        out = part if out is None else out.unionByName(part)
    return out


def write_evaluation(evaluation: DataFrame, root: str, trace: str = "trace_id") -> int:
    """Merge one row a trace into the documents; returns the new version.

    Every column but the key, ``file_name`` and ``eval_steps`` goes into the document's ``evaluation``.
    """
    from quarry.session import cut_lineage
    spark = evaluation.sparkSession
    version, manifest = _manifest(spark, root, None)
    kept = [c for c in evaluation.columns if c != trace and c not in LEFT_OUT]
    # read twice: for the buckets it touches (at most BUCKETS rows) and for the merge
    new = cut_lineage(evaluation.where(F.col(trace).isNotNull())
                      .select(trace, F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("_new"))
                      .groupBy(trace).agg(F.max("_new").alias("_new")), "evaluation")
    touched = [r.bucket for r in new.select(_bucket(trace).alias("bucket")).distinct().collect()]
    if touched:
        old = _read_headers(spark, root, manifest, touched)
        merged = old.join(new, trace, "left").withColumn("evaluation", F.coalesce("_new", "evaluation"))
        attempt = _write_headers(merged.select(*old.columns), root, trace)
        manifest.update({b: attempt for b in touched})
    _commit(spark, root, version + 1, manifest)
    return version + 1


def read_documents(spark: SparkSession, root: str, evaluation_schema: str, version: int | None = None) -> DataFrame:
    """One row a document of a version (default: the last): metadata columns and ``evaluation`` as a struct."""
    _, manifest = _manifest(spark, root, version)
    return _read_headers(spark, root, manifest, sorted(manifest)) \
        .withColumn("evaluation", F.from_json("evaluation", evaluation_schema))


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """The documents' messages in long form."""
    return spark.read.parquet(f"{root}/messages")
