"""File-corpus sources: manifest, physical lines, CSV records, decoding.

S1 ``file_manifest``  listing with relative path / extension / size / mtime.
S2 ``raw_lines``      numbered physical lines (a quoted multi-line cell is
                      several lines), CR/LF stripped.
S3 ``decode_fallback`` utf-8 first, then an Arrow-batched decoder hook for
                      the GBK family / utf-16 / latin-1.
S4 ``csv_records``    record-level CSV (no header, no NA inference).

Small files are read one row per file (``binaryFile``), so every per-file
operator (grep context, slices, previews, chunking) is a narrow per-row
array expression with no shuffle.  Very many small files cost a listing, an open
and a rename each, so they may lie in bundles, which are one file to the file
system.  A file too large for one row is read
with the ``text`` source instead, which Spark splits across tasks; its line
numbers come from a per-partition offset table (one row per partition,
broadcast — size bounded by the partition count, not the data).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_lines

# fixed values: extensions the corpus scan picks up, and grep's wider list
TABLE_EXTENSIONS = (".csv", ".xlsx", ".xls", ".tsv")
GREP_EXTENSIONS = ("csv", "xlsx", "xls", "tsv", "txt", "py")
# fixed values: directories grep never enters
SKIP_DIRS = ("__pycache__", ".git", "node_modules", ".venv")
# fixed values: decode order tried by the reader
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030", "utf-16", "latin-1")


def _with_manifest_columns(df: DataFrame, root: str) -> DataFrame:
    root = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^file:", "")
    return df.select(
        path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30))
         .otherwise(path).alias("relative_path"),
        F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]*)$", 1).alias("extension"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def file_manifest(spark: SparkSession, folder: str, extensions=TABLE_EXTENSIONS) -> DataFrame:
    """Recursive listing, suffix match exact and case-sensitive.

    ``binaryFile`` lists and stats in parallel; ``content`` is never
    selected, so Spark does not read file bodies.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
          .select("path", "length", "modificationTime"))
    m = _with_manifest_columns(df, folder)
    cond = F.lit(False)
    for e in extensions:
        cond = cond | F.endswith(F.col("name"), F.lit(e))
    return m.where(cond)


def read_file_texts(spark: SparkSession, folder: str, glob: str | None = None,
                    strip_bom: bool = False, bundled: bool = False) -> DataFrame:
    """One row per file: ``(path, text)``; utf-8 or the decoder hook (S3).

    ``bundled``: what lies in the folder are bundles (``sinks.bundle_sink``); a file's
    path is that of its bundle and its name, and each file is decoded by itself."""
    from quarry.session import ship_package
    ship_package(spark)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(folder).select(F.regexp_replace("path", r"^file:", "").alias("path"), "content")
    if bundled:
        df = df.mapInArrow(bundle_files, "path string, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")) \
        .otherwise(decode_fallback_udf(F.col("content")))
    if strip_bom:
        text = F.regexp_replace(text, "^﻿", "")
    return df.select("path", text.alias("text"))


def bundle_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: bundles -> their files.  A file lies behind a line with
    its length in bytes and its name."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at, paths, parts = content.as_py(), 0, [], []
            while at < len(data):
                start = data.index(b"\n", at) + 1
                size, _, name = data[at:start - 1].partition(b" ")
                at = start + int(size)
                paths.append(f"{path}/{name.decode()}")
                parts.append(data[start:at])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(parts, pa.binary())], ["path", "content"])


@F.pandas_udf(T.StringType())
def decode_fallback_udf(content: pd.Series) -> pd.Series:
    """X5 decode hook: the fallback order, Arrow-batched (no per-row JVM trip)."""
    def dec(b):
        if b is None:
            return None
        for enc in ENCODINGS:
            try:
                return bytes(b).decode(enc)
            except (UnicodeDecodeError, LookupError):
                continue
        return bytes(b).decode("utf-8", errors="ignore")
    return content.map(dec)


def file_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Per-file array form: ``(…, lines ARRAY<STRING>, n_lines)``."""
    return files.withColumn("lines", split_lines(F.col(text_col))) \
        .withColumn("n_lines", F.size("lines")).drop(text_col)


def raw_lines(files: DataFrame, text_col: str = "text", keys=("path",)) -> DataFrame:
    """``(keys…, line_no INT 1-based, line)`` — a narrow posexplode."""
    return files.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")) \
        .select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def big_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """S2 for text too big for one row, in one file or in a folder of files in
    the order of their names: split by Spark, numbered by offsets.

    A split is known by its file and first byte, and its lines keep their order
    inside a task (``monotonically_increasing_id``); the lines of earlier splits
    (one row a split) give each split's first number.
    """
    from pyspark.sql import Window as W
    raw = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    upto = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("off"))
    return raw.join(F.broadcast(offsets), ["file", "block"]).select(
        F.lit(path).alias("path"), (F.col("off") + F.col("mid") - F.col("first") + 1).cast("long").alias("line_no"), "line")


def csv_records(spark: SparkSession, paths, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """Record-level CSV, every column STRING, quoted newlines kept.

    Ragged rows are kept (PERMISSIVE) instead of failing the whole read.
    """
    return (spark.read.option("header", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt_col)
            .csv(paths).withColumn("path", F.input_file_name()))
