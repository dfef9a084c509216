"""Sinks and JSON sources.

Writers never overwrite an input in place: results go to a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("info_item", T.StringType()),
                     T.StructField("answer", T.StringType()),
                     T.StructField("related_tables", T.ArrayType(T.StringType())),
                     T.StructField("score_points", T.ArrayType(T.StringType()))])
SAMPLE = T.StructType([T.StructField("task", T.StringType()), T.StructField("question", T.StringType()),
                       T.StructField("answer", T.StringType()), T.StructField("table_path", T.StringType()),
                       T.StructField("score_points", T.ArrayType(T.StringType())),
                       T.StructField("design", T.StructType([T.StructField("type", T.StringType()),
                                                             T.StructField("checkout_list", T.ArrayType(STEP))]))])
CALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
                     T.StructField("function", T.StructType([T.StructField("name", T.StringType()),
                                                             T.StructField("arguments", T.StringType())]))])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
                        T.StructField("reasoning_content", T.StringType()),
                        T.StructField("tool_call_id", T.StringType()),
                        T.StructField("tool_calls", T.ArrayType(CALL))])
TRACE = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("query", T.StringType()),
                                            T.StructField("table_path", T.StringType()),
                                            T.StructField("total_turns", T.IntegerType()),
                                            T.StructField("timestamp", T.StringType()),
                                            T.StructField("success", T.BooleanType())])),
    T.StructField("conversation_trace", T.ArrayType(T.StructType([
        T.StructField("turn", T.IntegerType()), T.StructField("timestamp", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("response", T.StructType([T.StructField("content", T.StringType()),
                                                T.StructField("tool_calls", T.ArrayType(CALL))]))]))),
    T.StructField("_corrupt_record", T.StringType())])


def samples_source(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Samples (JSON array or JSONL) with an explicit schema and ``ord``
    = file order (``monotonically_increasing_id`` is ordered within and
    across the splits of one file)."""
    r = spark.read.schema(SAMPLE)
    df = r.json(path) if json_lines else r.option("multiLine", True).json(path)
    return df.withColumn("ord", F.monotonically_increasing_id()) \
        .withColumn("task", F.coalesce(F.nullif("task", F.lit("")), "question")) \
        .withColumn("table_path", F.when(F.col("table_path").isNotNull(), F.array("table_path")))


def trace_source(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Every ``*.json`` trace in a folder (non-recursive); unreadable
    files are dropped; a trace's id is the document's own, else its file's name;
    the last turn's response is appended as an
    assistant message.  Output: message rows ``(trace_id, seq, role, …)``."""
    df = spark.read.schema(TRACE).option("multiLine", multi_line).option("mode", "PERMISSIVE") \
        .option("pathGlobFilter", "*.json").json(folder).withColumn("trace_id", F.coalesce("trace_id", F.input_file_name()))
    df = df.where(F.col("_corrupt_record").isNull())
    last = F.element_at("conversation_trace", -1)
    resp = F.struct(F.lit("assistant").alias("role"), F.coalesce(last["response"]["content"], F.lit("")).alias("content"),
                    F.lit(None).cast("string").alias("reasoning_content"), F.lit(None).cast("string").alias("tool_call_id"),
                    last["response"]["tool_calls"].alias("tool_calls"))
    msgs = F.when(last["response"].isNotNull(), F.concat(last["messages"], F.array(resp))).otherwise(last["messages"])
    meta = df.select("trace_id", F.col("metadata.query").alias("task"), F.col("metadata.total_turns").alias("total_turns"),
                     F.col("metadata.success").alias("success"), F.posexplode_outer(msgs).alias("seq", "m"))
    return meta.select("trace_id", "task", "total_turns", "success", F.col("seq").cast("long").alias("seq"), "m.*")


def csv_sink(df: DataFrame, path: str) -> None:
    """CSV with a header row (UTF-8; the byte-order mark is dropped)."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def trace_sink(messages: DataFrame, path: str, trace: str = "trace_id", chunk: int = 4096) -> None:
    """One JSON line per message, the trace id in it.  Files hold parts of
    many traces: a trace is spread by ``seq div chunk``, never one task or folder."""
    messages.repartition(trace, F.floor(F.col("seq") / chunk)).sortWithinPartitions(trace, "seq") \
        .write.mode("errorifexists").json(path)


def text_sink(lines: DataFrame, path: str, col: str = "line") -> None:
    """S10 writer: JSONL request lines."""
    lines.select(col).write.mode("errorifexists").text(path)


def bundle_sink(files: DataFrame, path: str, by: list[str], encoding: str = "UTF-8") -> None:
    """Small text files ``(name, body)`` in bundles, one or more a folder of ``by``: each file
    behind a line with its length in bytes and its name (read back by
    ``files.read_file_texts``).  A character that the encoding lacks becomes "?"."""
    data = F.col("body").cast("binary") if encoding == "UTF-8" else \
        F.encode(F.regexp_replace("body", r"[^\x00-\xff]", "?"), encoding)
    rows = files.select(*by, "name", data.alias("data"))
    head = F.concat((F.octet_length("data") + 1).cast("string"), F.lit(" "), "name", F.lit("\n"))  # the writer ends the last line
    rows.select(*by, F.concat(head.cast("binary"), "data").cast("string").alias("value")) \
        .write.mode("errorifexists").partitionBy(*by).text(path)
