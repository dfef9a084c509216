"""Fixture views: the driver's tables re-shaped to the shapes the operators
take (files, lines, cells, messages, calls, samples, traces, steps,
requests).  Each view is a lazy projection of a parquet scan, so column
pruning and filter pushdown still reach the files; operators only ever see
column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import split_lines
from quarry.sources.tables import read_table


def _t(spark, sf, name, cols=None):
    return read_table(spark, sf, name, cols)


# --------------------------------------------------------------- V-lines
def v_files_text(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files: ``path = source/doc_id`` -> (path, text)."""
    d = _t(spark, sf, "documents", ["doc_id", "source", "text"])
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")


def v_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Per-file array form (path, lines)."""
    return v_files_text(spark, sf).select("path", split_lines(F.col("text")).alias("lines"))


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Long form (path, line_no, line)."""
    return v_file_lines(spark, sf).select("path", F.posexplode("lines").alias("pos", "line")) \
        .select("path", (F.col("pos") + 1).alias("line_no"), "line")


# ------------------------------------------------------------ V-messages
_CALL_T = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def v_messages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as messages: (trace_id, seq, role, content, tool_calls, tool_call_id)."""
    c = _t(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("seq"), "role",
                    F.col("text").alias("content"), F.lit(None).cast(_CALL_T).alias("tool_calls"),
                    F.lit(None).cast("string").alias("tool_call_id"))


def _json_text(name: str, text) -> "F.Column":
    """``{"name": text}`` as JSON text."""
    return F.to_json(F.struct(text.alias(name)))


def tag_wrap(conv_id, text) -> "F.Column":
    """V-tagged: assistant text wrapped by ``conv_id % 6`` into each parse branch."""
    k = F.pmod(conv_id, F.lit(6))
    return (F.when(k == 0, F.concat(F.lit("<answer>"), text, F.lit("</answer>")))
            .when(k == 1, F.concat(F.lit("<think>"), text, F.lit("</think>\n<answer>"), text, F.lit("</answer>")))
            .when(k == 2, F.concat(F.lit('<tool_call>{"tool": "grep_search", "params": '), _json_text("pattern", text),
                                   F.lit("}</tool_call>")))
            .when(k == 3, F.concat(F.lit('```json\n{"reply": '), _json_text("answer", text), F.lit(', "answer": "'),
                                   conv_id.cast("string"), F.lit('", "data_source": ["t'), conv_id.cast("string"),
                                   F.lit('.csv"]}\n```')))
            .when(k == 4, F.concat(F.lit("3 rows: "), _json_text("answer", text)))
            .otherwise(F.concat(F.lit("<answer>"), text)))


def v_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Tag-format traces.  In conversations of tool calls the later user
    messages are echoes of tool results; every seventh ends in an empty one."""
    m = v_messages(spark, sf)
    conv, user = F.col("trace_id"), F.col("role") == "user"
    echo = user & (F.pmod(conv, F.lit(6)).isin(1, 2)) & (F.col("seq") > 1)
    return m.withColumn(
        "content", F.when(F.col("role") == "assistant", tag_wrap(conv, F.col("content")))
        .when(echo, F.concat(F.lit("[Tool Execution Result: grep_search]\n[SUCCESS] "), F.col("content")))
        .when(user & (F.pmod(conv, F.lit(7)) == 6) & (F.col("seq") > 0), F.lit("")).otherwise(F.col("content")))


def v_openai(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as OpenAI-shaped traces: by ``conv_id % 7`` an assistant
    turn is a call with JSON arguments, one with raw arguments (both answered
    by a ``tool`` row with the call's id), a tag answer, a JSON answer, a
    headed answer, plain text or empty; some user turns are error echoes."""
    m = v_messages(spark, sf)
    k, text, asks = F.pmod("trace_id", F.lit(7)), F.col("content"), F.col("role") == "assistant"
    call = asks & (k <= 1)
    call_id = F.concat_ws("_", F.lit("call"), "trace_id", "seq")
    args = F.when(k == 0, _json_text("pattern", text)).otherwise(F.concat(F.lit("rows: "), text))
    calls = F.array(F.struct(call_id.alias("id"), F.lit("function").alias("type"),
                             F.struct(F.lit("grep_search").alias("name"), args.alias("arguments")).alias("function")))
    said = (F.when(call, F.when(F.col("seq") % 4 == 1, F.lit("")).otherwise(text))
            .when(asks & (k == 2), F.concat(F.lit("so <answer> "), text, F.lit(" </answer>")))
            .when(asks & (k == 3), _json_text("answer", text))
            .when(asks & (k == 4), F.concat(F.lit("found it\n## Answer\n"), text))
            .when(asks & (k == 6), F.lit(" "))
            .when((F.col("role") == "user") & (F.col("seq") > 1) & (k == 1), F.concat(F.lit("[ERROR] "), text)).otherwise(text))
    sent = m.select("trace_id", (2 * F.col("seq")).cast("long").alias("seq"), "role", said.alias("content"),
                    F.when(call, calls).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))
    back = m.where(call).select("trace_id", (2 * F.col("seq") + 1).cast("long").alias("seq"), F.lit("tool").alias("role"), "content",
                                F.lit(None).cast(_CALL_T).alias("tool_calls"), call_id.alias("tool_call_id"))
    return sent.unionByName(back)


# --------------------------------------------------------------- V-calls
def v_calls(spark: SparkSession, sf: str) -> DataFrame:
    """events as a tool-call log: click/purchase = call, view/error = result."""
    e = _t(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    kind = (F.when(F.col("event_type").isin("click", "purchase"), "call")
            .when(F.col("event_type").isin("view", "error"), "result").otherwise("other"))
    return e.select(F.col("user_id").alias("trace_id"), "ts", "event_id", kind.alias("kind"),
                    F.col("event_type").alias("tool"),
                    (F.col("event_type") != "error").alias("ok"))


# --------------------------------------------------------------- V-steps
def v_steps(spark: SparkSession, sf: str) -> DataFrame:
    """documents ⟕ labels as judged steps: trace = source, step = rank by doc_id."""
    from quarry.operators.scan import prefix_scan, seq_chunk
    d = _t(spark, sf, "documents", ["doc_id", "source"])
    lab = _t(spark, sf, "labels", ["doc_id", "quality"])
    j = d.join(lab, "doc_id", "left")
    j = prefix_scan(j, ["source"], ["doc_id"], {"step_index": F.lit(1)}, chunk=seq_chunk("doc_id"))
    k = F.col("doc_id")
    return j.select(
        F.col("source").alias("trace_id"), F.col("step_index").cast("int").alias("step_index"), "doc_id",
        F.concat(F.lit("doc "), k.cast("string")).alias("query"),
        F.col("quality").isNull().alias("is_missing"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("coverage_ratio"),
        F.when(k % 7 == 0, F.lit("n/a")).otherwise((k % 5).cast("string")).alias("richness_score"),
        (k % 3).cast("string").alias("redundancy_score"),
        (k % 2).cast("string").alias("contradiction_score"),
        F.concat(F.lit("reason "), k.cast("string")).alias("reasoning"),
        F.array(F.concat(F.lit("dir/t"), (k % 4).cast("string"), F.lit(".csv")),
                F.concat(F.lit("t"), (k % 6).cast("string"), F.lit("_split.csv"))).alias("true_tables"),
        F.array(F.concat(F.lit("t"), (k % 4).cast("string"), F.lit("_Sheet1.csv")),
                F.concat(F.lit("x/t"), (k % 5).cast("string"), F.lit(".csv"))).alias("model_tables"))


def v_metric_tables(spark: SparkSession, sf: str, materialize: bool = False):
    """(accuracy, quality, table_depend) step tables; each covers a different step set."""
    s = v_steps(spark, sf)
    if materialize:
        from quarry.session import cut_lineage
        s = cut_lineage(s)
    acc = s.select("trace_id", "step_index", "query", "is_missing", "coverage_ratio", "reasoning")
    qual = s.where(F.col("doc_id") % 3 != 0).select("trace_id", "step_index", "query", "is_missing",
                                                   "richness_score", "redundancy_score", "contradiction_score")
    dep = s.where(F.col("doc_id") % 4 != 1).select("trace_id", "step_index", "query", "true_tables", "model_tables")
    return acc, qual, dep


# ------------------------------------------------------ V-samples, V-traces
_DUP_OFFSET = 1_000_000


def v_samples(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark as ground-truth samples: even items carry a checklist (one
    step per '. '-sentence), odd items a plain answer; every 4th
    item is appended again (ord + 1e6) with a plain answer."""
    b = _t(spark, sf, "benchmark", ["item_id", "text"])
    k = F.col("item_id")
    sents = F.split(F.col("text"), r"\. ", -1)
    steps = F.transform(sents, lambda s, i: F.struct(
        (i + 1).cast("int").alias("idx"), s.alias("info_item"), F.length(s).cast("string").alias("answer"),
        F.array(F.concat(F.lit("t"), k.cast("string"), F.lit(".csv")),
                F.concat(F.lit("t"), k.cast("string"), F.lit("_part"), (i + 1).cast("string"), F.lit(".csv")))
        .alias("related_tables"),
        F.array(F.length(s).cast("string")).alias("score_points")))
    even = k % 2 == 0
    base = b.select(k.alias("ord"), F.col("text").alias("task"),
                    F.when(~even, F.length("text").cast("string")).alias("answer"),
                    F.when(~even, F.array(F.concat(F.lit("t"), k.cast("string"), F.lit(".csv")))).alias("table_path"),
                    F.when(even, F.struct(F.lit("checklist").alias("type"), steps.alias("checkout_list")))
                    .alias("design"))
    dup = b.where(k % 4 == 0).select((k + _DUP_OFFSET).alias("ord"), F.col("text").alias("task"),
                                     F.lit("dup").alias("answer"), F.lit(None).cast("array<string>").alias("table_path"),
                                     F.lit(None).cast(base.schema["design"].dataType).alias("design"))
    return base.unionByName(dup)


def v_traces(spark: SparkSession, sf: str) -> DataFrame:
    """documents as finished traces: trace_id = doc_id, query = text."""
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    return d.select(F.col("doc_id").alias("trace_id"), F.col("text").alias("query"))


# --------------------------------------------------------------- V-cells
def _supplier_grid(spark, sf):
    from quarry.operators.scan import prefix_scan
    s = _t(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    s = s.select(F.concat(F.lit("supplier/n"), F.pmod("s_nationkey", F.lit(5)).cast("string"), F.lit(".csv")).alias("path"),
                 F.lit("Sheet1").alias("sheet"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s = prefix_scan(s, ["path"], ["s_nationkey", "s_suppkey"], {"rn": F.lit(1)}, chunk=F.col("s_nationkey").cast("long"))
    runs = s.groupBy("path", "sheet", "s_nationkey").agg(F.min("rn").alias("min_rn"), F.max("rn").alias("max_rn"),
                                                         F.min("s_suppkey").alias("first_sk"))
    # nations per file are few: a window over this small table is cheap
    runs = runs.withColumn("nrank", F.dense_rank().over(Window.partitionBy("path").orderBy("s_nationkey")))
    return s.join(runs, ["path", "sheet", "s_nationkey"]), runs


def v_cells(spark: SparkSession, sf: str) -> DataFrame:
    """supplier as a messy sheet per nation group: junk first row, two header
    rows, a banner row before each nation, merged nation cells (NULL below
    the top-left), thousands separators, percent cells, a blank column."""
    g, runs = _supplier_grid(spark, sf)
    r = (F.lit(3) + F.col("rn") + F.col("nrank")).cast("int")
    data = g.select("path", "sheet", r.alias("r"), F.posexplode(F.array(
        F.col("s_name"),
        F.when(F.col("s_suppkey") == F.col("first_sk"), F.col("s_nationkey").cast("string")),
        F.format_number("s_acctbal", 2),
        F.concat((F.col("s_suppkey") % 100).cast("string"), F.lit("%")),
        F.lit(""))).alias("c0", "value"))
    banner = runs.select("path", "sheet", (F.lit(3) + F.col("min_rn") + F.col("nrank") - 1).cast("int").alias("r"),
                         F.posexplode(F.array(*([F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))] * 4),
                                              F.lit(""))).alias("c0", "value"))
    files = runs.select("path", "sheet").distinct()
    # fixed header rows of the generated sheet
    head = files.select("path", "sheet", F.inline(F.array(
        *[F.struct(F.lit(1).alias("r"), F.lit(i).alias("c0"), F.lit(f"Unnamed: {i}").alias("value")) for i in range(5)],
        *[F.struct(F.lit(2).alias("r"), F.lit(i).alias("c0"), F.lit(v).cast("string").alias("value"))
          for i, v in enumerate(["Supplier", None, "Finance", None, None])],
        *[F.struct(F.lit(3).alias("r"), F.lit(i).alias("c0"), F.lit(v).alias("value"))
          for i, v in enumerate(["name", "nation", "acctbal", "share", "Unnamed: 5"])])))
    out = data.unionByName(banner).unionByName(head)
    return out.select("path", "sheet", F.col("r").cast("int").alias("r"), (F.col("c0") + 1).cast("int").alias("c"),
                      "value")


def v_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Merged ranges of the supplier sheets (header spans, banners, nation runs)."""
    _, runs = _supplier_grid(spark, sf)
    files = runs.select("path", "sheet").distinct()
    head = files.select("path", "sheet", F.inline(F.array(
        F.struct(*[F.lit(v).alias(n) for v, n in zip((0, 2, 2, 1, 2), ("range_no", "r0", "r1", "c0", "c1"))]),
        F.struct(*[F.lit(v).alias(n) for v, n in zip((1, 2, 2, 3, 5), ("range_no", "r0", "r1", "c0", "c1"))]))))
    br = (F.lit(3) + F.col("min_rn") + F.col("nrank") - 1).cast("int")
    banners = runs.select("path", "sheet", (F.lit(10) + 2 * F.col("s_nationkey")).alias("range_no"),
                          br.alias("r0"), br.alias("r1"), F.lit(1).alias("c0"), F.lit(4).alias("c1"))
    nat = runs.where(F.col("max_rn") > F.col("min_rn")).select(
        "path", "sheet", (F.lit(11) + 2 * F.col("s_nationkey")).alias("range_no"),
        (br + 1).alias("r0"), (br + 1 + F.col("max_rn") - F.col("min_rn")).alias("r1"),
        F.lit(2).alias("c0"), F.lit(2).alias("c1"))
    out = head.unionByName(banners).unionByName(nat)
    return out.select("path", "sheet", F.col("range_no").cast("long").alias("range_no"),
                      *[F.col(c).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1")])


# ---------------------------------------------------------------- V-rows
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]


def v_row_lines(spark: SparkSession, sf: str) -> DataFrame:
    """part as one CSV file per p_type: header line + one line per part."""
    from quarry.operators.scan import prefix_scan, seq_chunk
    p = _t(spark, sf, "part", PART_COLS + ["p_type"])
    p = p.withColumn("path", F.concat(F.lit("part/"), F.lower("p_type"), F.lit(".csv")))
    p = prefix_scan(p, ["path"], ["p_partkey"], {"rn": F.lit(1)}, chunk=seq_chunk("p_partkey"))
    rows = p.select("path", (F.col("rn") + 1).cast("int").alias("line_no"),
                    F.concat_ws(",", *[F.col(c).cast("string") for c in PART_COLS]).alias("line"))
    head = p.select("path").distinct().select("path", F.lit(1).alias("line_no"), F.lit(",".join(PART_COLS)).alias("line"))
    return rows.unionByName(head)


# --------------------------------------------------------------- V-files
EXTS = ["csv", "tsv", "xlsx", "xls"]


def v_files(spark: SparkSession, sf: str) -> DataFrame:
    """pages as a file listing: path from the url (no scheme/query/fragment),
    extension by ``page_id % 4``, size = html length, mtime = a day by page_id."""
    p = _t(spark, sf, "pages", ["page_id", "url", "html"])
    base = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[a-z]+://", ""), r"[?#].*$", "")
    base = F.regexp_replace(base, r"/+$", "")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    rel = F.concat(base, F.lit("."), ext)
    return p.select("page_id", F.concat(F.lit("/corpus/"), rel).alias("path"),
                    F.element_at(F.split(rel, "/"), -1).alias("name"), rel.alias("relative_path"),
                    F.concat(F.lit("."), ext).alias("extension"), F.length("html").cast("long").alias("size"),
                    F.timestamp_add("DAY", F.pmod("page_id", F.lit(28)), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                    .alias("mtime"))


# ------------------------------------------------------------ V-requests
def v_requests(spark: SparkSession, sf: str) -> DataFrame:
    """events as a request-cache log: hash = md5(props|event_type), last write wins."""
    e = _t(spark, sf, "events", ["event_id", "ts", "event_type", "value", "props"])
    return e.select(F.md5(F.concat_ws("|", "props", "event_type")).alias("hash"), "event_id",
                    F.col("props").alias("prompt"), F.col("event_type").alias("system"),
                    F.col("value").alias("result"), F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("timestamp"))
