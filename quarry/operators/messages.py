"""Conversation / message-table operators (W4–W6, W12, W14, W15, A15, A19–A21,
F21, F22, P8, P10, P13, J15).

Messages: ``(trace_id, seq, role, content, …)``.  Per-trace boundaries
(last user message, first non-tool message, …) are aggregates joined back;
suffix sums (context trimming) use the skew-safe ``prefix_scan`` on the
reversed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.tags import strict_json
from quarry.functions.text import token_count
from quarry.operators.scan import prefix_scan, seq_chunk

# fixed values: command patterns treated as dangerous (case-insensitive), in order
DANGEROUS_PATTERNS = [
    r"\brm\s+(-rf?|--recursive)\s+[/\\]",
    r"\bdel\s+[/\\]\*",
    r"\bformat\s+[a-zA-Z]:",
    r"\bmkfs\b",
    r"\bdd\s+.*of=/dev/",
    r"\bsudo\s+",
    r"\bsu\s+",
    r"\brunas\b",
    r"\bnc\s+-[el]",
    r"\bcurl\s+.*\|\s*(bash|sh)",
    r"\bwget\s+.*\|\s*(bash|sh)",
    r"\bpasswd\b",
    r"\bshadow\b",
    r"\bkill\s+-9\s+1\b",
    r"\bshutdown\b",
    r"\breboot\b",
    r"\bhalt\b",
    r"\breg\s+(delete|add)\s+HKLM",
    r":\s*\(\s*\)\s*\{",
]
DELETE_ROOT = r"(rm|del|rmdir)\s+.*[/\\]$"
# fixed values: display labels per role
TOOL_RESULT_HEAD = "[Tool Execution Result"
ROLE_LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
# fixed values: tool categories with their display names
CATEGORIES = {"location": "File Location", "understanding": "Table Understanding",
              "retrieval": "Content Retrieval", "reasoning": "Table Reasoning", "general": "General Tools"}


def flag_dangerous_commands(x) -> Column:
    """STRUCT<is_dangerous, reason> — first matching pattern wins."""
    c = F.col(x) if isinstance(x, str) else x
    reason = F.when(F.lower(c).rlike(DELETE_ROOT), F.lit("Attempting to delete root directory"))
    for p in reversed(DANGEROUS_PATTERNS):
        reason = F.when(c.rlike("(?i)" + p), F.lit(f"Matches dangerous pattern: {p}")).otherwise(reason)
    return F.struct(reason.isNotNull().alias("is_dangerous"), reason.alias("reason"))


def drop_leading_tools(m: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Tool messages before the first non-tool message, and tool
    messages without a call id, are not sent."""
    first = m.where(F.col("role") != "tool").groupBy(trace).agg(F.min("seq").alias("_first"))
    j = m.join(first, trace, "left")
    keep = (F.col("seq") >= F.col("_first")) & ~((F.col("role") == "tool") & F.col("tool_call_id").isNull())
    return j.where(keep).drop("_first")


def trim_context(m: DataFrame, max_messages: int, max_tokens: int, trace: str = "trace_id") -> DataFrame:
    """W4∘W15: longest suffix with ≤ max_messages and ≤ max_tokens (at least
    the last message), then leading/orphan tool messages dropped."""
    r = m.withColumn("_neg", -F.col("seq")).withColumn("_tok", token_count("content"))
    r = prefix_scan(r, [trace], ["_neg"], {"_rn": F.lit(1), "_rt": F.col("_tok")}, chunk=seq_chunk("_neg"))
    kept = r.where(((F.col("_rn") <= max_messages) & (F.col("_rt") <= max_tokens)) | (F.col("_rn") == 1))
    return drop_leading_tools(kept.drop("_neg", "_tok", "_rn", "_rt"), trace)


def split_for_summary(m: DataFrame, min_messages: int, trace: str = "trace_id") -> DataFrame:
    """``part`` = old / recent.  Recent = the last ``min_messages``; its
    leading tool messages move to old; traces no longer than that stay recent."""
    r = prefix_scan(m.withColumn("_neg", -F.col("seq")), [trace], ["_neg"], {"_rn": F.lit(1)},
                    chunk=seq_chunk("_neg"))
    recent = r.where(F.col("_rn") <= min_messages)
    first = recent.where(F.col("role") != "tool").groupBy(trace).agg(F.min("seq").alias("_first"))
    j = r.join(first, trace, "left")
    is_recent = (F.col("_rn") <= min_messages) & (F.col("seq") >= F.coalesce("_first", F.lit(1 << 62)))
    return j.select(*m.columns, F.when(is_recent, "recent").otherwise("old").alias("part"))


def suppress_reasoning(m: DataFrame, trace: str = "trace_id", cols=("reasoning_content", "thought_signature")) -> DataFrame:
    """Reasoning fields nulled up to and including the last user message
    that asks something: empty ones and tool-result echoes don't count."""
    asks = (F.col("role") == "user") & (F.coalesce("content", F.lit("")) != "") & \
        ~F.startswith("content", F.lit(TOOL_RESULT_HEAD))
    last = m.where(asks).groupBy(trace).agg(F.max("seq").alias("_lu"))
    j = m.join(last, trace, "left")
    hide = F.col("seq") <= F.coalesce("_lu", F.lit(-1))
    out = j
    for c in cols:
        out = out.withColumn(c, F.when(hide, F.lit(None)).otherwise(F.col(c)))
    return out.drop("_lu")


def preserve_signature(kept: DataFrame, removed: DataFrame, trace: str = "trace_id") -> DataFrame:
    """If no kept assistant message has a signature, the latest removed
    signature moves to the earliest kept assistant message."""
    lost = removed.where(F.col("thought_signature").isNotNull()).groupBy(trace) \
        .agg(F.max_by("thought_signature", "seq").alias("_sig"))
    a = kept.where(F.col("role") == "assistant").groupBy(trace).agg(
        F.min("seq").alias("_first_a"), F.count("thought_signature").alias("_n_sig"))
    j = kept.join(a, trace, "left").join(lost, trace, "left")
    move = (F.col("seq") == F.col("_first_a")) & (F.col("_n_sig") == 0) & F.col("_sig").isNotNull()
    return j.withColumn("thought_signature", F.when(move, F.col("_sig")).otherwise(F.col("thought_signature"))) \
        .drop("_first_a", "_n_sig", "_sig")


def merge_tool_results(m: DataFrame, trace: str = "trace_id", order=("seq",), chunk: Column | None = None,
                       name: str = "tool_name") -> DataFrame:
    """A tool result without a call id becomes a user message headed
    ``[Tool Execution Result: name]``, or a further part of the message
    before it when that is a tool result too (with or without an id).
    Message id = running count of rows that start a new message.

    Long output — one row per part, never a gathered group:
    ``(trace_id, message_no, part_no, <order>, role, content)`` where
    ``role`` is the message's (its first row's) role; the message text is
    its parts in ``part_no`` order joined by a blank line.
    """
    tool = F.col("role") == "tool"
    bare = tool & F.col("tool_call_id").isNull()
    r = m.withColumns({"_tool": tool.cast("int"), "_bare": bare.cast("int")})
    r = prefix_scan(r, [trace], list(order), {"_c": F.lit(1)}, chunk=chunk)
    prev = r.select(trace, (F.col("_c") + 1).alias("_c"), F.col("_tool").alias("_ptool"))
    r = r.join(prev, [trace, "_c"], "left")
    start = ~((F.col("_bare") == 1) & (F.coalesce("_ptool", F.lit(0)) == 1))
    r = prefix_scan(r.withColumn("_start", start.cast("int")), [trace], list(order), {"message_no": F.col("_start")},
                    chunk=chunk)
    heads = r.where("_start = 1").select(trace, "message_no", F.col("_c").alias("_first"),
                                         F.when(F.col("_bare") == 1, "user").otherwise(F.col("role")).alias("_mrole"))
    j = r.join(heads, [trace, "message_no"])
    headed = F.concat(F.lit(TOOL_RESULT_HEAD + ": "), F.col(name), F.lit("]\n"), F.col("content"))
    return j.select(trace, F.col("message_no").cast("long").alias("message_no"),
                    (F.col("_c") - F.col("_first") + 1).cast("long").alias("part_no"), *order,
                    F.col("_mrole").alias("role"), F.when(F.col("_bare") == 1, headed).otherwise(F.col("content")).alias("content"))


# fixed values: per style the opening line, a message line around label / role and content, and the closing line
HISTORY_STYLES = {
    "text": ("Conversation History:", ("{label}: ", ""), None),
    "markdown": ("### Conversation History\n", ("**{label}**: ", "\n"), None),
    "xml": ("<conversation_history>", ('  <message role="{role}">', "</message>"), "</conversation_history>"),
}


def history_text(m: DataFrame, max_turns: int = 6, max_chars: int = 200, trace: str = "trace_id",
                 labels: dict[str, str] | None = None, header: bool = True, style: str = "text") -> DataFrame:
    """The last ``max_turns`` messages as prompt text.  An assistant's
    calls follow its content, one ``Call tool: name(arguments)`` a line; then
    the message is cut to ``max_chars`` and labelled by role."""
    r = prefix_scan(m.withColumn("_neg", -F.col("seq")), [trace], ["_neg"], {"_rn": F.lit(1)},
                    chunk=seq_chunk("_neg"))
    last = r.where(F.col("_rn") <= max_turns)
    names = ROLE_LABELS | (labels or {})
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("role")),
                       F.col("role"))
    content = F.coalesce("content", F.lit(""))
    calls = F.array_join(F.transform("tool_calls", lambda tc: F.concat(
        F.lit("Call tool: "), F.coalesce(tc["function"]["name"], F.lit("unknown")), F.lit("("),
        F.coalesce(tc["function"]["arguments"], F.lit("{}")), F.lit(")"))), "\n")
    body = F.when((F.col("role") == "assistant") & F.col("tool_calls").isNotNull(),
                  F.when(content != "", F.concat(content, F.lit("\n"), calls)).otherwise(calls)).otherwise(content)
    opening, (before, after), closing = HISTORY_STYLES[style]
    # a style names the label or the role, never both
    lead, tail = before.replace("{role}", "{label}").split("{label}")
    who = F.col("role") if "{role}" in before else label
    line = F.concat(F.lit(lead), who, F.lit(tail), F.left(body, F.lit(max_chars)), F.lit(after))
    g = last.groupBy(trace).agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))).alias("_l"))
    around = [F.lit(opening + "\n")] if header else []
    ending = [F.lit("\n" + closing)] if header and closing else []
    return g.select(trace, F.concat(*around, F.array_join(F.transform("_l", lambda s: s["l"]), "\n"), *ending).alias("history"))


def session_stats(m: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Messages, summary flag (a system message), estimated tokens."""
    return m.groupBy(trace).agg(F.count("*").alias("n_messages"),
                                F.bool_or(F.col("role") == "system").alias("has_summary"),
                                F.sum(token_count("content")).alias("est_tokens"))


def query_history(m: DataFrame, trace: str = "trace_id", current: DataFrame | None = None) -> DataFrame:
    """The numbered queries of each session ``(trace_id, n, line)``.  The
    last one is left out when it is the current query (``current``: trace and
    ``current_query``; without it the last query is the current one)."""
    q = m.where(F.col("role") == "user")
    q = prefix_scan(q, [trace], ["seq"], {"_n": F.lit(1)}, chunk=seq_chunk("seq"))
    last = q.groupBy(trace).agg(F.max("_n").alias("_last"))
    e = q.join(last, trace)
    shown = F.col("_n") < F.col("_last")
    if current is not None:
        e = e.join(current.select(trace, "current_query"), trace, "left")
        shown = shown | ~F.col("content").eqNullSafe(F.col("current_query"))
    return e.where(shown).select(trace, F.col("_n").cast("long").alias("n"),
                                 F.concat(F.lit("Historical Query "), F.col("_n").cast("string"), F.lit(": "), F.col("content"))
                                 .alias("line"))


def call_text(tc: Column) -> Column:
    """One call as ``{"tool": …, "params": …}``: arguments parsed, or the bare
    string when they are no JSON."""
    args = tc["function"]["arguments"]
    return F.to_json(F.struct(tc["function"]["name"].alias("tool"),
                              F.coalesce(strict_json(args), args.cast("variant")).alias("params")))


def tool_display_text(m: DataFrame) -> DataFrame:
    """a message without content shows its calls, one a line."""
    calls = F.array_join(F.transform("tool_calls", call_text), "\n")
    shown = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.col("content")) \
        .when(F.size("tool_calls") > 0, calls).otherwise(F.lit(""))
    return m.withColumn("display", shown)


def chat_format(m: DataFrame, trace: str = "trace_id") -> DataFrame:
    """F21 (shape 2): system text lifted out per trace (last system message),
    assistant → 'model', empty assistant messages vanish, tool results named
    through their call id (unknown ids dropped)."""
    sysm = m.where(F.col("role") == "system").groupBy(trace).agg(F.max_by("content", "seq").alias("system"))
    calls = m.where(F.size("tool_calls") > 0).select(trace, F.explode("tool_calls").alias("tc")) \
        .select(trace, F.col("tc.id").alias("tool_call_id"), F.col("tc.function.name").alias("tool_name"))
    body = m.where(F.col("role") != "system")
    body = body.where(~((F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) == "")
                        & F.coalesce(F.size("tool_calls") <= 0, F.lit(True))))
    tools = body.where(F.col("role") == "tool").join(calls, [trace, "tool_call_id"])
    other = body.where(F.col("role") != "tool").withColumn("tool_name", F.lit(None).cast("string"))
    out = other.unionByName(tools.select(*other.columns))
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return out.join(sysm, trace, "left").select(trace, "seq", role.alias("role"), "content", "tool_name", "system")


def missing_params(calls: DataFrame, required: str = "required", params: str = "params") -> DataFrame:
    """Required parameters absent from each call (``params`` MAP)."""
    miss = F.array_except(F.col(required), F.map_keys(F.col(params)))
    return calls.withColumn("missing", miss).withColumn("valid", F.size(miss) == 0)


def tool_catalog(spark, tools: dict[str, str]) -> DataFrame:
    """Tool → category dimension (a handful of rows: a broadcast side)."""
    rows = [(t, c, CATEGORIES.get(c, CATEGORIES["general"])) for t, c in tools.items()]
    return spark.createDataFrame(rows, "tool string, category string, category_name string")


def tool_catalog_join(calls: DataFrame, catalog: DataFrame, tool_col: str = "tool") -> DataFrame:
    """Left join to the (small) catalog; unknown tools get an error."""
    j = calls.join(F.broadcast(catalog), calls[tool_col] == catalog["tool"], "left").drop(catalog["tool"])
    err = F.when(F.col("category").isNull(), F.concat(F.lit("[ERROR] Tool '"), F.col(tool_col), F.lit("' does not exist")))
    return j.withColumn("error", err)


def tool_subset(catalog: DataFrame, include: list[str] | None = None, category: str | None = None) -> DataFrame:
    """P10: named tools, or one category (unknown category → general)."""
    c = catalog
    if include:
        c = c.where(F.col("tool").isin(*include))
    if category is not None:
        cat = category if category in CATEGORIES else "general"
        c = c.where(F.col("category") == cat)
    return c


def chat_blocks(m: DataFrame, trace: str = "trace_id", order=("seq",), chunk: Column | None = None) -> DataFrame:
    """F21 (shape 1): system text lifted out; assistants become ordered parts
    (reasoning, text, tool uses) and vanish when they have none; a tool
    result joins the preceding emitted *user* message (a plain query or an
    earlier result block), otherwise it opens a new user message.

    Emitted-message ids are a running count of rows that start a message
    (skew-safe prefix scan).  Long output, one row per part:
    ``(trace_id, msg_no, row_no, sub, role, type, text, tool_use_id)``;
    parts are ordered by (row_no, sub) inside a message.
    """
    has_reason = F.coalesce(F.col("reasoning_content"), F.lit("")) != "" if "reasoning_content" in m.columns \
        else F.lit(False)
    has_text = F.coalesce(F.col("content"), F.lit("")) != ""
    has_calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    kept = m.where((F.col("role") != "system") &
                   ~((F.col("role") == "assistant") & ~has_reason & ~has_text & ~has_calls))
    kept = prefix_scan(kept, [trace], list(order), {"_k": F.lit(1)}, chunk=chunk)
    prev = kept.select(trace, (F.col("_k") + 1).alias("_k"), F.col("role").alias("_prole"))
    kept = kept.join(prev, [trace, "_k"], "left")
    joins_prev = F.coalesce((F.col("role") == "tool") & F.col("_prole").isin("user", "tool"), F.lit(False))
    kept = prefix_scan(kept.withColumn("_start", (~joins_prev).cast("int")), [trace], list(order),
                       {"msg_no": F.col("_start")}, chunk=chunk)
    reason = F.col("reasoning_content") if "reasoning_content" in m.columns else F.lit(None).cast("string")
    parts = F.concat(
        F.when((F.col("role") == "assistant") & (F.coalesce(reason, F.lit("")) != ""),
               F.array(F.struct(F.lit("thinking").alias("type"), reason.alias("text"),
                                F.lit(None).cast("string").alias("tool_use_id")))).otherwise(F.array()),
        F.when(F.col("role").isin("user", "assistant") & has_text,
               F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"),
                                F.lit(None).cast("string").alias("tool_use_id")))).otherwise(F.array()),
        F.when(F.col("role") == "assistant", F.transform(F.coalesce("tool_calls", F.array()), lambda tc: F.struct(
            F.lit("tool_use").alias("type"), tc["function"]["arguments"].alias("text"), tc["id"].alias("tool_use_id"))))
        .otherwise(F.array()),
        F.when(F.col("role") == "tool", F.array(F.struct(F.lit("tool_result").alias("type"),
                                                         F.coalesce("content", F.lit("")).alias("text"),
                                                         F.col("tool_call_id").alias("tool_use_id"))))
        .otherwise(F.array()))
    heads = kept.where("_start = 1").select(trace, "msg_no", F.when(F.col("role") == "assistant", "assistant")
                                            .otherwise("user").alias("role"))
    rows = kept.select(trace, "msg_no", F.col("_k").alias("row_no"), F.posexplode(parts).alias("sub", "p"))
    out = rows.join(heads, [trace, "msg_no"])
    return out.select(trace, F.col("msg_no").cast("int").alias("msg_no"), F.col("row_no").cast("long").alias("row_no"),
                      F.col("sub").cast("int").alias("sub"), "role", F.col("p.type").alias("type"),
                      F.col("p.text").alias("text"), F.col("p.tool_use_id").alias("tool_use_id"))


def consolidate_snapshots(snaps: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Successive context snapshots ``(trace_id, turn, pos, content)``
    (pos 0 = system prompt) merged into stored message lists.

    For snapshot t the merge point is the first position whose content
    equals the last message of snapshot t-1 (the last stored message always
    equals it); what follows is appended, everything when nothing matches.
    A changed system prompt starts a new segment holding a copy of all
    stored messages plus the new ones.  The first stored message object is
    shared between segments and overwritten with each new system prompt, so
    every segment shows the trace's latest system prompt at position 1.

    No sequential fold: merge points come from a join with the previous
    snapshot, positions and segment numbers from skew-safe prefix scans.
    Output ``(trace_id, segment, position, content)``.
    """
    per = snaps.groupBy(trace, "turn").agg(F.min_by("content", "pos").alias("_sys"),
                                           F.max_by("content", "pos").alias("_last"))
    per = prefix_scan(per, [trace], ["turn"], {"_k": F.lit(1)}, chunk=seq_chunk("turn", 64))
    prev = per.select(trace, (F.col("_k") + 1).alias("_k"), F.col("_last").alias("_plast"),
                      F.col("_sys").alias("_psys"))
    per = per.join(prev, [trace, "_k"], "left")
    per = per.withColumn("_new", (F.col("_psys").isNull() | (F.col("_sys") != F.col("_psys"))).cast("int"))
    per = prefix_scan(per, [trace], ["_k"], {"segment": F.col("_new")}, chunk=seq_chunk("_k", 64))
    rows = snaps.join(per.select(trace, "turn", "_k", "_plast", "segment"), [trace, "turn"])
    idx = rows.where(F.col("content") == F.col("_plast")).groupBy(trace, "turn").agg(F.min("pos").alias("_idx"))
    rows = rows.join(idx, [trace, "turn"], "left").withColumn("_idx", F.coalesce("_idx", F.lit(-1)))
    app = rows.where(F.col("_plast").isNull() | (F.col("pos") > F.col("_idx")))
    app = prefix_scan(app, [trace], ["_k", "pos"], {"position": F.lit(1)}, chunk=seq_chunk("_k", 64))
    seg = per.groupBy(trace, "segment").agg(F.max("_k").alias("_end"))
    latest = per.groupBy(trace).agg(F.max_by("_sys", "_k").alias("_latest_sys"))
    out = app.select(trace, "_k", "position", "content").join(seg, trace).where(F.col("_k") <= F.col("_end"))
    out = out.join(latest, trace)
    return out.select(trace, F.col("segment").cast("int").alias("segment"), F.col("position").cast("int").alias("position"),
                      F.when(F.col("position") == 1, F.col("_latest_sys")).otherwise(F.col("content")).alias("content"))
