"""Registered message-table queries (V-messages, V-tagged, V-calls)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.operators import messages as MS
from quarry.operators.scan import time_chunk
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_calls, v_messages, v_openai, v_tagged
from quarry.registry import query

TOKS = "len(regexp_extract_all(content, '\\w+|[^\\w\\s]'))"


def _danger_sql(x):
    out = "NULL"
    for p in reversed(MS.DANGEROUS_PATTERNS):
        out = f"CASE WHEN regexp_matches({x}, '(?i)' || '{p.replace(chr(39), chr(39) * 2)}') THEN 'Matches dangerous pattern: ' || '{p.replace(chr(39), chr(39) * 2)}' ELSE {out} END"
    return out.replace("ELSE NULL END", f"ELSE CASE WHEN regexp_matches(lower({x}), '{MS.DELETE_ROOT}') THEN 'Attempting to delete root directory' END END", 1)


@query("flag_dangerous_commands", sql=f"""
WITH {O.MESSAGES}
SELECT trace_id, seq, r IS NOT NULL AS is_dangerous, r AS reason
FROM (SELECT trace_id, seq, {_danger_sql('content')} AS r FROM messages)""", category="messages")
def q_flag_dangerous_commands(spark, sf):
    """Audit of message texts against the dangerous-command patterns."""
    f = MS.flag_dangerous_commands("content")
    return v_messages(spark, sf).select("trace_id", "seq", f["is_dangerous"].alias("is_dangerous"),
                                        f["reason"].alias("reason"))


TRIM = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS rn,
             sum({TOKS}) OVER (PARTITION BY trace_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS rt FROM messages),
kept AS (SELECT * FROM r WHERE (rn <= 4 AND rt <= 300) OR rn = 1),
f AS (SELECT trace_id, min(seq) AS fs FROM kept WHERE role <> 'tool' GROUP BY trace_id)"""


@query("trim_context", sql=f"""
WITH {O.MESSAGES}, {TRIM}
SELECT k.trace_id, k.seq, k.role FROM kept k JOIN f USING (trace_id) WHERE k.seq >= f.fs""", category="messages")
def q_trim_context(spark, sf):
    """W4∘W15: context kept under 4 messages / 300 tokens."""
    return MS.trim_context(v_messages(spark, sf), 4, 300).select("trace_id", "seq", "role")


@query("drop_leading_tools", sql=f"""
WITH {O.CALLS},
m AS (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS seq,
             CASE WHEN kind = 'result' THEN 'tool' ELSE 'assistant' END AS role,
             CASE WHEN tool = 'view' THEN 'call_' || CAST(event_id AS VARCHAR) END AS tool_call_id FROM calls),
f AS (SELECT trace_id, min(seq) AS fs FROM m WHERE role <> 'tool' GROUP BY trace_id)
SELECT m.trace_id, m.seq, m.role FROM m JOIN f USING (trace_id)
WHERE m.seq >= f.fs AND NOT (m.role = 'tool' AND m.tool_call_id IS NULL)""", category="messages")
def q_drop_leading_tools(spark, sf):
    """Orphan / id-less tool results are not sent (call log as messages)."""
    return MS.drop_leading_tools(_call_messages(spark, sf)).select("trace_id", "seq", "role")


def _call_messages(spark, sf):
    from quarry.operators.scan import prefix_scan
    c = v_calls(spark, sf)
    c = prefix_scan(c, ["trace_id"], ["ts", "event_id"], {"seq": F.lit(1)}, chunk=time_chunk("ts"))
    return c.select("trace_id", F.col("seq").cast("long").alias("seq"),
                    F.when(F.col("kind") == "result", "tool").otherwise("assistant").alias("role"),
                    F.col("tool").alias("content"),
                    F.when(F.col("tool") == "view", F.concat(F.lit("call_"), F.col("event_id").cast("string")))
                    .alias("tool_call_id"))


@query("split_for_summary", sql=f"""
WITH {O.MESSAGES},
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS rn FROM messages),
f AS (SELECT trace_id, min(seq) AS fs FROM r WHERE rn <= 3 AND role <> 'tool' GROUP BY trace_id)
SELECT r.trace_id, r.seq, CASE WHEN rn <= 3 AND r.seq >= coalesce(f.fs, 4611686018427387904) THEN 'recent' ELSE 'old' END AS part
FROM r LEFT JOIN f USING (trace_id)""", category="messages")
def q_split_for_summary(spark, sf):
    """old/recent split keeping the last 3 messages."""
    return MS.split_for_summary(v_messages(spark, sf), 3).select("trace_id", "seq", "part")


@query("suppress_reasoning", sql=f"""
WITH {O.TAGGED},
m AS (SELECT *, CASE WHEN len(regexp_extract_all(content, '(?is)<think>(.*?)</think>', 1)) > 0
                     THEN array_to_string(list_transform(regexp_extract_all(content, '(?is)<think>(.*?)</think>', 1),
                          lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10) || chr(10)) END AS reasoning_content
      FROM tagged),
lu AS (SELECT trace_id, max(seq) AS l FROM m WHERE role = 'user' AND content <> ''
       AND NOT starts_with(content, '[Tool Execution Result') GROUP BY trace_id)
SELECT m.trace_id, m.seq, CASE WHEN m.seq <= coalesce(lu.l, -1) THEN NULL ELSE reasoning_content END AS reasoning_content
FROM m LEFT JOIN lu USING (trace_id)""", category="messages")
def q_suppress_reasoning(spark, sf):
    """Reasoning hidden up to the last user message."""
    m = v_tagged(spark, sf)
    m = m.withColumn("reasoning_content", tags.extract_reasoning("content")["reasoning"]) \
        .withColumn("thought_signature", F.lit(None).cast("string"))
    return MS.suppress_reasoning(m).select("trace_id", "seq", "reasoning_content")


@query("preserve_signature", sql=f"""
WITH {O.MESSAGES},
s AS (SELECT *, CASE WHEN role = 'assistant' AND seq % 3 = 0 THEN 'sig' || CAST(seq AS VARCHAR) END AS sig,
             row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS rn FROM messages),
kept AS (SELECT * FROM s WHERE rn <= 3), removed AS (SELECT * FROM s WHERE rn > 3),
lost AS (SELECT trace_id, arg_max(sig, seq) AS lsig FROM removed WHERE sig IS NOT NULL GROUP BY trace_id),
a AS (SELECT trace_id, min(seq) AS fa, count(sig) AS nsig FROM kept WHERE role = 'assistant' GROUP BY trace_id)
SELECT k.trace_id, k.seq, CASE WHEN k.seq = a.fa AND a.nsig = 0 AND lost.lsig IS NOT NULL THEN lost.lsig ELSE k.sig END
       AS thought_signature
FROM kept k LEFT JOIN a USING (trace_id) LEFT JOIN lost USING (trace_id)""", category="messages")
def q_preserve_signature(spark, sf):
    """Trimmed-away signature carried to the first kept assistant message."""
    from quarry.operators.scan import prefix_scan, seq_chunk
    m = v_messages(spark, sf).withColumn(
        "thought_signature", F.when((F.col("role") == "assistant") & (F.col("seq") % 3 == 0),
                                    F.concat(F.lit("sig"), F.col("seq").cast("string"))))
    r = prefix_scan(m.withColumn("_neg", -F.col("seq")), ["trace_id"], ["_neg"], {"_rn": F.lit(1)},
                    chunk=seq_chunk("_neg"))
    kept, removed = r.where("_rn <= 3"), r.where("_rn > 3")
    return MS.preserve_signature(kept, removed).select("trace_id", "seq", "thought_signature")


@query("merge_tool_results", sql=f"""
WITH {O.CALLS},
m AS (SELECT trace_id, ts, event_id, tool, CASE WHEN kind = 'result' THEN 'tool' ELSE 'assistant' END AS role,
             kind = 'result' AND tool <> 'view' AS bare FROM calls),
s AS (SELECT *, CASE WHEN bare AND lag(role) OVER w = 'tool' THEN 0 ELSE 1 END AS st FROM m
      WINDOW w AS (PARTITION BY trace_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(st) OVER (PARTITION BY trace_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM s)
SELECT trace_id, CAST(isl AS BIGINT) AS message_no,
       CAST(row_number() OVER (PARTITION BY trace_id, isl ORDER BY ts, event_id) AS BIGINT) AS part_no, ts, event_id,
       first_value(CASE WHEN bare THEN 'user' ELSE role END) OVER (PARTITION BY trace_id, isl ORDER BY ts, event_id) AS role,
       CASE WHEN bare THEN '[Tool Execution Result: ' || tool || ']' || chr(10) || tool ELSE tool END AS content
FROM i""", category="messages")
def q_merge_tool_results(spark, sf):
    """Id-less tool results merged into the result before them (call log
    as messages: 'view' results carry a call id, 'error' results none)."""
    c = v_calls(spark, sf).select("trace_id", "ts", "event_id", F.col("tool").alias("tool_name"),
                                  F.when(F.col("kind") == "result", "tool").otherwise("assistant").alias("role"),
                                  F.col("tool").alias("content"),
                                  F.when(F.col("tool") == "view", F.concat(F.lit("call_"), F.col("event_id").cast("string")))
                                  .alias("tool_call_id"))
    return MS.merge_tool_results(c, order=("ts", "event_id"), chunk=time_chunk("ts"))


def _history_sql(before: str, after: str, opening: str, closing: str, turns: int, chars: int, user: str) -> str:
    return f"""
WITH {O.OPENAI},
r AS (SELECT *, CASE role WHEN 'user' THEN '{user}' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
                          WHEN 'tool' THEN 'Tool' ELSE role END AS label,
             CASE WHEN arguments IS NULL THEN coalesce(content, '')
                  ELSE coalesce(nullif(content, '') || chr(10), '') || 'Call tool: grep_search(' || arguments || ')' END AS body,
             row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS rn FROM oac)
SELECT trace_id, {opening} || string_agg({before} || left(body, {chars}) || {after}, chr(10) ORDER BY seq) || {closing} AS history
FROM r WHERE rn <= {turns} GROUP BY trace_id"""


@query("history_text", sql=_history_sql("label || ': '", "''", "'Conversation History:' || chr(10)", "''", 6, 200, "User"), category="messages")
def q_history_text(spark, sf):
    """Last 6 messages as prompt text, calls included."""
    return MS.history_text(v_openai(spark, sf))


@query("history_markdown", sql=_history_sql("'**' || label || '**: '", "chr(10)", "''", "''", 3, 80, "Client"), category="messages")
def q_history_markdown(spark, sf):
    """The markdown style without header, with another user label."""
    return MS.history_text(v_openai(spark, sf), 3, 80, labels={"user": "Client"}, header=False, style="markdown")


@query("history_xml", sql=_history_sql("'  <message role=\"' || role || '\">'", "'</message>'", "'<conversation_history>' || chr(10)",
                                       "chr(10) || '</conversation_history>'", 6, 200, "User"), category="messages")
def q_history_xml(spark, sf):
    """The XML style."""
    return MS.history_text(v_openai(spark, sf), style="xml")


@query("session_stats", sql=f"""
WITH {O.MESSAGES}
SELECT trace_id, count(*) AS n_messages, bool_or(role = 'system') AS has_summary, CAST(sum({TOKS}) AS BIGINT) AS est_tokens
FROM messages GROUP BY trace_id""", category="messages")
def q_session_stats(spark, sf):
    """Per-session message count, summary flag, tokens."""
    return MS.session_stats(v_messages(spark, sf))


@query("query_history", sql=f"""
WITH {O.MESSAGES},
q AS (SELECT trace_id, content, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n,
             row_number() OVER (PARTITION BY trace_id ORDER BY seq DESC) AS back FROM messages WHERE role = 'user'),
cur AS (SELECT trace_id, max(CASE WHEN CASE WHEN trace_id % 2 = 0 THEN back ELSE n END = 1 THEN content END) AS current_query
        FROM q GROUP BY trace_id)
SELECT trace_id, CAST(n AS BIGINT) AS n, 'Historical Query ' || CAST(n AS VARCHAR) || ': ' || content AS line
FROM q JOIN cur USING (trace_id) WHERE NOT (back = 1 AND content IS NOT DISTINCT FROM current_query)""", category="messages")
def q_query_history(spark, sf):
    """Listed queries of each session; the current one is the last in
    sessions of even id and the first in the others (then the last is listed too)."""
    m = v_messages(spark, sf)
    ends = m.where("role = 'user'").groupBy("trace_id").agg(F.min_by("content", "seq").alias("a"), F.max_by("content", "seq").alias("b"))
    current = ends.select("trace_id", F.when(F.col("trace_id") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("current_query"))
    return MS.query_history(m, current=current)


@query("turn_latency", sql=f"""
WITH {O.CALLS},
l AS (SELECT trace_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY trace_id ORDER BY ts, event_id)) AS lat FROM calls)
SELECT trace_id, count(*) AS steps, round(avg(lat) / 1e6, 6) AS avg_latency_s, round(max(lat) / 1e6, 6) AS max_latency_s
FROM l GROUP BY trace_id""", category="messages")
def q_turn_latency(spark, sf):
    """Per trace step count and latency between consecutive steps."""
    from quarry.operators.scan import prefix_scan
    c = v_calls(spark, sf).select("trace_id", "ts", "event_id")
    c = prefix_scan(c, ["trace_id"], ["ts", "event_id"], {"n": F.lit(1)}, chunk=time_chunk("ts"))
    prev = c.select("trace_id", (F.col("n") + 1).alias("n"), F.col("ts").alias("pts"))
    j = c.join(prev, ["trace_id", "n"], "left")
    lat = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("pts").cast("timestamp"))
    return j.groupBy("trace_id").agg(F.count("*").alias("steps"), F.round(F.avg(lat) / 1e6, 6).alias("avg_latency_s"),
                                     F.round(F.max(lat) / 1e6, 6).alias("max_latency_s"))


@query("tool_display_text", sql=f"""
WITH {O.OPENAI}
SELECT trace_id, seq, CASE WHEN coalesce(content, '') <> '' THEN content ELSE coalesce(call_text, '') END AS display
FROM oac""", category="messages")
def q_tool_display_text(spark, sf):
    """display text (content, else the calls as JSON)."""
    m = MS.tool_display_text(v_openai(spark, sf))
    return m.select("trace_id", "seq", _sorted_keys(F.col("display")).alias("display"))


def _sorted_keys(x):
    """JSON texts compare by content: keys in the order of a parsed object."""
    from quarry.functions.tags import strict_json
    return F.coalesce(F.when(F.startswith(x, F.lit('{"')), F.to_json(strict_json(x))), x)


@query("chat_format", sql=f"""
WITH {O.OPENAI},
s AS (SELECT trace_id, arg_max(content, seq) AS system FROM oac WHERE role = 'system' GROUP BY trace_id)
SELECT m.trace_id, m.seq, CASE WHEN m.role = 'assistant' THEN 'model' ELSE m.role END AS role, m.content,
       CASE WHEN m.role = 'tool' THEN 'grep_search' END AS tool_name, s.system
FROM oac m LEFT JOIN s USING (trace_id)
WHERE m.role <> 'system' AND NOT (m.role = 'assistant' AND coalesce(m.content, '') = '' AND m.call_id IS NULL)""", category="messages")
def q_chat_format(spark, sf):
    """messages in the second chat shape (system lifted, model role, results named)."""
    return MS.chat_format(v_openai(spark, sf))


def _catalog(spark):
    # the tool catalogue: registered tool names and their categories
    return MS.tool_catalog(spark, {"click": "retrieval", "purchase": "reasoning", "grep_search": "retrieval",
                                   "table_head_reader": "understanding", "header_merger": "understanding"})


CAT_SQL = """cat AS (SELECT * FROM (VALUES ('click', 'retrieval', 'Content Retrieval'), ('purchase', 'reasoning', 'Table Reasoning'),
  ('grep_search', 'retrieval', 'Content Retrieval'), ('table_head_reader', 'understanding', 'Table Understanding'),
  ('header_merger', 'understanding', 'Table Understanding')) t(tool, category, category_name))"""


@query("tool_catalog_join", sql=f"""
WITH {O.CALLS}, {CAT_SQL}
SELECT c.trace_id, c.event_id, c.tool, k.category, k.category_name,
       CASE WHEN k.category IS NULL THEN '[ERROR] Tool ''' || c.tool || ''' does not exist' END AS error
FROM calls c LEFT JOIN cat k USING (tool)""", category="messages")
def q_tool_catalog_join(spark, sf):
    """Every logged call with its tool category (unknown → error)."""
    c = v_calls(spark, sf).select("trace_id", "event_id", "tool")
    return MS.tool_catalog_join(c, _catalog(spark)).select("trace_id", "event_id", "tool", "category",
                                                           "category_name", "error")


@query("tool_subset", sql=f"""
WITH {O.CALLS}, {CAT_SQL}
SELECT c.trace_id, c.event_id, c.tool FROM calls c JOIN cat k USING (tool) WHERE k.category = 'retrieval'""",
       category="messages")
def q_tool_subset(spark, sf):
    """P10: calls restricted to the retrieval tool category."""
    sub = MS.tool_subset(_catalog(spark), category="retrieval").select("tool")
    return v_calls(spark, sf).join(F.broadcast(sub), "tool").select("trace_id", "event_id", "tool")


@query("missing_params", sql="""
SELECT event_id, list_filter(['k', 'user'], lambda x: NOT list_contains(json_keys(props), x)) AS missing,
       len(list_filter(['k', 'user'], lambda x: NOT list_contains(json_keys(props), x))) = 0 AS valid
FROM events""", category="messages")
def q_missing_params(spark, sf):
    """Required parameters (k, user) missing from each event's props."""
    from quarry.sources.tables import read_table
    e = read_table(spark, sf, "events", ["event_id", "props"])
    c = e.select("event_id", F.from_json("props", "map<string,string>").alias("params"),
                 F.array(F.lit("k"), F.lit("user")).alias("required"))
    return MS.missing_params(c).select("event_id", "missing", "valid")


@query("chat_blocks", sql=f"""
WITH {O.CALLS},
m AS (SELECT trace_id, ts, event_id, CASE WHEN kind = 'result' THEN 'tool' ELSE 'assistant' END AS role, tool AS content,
             CASE WHEN tool = 'view' THEN 'call_' || CAST(event_id AS VARCHAR) END AS tool_call_id FROM calls),
s AS (SELECT *, CASE WHEN role = 'tool' AND lag(role) OVER w IN ('user', 'tool') THEN 0 ELSE 1 END AS st,
             row_number() OVER w AS row_no FROM m
      WINDOW w AS (PARTITION BY trace_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(st) OVER (PARTITION BY trace_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS msg_no FROM s)
SELECT trace_id, CAST(msg_no AS INTEGER) AS msg_no, CAST(row_no AS BIGINT) AS row_no, 0 AS sub,
       CASE WHEN first_value(role) OVER (PARTITION BY trace_id, msg_no ORDER BY ts, event_id) = 'assistant'
            THEN 'assistant' ELSE 'user' END AS role,
       CASE WHEN role = 'tool' THEN 'tool_result' ELSE 'text' END AS type, content AS text,
       CASE WHEN role = 'tool' THEN tool_call_id END AS tool_use_id
FROM i""", category="messages")
def q_chat_blocks(spark, sf):
    """F21 (shape 1): call log as chat blocks, tool results folded into user messages (one row per part)."""
    c = v_calls(spark, sf).select(
        "trace_id", "ts", "event_id", F.when(F.col("kind") == "result", "tool").otherwise("assistant").alias("role"),
        F.col("tool").alias("content"),
        F.when(F.col("tool") == "view", F.concat(F.lit("call_"), F.col("event_id").cast("string"))).alias("tool_call_id"),
        F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")
        .alias("tool_calls"))
    return MS.chat_blocks(c, order=("ts", "event_id"), chunk=time_chunk("ts"))


@query("consolidate_snapshots")
def q_consolidate_snapshots(spark, sf):
    """Per-turn context snapshots (system prompt + the last 4 messages;
    the prompt version changes every 3 turns) merged into stored segments."""
    m = v_messages(spark, sf).select("trace_id", "seq", "content")
    turns = m.select("trace_id", F.col("seq").alias("turn"))
    # a bounded context window per turn: explode its seq range, equi-join back
    win = turns.select("trace_id", "turn", F.explode(F.sequence(F.col("turn") - 3, F.col("turn"))).alias("seq"))
    body = win.join(m, ["trace_id", "seq"]).select("trace_id", "turn", (F.col("seq") + 1).alias("pos"), "content")
    sysr = turns.select("trace_id", "turn", F.lit(0).cast("long").alias("pos"),
                        F.concat(F.lit("system v"), (F.col("turn") / 3).cast("int").cast("string")).alias("content"))
    return MS.consolidate_snapshots(sysr.unionByName(body))
