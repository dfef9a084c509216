"""Trace parsing: messages → actions → turns → QA pairs.

Messages are ``(trace_id, seq, role, content, tool_calls, tool_call_id)``.
Per-message work (format branch, tag parsing, tool-call extraction) is a
narrow ``inline`` of an array of action structs.  Order-dependent state
(turn counter, FIFO result matching, step numbering) uses
``scan.prefix_scan``, which splits a hot trace into contiguous chunks, and
aggregations with map-side combine — never one task per trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.functions.tags import strict_json
from quarry.functions.text import py_strip
from quarry.operators.messages import call_text
from quarry.operators.scan import prefix_scan

TOOL_RESULT_MARK = "[Tool Execution Result"
OPENAI_RESULT_MARK = "[Tool Execution Result]"

_ACTION = ("struct<sub:int,type:string,content:string,result:string,success:string,"
           "data_source:array<string>>")


def detect_format(messages: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Per trace: ``is_openai`` if any assistant carries tool_calls or any role is 'tool'.

    An aggregate (partial + final), so a hot trace is combined map-side.
    """
    flag = ((F.col("role") == "assistant") & F.coalesce(F.size("tool_calls") > 0, F.lit(False))) | \
        (F.col("role") == "tool")
    return messages.groupBy(trace).agg(F.bool_or(flag).alias("is_openai"))


def query_messages(messages: DataFrame, openai: bool = False) -> DataFrame:
    """User messages that are queries (not tool-result echoes)."""
    c = F.coalesce(F.col("content"), F.lit(""))
    if openai:
        cond = ~(F.contains(c, F.lit("[ERROR]")) | F.contains(c, F.lit(OPENAI_RESULT_MARK)))
    else:
        cond = ~F.contains(c, F.lit(TOOL_RESULT_MARK))
    return messages.where((F.col("role") == "user") & cond)


def _act(sub, typ, content, result=None, success=None, ds=None) -> Column:
    return F.struct(F.lit(sub).cast("int").alias("sub") if isinstance(sub, int) else sub.cast("int").alias("sub"),
                    F.lit(typ).alias("type") if isinstance(typ, str) else typ.alias("type"),
                    content.cast("string").alias("content"),
                    (result if result is not None else F.lit(None)).cast("string").alias("result"),
                    (success if success is not None else F.lit(None)).cast("string").alias("success"),
                    (ds if ds is not None else F.lit(None)).cast("array<string>").alias("data_source"))


def _legacy_actions() -> Column:
    c = F.coalesce(F.col("content"), F.lit(""))
    role = F.col("role")
    # user: query, or one result per "[Tool Execution Result" segment
    parts = F.split(c, r"\[Tool Execution Result", -1)
    idx = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    results = F.transform(
        F.filter(idx, lambda i: (i < F.size(parts)) & (py_strip(F.get(parts, i)) != "")),
        lambda i: _act(i, "result", F.lit(None),
                       py_strip(F.concat(F.lit(TOOL_RESULT_MARK), F.get(parts, i))),
                       F.when(F.contains(F.get(parts, i), F.lit("[SUCCESS]")), "success").otherwise("failed")))
    user = F.when(F.contains(c, F.lit(TOOL_RESULT_MARK)), results) \
        .otherwise(F.array(_act(0, "query", F.col("content"))))
    # assistant: tool calls, unknown, answer
    tcs = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    has_tc = F.contains(c, F.lit("<tool_call>"))
    has_ans = F.contains(c, F.lit("<answer>"))
    tool_acts = F.transform(tcs, lambda t, i: _act(i, "tool", t))
    unknown_tc = F.when((F.size(tcs) == 0) & has_tc, F.array(_act(0, "unknown", c))) \
        .otherwise(F.array().cast(f"array<{_ACTION}>"))
    ans = F.nullif(py_strip(F.when(c.rlike(tags.ANSWER_TAG), F.regexp_extract(c, tags.ANSWER_TAG, 1))), F.lit(""))
    n_before = F.size(tcs) + F.size(unknown_tc)
    ans_act = (F.when(ans.isNotNull(), F.array(_act(n_before, "answer", ans)))
               .when(has_ans | ~has_tc, F.array(_act(n_before, "unknown", c)))
               .otherwise(F.array().cast(f"array<{_ACTION}>")))
    assistant = F.concat(tool_acts, unknown_tc, ans_act)
    return (F.when(role == "user", user).when(role == "assistant", assistant)
            .otherwise(F.array().cast(f"array<{_ACTION}>")))


def _openai_actions() -> Column:
    c = F.col("content")
    cc = F.coalesce(c, F.lit(""))
    role = F.col("role")
    user = F.when((cc != "") & (F.contains(cc, F.lit("[ERROR]")) | F.contains(cc, F.lit(OPENAI_RESULT_MARK))),
                  F.array().cast(f"array<{_ACTION}>")).otherwise(F.array(_act(0, "query", c)))
    tool = F.array(_act(0, "result", F.lit(None), F.concat(F.lit("[Tool Execution Result]: "), cc), F.lit("success")))
    calls = F.transform(F.coalesce(F.col("tool_calls"), F.array()), lambda tc, i: _act(i, "tool", call_text(tc)))
    a = F.col("_answer_info")  # staged by parse_actions (tags.with_answer)
    answer = F.array(_act(0, a["kind"], a["answer"], ds=a["data_source"]))
    has_calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    return (F.when(role == "user", user).when(role == "tool", tool)
            .when((role == "assistant") & has_calls, calls).when(role == "assistant", answer)
            .otherwise(F.array().cast(f"array<{_ACTION}>")))


def parse_actions(messages: DataFrame, trace: str = "trace_id", seq: str = "seq",
                  formats: DataFrame | None = None) -> DataFrame:
    """Messages → ``(trace_id, seq, sub, type, content, result, success, data_source)``.

    ``type`` ∈ query / tool / unknown / answer / result.  The format flag
    comes from ``detect_format`` (joined per trace) unless given.
    """
    fmt = formats if formats is not None else detect_format(messages, trace)
    m = messages.join(fmt, trace, "left").withColumn("is_openai", F.coalesce("is_openai", F.lit(False)))
    # each format parses only its own rows; the answer cascade is staged
    legacy = m.where(~F.col("is_openai")).select(trace, seq, "role", F.inline(_legacy_actions()))
    oa = tags.with_answer(m.where(F.col("is_openai")), "content", "_answer_info")
    oa = oa.select(trace, seq, "role", F.inline(_openai_actions()))
    return legacy.unionByName(oa)


def turn_number(actions: DataFrame, trace: str = "trace_id", order=("seq", "sub"),
                skew_safe: bool = True) -> DataFrame:
    """Running count of query actions; later actions inherit it."""
    return prefix_scan(actions, [trace], list(order),
                       {"turn": F.when(F.col("type") == "query", 1).otherwise(0)}, skew_safe=skew_safe) \
        .withColumn("turn", F.col("turn").cast("int"))


def fifo_match(events: DataFrame, key: list[str], order: list[str], is_call: Column, is_result: Column,
               skew_safe: bool = True, chunk: Column | None = None) -> DataFrame:
    """Each result goes to the earliest open call; results with no open call drop.

    With c, r the running call/result counts and d = r - c, results dropped
    so far = max(0, running max d); the k-th surviving result (k = r -
    dropped, first row reaching k) pairs with the k-th call.  Returns the
    input rows plus ``call_no`` (calls) and ``_k`` (results: the k a
    surviving result claims; repeated k values mark dropped results).
    """
    ev = events.withColumn("_is_call", is_call.cast("int")).withColumn("_is_res", is_result.cast("int"))
    sc = prefix_scan(ev, key, order, {"_c": F.col("_is_call"), "_r": F.col("_is_res"),
                                      "_d": F.col("_is_res") - F.col("_is_call")},
                     max_of={"_dmax": "_d"}, chunk=chunk, skew_safe=skew_safe)
    k = F.col("_r") - F.greatest(F.lit(0), F.col("_dmax"))
    sc = sc.withColumn("_k", F.when(F.col("_is_res") == 1, k))
    return sc.withColumn("call_no", F.when(F.col("_is_call") == 1, F.col("_c"))).drop("_c", "_r", "_d", "_dmax")


def match_tool_results(events: DataFrame, key: list[str], order: list[str], is_call: Column,
                       is_result: Column, result_cols: list[str], skew_safe: bool = True,
                       chunk: Column | None = None) -> DataFrame:
    """J4 pairs: every call with its matched result (NULL when none).

    Surviving results = first result row per (key, k) — an aggregate;
    the pair join is on (key, k), which spreads a hot trace over k.
    """
    tagged = fifo_match(events, key, order, is_call, is_result, skew_safe, chunk)
    res = tagged.where("_is_res = 1 AND _k >= 1")
    first = res.groupBy(*key, "_k").agg(F.min_by(F.struct(*order, *result_cols), F.struct(*order)).alias("_res"))
    calls = tagged.where("_is_call = 1").drop("_k", "_is_call", "_is_res")
    out = calls.join(first.withColumnRenamed("_k", "call_no"), [*key, "call_no"], "left")
    return out.select(*[c for c in calls.columns],
                      *[F.col(f"_res.{c}").alias(f"result_{c}") for c in [*order, *result_cols]])


def qa_pairs(actions: DataFrame, trace: str = "trace_id", skew_safe: bool = True) -> DataFrame:
    """One row per answered/unanswered non-empty query.

    A pair = all actions of one query turn: the query, the first answer of
    the turn, tools/unknowns before that answer.  Empty queries open no
    pair; actions before the first query are ignored.  Output:
    ``(trace_id, turn, step_index, query, answer, data_source, n_tools,
    answer_seq, answer_sub)``; the tools themselves are ``pair_tools``.
    """
    a = actions.where("turn >= 1")
    pos = F.struct("seq", "sub")
    g = a.groupBy(trace, "turn").agg(
        F.max(F.when(F.col("type") == "query", F.col("content"))).alias("query"),
        F.min_by(F.struct("seq", "sub", "content", "data_source"),
                 F.when(F.col("type") == "answer", pos)).alias("_ans"),
    )
    g = g.where(F.col("query").isNotNull() & (F.col("query") != ""))
    g = g.select(trace, "turn", "query",
                 F.when(F.col("_ans.seq").isNotNull(), F.col("_ans.content")).alias("answer"),
                 F.when(F.col("_ans.seq").isNotNull(), F.coalesce(F.col("_ans.data_source"),
                                                                  F.array().cast("array<string>")))
                 .otherwise(F.array().cast("array<string>")).alias("data_source"),
                 F.col("_ans.seq").alias("answer_seq"), F.col("_ans.sub").alias("answer_sub"))
    tools = pair_tools(actions, g, trace)
    n_tools = tools.groupBy(trace, "turn").agg(F.count("*").alias("n_tools"))
    g = g.join(n_tools, [trace, "turn"], "left").withColumn("n_tools", F.coalesce("n_tools", F.lit(0)))
    g = prefix_scan(g, [trace], ["turn"], {"step_index": F.lit(1)}, skew_safe=skew_safe)
    return g.withColumn("step_index", F.col("step_index").cast("int"))


def pair_tools(actions: DataFrame, pairs: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Tools/unknowns of each pair: same turn, before the pair's answer."""
    t = actions.where(F.col("type").isin("tool", "unknown") & (F.col("turn") >= 1))
    j = t.join(pairs.select(trace, "turn", "answer_seq", "answer_sub"), [trace, "turn"])
    before = F.col("answer_seq").isNull() | (F.struct("seq", "sub") < F.struct("answer_seq", "answer_sub"))
    return j.where(before).drop("answer_seq", "answer_sub")


def tool_metrics(actions: DataFrame, messages: DataFrame, trace: str = "trace_id") -> DataFrame:
    """A1: per trace tool success rate and parallelism.

    success rate = successful tool actions / tool actions (0 if none);
    parallelism = tool actions / assistant messages carrying calls.
    """
    tools = actions.where(F.col("type") == "tool").groupBy(trace).agg(
        F.count("*").alias("n_tools"), F.count_if(F.col("success") == "success").alias("n_success"))
    with_calls = ((F.col("role") == "assistant") &
                  (F.coalesce(F.size("tool_calls") > 0, F.lit(False)) |
                   F.contains(F.coalesce(F.col("content"), F.lit("")), F.lit("<tool_call>"))))
    msgs = messages.groupBy(trace).agg(F.count_if(with_calls).alias("n_call_msgs"))
    j = msgs.join(tools, trace, "left").fillna(0, ["n_tools", "n_success"])
    return j.select(trace, "n_tools", "n_success", "n_call_msgs",
                    F.coalesce(F.try_divide("n_success", "n_tools"), F.lit(0.0)).alias("tool_success_rate"),
                    F.coalesce(F.try_divide("n_tools", "n_call_msgs"), F.lit(0.0)).alias("tool_parallelism"))


def call_list(turned: DataFrame, trace: str = "trace_id", chunk: Column | None = None) -> DataFrame:
    """A1: every tool call with its name, parameters, turn and matched result
    ``(trace_id, turn, seq, sub, tool_name, params, success, result)``.  ``turned``
    are turn-numbered actions; results go to open calls in order (J4).  A call
    that is no JSON object is its own name with no parameters."""
    kind = F.col("type")
    called = match_tool_results(turned, [trace], ["seq", "sub"], kind.isin("tool", "unknown"), kind == "result",
                                ["result", "success"], chunk=chunk).where(kind == "tool")
    v = strict_json(F.col("content"))
    is_obj = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    name = F.when(is_obj, F.coalesce(F.try_variant_get(v, "$.tool", "string"), F.lit("unknown"))).otherwise(F.col("content"))
    params = F.when(is_obj, F.to_json(F.try_variant_get(v, "$.params", "variant")))
    return called.select(trace, "turn", "seq", "sub", name.alias("tool_name"), F.coalesce(params, F.lit("{}")).alias("params"),
                         F.col("result_success").alias("success"), F.col("result_result").alias("result"))


def match_by_call_id(calls: DataFrame, results: DataFrame, trace: str = "trace_id",
                     call_id: str = "call_id", result_id: str = "tool_call_id") -> DataFrame:
    """J4 (id mode): results matched to calls by their tool-call id instead of
    arrival order — an equi-join on (trace, id); calls without a result keep
    NULLs, results naming an unknown id are dropped, an id that repeats counts once."""
    r = results.select(F.col(trace), F.col(result_id).alias(call_id),
                       *[F.col(c).alias(f"result_{c}") for c in results.columns if c not in (trace, result_id)])
    first = r.groupBy(trace, call_id).agg(*[F.first(c).alias(c) for c in r.columns if c not in (trace, call_id)])
    return calls.join(first, [trace, call_id], "left")
