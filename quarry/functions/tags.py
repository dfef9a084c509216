"""Tagged-response parsing as Column expressions.

All regexes run in the JVM (``(?s)`` = DOTALL, ``(?i)`` = ignore case);
JSON goes through ``try_parse_json`` (VARIANT), so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import py_strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has(x: Column, lit: str) -> Column:
    return F.contains(x, F.lit(lit))


def count_sub(x: Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def _first_group(x: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL when there is no match."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


# ---------------------------------------------------------------- F6
# fixed values: the fenced-block patterns, lazy and greedy
FENCE_LAZY = r"```(?:json)?\s*([\s\S]*?)\s*```"
FENCE_GREEDY = r"```(?:json)?\s*([\s\S]*)\s*```"


def strict_json(c: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, else NULL.

    The JSON parser stops behind the first value.  Wrapped as the only array
    element and as the only object member, text behind the value makes one
    of the two invalid.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    as_member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    alone = as_member.isNotNull() & F.try_variant_get(as_item, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(as_item, "$[0]", "variant"))


def _obj_or_arr(c: Column) -> Column:
    """Direct parse, then first ``{…last}``, then first ``[…last]``."""
    obj = _first_group(c, r"(\{[\s\S]*\})")
    arr = _first_group(c, r"(\[[\s\S]*\])")
    return F.coalesce(F.when(strict_json(c).isNotNull(), c), F.when(strict_json(obj).isNotNull(), obj),
                      F.when(strict_json(arr).isNotNull(), arr))


def _fenced(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), py_strip(F.regexp_extract(text, pattern, 1)))


def _json_choice(x: Column, text: Column, lazy: Column, greedy: Column) -> Column:
    """F6 cascade over a stripped text and its fenced bodies."""
    fenced = F.coalesce(F.when(strict_json(lazy).isNotNull(), lazy), F.when(strict_json(greedy).isNotNull(), greedy))
    cand = F.when(lazy.isNull() & greedy.isNull(), _obj_or_arr(text)).otherwise(
        F.coalesce(_obj_or_arr(lazy), F.when(greedy != lazy, _obj_or_arr(greedy))))
    return F.when(x.isNull() | (x == ""), F.lit(None).cast("string")).otherwise(F.coalesce(fenced, cand))


def extract_json_text(x) -> Column:
    """the JSON text the parse cascade settles on (NULL = parse error).

    Fenced block (lazy), fenced (greedy), then for each candidate (fenced
    bodies, else the whole text): direct, ``{…}``, ``[…]``.
    """
    text = py_strip(_c(x))
    return _json_choice(_c(x), text, _fenced(text, FENCE_LAZY), _fenced(text, FENCE_GREEDY))


def extract_json(x) -> Column:
    """F6 as VARIANT (NULL when the cascade finds no JSON)."""
    return strict_json(extract_json_text(x))


# ---------------------------------------------------------------- F7
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
# fixed values: answer headings tried in order (the list repeats one entry)
ANSWER_KEYWORDS = ["**Answer:**", "**Answer:**", "## Answer", "### Answer", "## Response",
                   "### Response", "Answer:"]


def answer_tag(x) -> Column:
    """First ``<answer>…</answer>`` body, stripped; NULL if absent or blank."""
    a = py_strip(_first_group(_c(x), ANSWER_TAG))
    return F.nullif(a, F.lit(""))


def _after_keyword(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for kw in reversed(ANSWER_KEYWORDS):
        after = py_strip(F.substring(x, F.instr(x, kw) + len(kw), 1 << 30))
        out = F.when(_has(x, kw), F.nullif(after, F.lit(""))).otherwise(out)
    return out


def _json_answer(v: Column) -> Column:
    """STRUCT<answer, data_source> of a parsed object with an answer and no error."""
    ok = F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & F.try_variant_get(v, "$.error", "variant").isNull() & \
        F.try_variant_get(v, "$.answer", "variant").isNotNull()
    answer = F.nullif(py_strip(F.try_variant_get(v, "$.answer", "string")), F.lit(""))
    none = F.array().cast("array<string>")
    return F.struct(F.when(ok, answer).alias("answer"),
                    F.when(ok, F.coalesce(F.try_variant_get(v, "$.data_source", "array<string>"), none)).alias("data_source"))


def _answer_choice(c: Column, tag: Column, js: Column, kw: Column) -> Column:
    """F7 cascade over the tag body, the JSON answer and the text behind a heading."""
    blank = c.isNull() | (py_strip(c) == "")
    found = F.coalesce(tag, js["answer"], kw)
    kind = F.when(found.isNull() & blank, F.lit("unknown")).otherwise("answer")
    answer = F.coalesce(found, F.when(~blank, c), F.lit("Empty Content"))
    ds = F.when(tag.isNull() & js["answer"].isNotNull(), js["data_source"]).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.alias("kind"), answer.alias("answer"), ds.alias("data_source"))


def extract_answer(x) -> Column:
    """STRUCT<kind, answer, data_source ARRAY<STRING>> for an assistant text.

    ``<answer>`` → JSON ``answer`` (+``data_source``) → heading keywords →
    whole content → kind ``unknown`` with "Empty Content".
    """
    c = _c(x)
    return _answer_choice(c, answer_tag(c), _json_answer(extract_json(c)), _after_keyword(c))


# ---------------------------------------------------------------- F8
# fixed values: the call patterns
TOOL_CALL_TAG = r"(?is)<tool_call>(.*?)</tool_call>"
INVOKE = r"""(?is)<invoke\s+name=["'](.*?)["']\s*>(.*?)</invoke>"""
PARAM = r"""(?is)<parameter\s+name=["'](.*?)["']\s*>(.*?)</parameter>"""
FENCED_OBJ = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"


def _truthy_variant(v: Column) -> Column:
    """Python truthiness of a JSON value: null, '', {}, [], 0, false are false."""
    t = F.schema_of_variant(v)
    s = v.cast("string")
    falsy = (((t == "STRING") & (s == "")) | (F.startswith(t, F.lit("OBJECT")) & (s == "{}"))
             | (F.startswith(t, F.lit("ARRAY")) & (s == "[]")) | ((t == "BOOLEAN") & (s == "false"))
             | (t == "VOID") | (s.try_cast("double") == 0) & ~F.startswith(t, F.lit("STRING")))
    return v.isNotNull() & ~F.coalesce(falsy, F.lit(False))


def _json_call(body: Column) -> Column:
    v = F.try_parse_json(py_strip(body))
    is_obj = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    name = None
    for k in ("tool", "name", "function"):
        cand = F.try_variant_get(v, f"$.{k}", "variant")
        val = F.when(_truthy_variant(cand), F.try_variant_get(v, f"$.{k}", "string"))
        name = val if name is None else F.coalesce(name, val)
    params = None
    for k in ("params", "arguments", "parameters"):
        cand = F.try_variant_get(v, f"$.{k}", "variant")
        val = F.when(_truthy_variant(cand), F.to_json(cand))
        params = val if params is None else F.coalesce(params, val)
    return F.struct(F.when(is_obj, name).alias("name"), F.coalesce(params, F.lit("{}")).alias("arguments"))


def _parameters(body: Column) -> Column:
    """MAP of an XML call's parameters; a repeated name keeps its last value."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(PARAM), 1).alias("k"),
                         F.transform(F.regexp_extract_all(body, F.lit(PARAM), 2), py_strip).alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, values)


def extract_tool_calls(x) -> Column:
    """F8: ARRAY<STRUCT<name, arguments JSON STRING>> in text order.

    ``<tool_call>`` JSON bodies, then XML ``<invoke>`` calls; fenced JSON
    blocks only when neither form produced a call.
    """
    c = _c(x)
    tagged = F.transform(F.regexp_extract_all(c, F.lit(TOOL_CALL_TAG), 1), _json_call)
    names = F.regexp_extract_all(c, F.lit(INVOKE), 1)
    bodies = F.regexp_extract_all(c, F.lit(INVOKE), 2)
    xml = F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda z: F.struct(
        z["n"].alias("name"), F.to_json(_parameters(z["b"])).alias("arguments")))
    both = F.filter(F.concat(tagged, xml), lambda s: s["name"].isNotNull())
    fenced = F.filter(F.transform(F.regexp_extract_all(c, F.lit(FENCED_OBJ), 1), _json_call),
                      lambda s: s["name"].isNotNull())
    return F.when(c.isNull(), F.array()).otherwise(F.when(F.size(both) > 0, both).otherwise(fenced))


# ---------------------------------------------------------------- F9
# fixed values: reasoning tags, in priority order
REASONING_TAGS = ["think", "reasoning", "thought"]


def extract_reasoning(x) -> Column:
    """STRUCT<reasoning, remaining>: tag bodies joined by a blank line."""
    rest = _c(x)
    parts = F.array().cast("array<string>")
    for t in REASONING_TAGS:
        pat = f"(?is)<{t}>(.*?)</{t}>"
        found = F.regexp_extract_all(rest, F.lit(pat), 1)
        parts = F.concat(parts, F.transform(found, py_strip))
        rest = F.when(F.size(found) > 0, py_strip(F.regexp_replace(rest, pat, ""))).otherwise(rest)
    reasoning = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
    return F.struct(reasoning.alias("reasoning"), F.when(F.size(parts) > 0, rest).otherwise(_c(x)).alias("remaining"))


# ---------------------------------------------------------------- P9 / F23
def _think_norm(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<thinking>"), F.lit("<think>")), F.lit("</thinking>"), F.lit("</think>"))


def validate_tags(x) -> Column:
    """STRUCT<is_valid, errors ARRAY<STRING>, think_warning>."""
    n = _think_norm(_c(x))
    t_open, t_close = count_sub(n, "<think>"), count_sub(n, "</think>")
    body = F.regexp_replace(n, r"(?s)<think>.*?</think>", "")
    has_tc, has_ans = _has(body, "<tool_call>"), _has(body, "<answer>")

    def mismatch(tag):
        o, c = count_sub(body, f"<{tag}>"), count_sub(body, f"</{tag}>")
        return F.when(o != c, F.format_string(f"<{tag}> tags mismatch: %d open, %d closed", o, c))

    # fixed values: the error and warning texts
    errs = F.array(
        F.when(~has_tc & ~has_ans,
               F.lit("Missing action tags: requires <tool_call>...</tool_call> or <answer>...</answer>")),
        F.when(has_tc, mismatch("tool_call")),
        F.when(has_ans, mismatch("answer")),
        F.when(_has(body, "<current_step>"), mismatch("current_step")))
    errors = F.filter(errs, lambda e: e.isNotNull())
    warn = F.when(t_open == 0, F.lit("Missing thinking tags <think>...</think>")) \
        .when(t_open != t_close, F.format_string("<think> tags mismatch: %d open, %d closed", t_open, t_close))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warn.alias("think_warning"))


def normalize_tags(content, reasoning=None) -> Column:
    """``<thinking>``→``<think>``; drop ``</think>`` when reasoning is
    separate or no ``<think>`` opens; wrap reasoning as a think block."""
    c = _think_norm(_c(content))
    has_reasoning = F.lit(False) if reasoning is None else (_c(reasoning).isNotNull() & (_c(reasoning) != ""))
    c = F.when(has_reasoning | ~_has(c, "<think>"), F.replace(c, F.lit("</think>"), F.lit(""))).otherwise(c)
    if reasoning is None:
        return c
    return F.concat(F.when(has_reasoning, F.concat(F.lit("<think>\n"), _c(reasoning), F.lit("\n</think>\n\n")))
                    .otherwise(F.lit("")), F.coalesce(c, F.lit("")))


# ------------------------------------------------- staged (DataFrame) forms
# Column forms above repeat sub-expressions (e.g. the fenced body is used by
# several branches).  Inside generators and CASE branches Spark cannot
# share them, so hot paths use these staged versions: each intermediate is
# its own projected column, and CollapseProject keeps expensive columns
# that are referenced more than once un-inlined.

def with_json_text(df, col: str, out: str = "_json_text"):
    """F6 staged: adds ``out`` = JSON text chosen by the cascade (or NULL)."""
    df = df.withColumn("_jt_text", py_strip(F.col(col)))
    df = df.withColumns({"_jt_lazy": _fenced(F.col("_jt_text"), FENCE_LAZY),
                         "_jt_greedy": _fenced(F.col("_jt_text"), FENCE_GREEDY)})
    return df.withColumn(out, _json_choice(F.col(col), F.col("_jt_text"), F.col("_jt_lazy"), F.col("_jt_greedy"))) \
        .drop("_jt_text", "_jt_lazy", "_jt_greedy")


def with_answer(df, col: str, out: str = "answer_info"):
    """F7 staged: adds ``out`` = STRUCT<kind, answer, data_source>."""
    df = with_json_text(df, col, "_ans_json").withColumn("_ans_v", strict_json(F.col("_ans_json")))
    df = df.withColumns({"_ans_tag": answer_tag(col), "_ans_kw": _after_keyword(F.col(col)),
                         "_ans_js": _json_answer(F.col("_ans_v"))})
    return df.withColumn(out, _answer_choice(F.col(col), F.col("_ans_tag"), F.col("_ans_js"), F.col("_ans_kw"))) \
        .drop("_ans_json", "_ans_v", "_ans_tag", "_ans_kw", "_ans_js")
