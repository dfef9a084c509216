"""Small cases that tell the specified semantics from near misses."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.operators import cache as K
from quarry.operators import cells as C
from quarry.operators import messages as MS
from quarry.operators import samples as S
from quarry.sources import files as FS

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MSG = f"trace_id long, seq long, role string, content string, reasoning_content string, thought_signature string, tool_calls {CALLS}, tool_call_id string, tool_name string"


def messages(spark, rows):
    full = [{"trace_id": 1, "seq": i, **r} for i, r in enumerate(rows)]
    keys = ["trace_id", "seq", "role", "content", "reasoning_content", "thought_signature", "tool_calls", "tool_call_id", "tool_name"]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in full], MSG)


def call(name, args, call_id="c1"):
    return [(call_id, "function", (name, args))]


def test_strict_json_falls_through_to_the_object(spark):
    texts = ['[1] see {"answer":"x"}', '3 rows: {"answer":"x"}', '{"answer":"x"} trailing', '"just text"', "1], [2", '1, "v": 2', "", "{bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.j, r.a) for r in tags.with_answer(df, "t").select(
        "i", tags.extract_json_text("t").alias("j"), F.col("answer_info.answer").alias("a")).collect()}
    assert [got[i][0] for i in range(8)] == ['{"answer":"x"}'] * 3 + ['"just text"', None, None, None, None]
    assert [got[i][1] for i in range(3)] == ["x", "x", "x"]


def test_repeated_xml_parameter_keeps_its_last_value(spark):
    text = '<invoke name="f"><parameter name="a">1</parameter><parameter name="b">2</parameter><parameter name="a">3</parameter></invoke>'
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(tags.extract_tool_calls("t")).alias("c"))
    assert [(r.c.name, r.c.arguments) for r in df.collect()] == [("f", '{"a":"3","b":"2"}')]


def test_reasoning_behind_the_last_real_query_stays(spark):
    m = messages(spark, [dict(role="user", content="q"), dict(role="assistant", content="a", reasoning_content="r1"),
                         dict(role="user", content="[Tool Execution Result: f]\nok"), dict(role="user", content=""),
                         dict(role="assistant", content="b", reasoning_content="r2")])
    assert [r.reasoning_content for r in MS.suppress_reasoning(m).orderBy("seq").collect()] == [None, "r1", None, None, "r2"]


def test_tool_results_merge_into_any_result_before_them(spark):
    m = messages(spark, [dict(role="assistant", content="x"), dict(role="tool", content="r1", tool_call_id="c1"),
                         dict(role="tool", content="r2", tool_name="f"), dict(role="tool", content="r3", tool_name="g"),
                         dict(role="user", content="q"), dict(role="tool", content="r4", tool_name="h")])
    got = [(r.message_no, r.part_no, r.role, r.content) for r in MS.merge_tool_results(m).orderBy("seq").collect()]
    assert got == [(1, 1, "assistant", "x"), (2, 1, "tool", "r1"), (2, 2, "tool", "[Tool Execution Result: f]\nr2"),
                   (2, 3, "tool", "[Tool Execution Result: g]\nr3"), (3, 1, "user", "q"), (4, 1, "user", "[Tool Execution Result: h]\nr4")]


@pytest.mark.parametrize("kwargs, expected", [
    ({}, "Conversation History:\nUser: q\nAssistant: x\nCall tool: grep({\"a\":1})\nAssistant: Call tool: f({})"),
    ({"style": "markdown", "labels": {"user": "Me"}}, "### Conversation History\n\n**Me**: q\n\n**Assistant**: x\nCall tool: grep({\"a\":1})\n\n**Assistant**: Call tool: f({})\n"),
    ({"style": "xml", "max_chars": 6}, '<conversation_history>\n  <message role="user">q</message>\n  <message role="assistant">x\nCall</message>\n  <message role="assistant">Call t</message>\n</conversation_history>'),
    ({"header": False, "max_turns": 1}, "Assistant: Call tool: f({})")])
def test_history_text(spark, kwargs, expected):
    m = messages(spark, [dict(role="user", content="q"), dict(role="assistant", content="x", tool_calls=call("grep", '{"a":1}')),
                         dict(role="assistant", content="", tool_calls=call("f", "{}"))])
    assert MS.history_text(m, **kwargs).first().history == expected


def test_query_history_drops_only_the_current_query(spark):
    m = messages(spark, [dict(role="user", content="a"), dict(role="user", content="b")])
    assert [r.line for r in MS.query_history(m).collect()] == ["Historical Query 1: a"]
    other = spark.createDataFrame([(1, "a")], "trace_id long, current_query string")
    assert sorted(r.line for r in MS.query_history(m, current=other).collect()) == ["Historical Query 1: a", "Historical Query 2: b"]


def test_display_shows_parsed_or_bare_arguments(spark):
    m = messages(spark, [dict(role="assistant", content="", tool_calls=call("f", '{"a": 1}')), dict(role="assistant", content="", tool_calls=call("g", "raw text"))])
    assert [r.display for r in MS.tool_display_text(m).orderBy("seq").collect()] == [
        '{"tool":"f","params":{"a":1}}', '{"tool":"g","params":"raw text"}']


def test_table_description_leaves_out_what_is_missing(spark):
    cols = "array<struct<col_name:string,col_type:string,col_desc:string>>"
    df = spark.createDataFrame([("p", "d", [("c", "int", "n"), (None, None, None)]), ("q", None, None)], f"file_path string, table_desc string, column_info {cols}")
    assert {r.file_path: r.text for r in C.describe_table(df).collect()} == {
        "p": "File path: p\nTable description: d\nColumn information:\n  - c (int): n\n  - Unknown (): ", "q": "File path: q"}


def folder_view(paths, quota):
    """Plain walk: the root's children, then the first directory as long as whole levels fit."""
    tree = {}
    for p in paths:
        node = tree
        parts = p.split("/")
        for x in parts[:-1]:
            node = node.setdefault(x, {})
        node[parts[-1]] = None
    out, here, at = [], tree, []
    while here is not None:
        names = sorted(here, key=lambda n: (here[n] is None, n))
        out += [("/".join(at), n) for n in names[:quota]]
        quota -= min(quota, len(names))
        dirs = [n for n in names if here[n] is not None]
        if not quota or not dirs:
            break
        at, here = [*at, dirs[0]], here[dirs[0]]
    return out


def test_folder_view_follows_the_first_directories(spark):
    rng = random.Random(1)
    for quota in (1, 3, 6, 30):
        paths = sorted({"/".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 5))) + f"/f{rng.randrange(9)}.csv" for _ in range(25)})
        paths += [f"root{i}.csv" for i in range(rng.randrange(3))]
        df = spark.createDataFrame([(p,) for p in paths], "relative_path string")
        got = [(r.parent, r.name) for r in K.dirs_first_order(df, quota).collect()]
        assert sorted(got) == sorted(folder_view(paths, quota))


@pytest.mark.parametrize("block", [1_000_000, 25])
def test_match_sample_in_any_script(spark, monkeypatch, block):
    """Short, repeated, non-Latin and blank tasks; blocks of needles as well as one scan."""
    monkeypatch.setattr(S, "BLOCK_CHARS", block)
    rng = random.Random(4)
    words = ["table", "größe", "日本語", "データ", "строка", "a", "b", "sum", "é"]

    def text(n):
        return rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", " ", "\n"])

    tasks = [text(rng.choice([0, 1, 2, 3, 5, 7, 9])) for _ in range(40)] + ["日本", "ー", None]
    samples = [(i, x, "ans" if i % 5 else None) for i, x in enumerate(tasks + tasks[:10])]
    queries = [(1000 + i, text(rng.choice([0, 1, 2, 4, 6, 8, 14])) + (rng.choice(tasks[:40]) if rng.random() < 0.3 else "")) for i in range(60)]
    queries += [(5000, None), (5001, "データ日本語です")]
    want = {}
    for k, q in queries:
        q = (q or "").strip()
        for o, x, a in samples:
            x = (x or "").strip()
            if a is not None and (x == q or (q and q in x) or (x and x in q)):
                want[k] = o
                break
    sd = spark.createDataFrame(samples, "ord long, task string, answer string").withColumn("design", F.lit(None).cast("struct<checkout_list:array<string>>"))
    qd = spark.createDataFrame(queries, "trace_id long, query string").repartition(3)
    assert {r.trace_id: r.ord for r in S.match_sample(qd, sd).collect()} == want


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    lines = [f"line {i}" for i in range(1, 400)]
    for k in range(4):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[k * 100:(k + 1) * 100]) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {r.line_no: r.line for r in FS.big_file_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == {i: f"line {i}" for i in range(1, 400)}
