"""Scalar quirks: number parsing, tags, JSON cascade, strip, clip."""

from pyspark.sql import functions as F

from quarry.functions import tags
from quarry.functions.text import clip_tail, line_label, py_strip, split_lines
from quarry.operators.cells import is_junk, normalize_cell


def _one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first().y


def test_normalize_cell(spark):
    n = normalize_cell(F.col("x"))
    assert _one(spark, n, "1,234").num == 1234.0
    assert _one(spark, n, " 12.5% ").num == 0.125
    assert _one(spark, n, "1d").num is None          # Spark would cast it; Python would not
    assert _one(spark, n, " abc ").text == " abc "   # untrimmed original kept
    assert _one(spark, n, "  ").text == ""


def test_junk(spark):
    assert _one(spark, is_junk("x"), "Unnamed: 3")
    assert _one(spark, is_junk("x"), "unnamed:12")
    assert not _one(spark, is_junk("x"), "Unnamed")


def test_split_lines(spark):
    assert _one(spark, split_lines(F.col("x")), "a\r\nb\rc\n") == ["a", "b", "c"]
    assert _one(spark, split_lines(F.col("x")), "") == []


def test_strip_unicode(spark):
    assert _one(spark, py_strip(F.col("x")), "　 a b\t\n") == "a b"


def test_answer_cascade(spark):
    a = tags.extract_answer(F.col("x"))
    assert _one(spark, a, "x <answer> 42 </answer> y").answer == "42"
    r = _one(spark, a, 'noise ```json\n{"answer": "B", "data_source": ["a/t.csv"]}\n``` tail')
    assert (r.answer, r.data_source) == ("B", ["a/t.csv"])
    assert _one(spark, a, "text\n## Answer\n 7 ").answer == "7"
    assert _one(spark, a, "   ").kind == "unknown"


def test_tool_calls(spark):
    c = tags.extract_tool_calls(F.col("x"))
    r = _one(spark, c, '<tool_call>{"name": "grep", "arguments": {"p": 1}}</tool_call>'
                       '<invoke name="read"><parameter name="path"> a.csv </parameter></invoke>')
    assert [x.name for x in r] == ["grep", "read"]
    assert r[1].arguments == '{"path":"a.csv"}'
    r = _one(spark, c, '```json\n{"tool": "ls", "params": {}}\n```')
    assert [x.name for x in r] == ["ls"]


def test_validate_tags(spark):
    v = _one(spark, tags.validate_tags("x"), "<thinking>a</thinking><answer>b")
    assert not v.is_valid and v.errors == ["<answer> tags mismatch: 1 open, 0 closed"]
    assert _one(spark, tags.validate_tags("x"), "<think>x</think><tool_call>{}</tool_call>").is_valid


def test_clip_and_label(spark):
    s = _one(spark, clip_tail(F.col("x"), 5), "abcdefgh")
    assert s.endswith("defgh") and "original length: 8" in s
    assert _one(spark, line_label(F.lit(12345), F.col("x")), "row  ") == "12345| row"


def test_split_lines_matches_splitlines(spark):
    cases = ["a\n\n", "a\r\n", "a\n\r", "\n", "", "a", "a\rb\r\nc\n", "x\n\n\ny", "\r\r"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r.y for r in df.select(split_lines(F.col("x")).alias("y")).collect()]
    assert got == [c.splitlines() for c in cases]


def test_py_strip_matches_python(spark):
    cases = ["\x1c a \x85", "　 b\t", "﻿c ", "  "]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [r.y for r in df.select(py_strip(F.col("x")).alias("y")).collect()] == [c.strip() for c in cases]
