"""File sources and sinks on small files written to a scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import grep
from quarry.sources import files as S
from quarry.sources import sinks as K


def _scratch():
    return tempfile.mkdtemp(prefix="quarry-test-")


def test_manifest_lines_and_records(spark):
    d = _scratch()
    os.makedirs(f"{d}/a/__pycache__")
    with open(f"{d}/a/t1.csv", "wb") as f:
        f.write('﻿name,note\r\nx,"two\nlines"\r\ny,z\r\n'.encode("utf-8"))
    with open(f"{d}/a/t2.CSV", "w") as f:
        f.write("q\n")
    with open(f"{d}/a/t3.tsv", "wb") as f:
        f.write("caf\xe9\tb\n".encode("latin-1"))  # not valid UTF-8
    m = S.file_manifest(spark, d)
    assert sorted(r.name for r in m.collect()) == ["t1.csv", "t3.tsv"]  # suffix match is case-sensitive
    files = S.read_file_texts(spark, d, strip_bom=True)
    lines = S.raw_lines(files).where(F.col("path").endswith("t1.csv")).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["name,note", 'x,"two', 'lines"', "y,z"]  # physical lines
    tsv = S.raw_lines(files).where(F.col("path").endswith("t3.tsv")).first()
    assert tsv.line == "caf\xe9\tb"  # latin-1 fallback through the decode hook
    rec = S.csv_records(spark, f"{d}/a/t1.csv").collect()
    assert len(rec) == 3 and rec[1]["_c1"] == "two\nlines"  # records keep quoted newlines


def test_big_file_lines(spark):
    d = _scratch()
    with open(f"{d}/big.txt", "w") as f:
        for i in range(5000):
            f.write(f"row {i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.big_file_lines(spark, f"{d}/big.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.line) for r in got) == [(i + 1, f"row {i}") for i in range(5000)]


def test_grep_file_filter(spark):
    rows = [("/r/a/x.csv", "x.csv"), ("/r/.git/y.csv", "y.csv"), ("/r/a/z.parquet", "z.parquet"),
            ("/r/node_modules/k.txt", "k.txt"), ("/r/b/Q.TSV", "Q.TSV")]
    m = spark.createDataFrame(rows, "path string, name string")
    assert sorted(r.name for r in grep.grep_file_filter(m).collect()) == ["Q.TSV", "x.csv"]
    assert [r.name for r in grep.grep_file_filter(m, "^x").collect()] == ["x.csv"]


def test_samples_and_traces(spark):
    d = _scratch()
    with open(f"{d}/samples.json", "w") as f:
        json.dump([{"task": "A", "answer": 3, "table_path": "t.csv"},
                   {"question": "B", "design": {"type": "c", "checkout_list": [{"idx": 1, "info_item": "b1"}]}}], f)
    s = K.samples_source(spark, f"{d}/samples.json").orderBy("ord").collect()
    assert [r.task for r in s] == ["A", "B"] and s[0].table_path == ["t.csv"]
    os.makedirs(f"{d}/traces")
    with open(f"{d}/traces/trace_1.json", "w") as f:
        json.dump({"metadata": {"query": "q", "total_turns": 1, "success": True},
                   "conversation_trace": [{"turn": 1, "messages": [{"role": "user", "content": "q"}],
                                           "response": {"content": "<answer>1</answer>"}}]}, f)
    with open(f"{d}/traces/broken.json", "w") as f:
        f.write("{not json")
    t = K.trace_source(spark, f"{d}/traces").orderBy("seq").collect()
    assert [(r.role, r.content) for r in t] == [("user", "q"), ("assistant", "<answer>1</answer>")]


def test_sinks(spark):
    d = _scratch()
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")],
                               "trace_id long, seq long, role string, content string")
    K.trace_sink(df, f"{d}/traces")
    back = spark.read.json(f"{d}/traces").orderBy("seq").collect()
    assert [r.content for r in back] == ["hi", "yo"]
    K.csv_sink(df, f"{d}/csv")
    assert spark.read.option("header", True).csv(f"{d}/csv").count() == 2


def _decoded(data):
    for enc in S.ENCODINGS:
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            continue


def test_bundled_files_stay_files(spark):
    d = _scratch()
    rows = [("a", f"run={i}", f"{i} caf\xe9\n\u20ac") for i in range(300)] + [("a", "run=300", ""), ("b", "run=7", "x\r\ny")]
    df = spark.createDataFrame(rows, "source string, name string, body string")
    for encoding, other in (("UTF-8", "\u20ac"), ("ISO-8859-1", "?")):
        out = f"{d}/{encoding}"
        K.bundle_sink(df.coalesce(1), out, ["source"], encoding)
        assert sum(f.endswith(".txt") for _, _, fs in os.walk(out) for f in fs) == 2  # whatever the number of files
        got = {"/".join(r.path.split("/")[-3::2]): r.text for r in S.read_file_texts(spark, out, glob="*.txt", bundled=True).collect()}
        assert got.pop("source=b/run=7") == "x\r\ny\n" and got.pop("source=a/run=300") == "\n"
        assert got == {f"source=a/run={i}": _decoded(f"{i} caf\xe9\n{other}\n".encode(encoding)) for i in range(300)}


def test_documents_lie_in_few_files(spark):
    from quarry.plans import q_sources as Q
    d = _scratch()
    spark.createDataFrame([(i, f"s{i % 2}", f"{i} \"caf\xe9\", b\n") for i in range(4000)], "doc_id long, source string, text string") \
        .write.parquet(f"{d}/documents.parquet")
    for query, line, encoding in ((Q.q_raw_lines, '{} "caf\xe9", b\n\n', "utf-8"), (Q.q_decode_fallback, '"{} \\"caf\xe9\\", b"\n', "latin-1")):
        made = []
        seen, Q._scratch = Q._scratch, lambda s, n: made.append(f"{d}/{n}") or made[-1]
        try:
            got = query(spark, d).collect()
        finally:
            Q._scratch = seen
        assert sum(not f.startswith((".", "_")) for _, _, fs in os.walk(made[0]) for f in fs) <= 4
        files = {}
        for i in range(4000):
            files[f"s{i % 2}", i // 64] = files.get((f"s{i % 2}", i // 64), "") + line.format(i)
        assert sorted((r.source, r.run, r.line_no, r.line) for r in got) == sorted(
            (*k, n, x) for k, t in files.items() for n, x in enumerate(_decoded(t.encode(encoding))[:-1].split("\n"), 1))
