"""Order-dependent operators vs sequential Python models on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.operators import traces as T
from quarry.operators import scan
from quarry.operators.scan import prefix_scan


def _queue_model(kinds):
    """Each result goes to the earliest open call; no open call -> dropped."""
    open_calls, pairs, call_no = [], {}, 0
    for i, k in enumerate(kinds):
        if k == "call":
            call_no += 1
            open_calls.append(call_no)
        elif k == "result" and open_calls:
            pairs[open_calls.pop(0)] = i
    return pairs


def test_fifo_match_against_queue(spark):
    rng = random.Random(7)
    rows, expect = [], {}
    for t in range(40):
        n = rng.randint(0, 60)
        kinds = [rng.choice(["call", "result", "other", "call", "result"]) for _ in range(n)]
        for i, k in enumerate(kinds):
            rows.append((t, i, k))
        for c, i in _queue_model(kinds).items():
            expect[(t, c)] = i
    df = spark.createDataFrame(rows, "trace_id long, seq long, kind string")
    for skew_safe, chunk in ((False, None), (True, F.floor(F.col("seq") / 7).cast("long"))):
        got = T.match_tool_results(df, ["trace_id"], ["seq"], F.col("kind") == "call", F.col("kind") == "result",
                                   ["kind"], skew_safe=skew_safe, chunk=chunk)
        res = {(r.trace_id, r.call_no): r.result_seq for r in got.collect() if r.result_seq is not None}
        assert res == expect


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_prefix_scan_matches_window(spark, monkeypatch, span):
    monkeypatch.setattr(scan, "SPAN", span)
    rng = random.Random(3)
    rows = [(rng.randint(0, 4), i, rng.randint(-3, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    a = prefix_scan(df, ["k"], ["o"], {"s": F.col("v")}, max_of={"m": "s"}, chunk=F.floor(F.col("o") / 37).cast("long"))
    b = prefix_scan(df, ["k"], ["o"], {"s": F.col("v")}, max_of={"m": "s"}, skew_safe=False)
    assert sorted(a.select("k", "o", "s", "m").collect()) == sorted(b.select("k", "o", "s", "m").collect())


def _pairs_model(actions):
    """Sequential QA pairing as described: query opens, first answer closes."""
    out, cur, tools = [], None, 0
    for typ, content in actions:
        if typ == "query":
            if cur:
                out.append((cur, None, tools))
            cur, tools = content, 0
        elif typ in ("tool", "unknown"):
            if cur:
                tools += 1
        elif typ == "answer" and cur:
            out.append((cur, content, tools))
            cur, tools = None, 0
    if cur:
        out.append((cur, None, tools))
    return out


def test_qa_pairs_against_model(spark):
    rng = random.Random(11)
    rows, expect = [], {}
    for t in range(30):
        acts = []
        for i in range(rng.randint(0, 25)):
            typ = rng.choice(["query", "tool", "answer", "unknown", "query", "answer"])
            content = rng.choice(["", f"q{t}_{i}"]) if typ == "query" else f"{typ}{i}"
            acts.append((typ, content))
            rows.append((t, i, 0, typ, content))
        expect[t] = _pairs_model(acts)
    df = spark.createDataFrame(rows, "trace_id long, seq long, sub int, type string, content string") \
        .withColumn("data_source", F.lit(None).cast("array<string>"))
    got = T.qa_pairs(T.turn_number(df)).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.trace_id, r.step_index)):
        res.setdefault(r.trace_id, []).append((r.query, r.answer, r.n_tools))
    assert {k: v for k, v in expect.items() if v} == res


def _header_model(grid):
    """Vertical fill from original cells, else left lookup into filled rows."""
    cols = [[(grid[r][c] or "").strip() for r in range(len(grid))] for c in range(len(grid[0]))]
    out = []
    for ci, col in enumerate(cols):
        new, cur = [], ""
        for ri, cell in enumerate(col):
            if not cell:
                if cur:
                    col[ri] = cur
                else:
                    for li in range(ci - 1, -1, -1):
                        if cols[li][ri]:
                            col[ri] = cols[li][ri]
                            new.append(cols[li][ri])
                            break
            else:
                cur = cell
                new.append(cell)
        out.append("-".join(dict.fromkeys(x for x in new if x)))
    return out


def test_flatten_header_against_model(spark):
    rng = random.Random(5)
    rows, expect = [], {}
    for f in range(60):
        n, w = rng.randint(1, 4), rng.randint(1, 6)
        grid = [[rng.choice(["", "", "a", "b", "c"]) for _ in range(w)] for _ in range(n)]
        for r in range(n):
            for c in range(w):
                rows.append((f"f{f}", "s", r + 1, c + 1, grid[r][c]))
        for c, lab in enumerate(_header_model(grid)):
            expect[(f"f{f}", c + 1)] = lab
    df = spark.createDataFrame(rows, "path string, sheet string, r int, c int, value string")
    got = {(r.path, r.c): r.label for r in C.flatten_header(df, 4).collect()}
    assert got == expect


def test_match_sample_against_brute_force(spark):
    from quarry.operators import samples as S
    rng = random.Random(13)
    words = ["ab", "cd", "efg", "h", "ij", "k l", "mn"]

    def text(n):
        return rng.choice(["", " ", "\t"]) + " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", " "])
    tasks = [text(rng.randint(0, 6)) for _ in range(25)]
    queries = [text(rng.randint(0, 12)) for _ in range(60)]
    queries += [t[1:] for t in tasks[:5]] + [t + " zz" for t in tasks[5:10]]
    samples = spark.createDataFrame([(i, t, "a", None) for i, t in enumerate(tasks)],
                                    "ord long, task string, answer string, design struct<checkout_list:array<int>>")
    traces = spark.createDataFrame(list(enumerate(queries)), "trace_id long, query string")
    got = {r.trace_id: r.ord for r in S.match_sample(traces, samples).collect()}
    expect = {}
    for t, q in enumerate(queries):
        nq = q.strip()
        for o, task in enumerate(tasks):
            ct = task.strip()
            if ct == nq or (nq and nq in ct) or (ct and ct in nq):
                expect[t] = o
                break
    assert got == expect


def _snapshots_model(snaps):
    """Snapshot merging as recorded: first-match merge point, new segment on
    a changed system prompt, first message object shared between segments."""
    trace = []
    for msgs in snaps:
        msgs = [{"content": c} for c in msgs]
        if not trace:
            trace.append(msgs)
            continue
        last = trace[-1]
        idx = next((i for i, m in enumerate(msgs) if m["content"] == last[-1]["content"]), -1)
        if last[0]["content"] == msgs[0]["content"]:
            last.extend(msgs[idx + 1:])
        else:
            old = last[:]
            old[0]["content"] = msgs[0]["content"]
            trace.append(old + msgs[idx + 1:])
    return [[m["content"] for m in seg] for seg in trace]


def test_consolidate_snapshots_against_model(spark):
    from quarry.operators.messages import consolidate_snapshots
    rng = random.Random(17)
    rows, expect = [], {}
    for t in range(25):
        convo = [rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randint(1, 12))]
        snaps = []
        for turn in range(len(convo)):
            lo = max(0, turn - rng.randint(0, 4))
            snaps.append([f"sys{turn // rng.choice([2, 3, 50])}"] + convo[lo:turn + 1])
        for turn, sn in enumerate(snaps):
            for pos, c in enumerate(sn):
                rows.append((t, turn, pos, c))
        expect[t] = _snapshots_model(snaps)
    df = spark.createDataFrame(rows, "trace_id long, turn long, pos long, content string")
    got = {}
    for r in sorted(consolidate_snapshots(df).collect(), key=lambda r: (r.trace_id, r.segment, r.position)):
        segs = got.setdefault(r.trace_id, [])
        if len(segs) < r.segment:
            segs.append([])
        segs[r.segment - 1].append(r.content)
    assert got == expect


def test_openai_format_parsing(spark):
    """Structured tool calls + tool messages: tool actions in call order, the
    answer cascade on plain assistant text, '[ERROR]' user echoes skipped."""
    call_t = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    rows = [
        (1, 0, "system", "sys", None),
        (1, 1, "user", "how many rows?", None),
        (1, 2, "assistant", "", [("c1", "function", ("grep", '{"p": "x"}')), ("c2", "function", ("head", "bad json"))]),
        (1, 3, "tool", "3 hits", None),
        (1, 4, "user", "[ERROR] tool failed", None),
        (1, 5, "assistant", 'sure ```json\n{"answer": " 42 ", "data_source": ["d/t.csv"]}\n```', None),
    ]
    m = spark.createDataFrame(rows, f"trace_id long, seq long, role string, content string, tool_calls {call_t}") \
        .withColumn("tool_call_id", F.lit(None).cast("string"))
    acts = T.parse_actions(m).orderBy("seq", "sub").collect()
    assert [(a.seq, a.type) for a in acts] == [(1, "query"), (2, "tool"), (2, "tool"), (3, "result"), (5, "answer")]
    assert acts[1].content == '{"tool":"grep","params":{"p":"x"}}'
    assert acts[4].content == "42" and acts[4].data_source == ["d/t.csv"]
    pairs = T.qa_pairs(T.turn_number(T.parse_actions(m))).collect()
    assert [(p.query, p.answer, p.n_tools) for p in pairs] == [("how many rows?", "42", 2)]


def test_fill_merged_cells_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_PIECE_ROWS", 7)  # force ranges to span several pieces
    cells = [("f", "s", r, c, f"{r}:{c}" if (r, c) in {(1, 1), (3, 2), (20, 1)} else None)
             for r in range(1, 41) for c in range(1, 4)]
    merged = [("f", "s", 0, 1, 30, 1, 1), ("f", "s", 1, 3, 25, 2, 3), ("f", "s", 2, 20, 22, 1, 1)]
    cdf = spark.createDataFrame(cells, "path string, sheet string, r int, c int, value string")
    mdf = spark.createDataFrame(merged, "path string, sheet string, range_no long, r0 int, r1 int, c0 int, c1 int")
    got = {(x.r, x.c): x.value for x in C.fill_merged_cells(cdf, mdf).collect()}
    expect = {}
    for r in range(1, 41):
        for c in range(1, 4):
            v = f"{r}:{c}" if (r, c) in {(1, 1), (3, 2), (20, 1)} else None
            for _, _, _, r0, r1, c0, c1 in merged:  # later ranges overwrite earlier ones
                if r0 <= r <= r1 and c0 <= c <= c1:
                    v = f"{r0}:{c0}" if (r0, c0) in {(1, 1), (3, 2), (20, 1)} else None
            expect[(r, c)] = v
    assert got == expect


def test_match_by_call_id(spark):
    calls = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0)], "trace_id long, call_id string, seq long")
    res = spark.createDataFrame([(1, "b", "ok"), (1, "zz", "lost"), (2, "a", "fine")],
                                "trace_id long, tool_call_id string, content string")
    got = sorted((r.trace_id, r.call_id, r.result_content) for r in T.match_by_call_id(calls, res).collect())
    assert got == [(1, "a", None), (1, "b", "ok"), (2, "a", "fine")]
