"""Approximate search recall against the exact top-k; chunking invariants."""

from pyspark.sql import functions as F

from quarry.operators import search as R
from quarry.sources.tables import read_table
from tests.conftest import SF_ORACLE


def _sets(df, key="qid", item="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[item])
    return out


def test_ivf_and_lsh_recall(spark):
    e = read_table(spark, SF_ORACLE, "embeddings", ["vec_id", "embedding"])
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = _sets(R.dense_topk(corpus, q, 10))
    ivf = _sets(R.ivf_search(corpus, q, 10))
    ivf_all = _sets(R.ivf_search(corpus, q, 10, nprobe=50))  # every list probed = exhaustive
    lsh = _sets(R.lsh_search(corpus, q, 10))

    def recall(got):
        return sum(len(exact[k] & got.get(k, set())) for k in exact) / sum(len(v) for v in exact.values())
    assert recall(ivf_all) == 1.0
    assert recall(ivf) >= 0.9
    assert recall(lsh) >= 0.9


def _share(members, probes, n):
    """Share of all pairs that meet in some list or bucket."""
    m, p = _sets(members, "id", "key"), _sets(probes, "qid", "key")
    return sum(not m[i].isdisjoint(p[q]) for i in m for q in p) / (n * n)


def test_share_of_pairs_compared(spark):
    e = read_table(spark, SF_ORACLE, "embeddings", ["vec_id", "embedding"])
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    n = e.count()
    assert _share(*R.lsh_buckets(corpus, q), n) < 0.55
    assert _share(*R.ivf_lists(corpus, q), n) < 0.75


def test_full_lists_are_cut_into_blocks(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(R, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(R, "ROWS_PER_BLOCK", 7)
    rng = np.random.default_rng(5)
    cv, qv = rng.normal(size=(50, 6)), rng.normal(size=(8, 6))
    members = spark.createDataFrame([(i % 4 // 3, i, v.tolist()) for i, v in enumerate(cv)], "key long, id long, vec array<double>")
    probes = spark.createDataFrame([(k, i, v.tolist()) for i, v in enumerate(qv) for k in (0, 1, 9)],
                                   "key long, qid long, qvec array<double>")
    got = {(r.qid, r.rank): r.id for r in R._ranked(R._listed_topk(members, probes, 4), 4).collect()}
    s = qv @ cv.T
    assert got == {(q, r): int(i) for q in range(8) for r, i in enumerate(np.argsort(-s[q])[:4], start=1)}


def test_vectors_with_clusters_need_few_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    v = [(i, (centres[i % 40] + 0.05 * rng.normal(size=32)).tolist()) for i in range(400)]
    corpus, q = spark.createDataFrame(v, "id long, vec array<double>"), spark.createDataFrame(v, "qid long, qvec array<double>")
    hits = R.lsh_search(corpus, q, 10, bits=12, tables=6, probes=4)
    assert {(r.qid, r.id) for r in hits.collect()} == {(a, b) for a in range(400) for b in range(a % 40, 400, 40)}
    assert _share(*R.lsh_buckets(corpus, q, 12, 6, 4), 400) < 0.1


def test_rerank_orders_candidates_exactly(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    dv, qv = rng.normal(size=(120, 8)), rng.normal(size=(9, 8))
    docs = spark.createDataFrame([(i // 4, i, v.tolist()) for i, v in enumerate(dv)], "doc_id long, tok long, vec array<double>")
    qs = spark.createDataFrame([(i // 3, i, v.tolist()) for i, v in enumerate(qv)], "qid long, qtok long, qvec array<double>")
    got = {(r.qid, r.rank): r.doc_id for r in R.maxsim_rerank(docs, qs, 12, 3, near=30).collect()}
    s = qv @ dv.T
    for q in range(3):
        first, exact = {}, {}
        for d in range(30):
            exact[d] = sum(s[t, 4 * d:4 * d + 4].max() for t in range(3 * q, 3 * q + 3))
        for t in range(3 * q, 3 * q + 3):
            found = {}
            for i in np.argsort(-s[t])[:30]:
                found[i // 4] = max(found.get(i // 4, -9), s[t, i])
            for d, x in found.items():
                first[d] = first.get(d, 0) + x
        cand = sorted(first, key=lambda d: -first[d])[:12]
        assert [got[(q, r)] for r in (1, 2, 3)] == sorted(cand, key=lambda d: -exact[d])[:3]


def test_rerank_recall(spark):
    e = read_table(spark, SF_ORACLE, "embeddings", ["vec_id", "embedding"])
    docs = e.select(F.floor(F.col("vec_id") / 8).alias("doc_id"), F.col("vec_id").alias("tok"),
                    F.col("embedding").cast("array<double>").alias("vec"))
    qs = docs.select(F.col("doc_id").alias("qid"), F.col("tok").alias("qtok"), F.col("vec").alias("qvec"))
    exact = _sets(R.maxsim(docs.select("doc_id", "vec"), qs, 3), item="doc_id")
    got = _sets(R.maxsim_rerank(docs, qs, 20, 3, near=40), item="doc_id")
    assert sum(len(exact[q] & got[q]) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def _count(x):
    import re
    return len(re.findall(r"\w+|[^\w\s]", x))


def _blocks_model(lines, max_tokens=512, count=_count):
    header = "Header data:\n" + "\n".join(lines[:2]) + "\n-------\nSpecific table data:\n"
    ht = count(header)
    out, block, now = [], [], ht
    for i, line in enumerate(lines):
        if i < 2:
            continue
        lt = count(line)
        if now + lt > max_tokens and block:
            out.append((i - len(block) + 1, header + "\n".join(block)))
            block = [block[-1]]
            now = ht + count(block[0])
        block.append(line)
        now += lt
    if block:
        out.append((len(lines) - len(block) + 1, header + "\n".join(block)))
    return out


def test_chunk_blocks_against_model(spark):
    import random
    rng = random.Random(2)
    files = []
    for f in range(20):
        files.append((f"f{f}", [" ".join(rng.choice(["a", "b,", "c."]) for _ in range(rng.randint(0, 300)))
                                for _ in range(rng.randint(0, 40))]))
    df = spark.createDataFrame(files, "path string, lines array<string>")
    got = {}
    for r in R.chunk_blocks(df, max_tokens=512).collect():
        got.setdefault(r.path, []).append((r.block_no, r.start_line, r.text))
    for path, lines in files:
        exp = _blocks_model(lines)
        mine = [(s, t) for _, s, t in sorted(got.get(path, []))]
        assert mine == exp, path


def test_dense_topk_with_query_blocks(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(R, "QUERIES_PER_BLOCK", 3)  # force several blocks of both sides
    monkeypatch.setattr(R, "ROWS_PER_BLOCK", 12)
    rng = np.random.default_rng(1)
    cv, qv = rng.normal(size=(60, 8)), rng.normal(size=(10, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cv)], "id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "qid long, qvec array<double>")
    got = {(r.qid, r.rank): r.id for r in R.dense_topk(corpus, queries, 4).collect()}
    s = qv @ cv.T
    for q in range(10):
        for rank, i in enumerate(np.argsort(-s[q])[:4], start=1):
            assert got[(q, rank)] == i


def test_running_topk_is_bounded_and_breaks_ties_by_id():
    import numpy as np
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 5, (3, 400)).astype(float), rng.permutation(400)
    best = R.RunningTopK(np.array([7, 8, 9]), 6)
    for i in range(0, 400, 37):
        best.add(ids[i:i + 37], scores[:, i:i + 37])
        assert all(len(x) <= 6 for x in best.ids)  # whatever has passed
    for q in range(3):
        assert best.ids[q].tolist() == ids[np.lexsort((ids, -scores[q]))[:6]].tolist()


def test_maxsim_equals_brute_force(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(R, "ROWS_PER_BLOCK", 30)
    monkeypatch.setattr(R, "STEP", 7)
    rng = np.random.default_rng(3)
    dv, qv = rng.normal(size=(90, 6)), rng.normal(size=(8, 6))
    docs = spark.createDataFrame([(i // 4, v.tolist()) for i, v in enumerate(dv)], "doc_id long, vec array<double>")
    qs = spark.createDataFrame([(i // 3, i, v.tolist()) for i, v in enumerate(qv)], "qid long, qtok long, qvec array<double>")
    got = {(r.qid, r.rank): r.doc_id for r in R.maxsim(docs, qs, 3).collect()}
    s = qv @ dv.T
    for q in range(3):
        per = [sum(s[t, 4 * d:4 * d + 4].max() for t in range(8) if t // 3 == q) for d in range(23)]
        for rank, d in enumerate(np.argsort(per)[::-1][:3], start=1):
            assert got[(q, rank)] == d


def test_vectors_are_sent_once_a_block(spark):
    import numpy as np
    assert R._sides(600_000, 600_000) == (30, 30)  # not once for every thousand queries
    rng = np.random.default_rng(8)
    v = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(300)]
    corpus, q = spark.createDataFrame(v, "id long, vec array<float>"), spark.createDataFrame(v, "qid long, qvec array<float>")
    ivf, queries, centres, nl = R._ivf(corpus, q, 42, 10)
    asked, = R._probes(queries, centres, 3, nl)
    for members, asked in ((ivf, asked), R._lsh(corpus, q, 8, 44, 4, 42)):
        assert members.count() == asked.count() == 300  # however many lists hold or are probed
    lists, probes = R.ivf_lists(corpus, q, 3, 42, 10)
    own, probed = _sets(lists, "id", "key"), _sets(probes, "qid", "key")
    assert all(len(x) == 3 for x in probed.values())
    x = np.array([y for _, y in v], np.float64)
    s = x @ x.T
    got = {(r.qid, r.rank): r.id for r in R.ivf_search(corpus, q, 2, 3, 42, 10).collect()}
    for i in range(300):
        best = sorted((j for j in range(300) if not own[j].isdisjoint(probed[i])), key=lambda j: -s[i, j])
        assert [got.get((i, n)) for n in range(1, 1 + min(2, len(best)))] == best[:2]


def test_a_pair_met_again_counts_once():
    import numpy as np
    best = R.RunningTopK(np.array([4, 5]), 3)
    ids, scores = np.arange(5), np.array([[5.0, 4, 3, 2, 1], [1, 2, 3, 4, 5]])
    for rows in ([0, 1], [1], [0]):
        best.add(ids, scores[rows], np.array(rows), distinct=True)
    assert [x.tolist() for x in best.ids] == [[0, 1, 2], [4, 3, 2]]


def test_queries_of_one_id_and_rows_without_id(spark):
    import numpy as np
    v = [(i, [float(i == j) for j in range(4)]) for i in range(4)]
    corpus = spark.createDataFrame(v, "id long, vec array<double>")
    q = spark.createDataFrame([*v, v[2]], "qid long, qvec array<double>")
    hits = R.ivf_search(corpus, q, 4, nprobe=2, nlist=2).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r["rank"]) if r.qid == 2] == [2, 2, 2, 2]  # both rows, both their lists
    assert [r.id for r in sorted(hits, key=lambda r: r["rank"]) if r.qid == 1] == [1, 0, 2, 3]
    best = R.RunningTopK(np.array([1]), 2)
    best.add(np.array([np.nan, 7.0, 8.0]), np.array([[3.0, 2.0, 1.0]]))
    assert best.frame()["id"].isna().tolist() == [True, False]
