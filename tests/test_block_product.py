"""Blocks of both sides meet without a row or a vector being sent once a pair of blocks."""

import numpy as np

from quarry.operators import search as R


def test_rows_that_leave_a_search_dont_grow_with_blocks(spark, monkeypatch):
    for name, value in (("ROWS_PER_BLOCK", 10), ("QUERIES_PER_BLOCK", 5), ("LEAST_TASKS", 1)):
        monkeypatch.setattr(R, name, value, raising=False)
    rng, k, ranked, left = np.random.default_rng(3), 3, R._ranked, []
    v = rng.normal(size=(60, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(R, "_ranked", lambda cand, *a, **b: left.append(cand) or ranked(cand, *a, **b))
    hits = R.dense_topk(spark.createDataFrame(rows, "id long, vec array<double>"),
                        spark.createDataFrame(rows, "qid long, qvec array<double>"), k)
    s = v @ v.T
    assert {(r.qid, r.rank): r.id for r in hits.collect()} == {
        (q, n): int(i) for q in range(60) for n, i in enumerate(np.argsort(-s[q])[:k], start=1)}
    assert left[0].count() == 60 * k  # one part of the corpus: six or more blocks, but k rows a query
    assert "CartesianProduct" in left[0]._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_make_smaller_blocks():
    assert R._sides(600_000, 600_000, 64) == (30, 30)
    assert R._sides(600_000, 600_000, 4_000) == (600, 600)
