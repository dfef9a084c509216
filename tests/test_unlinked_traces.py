"""Traces without a sample stay in the judged steps and in the report."""

import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.tables import TABLES
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def steps():
    """(trace_id, step_index, true_answer) of all aligned steps, by the twin of align_steps."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con.execute(f"SELECT trace_id, step_index, true_answer FROM ({E.oracle_sql()['align_steps']})").fetchall()


@pytest.mark.parametrize("name", ["judge_hook", "score_point_coverage"])
def test_every_aligned_step_is_judged(spark, steps, name):
    raw = {(t, i) for t, i, answer in steps if answer is None}
    assert raw
    rows = E.queries()[name](spark, SF_ORACLE).collect()
    assert sorted((r.trace_id, r.step_index) for r in rows) == sorted((t, i) for t, i, _ in steps)
    unlinked = [r for r in rows if (r.trace_id, r.step_index) in raw]
    assert all((r.total_metrics, r.covered_metrics, r.coverage_ratio) == (0, 0, 0) for r in unlinked)
    if name == "judge_hook":
        assert all(r.is_missing and r.reasoning is None for r in unlinked)


def test_report_counts_every_trace(spark, steps):
    got = {(r.section, r.metric): r.value for r in E.queries()["evaluate_traces"](spark, SF_ORACLE).collect()}
    assert got["micro", "n_strict"] == len(steps)
    assert got["pass_at_1", "total_valid_tasks"] == len({t for t, _, _ in steps})
