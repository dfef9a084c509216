"""Metric quirks on tiny inline step tables: zero denominators, string
scores, the correct-count fallback, pass@1 with a step lacking accuracy."""

from pyspark.sql import functions as F

from quarry.operators import metrics as M


def _rows(df):
    return {(r.section, r.metric): r.value for r in df.collect()}


def test_table_prf_zero_denominators_and_fallback(spark):
    dep = spark.createDataFrame(
        [("t", 1, "q", [], ["a.csv"]), ("t", 2, "q", ["a.csv"], []), ("t", 3, "q", ["x/a.xlsx"], ["a_part2.csv", "b.csv"])],
        "trace_id string, step_index int, query string, true_tables array<string>, model_tables array<string>")
    got = {r.step_index: (r.recall, r.precision, r.f1) for r in M.table_prf(M.table_coverage(dep)).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (0.0, 0.0, 0.0)
    assert got[3] == (1.0, 0.5, 2 * 0.5 * 1.0 / 1.5)
    # a judge that reports no correct-prediction count: precision falls back to covered (may exceed 1)
    cov = spark.createDataFrame([("t", 1, ["a"], ["a"], 1, None)],
                                "trace_id string, step_index int, true_tables array<string>, model_tables array<string>, "
                                "covered_true_count int, correct_pred_count int")
    r = M.table_prf(cov).first()
    assert (r.recall, r.precision) == (1.0, 1.0)


def test_string_scores_and_missing_steps(spark):
    acc = spark.createDataFrame([("t", 1, "q", False, "1", ""), ("t", 2, "q", True, "bad", "")],
                                "trace_id string, step_index int, query string, is_missing boolean, coverage_ratio string, reasoning string")
    qual = spark.createDataFrame([("t", 1, "q", False, "4", "x", None)],
                                 "trace_id string, step_index int, query string, is_missing boolean, richness_score string, "
                                 "redundancy_score string, contradiction_score string")
    g = _rows(M.micro_quality(acc, qual))
    assert g[("micro", "strict_coverage")] == 0.5 and g[("micro", "coverage")] == 1.0
    assert g[("micro_quality", "richness")] == 4.0 and g[("micro_quality", "redundancy")] == 0.0


def test_pass_at_1_needs_accuracy_on_every_step(spark):
    acc = spark.createDataFrame([("a", 1, "q", False, "1.0", ""), ("b", 1, "q", False, "1", "")],
                                "trace_id string, step_index int, query string, is_missing boolean, coverage_ratio string, reasoning string")
    qual = spark.createDataFrame([("b", 2, "q", False, "1", "1", "1")],
                                 "trace_id string, step_index int, query string, is_missing boolean, richness_score string, "
                                 "redundancy_score string, contradiction_score string")
    dep = spark.createDataFrame([], "trace_id string, step_index int, query string, true_tables array<string>, "
                                    "model_tables array<string>")
    r = M.pass_at_1(M.merge_steps(acc, qual, dep)).first()
    # trace b has a step with no accuracy result, so only trace a passes
    assert (r.total_valid_tasks, r.task_pass_count, r.task_pass_at_1, r.turn_coverage_at_1) == (2, 1, 0.5, 1.0)


def test_score_point_rule(spark):
    df = spark.createDataFrame([("revenue 12.05 and 7", ["12.0", "7 units", "growth"])], "answer string, pts array<string>")
    r = df.select(M.score_point_coverage(F.col("answer"), F.col("pts")).alias("s")).first().s
    assert (r.total_metrics, r.covered_metrics, r.coverage_ratio) == (3, 2, 0.667)
