"""Step metrics and the evaluation report.

Steps are long tables keyed by ``(trace_id, step_index)``:

* accuracy  ``(…, query, is_missing, coverage_ratio, reasoning)``
* quality   ``(…, query, is_missing, richness_score, redundancy_score, contradiction_score)``
* table_depend ``(…, query, true_tables ARRAY, model_tables ARRAY)``

Judge scores may arrive as strings; every number goes through
``safe_float`` (bad → 0.0).  All rates use ``try_divide`` + ``coalesce``
(ANSI mode raises on 1/0).  Every aggregate here is a global or per-trace
``agg`` with partial aggregation, so no step list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename, safe_float, stem
from quarry.registry import register_metric

KEY = ["trace_id", "step_index"]
QUALITY_SCORES = ["richness_score", "redundancy_score", "contradiction_score"]
# fixed values: name suffixes that mark a derived table variant
VARIANT_SUFFIX = r"(_split|_merged|_flattened|_part\d+)$"


def merge_steps(acc: DataFrame, qual: DataFrame, dep: DataFrame) -> DataFrame:
    """Full outer merge on (trace, step); query from the first present.

    Each metric becomes a nullable struct column (absent = NULL).
    """
    a = acc.select(*KEY, F.col("query").alias("_qa"),
                   F.struct(*[c for c in acc.columns if c not in KEY + ["query"]]).alias("accuracy"))
    q = qual.select(*KEY, F.col("query").alias("_qq"),
                    F.struct(*[c for c in qual.columns if c not in KEY + ["query"]]).alias("quality"))
    d = dep.select(*KEY, F.col("query").alias("_qd"),
                   F.struct(*[c for c in dep.columns if c not in KEY + ["query"]]).alias("table_depend"))
    m = a.join(q, KEY, "full_outer").join(d, KEY, "full_outer")
    return m.select(*KEY, F.coalesce("_qa", "_qq", "_qd").alias("query"), "accuracy", "quality", "table_depend")


def _table_match(t: Column, p: Column) -> Column:
    """J6 rules on basenames: same stem, variant suffix, file_sheet, containment."""
    ts, ps = stem(t), stem(p)
    ps_base = F.regexp_replace(ps, VARIANT_SUFFIX, "")
    ts_base = F.regexp_replace(ts, VARIANT_SUFFIX, "")
    return ((ts == ps) | (ps_base == ts) | (ps_base == ts_base)
            | F.startswith(ps, F.concat(ts, F.lit("_")))
            | F.contains(ts, ps) | F.contains(ps, ts))


def table_coverage(dep: DataFrame) -> DataFrame:
    """covered_true_count / correct_pred_count per step.

    Both lists are exploded with positions and joined on the step key with
    the match rule as a residual predicate — the theta join is confined to
    one step's (small) lists, never across steps.
    """
    t = dep.select(*KEY, F.posexplode_outer("true_tables").alias("tpos", "t"))
    p = dep.select(*KEY, F.posexplode_outer("model_tables").alias("ppos", "p"))
    t = t.where(F.col("t").isNotNull()).withColumn("tb", basename("t"))
    p = p.where(F.col("p").isNotNull()).withColumn("pb", basename("p"))
    j = t.join(p, KEY).where(_table_match(F.col("tb"), F.col("pb")))
    cnt = j.groupBy(*KEY).agg(F.count_distinct("tpos").alias("covered_true_count"),
                              F.count_distinct("ppos").alias("correct_pred_count"))
    return dep.join(cnt, KEY, "left").select(
        *dep.columns, F.coalesce("covered_true_count", F.lit(0)).alias("covered_true_count"),
        F.coalesce("correct_pred_count", F.lit(0)).alias("correct_pred_count"))


def table_prf(cov: DataFrame) -> DataFrame:
    """A5: recall, precision, F1 (0 when undefined).  A missing
    ``correct_pred_count`` falls back to the covered count."""
    nt = F.size(F.coalesce("true_tables", F.array()))
    npd = F.size(F.coalesce("model_tables", F.array()))
    correct = F.coalesce(F.col("correct_pred_count"), F.col("covered_true_count"))
    recall = F.coalesce(F.try_divide(F.col("covered_true_count").cast("double"), nt), F.lit(0.0))
    precision = F.coalesce(F.try_divide(correct.cast("double"), npd), F.lit(0.0))
    out = cov.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when(F.col("recall") + F.col("precision") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1).withColumn("total_true", nt)


def table_overlap(dep: DataFrame) -> DataFrame:
    """Stems present in both lists (exact-match rule only)."""
    ts = F.transform(F.coalesce("true_tables", F.array()), lambda x: stem(basename(x)))
    ps = F.transform(F.coalesce("model_tables", F.array()), lambda x: stem(basename(x)))
    ov = F.array_sort(F.array_intersect(ts, ps))
    return dep.select(*KEY, ov.alias("overlap"), F.size(ov).alias("n_overlap"))


# ------------------------------------------------------------ aggregates
def _avg0(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def micro_quality(acc: DataFrame, qual: DataFrame) -> DataFrame:
    """A3: strict (all steps) and non-strict (not missing) means; empty → 0.

    Returned long: ``(section, metric, value)``."""
    cov = safe_float(F.col("coverage_ratio"))
    ok = ~F.coalesce(F.col("is_missing"), F.lit(False))
    a = acc.agg(_avg0(cov).alias("strict_coverage"), _avg0(F.when(ok, cov)).alias("coverage"),
                F.count("*").alias("n_strict"), F.count_if(ok).alias("n_non_strict"))
    qcols = []
    for s in QUALITY_SCORES:
        n = s.replace("_score", "")
        qcols += [_avg0(safe_float(F.col(s))).alias(f"strict_{n}"), _avg0(F.when(ok, safe_float(F.col(s)))).alias(n)]
    return stack_metrics({"micro": a, "micro_quality": qual.agg(*qcols)})


def macro_quality(acc: DataFrame, qual: DataFrame) -> DataFrame:
    """A4: mean of per-trace means; a trace counts for non-strict only if it
    has a non-missing step (AVG skips the NULL it gets otherwise)."""
    ok = ~F.coalesce(F.col("is_missing"), F.lit(False))
    pa = acc.groupBy("trace_id").agg(F.avg(safe_float(F.col("coverage_ratio"))).alias("s_cov"),
                                     F.avg(F.when(ok, safe_float(F.col("coverage_ratio")))).alias("cov"))
    qa = []
    for s in QUALITY_SCORES:
        n = s.replace("_score", "")
        qa += [F.avg(safe_float(F.col(s))).alias(f"s_{n}"), F.avg(F.when(ok, safe_float(F.col(s)))).alias(n)]
    pq = qual.groupBy("trace_id").agg(*qa)
    a = pa.agg(_avg0("cov").alias("macro_coverage"), _avg0("s_cov").alias("macro_strict_coverage"))
    q = pq.agg(*[_avg0(n).alias(f"macro_{n}") for n in ("richness", "redundancy", "contradiction")],
               *[_avg0(f"s_{n}").alias(f"macro_strict_{n}") for n in ("richness", "redundancy", "contradiction")])
    return stack_metrics({"macro": a, "macro_quality": q})


def table_prf_avg(prf: DataFrame, acc: DataFrame) -> DataFrame:
    """Strict and non-strict means of recall/precision/F1; non-strict
    uses the accuracy missing flag of the same step (absent ⇒ not missing)."""
    flag = acc.select(*KEY, F.col("is_missing").alias("_acc_missing"))
    j = prf.join(flag, KEY, "left")
    ok = ~F.coalesce(F.col("_acc_missing"), F.lit(False))
    cols = []
    for m in ("recall", "precision", "f1"):
        cols += [_avg0(safe_float(F.col(m))).alias(f"strict_table_{m}"),
                 _avg0(F.when(ok, safe_float(F.col(m)))).alias(f"table_{m}")]
    return j.agg(*cols)


def pass_at_1(merged: DataFrame) -> DataFrame:
    """A task passes iff every step has accuracy with coverage ≥ 1;
    turn coverage@1 = share of accuracy steps with coverage ≥ 1."""
    cov = safe_float(F.col("accuracy.coverage_ratio"))
    step_ok = F.col("accuracy").isNotNull() & (cov >= 1.0)
    per = merged.groupBy("trace_id").agg(F.bool_and(step_ok).alias("passed"),
                                         F.count_if(F.col("accuracy").isNotNull() & (cov >= 1.0)).alias("n_cov1"),
                                         F.count_if(F.col("accuracy").isNotNull()).alias("n_acc"))
    return per.agg(F.count("*").alias("total_valid_tasks"), F.count_if("passed").alias("task_pass_count"),
                   F.coalesce(F.try_divide(F.count_if("passed").cast("double"), F.count("*")), F.lit(0.0))
                   .alias("task_pass_at_1"),
                   F.coalesce(F.try_divide(F.sum("n_cov1").cast("double"), F.sum("n_acc")), F.lit(0.0))
                   .alias("turn_coverage_at_1"))


def case_details(acc: DataFrame, qual: DataFrame) -> DataFrame:
    """Per trace steps, missing steps, mean coverage, whether every step is
    covered, and mean richness (NULL without quality steps)."""
    a = acc.groupBy("trace_id").agg(
        F.count("*").alias("n_steps"), F.count_if("is_missing").alias("n_missing"),
        F.round(F.avg(safe_float(F.col("coverage_ratio"))), 6).alias("coverage"),
        F.bool_and(safe_float(F.col("coverage_ratio")) >= 1.0).alias("passed"))
    q = qual.groupBy("trace_id").agg(F.round(F.avg(safe_float(F.col("richness_score"))), 6).alias("richness"))
    return a.join(q, "trace_id", "left")


def overview(traces: DataFrame) -> DataFrame:
    """Count, success rate, mean turns (NULL → 0), mean tool metrics."""
    return traces.agg(
        F.count("*").alias("total_traces"),
        F.coalesce(F.try_divide(F.count_if(F.coalesce("success", F.lit(False))).cast("double"), F.count("*")),
                   F.lit(0.0)).alias("success_rate"),
        _avg0(F.coalesce(F.col("total_turns"), F.lit(0))).alias("avg_turns"),
        _avg0(F.coalesce(F.col("tool_success_rate"), F.lit(0.0))).alias("avg_tool_success"),
        _avg0(F.coalesce(F.col("tool_parallelism"), F.lit(0.0))).alias("avg_tool_parallelism"))


def token_usage(per_trace: DataFrame, tokens: str = "total_tokens") -> DataFrame:
    """A2: avg/max/min tokens over traces."""
    t = F.coalesce(F.col(tokens), F.lit(0))
    return per_trace.agg(_avg0(t).alias("avg_tokens"), F.coalesce(F.max(t), F.lit(0)).alias("max_tokens"),
                         F.coalesce(F.min(t), F.lit(0)).alias("min_tokens"),
                         F.coalesce(F.sum(t), F.lit(0)).alias("sum_tokens"))


def high_acc_low_recall(merged: DataFrame, prf: DataFrame, reason_chars: int = 200) -> DataFrame:
    """Steps with coverage ≥ 1 and recall < 1, both metrics present."""
    r = prf.select(*KEY, "recall", "true_tables", "model_tables")
    j = merged.where(F.col("accuracy").isNotNull() & F.col("table_depend").isNotNull()).join(r, KEY)
    cov = safe_float(F.col("accuracy.coverage_ratio"))
    return j.where((cov >= 1.0) & (safe_float(F.col("recall")) < 1.0)).select(
        *KEY, "query", cov.alias("coverage"), F.col("recall"),
        F.left(F.coalesce(F.col("accuracy.reasoning"), F.lit("")), F.lit(reason_chars)).alias("reasoning"),
        F.transform("true_tables", basename).alias("true_tables"),
        F.transform("model_tables", basename).alias("model_tables"))


def fail_template(expected: DataFrame, judged: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """A10: steps without a judgement get numbers → 0, other fields → NULL,
    ``is_missing = true``."""
    j = expected.join(judged.withColumn("_judged", F.lit(True)), KEY, "left")
    missing = F.col("_judged").isNull()
    return j.select(*expected.columns, missing.alias("is_missing"),
                    *[F.when(missing, F.lit(0.0)).otherwise(safe_float(F.col(c))).alias(c) for c in numeric],
                    *[F.when(missing, F.lit(None)).otherwise(F.col(c)).alias(c) for c in other])


def stack_metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """One-row metric frames → long ``(section, metric, value)``.

    Each input has one row; ``stack`` unpivots it without a shuffle and
    the union is of constant size — the report never touches step rows.
    """
    out = None
    for section, df in frames.items():
        cols = df.columns
        expr = "stack({n}, {pairs}) AS (metric, value)".format(
            n=len(cols), pairs=", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))
        part = df.selectExpr(expr).select(F.lit(section).alias("section"), "metric",
                                          F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ X2 metrics
@register_metric("accuracy")
def _m_accuracy():
    cov = safe_float(F.col("coverage_ratio"))
    ok = ~F.coalesce(F.col("is_missing"), F.lit(False))
    return [_avg0(cov).alias("strict_coverage"), _avg0(F.when(ok, cov)).alias("coverage")]


@register_metric("quality")
def _m_quality():
    ok = ~F.coalesce(F.col("is_missing"), F.lit(False))
    out = []
    for s in QUALITY_SCORES:
        n = s.replace("_score", "")
        out += [_avg0(safe_float(F.col(s))).alias(f"strict_{n}"), _avg0(F.when(ok, safe_float(F.col(s)))).alias(n)]
    return out


# ------------------------------------------------------------ F19 / X3
NUM_TOKEN = r"-?\d+(?:\.\d+)?"


def score_point_coverage(answer, points, tol: float = 0.1) -> Column:
    """F19 (deterministic judge): STRUCT<total_metrics, covered_metrics,
    coverage_ratio>.  A point with numbers is covered when every number of
    it appears in the answer within ``tol``; a point without numbers when
    all of its words occur in the answer (case-insensitive)."""
    a = F.coalesce(answer if not isinstance(answer, str) else F.col(answer), F.lit(""))
    pts = F.coalesce(points if not isinstance(points, str) else F.col(points), F.array().cast("array<string>"))
    ans_nums = F.transform(F.regexp_extract_all(a, F.lit(NUM_TOKEN), 0), lambda x: x.cast("double"))
    ans_words = F.regexp_extract_all(F.lower(a), F.lit(r"\w+"), 0)

    def covered(p):
        nums = F.transform(F.regexp_extract_all(p, F.lit(NUM_TOKEN), 0), lambda x: x.cast("double"))
        words = F.regexp_extract_all(F.lower(p), F.lit(r"\w+"), 0)
        num_ok = F.forall(nums, lambda n: F.exists(ans_nums, lambda v: F.abs(v - n) <= tol))
        word_ok = F.forall(words, lambda w: F.array_contains(ans_words, w))
        return F.when(F.size(nums) > 0, num_ok).otherwise(word_ok)

    total = F.size(pts)
    cov = F.size(F.filter(pts, covered))
    ratio = F.when(total > 0, F.round(cov / total, 3)).otherwise(F.lit(0.0))
    return F.struct(total.alias("total_metrics"), cov.alias("covered_metrics"), ratio.alias("coverage_ratio"))


def judge_steps(aligned: DataFrame, judge=None) -> DataFrame:
    """Accuracy judgements for aligned steps.  ``judge`` maps the aligned
    frame to ``(trace_id, step_index, total_metrics, covered_metrics,
    coverage_ratio, reasoning)``; the default is the rule judge F19.  Any
    DataFrame of judgements (e.g. from an Arrow UDF calling a model) fits;
    steps it leaves out get the zeroed template (A10)."""
    if judge is None:
        s = score_point_coverage(F.col("answer"), F.col("score_points"))
        judged = aligned.select(*KEY, s["total_metrics"].alias("total_metrics"),
                                s["covered_metrics"].alias("covered_metrics"),
                                s["coverage_ratio"].alias("coverage_ratio"),
                                F.lit("rule: numbers within 0.1, words present").alias("reasoning"))
    else:
        judged = judge(aligned)
    missing = aligned.where(F.col("is_missing")).select(*KEY)
    judged = judged.join(missing, KEY, "left_anti")
    return fail_template(aligned.select(*KEY, "query"), judged,
                         ["total_metrics", "covered_metrics", "coverage_ratio"], ["reasoning"])
