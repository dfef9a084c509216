"""Registered evaluation-metric queries over V-steps (documents ⟕ labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import safe_float, token_count
from quarry.operators import metrics as M
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_messages, v_metric_tables
from quarry.plans.q_traces import FIFO, _pairs
from quarry.registry import evaluate_metrics, query

SF = "coalesce(TRY_CAST({} AS DOUBLE), 0.0)"


def sf(x):
    return SF.format(x)


def _long(section: str, select_sql: str) -> str:
    """DuckDB: one-row SELECT → (section, metric, value) rows."""
    return (f"SELECT '{section}' AS section, metric, round(value, 6) AS value FROM "
            f"(UNPIVOT ({select_sql}) ON COLUMNS(*) INTO NAME metric VALUE value)")


def _tables(spark, sf_dir):
    # the step table feeds every metric: materialise it once (reliable
    # checkpoint in the shared folder) instead of re-deriving it per metric
    return v_metric_tables(spark, sf_dir, materialize=True)


@query("merge_steps", sql=f"""
WITH {O.STEPS},
m AS (SELECT coalesce(a.trace_id, q.trace_id) AS trace_id, coalesce(a.step_index, q.step_index) AS step_index,
             coalesce(a.query, q.query) AS query, a.trace_id IS NOT NULL AS has_acc, q.trace_id IS NOT NULL AS has_qual,
             a.coverage_ratio, q.richness_score
      FROM acc a FULL OUTER JOIN qual q USING (trace_id, step_index))
SELECT coalesce(m.trace_id, d.trace_id) AS trace_id, coalesce(m.step_index, d.step_index) AS step_index,
       coalesce(m.query, d.query) AS query, coalesce(m.has_acc, false) AS has_acc, coalesce(m.has_qual, false) AS has_qual,
       d.trace_id IS NOT NULL AS has_dep, m.coverage_ratio, m.richness_score
FROM m FULL OUTER JOIN dep d USING (trace_id, step_index)""", category="metrics")
def q_merge_steps(spark, sf_dir):
    """Full outer merge of the three metric step tables."""
    m = M.merge_steps(*_tables(spark, sf_dir))
    return m.select("trace_id", "step_index", "query", F.col("accuracy").isNotNull().alias("has_acc"),
                    F.col("quality").isNotNull().alias("has_qual"), F.col("table_depend").isNotNull().alias("has_dep"),
                    F.col("accuracy.coverage_ratio").alias("coverage_ratio"),
                    F.col("quality.richness_score").alias("richness_score"))


def _stem_sql(x):
    b = f"regexp_extract({x}, '([^/]*)$', 1)"
    return f"CASE WHEN regexp_matches({b}, '^.+\\.[^.]*$') THEN regexp_extract({b}, '^(.*)\\.[^.]*$', 1) ELSE {b} END"


VS = "'(_split|_merged|_flattened|_part\\d+)$'"
COV = O.STEPS + f""",
t AS (SELECT trace_id, step_index, generate_subscripts(true_tables, 1) AS tpos, unnest(true_tables) AS t FROM dep),
p AS (SELECT trace_id, step_index, generate_subscripts(model_tables, 1) AS ppos, unnest(model_tables) AS p FROM dep),
tp AS (SELECT t.trace_id, t.step_index, tpos, ppos, {_stem_sql('t')} AS ts, {_stem_sql('p')} AS ps
       FROM t JOIN p USING (trace_id, step_index)),
hits AS (SELECT * FROM tp WHERE ts = ps OR regexp_replace(ps, {VS}, '') = ts
           OR regexp_replace(ps, {VS}, '') = regexp_replace(ts, {VS}, '')
           OR starts_with(ps, ts || '_') OR contains(ts, ps) OR contains(ps, ts)),
cnt AS (SELECT trace_id, step_index, COUNT(DISTINCT tpos) AS covered_true_count, COUNT(DISTINCT ppos) AS correct_pred_count
        FROM hits GROUP BY ALL),
cov AS (SELECT d.trace_id, d.step_index, d.true_tables, d.model_tables,
               coalesce(c.covered_true_count, 0) AS covered_true_count, coalesce(c.correct_pred_count, 0) AS correct_pred_count
        FROM dep d LEFT JOIN cnt c USING (trace_id, step_index)),
prf0 AS (SELECT *, coalesce(covered_true_count / nullif(len(true_tables), 0), 0.0) AS recall,
                coalesce(correct_pred_count / nullif(len(model_tables), 0), 0.0) AS precision FROM cov),
prf AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM prf0)"""


def _prf(spark, sf_dir):
    _, _, dep = _tables(spark, sf_dir)
    return M.table_prf(M.table_coverage(dep))


@query("table_coverage", sql=f"""
WITH {COV}
SELECT trace_id, step_index, covered_true_count, correct_pred_count FROM cov""", category="metrics")
def q_table_coverage(spark, sf_dir):
    """Rule-based true × predicted table matching per step."""
    _, _, dep = _tables(spark, sf_dir)
    return M.table_coverage(dep).select("trace_id", "step_index", "covered_true_count", "correct_pred_count")


@query("table_prf", sql=f"""
WITH {COV}
SELECT trace_id, step_index, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM prf""",
       category="metrics")
def q_table_prf(spark, sf_dir):
    """A5: table recall / precision / F1 per step."""
    p = _prf(spark, sf_dir)
    return p.select("trace_id", "step_index", F.round("recall", 6).alias("recall"),
                    F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"))


@query("table_overlap", sql=f"""
WITH {O.STEPS}
SELECT trace_id, step_index,
       list_sort(list_intersect(list_transform(true_tables, lambda x: {_stem_sql('x')}),
                                list_transform(model_tables, lambda x: {_stem_sql('x')}))) AS overlap,
       CAST(len(list_intersect(list_transform(true_tables, lambda x: {_stem_sql('x')}),
                               list_transform(model_tables, lambda x: {_stem_sql('x')}))) AS INTEGER) AS n_overlap
FROM dep""", category="metrics")
def q_table_overlap(spark, sf_dir):
    """Exact-stem intersection of true and predicted tables."""
    _, _, dep = _tables(spark, sf_dir)
    return M.table_overlap(dep)


_NM = "NOT coalesce(is_missing, false)"


def _avgs(cols, tbl, filt=_NM):
    out = []
    for c, n in cols:
        out.append(f"coalesce(avg({sf(c)}), 0.0) AS strict_{n}")
        out.append(f"coalesce(avg({sf(c)}) FILTER (WHERE {filt}), 0.0) AS {n}")
    return f"SELECT {', '.join(out)} FROM {tbl}"


MICRO_SEL = f"""
SELECT * FROM ({_long('micro', f"SELECT coalesce(avg({sf('coverage_ratio')}), 0.0) AS strict_coverage, "
                              f"coalesce(avg({sf('coverage_ratio')}) FILTER (WHERE {_NM}), 0.0) AS coverage, "
                              f"CAST(count(*) AS DOUBLE) AS n_strict, CAST(count_if({_NM}) AS DOUBLE) AS n_non_strict FROM acc")})
UNION ALL
SELECT * FROM ({_long('micro_quality', _avgs([('richness_score', 'richness'), ('redundancy_score', 'redundancy'),
                                             ('contradiction_score', 'contradiction')], 'qual'))})"""

MACRO_CTE = f"""
pa AS (SELECT trace_id, avg({sf('coverage_ratio')}) AS s_cov,
              avg({sf('coverage_ratio')}) FILTER (WHERE {_NM}) AS cov FROM acc GROUP BY trace_id),
pq AS (SELECT trace_id,
         avg({sf('richness_score')}) AS s_richness, avg({sf('richness_score')}) FILTER (WHERE {_NM}) AS richness,
         avg({sf('redundancy_score')}) AS s_redundancy, avg({sf('redundancy_score')}) FILTER (WHERE {_NM}) AS redundancy,
         avg({sf('contradiction_score')}) AS s_contradiction,
         avg({sf('contradiction_score')}) FILTER (WHERE {_NM}) AS contradiction
       FROM qual GROUP BY trace_id)"""
MACRO_SEL = f"""
SELECT * FROM ({_long('macro', 'SELECT coalesce(avg(cov), 0.0) AS macro_coverage, coalesce(avg(s_cov), 0.0) AS macro_strict_coverage FROM pa')})
UNION ALL
SELECT * FROM ({_long('macro_quality', '''SELECT coalesce(avg(richness), 0.0) AS macro_richness,
   coalesce(avg(redundancy), 0.0) AS macro_redundancy, coalesce(avg(contradiction), 0.0) AS macro_contradiction,
   coalesce(avg(s_richness), 0.0) AS macro_strict_richness, coalesce(avg(s_redundancy), 0.0) AS macro_strict_redundancy,
   coalesce(avg(s_contradiction), 0.0) AS macro_strict_contradiction FROM pq''')})"""

PRF_CTE = "jp AS (SELECT p.*, a.is_missing AS am FROM prf p LEFT JOIN acc a USING (trace_id, step_index))"
PRF_SEL = f"""
SELECT * FROM ({_long('table_prf', _avgs([('recall', 'table_recall'), ('precision', 'table_precision'), ('f1', 'table_f1')],
                                         'jp', 'NOT coalesce(am, false)'))})"""

PASS_CTE = f"""
mp AS (SELECT coalesce(a.trace_id, q.trace_id, d.trace_id) AS trace_id, a.coverage_ratio, a.trace_id IS NOT NULL AS has_acc
       FROM acc a FULL OUTER JOIN qual q USING (trace_id, step_index) FULL OUTER JOIN dep d USING (trace_id, step_index)),
perp AS (SELECT trace_id, bool_and(has_acc AND {sf('coverage_ratio')} >= 1.0) AS passed,
                count_if(has_acc AND {sf('coverage_ratio')} >= 1.0) AS n_cov1, count_if(has_acc) AS n_acc
         FROM mp GROUP BY trace_id)"""
PASS_SEL = f"""
SELECT * FROM ({_long('pass_at_1', '''SELECT CAST(count(*) AS DOUBLE) AS total_valid_tasks,
   CAST(count_if(passed) AS DOUBLE) AS task_pass_count,
   coalesce(count_if(passed) / nullif(count(*), 0), 0.0) AS task_pass_at_1,
   coalesce(sum(n_cov1) / nullif(sum(n_acc), 0), 0.0) AS turn_coverage_at_1 FROM perp''')})"""


@query("micro_quality", sql=f"WITH {O.STEPS} {MICRO_SEL}", category="metrics")
def q_micro_quality(spark, sf_dir):
    """A3: micro strict / non-strict means of coverage and quality scores."""
    acc, qual, _ = _tables(spark, sf_dir)
    return M.micro_quality(acc, qual)


@query("macro_quality", sql=f"WITH {O.STEPS}, {MACRO_CTE} {MACRO_SEL}", category="metrics")
def q_macro_quality(spark, sf_dir):
    """A4: macro (per-trace then overall) means."""
    acc, qual, _ = _tables(spark, sf_dir)
    return M.macro_quality(acc, qual)


@query("table_prf_avg", sql=f"WITH {COV}, {PRF_CTE} {PRF_SEL}", category="metrics")
def q_table_prf_avg(spark, sf_dir):
    """Strict / non-strict table recall, precision, F1."""
    acc, _, dep = _tables(spark, sf_dir)
    return M.stack_metrics({"table_prf": M.table_prf_avg(M.table_prf(M.table_coverage(dep)), acc)})


@query("pass_at_1", sql=f"WITH {O.STEPS}, {PASS_CTE} {PASS_SEL}", category="metrics")
def q_pass_at_1(spark, sf_dir):
    """Task pass@1 and turn coverage@1."""
    return M.stack_metrics({"pass_at_1": M.pass_at_1(M.merge_steps(*_tables(spark, sf_dir)))})


@query("evaluation_report", sql=f"""
WITH {COV}, {MACRO_CTE}, {PRF_CTE}, {PASS_CTE}
{MICRO_SEL} UNION ALL {MACRO_SEL} UNION ALL {PRF_SEL} UNION ALL {PASS_SEL}""", category="metrics")
def q_evaluation_report(spark, sf_dir):
    """S12 (flagship): the evaluation report as (section, metric, value)."""
    acc, qual, dep = _tables(spark, sf_dir)
    prf = M.table_prf(M.table_coverage(dep))
    merged = M.merge_steps(acc, qual, dep)
    return (M.micro_quality(acc, qual)
            .unionByName(M.macro_quality(acc, qual))
            .unionByName(M.stack_metrics({"table_prf": M.table_prf_avg(prf, acc)}))
            .unionByName(M.stack_metrics({"pass_at_1": M.pass_at_1(merged)})))


@query("high_acc_low_recall", sql=f"""
WITH {COV}
SELECT p.trace_id, p.step_index, a.query, {sf('a.coverage_ratio')} AS coverage, p.recall,
       left(coalesce(a.reasoning, ''), 200) AS reasoning,
       list_transform(p.true_tables, lambda x: regexp_extract(x, '([^/]*)$', 1)) AS true_tables,
       list_transform(p.model_tables, lambda x: regexp_extract(x, '([^/]*)$', 1)) AS model_tables
FROM prf p JOIN acc a USING (trace_id, step_index)
WHERE {sf('a.coverage_ratio')} >= 1.0 AND p.recall < 1.0""", category="metrics")
def q_high_acc_low_recall(spark, sf_dir):
    """Fully covered answers that cite too few tables."""
    acc, qual, dep = _tables(spark, sf_dir)
    prf = M.table_prf(M.table_coverage(dep))
    return M.high_acc_low_recall(M.merge_steps(acc, qual, dep), prf)


@query("fail_template", sql=f"""
WITH {O.STEPS}
SELECT a.trace_id, a.step_index, a.query, q.trace_id IS NULL AS is_missing,
       CASE WHEN q.trace_id IS NULL THEN 0.0 ELSE {sf('q.richness_score')} END AS richness_score,
       CASE WHEN q.trace_id IS NULL THEN 0.0 ELSE {sf('q.redundancy_score')} END AS redundancy_score,
       CASE WHEN q.trace_id IS NULL THEN NULL ELSE q.contradiction_score END AS contradiction_score
FROM acc a LEFT JOIN qual q USING (trace_id, step_index)""", category="metrics")
def q_fail_template(spark, sf_dir):
    """A10: expected steps without a quality judgement → zeroed template."""
    acc, qual, _ = _tables(spark, sf_dir)
    judged = qual.drop("query", "is_missing")
    return M.fail_template(acc.select("trace_id", "step_index", "query"), judged,
                           ["richness_score", "redundancy_score"], ["contradiction_score"])


@query("safe_float", sql=f"""
WITH {O.STEPS}
SELECT trace_id, step_index, {sf('richness_score')} AS richness, {sf('redundancy_score')} AS redundancy FROM qual""",
       category="metrics")
def q_safe_float(spark, sf_dir):
    """judge scores as numbers (bad → 0.0)."""
    _, qual, _ = _tables(spark, sf_dir)
    return qual.select("trace_id", "step_index", safe_float(F.col("richness_score")).alias("richness"),
                       safe_float(F.col("redundancy_score")).alias("redundancy"))


@query("metric_registry", sql=f"""
WITH {O.STEPS}
SELECT coalesce(avg({sf('coverage_ratio')}), 0.0) AS strict_coverage,
       coalesce(avg({sf('coverage_ratio')}) FILTER (WHERE NOT coalesce(is_missing, false)), 0.0) AS coverage,
       coalesce(avg({sf('richness_score')}), 0.0) AS strict_richness,
       coalesce(avg({sf('richness_score')}) FILTER (WHERE NOT coalesce(is_missing, false)), 0.0) AS richness,
       coalesce(avg({sf('redundancy_score')}), 0.0) AS strict_redundancy,
       coalesce(avg({sf('redundancy_score')}) FILTER (WHERE NOT coalesce(is_missing, false)), 0.0) AS redundancy,
       coalesce(avg({sf('contradiction_score')}), 0.0) AS strict_contradiction,
       coalesce(avg({sf('contradiction_score')}) FILTER (WHERE NOT coalesce(is_missing, false)), 0.0) AS contradiction
FROM steps""", category="metrics")
def q_metric_registry(spark, sf_dir):
    """Registered metrics evaluated as one aggregate."""
    from quarry.plans.fixtures import v_steps
    return evaluate_metrics(v_steps(spark, sf_dir), ["accuracy", "quality"])


_OVERVIEW_SQL = f"""
WITH {FIFO},
per AS (SELECT trace_id, count(*) AS n, count_if(coalesce(result_ok, false)) AS ok FROM pairs GROUP BY trace_id)
SELECT CAST(count(*) AS BIGINT) AS total_traces, coalesce(count_if(ok = n) / nullif(count(*), 0), 0.0) AS success_rate,
       round(avg(n), 6) AS avg_turns, round(avg(ok / n), 6) AS avg_tool_success, CAST(1.0 AS DOUBLE) AS avg_tool_parallelism FROM per"""


@query("overview", sql=_OVERVIEW_SQL, category="metrics")
def q_overview(spark, sf_dir):
    """Overview over call-log traces (success = every call answered ok)."""
    p = _pairs(spark, sf_dir)
    per = p.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("result_ok", F.lit(False))).alias("ok"))
    tr = per.select((F.col("ok") == F.col("n")).alias("success"), F.col("n").alias("total_turns"),
                    (F.col("ok") / F.col("n")).alias("tool_success_rate"), F.lit(1.0).alias("tool_parallelism"))
    o = M.overview(tr)
    return o.select("total_traces", "success_rate", F.round("avg_turns", 6).alias("avg_turns"),
                    F.round("avg_tool_success", 6).alias("avg_tool_success"), "avg_tool_parallelism")


_TOKENS_SQL = f"""
WITH {O.MESSAGES},
per AS (SELECT trace_id, sum(len(regexp_extract_all(content, '\\w+|[^\\w\\s]'))) AS total_tokens FROM messages GROUP BY trace_id)
SELECT round(avg(total_tokens), 6) AS avg_tokens, CAST(max(total_tokens) AS BIGINT) AS max_tokens,
       CAST(min(total_tokens) AS BIGINT) AS min_tokens, CAST(sum(total_tokens) AS BIGINT) AS sum_tokens FROM per"""


@query("token_usage", sql=_TOKENS_SQL, category="metrics")
def q_token_usage(spark, sf_dir):
    """A2: token usage over traces (default word/punctuation tokenizer)."""
    m = v_messages(spark, sf_dir)
    per = m.groupBy("trace_id").agg(F.sum(token_count("content")).alias("total_tokens"))
    u = M.token_usage(per)
    return u.select(F.round("avg_tokens", 6).alias("avg_tokens"), "max_tokens", "min_tokens", "sum_tokens")


def _section(name: str, sql: str, columns: str) -> str:
    """DuckDB: a registered one-row query as report rows."""
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns.split())
    return f"SELECT * FROM ({_long(name, f'SELECT {cols} FROM ({sql})')})"


@query("report_tables", sql=f"""
SELECT * FROM (WITH {COV}, {MACRO_CTE}, {PRF_CTE}, {PASS_CTE}
{MICRO_SEL} UNION ALL {MACRO_SEL} UNION ALL {PRF_SEL} UNION ALL {PASS_SEL})
UNION ALL {_section('overview', _OVERVIEW_SQL, 'total_traces success_rate avg_turns')}
UNION ALL {_section('tools', _OVERVIEW_SQL, 'avg_tool_success avg_tool_parallelism')}
UNION ALL {_section('tokens', _TOKENS_SQL, 'avg_tokens max_tokens min_tokens sum_tokens')}""", category="metrics")
def q_report_tables(spark, sf_dir):
    """All report sections as one long (section, metric, value) table:
    overview, tools and tokens beside the metric sections (the Markdown
    rendering of these rows is a driver-side format step)."""
    o, t = q_overview(spark, sf_dir), q_token_usage(spark, sf_dir)
    extra = M.stack_metrics({"overview": o.select("total_traces", "success_rate", "avg_turns"),
                             "tools": o.select("avg_tool_success", "avg_tool_parallelism"), "tokens": t})
    return q_evaluation_report(spark, sf_dir).unionByName(extra)


@query("case_details", sql=f"""
WITH {O.STEPS},
a AS (SELECT trace_id, count(*) AS n_steps, CAST(count_if(is_missing) AS BIGINT) AS n_missing,
             round(avg({sf('coverage_ratio')}), 6) AS coverage, bool_and({sf('coverage_ratio')} >= 1.0) AS passed FROM acc GROUP BY trace_id),
q AS (SELECT trace_id, round(avg({sf('richness_score')}), 6) AS richness FROM qual GROUP BY trace_id)
SELECT trace_id, n_steps, n_missing, coverage, passed, richness FROM a LEFT JOIN q USING (trace_id)""", category="metrics")
def q_case_details(spark, sf_dir):
    """The per-case section, one row a trace."""
    acc, qual, _ = _tables(spark, sf_dir)
    return M.case_details(acc, qual)
