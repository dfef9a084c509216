"""Registered sample / alignment queries (V-samples, V-traces, V-tagged)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import samples as S
from quarry.operators import traces as T
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_samples, v_tagged, v_traces
from quarry.plans.q_traces import QA, turned_actions
from quarry.registry import query

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("explode_checklist", sql=f"""
WITH {O.SAMPLES}
SELECT ord, task, step_no, idx, info_item, answer AS true_answer, related_tables, score_points FROM expected""",
       category="samples")
def q_explode_checklist(spark, sf):
    """Expected steps of every sample."""
    return S.explode_checklist(v_samples(spark, sf))


@query("first_occurrence", sql=f"""
WITH {O.SAMPLES}
SELECT task, ord, answer FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ord) AS rn FROM samples)
WHERE rn = 1""", category="samples")
def q_first_occurrence(spark, sf):
    """First sample per task in file order."""
    return S.first_occurrence(v_samples(spark, sf)).select("task", "ord", "answer")


@query("duplicate_tasks", sql=f"""
WITH {O.SAMPLES}
SELECT task, count(*) AS n FROM samples GROUP BY task HAVING count(*) > 1""", category="samples")
def q_duplicate_tasks(spark, sf):
    """Repeated tasks."""
    return S.duplicate_tasks(v_samples(spark, sf))


@query("sample_limit", sql=f"""
WITH {O.SAMPLES}
SELECT ord, task FROM samples ORDER BY ord LIMIT 10""", category="samples")
def q_sample_limit(spark, sf):
    """L4: first 10 samples in file order (the --sample option)."""
    return S.sample_limit(v_samples(spark, sf), 10).select("ord", "task")


@query("pending_samples", sql=f"""
WITH {O.SAMPLES}
SELECT ord, task FROM samples s
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE {STRIP.format('d.text')} = s.task)""", category="samples")
def q_pending_samples(spark, sf):
    """Samples with no finished trace yet."""
    return S.pending_samples(v_samples(spark, sf), v_traces(spark, sf)).select("ord", "task")


@query("match_sample", sql=f"""
WITH {O.SAMPLES},
q AS (SELECT doc_id AS trace_id, {STRIP.format("coalesce(text, '')")} AS q FROM documents),
s AS (SELECT ord, {STRIP.format("coalesce(task, '')")} AS s FROM samples WHERE checkout_list IS NOT NULL OR answer IS NOT NULL)
SELECT trace_id, min(ord) AS ord FROM q JOIN s
  ON s.s = q.q OR (q.q <> '' AND contains(s.s, q.q)) OR (s.s <> '' AND contains(q.q, s.s))
GROUP BY trace_id""", category="samples")
def q_match_sample(spark, sf):
    """First usable sample matching each trace query (containment either way, blocked by word runs)."""
    return S.match_sample(v_traces(spark, sf), v_samples(spark, sf))


@query("align_steps", sql=f"""
WITH {QA}, {O.SAMPLES},
links AS (SELECT DISTINCT t.trace_id, s.ord FROM tagged t JOIN samples s ON s.ord = t.trace_id),
exp AS (SELECT l.trace_id, e.step_no AS step_index, e.info_item, e.answer AS true_answer FROM links l JOIN expected e USING (ord)),
al AS (SELECT e.trace_id, e.step_index, e.info_item AS query,
              CASE WHEN coalesce(p.answer, '') <> '' THEN p.answer ELSE '' END AS answer,
              coalesce(p.answer, '') = '' AS is_missing, e.true_answer, coalesce(p.n_tools, 0) AS n_tools
       FROM exp e LEFT JOIN pairs p ON p.trace_id = e.trace_id AND p.step_index = e.step_index)
SELECT * FROM al
UNION ALL
SELECT trace_id, step_index, query, answer, false, NULL, n_tools FROM pairs WHERE trace_id NOT IN (SELECT trace_id FROM links)""",
       category="samples")
def q_align_steps(spark, sf):
    """Positional alignment of raw QA pairs with expected steps."""
    pairs = T.qa_pairs(turned_actions(spark, sf))
    samples = v_samples(spark, sf)
    # trace i was generated from sample i (ords below the duplicate offset)
    traces = v_tagged(spark, sf).select("trace_id").distinct()
    links = traces.join(samples.select("ord"), F.col("trace_id") == F.col("ord"))
    out = S.align_steps(pairs, S.explode_checklist(samples), links)
    return out.select("trace_id", "step_index", "query", "answer", "is_missing", "true_answer", "n_tools")


@query("step_order", sql=f"""
WITH {QA}
SELECT trace_id, step_index, query FROM pairs""", category="samples")
def q_step_order(spark, sf):
    """QA steps ordered by (trace, step) via range partitioning."""
    pairs = T.qa_pairs(turned_actions(spark, sf))
    return S.step_order(pairs.select("trace_id", "step_index", "query"))


NUM = "'-?\\d+(?:\\.\\d+)?'"
COVER = f"""
sp AS (SELECT a.*, list_transform(regexp_extract_all(coalesce(answer, ''), {NUM}), lambda x: CAST(x AS DOUBLE)) AS an,
              regexp_extract_all(lower(coalesce(answer, '')), '\\w+') AS aw FROM aligned a),
cv AS (SELECT *, len(coalesce(score_points, [])) AS total_metrics,
              len(list_filter(coalesce(score_points, []), lambda p:
                CASE WHEN len(regexp_extract_all(p, {NUM})) > 0
                     THEN len(list_filter(regexp_extract_all(p, {NUM}), lambda n:
                              len(list_filter(an, lambda v: abs(v - CAST(n AS DOUBLE)) <= 0.1)) = 0)) = 0
                     ELSE len(list_filter(regexp_extract_all(lower(p), '\\w+'), lambda w: NOT list_contains(aw, w))) = 0 END))
              AS covered_metrics FROM sp)"""

ALIGNED = f"""{QA}, {O.SAMPLES},
links AS (SELECT DISTINCT t.trace_id, s.ord FROM tagged t JOIN samples s ON s.ord = t.trace_id),
exp AS (SELECT l.trace_id, e.step_no AS step_index, e.info_item, e.answer AS true_answer, e.score_points
        FROM links l JOIN expected e USING (ord)),
aligned AS (SELECT e.trace_id, e.step_index, e.info_item AS query,
              CASE WHEN coalesce(p.answer, '') <> '' THEN p.answer ELSE '' END AS answer,
              coalesce(p.answer, '') = '' OR coalesce(e.true_answer, '') = '' AS is_missing, e.score_points
       FROM exp e LEFT JOIN pairs p ON p.trace_id = e.trace_id AND p.step_index = e.step_index
       UNION ALL
       SELECT trace_id, step_index, query, answer, true, NULL FROM pairs
       WHERE trace_id NOT IN (SELECT trace_id FROM links))"""


def _aligned(spark, sf):
    """Steps of every trace.  A trace without a sample keeps its raw pairs; a step
    without a true answer can't be judged and is missing, as in the reference."""
    pairs = T.qa_pairs(turned_actions(spark, sf))
    samples = v_samples(spark, sf)
    links = v_tagged(spark, sf).select("trace_id").distinct().join(samples.select("ord"),
                                                                   F.col("trace_id") == F.col("ord"))
    out = S.align_steps(pairs, S.explode_checklist(samples), links)
    return out.withColumn("is_missing", F.col("is_missing") | (F.coalesce("true_answer", F.lit("")) == ""))


@query("score_point_coverage", sql=f"""
WITH {ALIGNED}, {COVER}
SELECT trace_id, step_index, CAST(total_metrics AS INTEGER) AS total_metrics, CAST(covered_metrics AS INTEGER) AS covered_metrics,
       CASE WHEN total_metrics > 0 THEN round(covered_metrics / total_metrics, 3) ELSE 0.0 END AS coverage_ratio FROM cv""",
       category="samples")
def q_score_point_coverage(spark, sf):
    """rule judge of each aligned step's answer against its score points."""
    from quarry.operators.metrics import score_point_coverage
    a = _aligned(spark, sf)
    s = score_point_coverage(F.col("answer"), F.col("score_points"))
    return a.select("trace_id", "step_index", s["total_metrics"].alias("total_metrics"),
                    s["covered_metrics"].alias("covered_metrics"), s["coverage_ratio"].alias("coverage_ratio"))


@query("judge_hook", sql=f"""
WITH {ALIGNED}, {COVER}
SELECT trace_id, step_index, query, is_missing,
       CASE WHEN is_missing THEN 0.0 ELSE CAST(total_metrics AS DOUBLE) END AS total_metrics,
       CASE WHEN is_missing THEN 0.0 ELSE CAST(covered_metrics AS DOUBLE) END AS covered_metrics,
       CASE WHEN is_missing THEN 0.0 WHEN total_metrics > 0 THEN round(covered_metrics / total_metrics, 3) ELSE 0.0 END
         AS coverage_ratio,
       CASE WHEN is_missing THEN NULL ELSE 'rule: numbers within 0.1, words present' END AS reasoning FROM cv""",
       category="samples")
def q_judge_hook(spark, sf):
    """Default judge over aligned steps; missing steps get the zero template."""
    from quarry.operators.metrics import judge_steps
    return judge_steps(_aligned(spark, sf))


@query("evaluate_traces", sql=f"""
WITH {ALIGNED}, {COVER},
acc AS (SELECT trace_id, step_index, is_missing,
               CASE WHEN is_missing THEN 0.0 WHEN total_metrics > 0 THEN round(covered_metrics / total_metrics, 3)
                    ELSE 0.0 END AS coverage_ratio FROM cv),
per AS (SELECT trace_id, bool_and(coverage_ratio >= 1.0) AS passed, count_if(coverage_ratio >= 1.0) AS n_cov1,
               count(*) AS n_acc FROM acc GROUP BY trace_id)
SELECT * FROM (SELECT 'micro' AS section, metric, round(value, 6) AS value FROM (UNPIVOT (
  SELECT coalesce(avg(coverage_ratio), 0.0) AS strict_coverage,
         coalesce(avg(coverage_ratio) FILTER (WHERE NOT is_missing), 0.0) AS coverage,
         CAST(count(*) AS DOUBLE) AS n_strict, CAST(count_if(NOT is_missing) AS DOUBLE) AS n_non_strict FROM acc)
  ON COLUMNS(*) INTO NAME metric VALUE value))
UNION ALL
SELECT * FROM (SELECT 'table_prf' AS section, metric, round(value, 6) AS value FROM (UNPIVOT (
  SELECT 0.0 AS strict_table_recall, 0.0 AS table_recall, 0.0 AS strict_table_precision, 0.0 AS table_precision,
         0.0 AS strict_table_f1, 0.0 AS table_f1) ON COLUMNS(*) INTO NAME metric VALUE value))
UNION ALL
SELECT * FROM (SELECT 'pass_at_1' AS section, metric, round(value, 6) AS value FROM (UNPIVOT (
  SELECT CAST(count(*) AS DOUBLE) AS total_valid_tasks, CAST(count_if(passed) AS DOUBLE) AS task_pass_count,
         coalesce(count_if(passed) / nullif(count(*), 0), 0.0) AS task_pass_at_1,
         coalesce(sum(n_cov1) / nullif(sum(n_acc), 0), 0.0) AS turn_coverage_at_1 FROM per)
  ON COLUMNS(*) INTO NAME metric VALUE value))""", category="metrics")
def q_evaluate_traces(spark, sf):
    """Flagship end to end: tagged conversations → actions → QA pairs →
    alignment with their samples → rule judge → steps → report sections
    (micro coverage, table PRF, pass@1) as (section, metric, value)."""
    from quarry.operators import metrics as M
    from quarry.session import cut_lineage
    # the aligned steps feed the judge, the table metrics and pass@1: store once
    aligned = cut_lineage(_aligned(spark, sf))
    judged = M.judge_steps(aligned)
    acc = judged.select("trace_id", "step_index", "query", "is_missing", "coverage_ratio", "reasoning")
    dep = aligned.select("trace_id", "step_index", "query", F.col("related_tables").alias("true_tables"),
                         F.col("data_source").alias("model_tables"))
    # no quality judge runs here: an empty quality table with the step schema
    qual = acc.where(F.lit(False)).select("trace_id", "step_index", "query", "is_missing",
                                          *[F.lit(None).cast("string").alias(c) for c in M.QUALITY_SCORES])
    micro = M.stack_metrics({"micro": acc.agg(
        F.coalesce(F.avg("coverage_ratio"), F.lit(0.0)).alias("strict_coverage"),
        F.coalesce(F.avg(F.when(~F.col("is_missing"), F.col("coverage_ratio"))), F.lit(0.0)).alias("coverage"),
        F.count("*").alias("n_strict"), F.count_if(~F.col("is_missing")).alias("n_non_strict"))})
    prf = M.stack_metrics({"table_prf": M.table_prf_avg(M.table_prf(M.table_coverage(dep)), acc)})
    p1 = M.stack_metrics({"pass_at_1": M.pass_at_1(M.merge_steps(acc, qual, dep))})
    return micro.unionByName(prf).unionByName(p1)


@query("trace_evaluation", sql=f"""
WITH {ALIGNED}, {COVER},
per AS (SELECT trace_id, count(*) AS n_steps, CAST(count_if(is_missing) AS BIGINT) AS n_missing,
               round(avg(CASE WHEN is_missing OR total_metrics = 0 THEN 0.0
                              ELSE round(covered_metrics / total_metrics, 3) END), 6) AS coverage
        FROM cv GROUP BY trace_id),
doc AS (SELECT conv_id AS trace_id, count(*) AS total_turns,
               arg_min(text, turn) FILTER (WHERE role = 'user') AS task FROM conversations GROUP BY conv_id)
SELECT c.conv_id AS trace_id, d.task, d.total_turns, c.turn AS seq, c.role, c.text AS content,
       p.n_steps, p.n_missing, p.coverage
FROM conversations c JOIN doc d ON d.trace_id = c.conv_id LEFT JOIN per p ON p.trace_id = c.conv_id""",
       category="samples")
def q_trace_evaluation(spark, sf):
    """Conversations stored as trace documents, their judged steps written
    back as a new version, and every document's messages read with its
    metadata and evaluation (long form)."""
    from quarry.operators.metrics import judge_steps
    from quarry.plans.fixtures import v_messages
    from quarry.plans.q_sources import _scratch
    from quarry.sources import trace_store as TS
    root = _scratch(spark, "tracestore")
    m = v_messages(spark, sf).select("trace_id", "seq", "role", "content")
    asked = F.col("role") == "user"
    meta = m.groupBy("trace_id").agg(F.count("*").alias("total_turns"),
                                     F.min_by(F.when(asked, F.col("content")), F.when(asked, F.col("seq"))).alias("task"))
    TS.create(m, meta, root)
    judged = judge_steps(_aligned(spark, sf)).groupBy("trace_id").agg(
        F.count("*").alias("n_steps"), F.count_if("is_missing").alias("n_missing"),
        F.round(F.avg("coverage_ratio"), 6).alias("coverage"))
    TS.write_evaluation(judged, root)
    docs = TS.read_documents(spark, root, "n_steps long, n_missing long, coverage double")
    return TS.read_messages(spark, root).join(docs, "trace_id").select(
        "trace_id", "task", "total_turns", "seq", "role", "content", "evaluation.*")
