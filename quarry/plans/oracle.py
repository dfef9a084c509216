"""DuckDB twins of the fixture views, as CTE fragments.

Each constant is one or more ``name AS (...)`` CTE bodies written against
the driver's base tables, so an oracle query is ``WITH <views> SELECT …``.
"""

# V-lines: documents as files, one row per physical line (1-based)
FILES = r"""
files AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path,
         CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[]
              ELSE list_slice(regexp_split_to_array(text, '\r\n|\n|\r'), 1,
                     len(regexp_split_to_array(text, '\r\n|\n|\r'))
                     - CASE WHEN regexp_split_to_array(text, '\r\n|\n|\r')[-1] = '' THEN 1 ELSE 0 END)
         END AS lines
  FROM documents)"""

LINES = FILES + r""",
lines AS (
  SELECT path, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line_no, unnest(lines) AS line FROM files)"""

MESSAGES = r"""
messages AS (
  SELECT conv_id AS trace_id, turn AS seq, role, text AS content FROM conversations)"""

TAGGED = r"""
tagged AS (
  SELECT conv_id AS trace_id, turn AS seq, role,
    CASE WHEN role = 'user' AND conv_id % 6 IN (1, 2) AND turn > 1 THEN '[Tool Execution Result: grep_search]' || chr(10) || '[SUCCESS] ' || text
         WHEN role = 'user' AND conv_id % 7 = 6 AND turn > 0 THEN ''
         WHEN role <> 'assistant' THEN text
         WHEN conv_id % 6 = 0 THEN '<answer>' || text || '</answer>'
         WHEN conv_id % 6 = 1 THEN '<think>' || text || '</think>' || chr(10) || '<answer>' || text || '</answer>'
         WHEN conv_id % 6 = 2 THEN '<tool_call>{"tool": "grep_search", "params": ' || CAST(to_json({'pattern': text}) AS VARCHAR) || '}</tool_call>'
         WHEN conv_id % 6 = 3 THEN '```json' || chr(10) || '{"reply": ' || CAST(to_json({'answer': text}) AS VARCHAR) || ', "answer": "'
                                   || CAST(conv_id AS VARCHAR) || '", "data_source": ["t' || CAST(conv_id AS VARCHAR) || '.csv"]}'
                                   || chr(10) || '```'
         WHEN conv_id % 6 = 4 THEN '3 rows: ' || CAST(to_json({'answer': text}) AS VARCHAR)
         ELSE '<answer>' || text END AS content
  FROM conversations)"""

# OpenAI-shaped traces: (call name, arguments) of call rows, NULL elsewhere
OPENAI = r"""
oa AS (
  SELECT conv_id AS trace_id, CAST(2 * turn AS BIGINT) AS seq, role,
    CASE WHEN role = 'assistant' AND conv_id % 7 <= 1 THEN CASE WHEN turn % 4 = 1 THEN '' ELSE text END
         WHEN role = 'assistant' AND conv_id % 7 = 2 THEN 'so <answer> ' || text || ' </answer>'
         WHEN role = 'assistant' AND conv_id % 7 = 3 THEN CAST(to_json({'answer': text}) AS VARCHAR)
         WHEN role = 'assistant' AND conv_id % 7 = 4 THEN 'found it' || chr(10) || '## Answer' || chr(10) || text
         WHEN role = 'assistant' AND conv_id % 7 = 6 THEN ' '
         WHEN role = 'user' AND turn > 1 AND conv_id % 7 = 1 THEN '[ERROR] ' || text ELSE text END AS content,
    CASE WHEN role = 'assistant' AND conv_id % 7 = 0 THEN CAST(to_json({'pattern': text}) AS VARCHAR)
         WHEN role = 'assistant' AND conv_id % 7 = 1 THEN 'rows: ' || text END AS arguments,
    CASE WHEN role = 'assistant' AND conv_id % 7 <= 1 THEN 'call_' || conv_id || '_' || turn END AS call_id,
    NULL::VARCHAR AS tool_call_id
  FROM conversations
  UNION ALL
  SELECT conv_id, CAST(2 * turn + 1 AS BIGINT), 'tool', text, NULL, NULL, 'call_' || conv_id || '_' || turn
  FROM conversations WHERE role = 'assistant' AND conv_id % 7 <= 1),
oac AS (  -- a call as text: arguments parsed, or the bare string
  SELECT *, CASE WHEN arguments IS NOT NULL THEN '{"params":' || CASE WHEN json_valid(arguments) THEN arguments
            ELSE CAST(to_json(arguments) AS VARCHAR) END || ',"tool":"grep_search"}' END AS call_text FROM oa)"""

CALLS = r"""
calls AS (
  SELECT user_id AS trace_id, ts, event_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'call'
              WHEN event_type IN ('view', 'error') THEN 'result' ELSE 'other' END AS kind,
         event_type AS tool, event_type <> 'error' AS ok
  FROM events)"""

STEPS = r"""
steps AS (
  SELECT d.source AS trace_id,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS INTEGER) AS step_index, d.doc_id,
         'doc ' || CAST(d.doc_id AS VARCHAR) AS query, l.quality IS NULL AS is_missing,
         coalesce(CAST(l.quality AS DOUBLE), 0.0) AS coverage_ratio,
         CASE WHEN d.doc_id % 7 = 0 THEN 'n/a' ELSE CAST(d.doc_id % 5 AS VARCHAR) END AS richness_score,
         CAST(d.doc_id % 3 AS VARCHAR) AS redundancy_score, CAST(d.doc_id % 2 AS VARCHAR) AS contradiction_score,
         'reason ' || CAST(d.doc_id AS VARCHAR) AS reasoning,
         ['dir/t' || CAST(d.doc_id % 4 AS VARCHAR) || '.csv', 't' || CAST(d.doc_id % 6 AS VARCHAR) || '_split.csv'] AS true_tables,
         ['t' || CAST(d.doc_id % 4 AS VARCHAR) || '_Sheet1.csv', 'x/t' || CAST(d.doc_id % 5 AS VARCHAR) || '.csv'] AS model_tables
  FROM documents d LEFT JOIN labels l USING (doc_id)),
acc AS (SELECT trace_id, step_index, query, is_missing, coverage_ratio, reasoning FROM steps),
qual AS (SELECT trace_id, step_index, query, is_missing, richness_score, redundancy_score, contradiction_score
         FROM steps WHERE doc_id % 3 <> 0),
dep AS (SELECT trace_id, step_index, query, true_tables, model_tables FROM steps WHERE doc_id % 4 <> 1)"""

SAMPLES = r"""
samples AS (
  SELECT item_id AS ord, text AS task,
         CASE WHEN item_id % 2 = 1 THEN CAST(length(text) AS VARCHAR) END AS answer,
         CASE WHEN item_id % 2 = 1 THEN ['t' || CAST(item_id AS VARCHAR) || '.csv'] END AS table_path,
         CASE WHEN item_id % 2 = 0 THEN list_transform(
             string_split(text, '. '),
             lambda s, i: {'idx': CAST(i AS INTEGER), 'info_item': s, 'answer': CAST(length(s) AS VARCHAR),
                           'related_tables': ['t' || CAST(item_id AS VARCHAR) || '.csv',
                                              't' || CAST(item_id AS VARCHAR) || '_part' || CAST(i AS VARCHAR) || '.csv'],
                           'score_points': [CAST(length(s) AS VARCHAR)]}) END AS checkout_list
  FROM benchmark
  UNION ALL
  SELECT item_id + 1000000, text, 'dup', NULL, NULL FROM benchmark WHERE item_id % 4 = 0),
expected AS (
  SELECT ord, task, CAST(generate_subscripts(checkout_list, 1) AS INTEGER) AS step_no, unnest(checkout_list, recursive := true)
  FROM samples WHERE checkout_list IS NOT NULL
  UNION ALL
  SELECT ord, task, 1, 1, regexp_replace(task, '^\s+|\s+$', '', 'g'), answer, coalesce(table_path, []::VARCHAR[]), []::VARCHAR[]
  FROM samples WHERE checkout_list IS NULL AND answer IS NOT NULL)"""

CELLS = r"""
sup AS (
  SELECT 'supplier/n' || CAST(s_nationkey % 5 AS VARCHAR) || '.csv' AS path, 'Sheet1' AS sheet, s_suppkey, s_name,
         s_nationkey, s_acctbal FROM supplier),
sr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s_nationkey, s_suppkey) AS rn FROM sup),
runs0 AS (SELECT path, sheet, s_nationkey, min(rn) AS min_rn, max(rn) AS max_rn, min(s_suppkey) AS first_sk
          FROM sr GROUP BY ALL),
runs AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY s_nationkey) AS nrank FROM runs0),
g AS (SELECT sr.*, runs.min_rn, runs.max_rn, runs.first_sk, runs.nrank FROM sr JOIN runs USING (path, sheet, s_nationkey)),
cells AS (
  SELECT path, sheet, CAST(3 + rn + nrank AS INTEGER) AS r, CAST(c AS INTEGER) AS c,
         [s_name, CASE WHEN s_suppkey = first_sk THEN CAST(s_nationkey AS VARCHAR) END,
          format('{:,.2f}', s_acctbal), CAST(s_suppkey % 100 AS VARCHAR) || '%', ''][c] AS value
  FROM g, range(1, 6) t(c)
  UNION ALL
  SELECT path, sheet, CAST(3 + min_rn + nrank - 1 AS INTEGER), CAST(c AS INTEGER),
         CASE WHEN c <= 4 THEN 'Nation ' || CAST(s_nationkey AS VARCHAR) ELSE '' END
  FROM runs, range(1, 6) t(c)
  UNION ALL
  SELECT path, sheet, h.r, h.c, h.value FROM (SELECT DISTINCT path, sheet FROM runs) f,
    (VALUES (1, 1, 'Unnamed: 0'), (1, 2, 'Unnamed: 1'), (1, 3, 'Unnamed: 2'), (1, 4, 'Unnamed: 3'), (1, 5, 'Unnamed: 4'),
            (2, 1, 'Supplier'), (2, 2, NULL), (2, 3, 'Finance'), (2, 4, NULL), (2, 5, NULL),
            (3, 1, 'name'), (3, 2, 'nation'), (3, 3, 'acctbal'), (3, 4, 'share'), (3, 5, 'Unnamed: 5')) h(r, c, value)),
merged AS (
  SELECT path, sheet, CAST(m.range_no AS BIGINT) AS range_no, m.r0, m.r1, m.c0, m.c1
  FROM (SELECT DISTINCT path, sheet FROM runs) f, (VALUES (0, 2, 2, 1, 2), (1, 2, 2, 3, 5)) m(range_no, r0, r1, c0, c1)
  UNION ALL
  SELECT path, sheet, 10 + 2 * s_nationkey, CAST(3 + min_rn + nrank - 1 AS INTEGER), CAST(3 + min_rn + nrank - 1 AS INTEGER), 1, 4
  FROM runs
  UNION ALL
  SELECT path, sheet, 11 + 2 * s_nationkey, CAST(3 + min_rn + nrank AS INTEGER), CAST(3 + min_rn + nrank + max_rn - min_rn AS INTEGER), 2, 2
  FROM runs WHERE max_rn > min_rn)"""

ROW_LINES = r"""
pl AS (SELECT 'part/' || lower(p_type) || '.csv' AS path,
              CAST(1 + row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS INTEGER) AS line_no,
              concat_ws(',', CAST(p_partkey AS VARCHAR), p_name, p_brand, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)) AS line
       FROM part
       UNION ALL
       SELECT DISTINCT 'part/' || lower(p_type) || '.csv', 1, 'p_partkey,p_name,p_brand,p_size,p_retailprice' FROM part)"""

VFILES = r"""
vf0 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')
               || '.' || ['csv', 'tsv', 'xlsx', 'xls'][page_id % 4 + 1] AS rel, html FROM pages),
vfiles AS (SELECT page_id, '/corpus/' || rel AS path, regexp_extract(rel, '([^/]*)$', 1) AS name, rel AS relative_path,
                  '.' || ['csv', 'tsv', 'xlsx', 'xls'][page_id % 4 + 1] AS extension, CAST(length(html) AS BIGINT) AS size,
                  TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) AS mtime FROM vf0)"""

REQUESTS = r"""
requests AS (SELECT md5(concat_ws('|', props, event_type)) AS hash, event_id, props AS prompt, event_type AS system,
                    value AS result, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp FROM events)"""
