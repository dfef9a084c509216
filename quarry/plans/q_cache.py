"""Registered cache / store / manifest queries (V-requests, V-files, documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cache as K
from quarry.operators import search as R
from quarry.functions.text import basename, extension, sanitize_name, stem
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_files, v_requests
from quarry.registry import query
from quarry.sources.tables import read_table

CUTOFF = 1705881600  # 2024-01-22 00:00:00 UTC, the TTL cut used by the cache queries


@query("request_key", sql="""
SELECT event_id, md5(json_object('event_type', event_type, 'props', props, 'user_id', user_id)) AS key FROM events""",
       category="cache")
def q_request_key(spark, sf):
    """canonical request hash of (event_type, props, user_id)."""
    e = read_table(spark, sf, "events", ["event_id", "event_type", "props", "user_id"])
    return e.select("event_id", K.request_key("event_type", "props", "user_id").alias("key"))


@query("cache_log_source", sql=f"""
WITH {O.REQUESTS}
SELECT hash, event_id, prompt, system, result, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY timestamp DESC, event_id DESC) AS rn FROM requests) WHERE rn = 1""",
       category="cache")
def q_cache_log_source(spark, sf):
    """Latest entry per request hash (later write wins)."""
    return K.latest_per_key(v_requests(spark, sf), "hash", ("timestamp", "event_id"))


@query("cache_ttl", sql=f"""
WITH {O.REQUESTS}
SELECT hash, event_id, timestamp FROM requests WHERE coalesce(timestamp, 0) >= {CUTOFF}""", category="cache")
def q_cache_ttl(spark, sf):
    """U4: entries newer than the TTL cut."""
    return K.cache_ttl(v_requests(spark, sf), F.lit(CUTOFF)).select("hash", "event_id", "timestamp")


@query("request_cache_lookup", sql=f"""
WITH {O.REQUESTS},
cache AS (SELECT hash, arg_max(result, (timestamp, event_id)) AS result FROM requests WHERE timestamp < {CUTOFF} GROUP BY hash),
req AS (SELECT hash, min(event_id) AS ordinal FROM requests GROUP BY hash)
SELECT r.hash, r.ordinal, c.hash IS NOT NULL AS hit, c.result FROM req r LEFT JOIN cache c USING (hash)""",
       category="cache")
def q_request_cache_lookup(spark, sf):
    """Distinct requests against the cache built before the cut."""
    r = v_requests(spark, sf)
    cache = K.latest_per_key(r.where(F.col("timestamp") < CUTOFF), "hash", ("timestamp", "event_id")).select("hash", "result")
    req = r.groupBy("hash").agg(F.min("event_id").alias("ordinal"))
    return K.cache_lookup(req, cache)


@query("pending_requests", sql=f"""
WITH {O.REQUESTS}
SELECT hash, min(event_id) AS ordinal FROM requests GROUP BY hash
HAVING hash NOT IN (SELECT hash FROM requests WHERE timestamp < {CUTOFF})""", category="cache")
def q_pending_requests(spark, sf):
    """J8 misses: requests not answered by the cache."""
    r = v_requests(spark, sf)
    req = r.groupBy("hash").agg(F.min("event_id").alias("ordinal"))
    return K.pending_requests(req, r.where(F.col("timestamp") < CUTOFF).select("hash").distinct())


@query("request_jsonl_sink", sql=f"""
WITH {O.REQUESTS},
r AS (SELECT row_number() OVER (ORDER BY event_id) AS custom_id, * FROM requests)
SELECT custom_id, json_object('custom_id', custom_id, 'method', 'POST', 'url', '/v1/chat/completions',
         'body', json_object('model', 'm1', 'messages', [json_object('role', 'system', 'content', system),
                                                         json_object('role', 'user', 'content', prompt)]))::VARCHAR AS line
FROM r""", category="cache")
def q_request_jsonl_sink(spark, sf):
    """Batch-request JSONL lines (what the sink writes with write.text)."""
    r = v_requests(spark, sf).withColumn("model", F.lit("m1"))
    return K.request_lines(r, "event_id", "model", "system", "prompt")


@query("cache_stats", sql=f"""
WITH {O.REQUESTS},
l AS (SELECT json_object('hash', hash, 'result', result, 'timestamp', timestamp)::VARCHAR AS line FROM requests)
SELECT count(*) AS entries, round(coalesce(sum(length(line) + 1), 0) / 1048576, 2) AS size_mb FROM l""",
       category="cache")
def q_cache_stats(spark, sf):
    """Entry count and size of the JSONL log."""
    r = v_requests(spark, sf)
    lines = r.select(F.to_json(F.struct("hash", "result", "timestamp")).alias("line"))
    return K.cache_stats(lines)


STORE = """
d AS (SELECT DISTINCT text FROM documents),
old AS (SELECT DISTINCT text FROM documents WHERE lang = 'en')"""


@query("missing_embeddings", sql=f"""
WITH {STORE}
SELECT text FROM d WHERE text NOT IN (SELECT text FROM old)""", category="cache")
def q_missing_embeddings(spark, sf):
    """Distinct texts not yet in the store (store = English documents)."""
    d = read_table(spark, sf, "documents", ["text", "lang"])
    dist = d.select(F.xxhash64("text").alias("text_hash"), "text").distinct()
    store = d.where("lang = 'en'").select(F.xxhash64("text").alias("text_hash"), "text").distinct()
    return R.missing_embeddings(dist, store).select("text")


@query("store_union", sql=f"""
WITH {STORE}
SELECT text, CASE WHEN text IN (SELECT text FROM old) AND lang_new IS NULL THEN 'cached' ELSE 'new' END AS version
FROM (SELECT DISTINCT d.text, n.text AS lang_new FROM d LEFT JOIN (SELECT DISTINCT text FROM documents WHERE lang <> 'en') n
      USING (text))""", category="cache")
def q_store_union(spark, sf):
    """Cached English vectors ∪ newly encoded other texts, new wins."""
    d = read_table(spark, sf, "documents", ["text", "lang"])
    old = d.where("lang = 'en'").select(F.xxhash64("text").alias("text_hash"), "text", F.lit("cached").alias("version")).distinct()
    new = d.where("lang <> 'en'").select(F.xxhash64("text").alias("text_hash"), "text", F.lit("new").alias("version")).distinct()
    return K.store_union(old, new).select("text", "version")


@query("embed_distinct")
def q_embed_distinct(spark, sf):
    """Every document with the vector of its distinct text (hashing encoder hook)."""
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return R.embed_distinct(d, None).select("doc_id", "embedding")


@query("grep_file_filter", sql=f"""
WITH {O.VFILES}
SELECT path FROM vfiles WHERE lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('csv', 'xlsx', 'xls', 'tsv', 'txt', 'py')
  AND regexp_matches(name, '^[1-4]')""", category="files")
def q_grep_file_filter(spark, sf):
    """Files grep would open for the name pattern ^[1-4]."""
    from quarry.operators.grep import grep_file_filter
    return grep_file_filter(v_files(spark, sf), r"^[1-4]").select("path")


@query("split_supported", sql=f"""
WITH {O.VFILES}
SELECT CAST(count_if(extension NOT IN ('.xlsx', '.xls')) AS BIGINT) AS n_processed, CAST(count_if(extension IN ('.xlsx', '.xls')) AS BIGINT) AS n_skipped,
       (SELECT list(path ORDER BY path) FROM (SELECT path FROM vfiles WHERE extension IN ('.xlsx', '.xls') ORDER BY path LIMIT 3))
         AS first_skipped
FROM vfiles""", category="files")
def q_split_supported(spark, sf):
    """P5: processed vs skipped files, first three skipped."""
    return K.split_supported(v_files(spark, sf))


@query("file_diff", sql=f"""
WITH {O.VFILES}
SELECT path FROM vfiles WHERE path NOT IN (
  SELECT path FROM vfiles WHERE mtime < TIMESTAMP '2024-01-15' AND NOT (starts_with(name, '.') OR starts_with(name, '_')))""",
       category="files")
def q_file_diff(spark, sf):
    """Files present now but not in the mid-month snapshot."""
    m = v_files(spark, sf)
    snap = m.where(F.col("mtime") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return K.file_diff(m, snap).select("path")


@query("folder_rollup", sql=f"""
WITH {O.VFILES},
p AS (SELECT string_split(relative_path, '/') AS p FROM vfiles),
pre AS (SELECT array_to_string(list_slice(p, 1, d), '/') AS dir, d AS depth, p[d + 1] AS child, d + 1 = len(p) AS is_file
        FROM (SELECT p, unnest(range(0, len(p))) AS d FROM p))
SELECT dir, CAST(depth AS INTEGER) AS depth, CAST(count_if(is_file) AS BIGINT) AS n_files_here, count(*) AS n_files_below,
       count(DISTINCT child) AS n_children FROM pre GROUP BY dir, depth""", category="files")
def q_folder_rollup(spark, sf):
    """Per-directory file counts over the whole tree."""
    return K.folder_rollup(v_files(spark, sf))


@query("dirs_first_order", sql=f"""
WITH RECURSIVE {O.VFILES},
p AS (SELECT string_split(relative_path, '/') AS p FROM vfiles),
nodes AS (SELECT DISTINCT array_to_string(list_slice(p, 1, d), '/') AS parent, d AS depth, p[d + 1] AS name, d + 1 = len(p) AS is_file
          FROM (SELECT p, unnest(range(0, len(p))) AS d FROM p)),
lv AS (SELECT parent, depth, count(*) AS n_children, min(CASE WHEN NOT is_file THEN name END) AS first_dir
       FROM nodes GROUP BY parent, depth),
walk AS (  -- each level with what the quota allows it; the next one only behind a whole level
  SELECT parent, depth, n_children, first_dir, least(n_children, 10) AS shown, 10 - least(n_children, 10) AS left_over
  FROM lv WHERE depth = 0
  UNION ALL
  SELECT l.parent, l.depth, l.n_children, l.first_dir, least(l.n_children, w.left_over), w.left_over - least(l.n_children, w.left_over)
  FROM walk w JOIN lv l ON l.depth = w.depth + 1
       AND l.parent = CASE WHEN w.depth = 0 THEN w.first_dir ELSE w.parent || '/' || w.first_dir END
  WHERE w.left_over > 0)
SELECT parent, name, is_file, rank, n_children FROM (
  SELECT n.*, w.n_children, w.shown, CAST(row_number() OVER (PARTITION BY n.parent ORDER BY n.is_file, n.name) AS INTEGER) AS rank
  FROM nodes n JOIN walk w USING (parent, depth))
WHERE rank <= shown""", category="files")
def q_dirs_first_order(spark, sf):
    """A folder view of at most 10 entries: the root, then the first directories."""
    return K.dirs_first_order(v_files(spark, sf))


@query("path_parts", sql=f"""
WITH {O.VFILES}
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base,
       CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS stem,
       lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) AS ext FROM vfiles""", category="files")
def q_path_parts(spark, sf):
    """basename, stem and lower-case extension."""
    m = v_files(spark, sf)
    return m.select("path", basename("path").alias("base"), stem("path").alias("stem"), extension("path").alias("ext"))


@query("sanitize_name", sql="""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), ''), 'sheet') AS name
FROM pages""", category="files")
def q_sanitize_name(spark, sf):
    """urls turned into safe file names."""
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", sanitize_name("url").alias("name"))


@query("fresh_summaries", sql=f"""
WITH {O.VFILES},
s AS (SELECT path AS file_path, mtime + to_days(CAST(page_id % 3 AS INTEGER) - 1) AS last_modified FROM vfiles)
SELECT s.file_path, s.last_modified FROM s JOIN vfiles v ON v.path = s.file_path WHERE s.last_modified >= v.mtime""",
       category="files")
def q_fresh_summaries(spark, sf):
    """Cached table summaries still fresh against the listing."""
    m = v_files(spark, sf)
    s = m.select(F.col("path").alias("file_path"),
                 F.timestamp_add("DAY", F.pmod("page_id", F.lit(3)) - 1, F.col("mtime")).alias("last_modified"))
    return K.fresh_summaries(s, m)


@query("summary_upsert", sql=f"""
WITH {O.VFILES},
old AS (SELECT path AS file_path, 'old' AS summary FROM vfiles WHERE page_id % 2 = 0),
new AS (SELECT path AS file_path, 'new' AS summary FROM vfiles WHERE page_id % 3 = 0)
SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT * FROM new""", category="files")
def q_summary_upsert(spark, sf):
    """Table summaries upserted with a new batch."""
    m = v_files(spark, sf)
    old = m.where(F.col("page_id") % 2 == 0).select(F.col("path").alias("file_path"), F.lit("old").alias("summary"))
    new = m.where(F.col("page_id") % 3 == 0).select(F.col("path").alias("file_path"), F.lit("new").alias("summary"))
    return K.summary_upsert(old, new)


@query("new_files", sql=f"""
WITH {O.VFILES}
SELECT path FROM vfiles EXCEPT ALL SELECT path FROM vfiles WHERE mtime < TIMESTAMP '2024-01-15'""", category="files")
def q_new_files(spark, sf):
    """Set difference of listings (paths now minus paths at the snapshot)."""
    m = v_files(spark, sf).select("path")
    snap = v_files(spark, sf).where(F.col("mtime") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("path")
    return m.exceptAll(snap)


@query("union_corpus", sql="""
SELECT * FROM (SELECT 'part' AS src, CAST(p_partkey AS BIGINT) AS id, p_name AS name, p_retailprice AS price FROM part)
UNION ALL BY NAME
SELECT * FROM (SELECT 'supplier' AS src, s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier)""",
       category="files")
def q_union_corpus(spark, sf):
    """Rows of differently shaped tables in one frame (missing columns NULL)."""
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_retailprice"]).select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"))
    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).select(
        F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"))
    return p.unionByName(s, allowMissingColumns=True)
