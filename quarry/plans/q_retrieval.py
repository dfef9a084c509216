"""Registered retrieval queries (documents, benchmark, embeddings, V-rows, V-lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import token_count
from quarry.operators import cells as C
from quarry.operators import search as R
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_file_lines, v_row_lines
from quarry.plans.q_cells import _row_lines
from quarry.registry import query
from quarry.sources.tables import read_table

TOK = "regexp_extract_all(lower({}), '[\\pL\\pN_]{{2,}}')"


def _tfidf_sql(corpus_cte: str, query_cte: str, k: int) -> str:
    """DuckDB TF-IDF (sparse) over ``corp(id, text)`` and ``qs(qid, text)``."""
    return f"""
{corpus_cte},
{query_cte},
dtok AS (SELECT id, unnest({TOK.format('text')}) AS term FROM corp),
dtf AS (SELECT id, term, count(*) AS tf FROM dtok GROUP BY ALL),
st AS (SELECT term, sum(tf) AS cnt, count(*) AS df FROM dtf GROUP BY term),
voc AS (SELECT term, ln((1 + (SELECT count(*) FROM corp)) / (1 + df)) + 1 AS idf FROM st ORDER BY cnt DESC, term LIMIT 512),
dw AS (SELECT id, term, tf * idf AS w FROM dtf JOIN voc USING (term)),
dn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM dw),
qtok AS (SELECT qid, unnest({TOK.format('text')}) AS term FROM qs),
qw AS (SELECT qid, term, count(*) * any_value(idf) AS w FROM qtok JOIN voc USING (term) GROUP BY qid, term),
qn AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qw),
sc AS (SELECT q.qid, d.id, sum(q.w * d.w) AS score FROM qn q JOIN dn d USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {k}"""


def _tfidf(corpus, queries, k):
    vocab = R.tfidf_fit(corpus, "id", "text")
    dv = R.tfidf_vectors(corpus, vocab, "id", "text")
    qv = R.tfidf_vectors(queries.withColumnRenamed("qid", "id"), vocab, "id", "text").withColumnRenamed("id", "qid")
    hits = R.sparse_topk(dv, qv, k, R.TFIDF_MAX_FEATURES)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _benchmark_queries(spark, sf):
    return read_table(spark, sf, "benchmark", ["item_id", "text"]).select(F.col("item_id").alias("qid"), "text")


@query("tfidf_search", sql="WITH " + _tfidf_sql("corp AS (SELECT doc_id AS id, text FROM documents)",
                                      "qs AS (SELECT item_id AS qid, text FROM benchmark)", 5), category="retrieval")
def q_tfidf_search(spark, sf):
    """V1: TF-IDF (512 features, smooth idf, L2) top-5 documents per benchmark item."""
    corpus = read_table(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    return _tfidf(corpus, _benchmark_queries(spark, sf), 5)


EMB = "CAST(embedding AS DOUBLE[])"


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


def _dense_sql(where_q: str, k: int) -> str:
    return f"""
WITH q AS (SELECT vec_id AS qid, {EMB} AS qv FROM embeddings WHERE {where_q}),
sc AS (SELECT q.qid, e.vec_id AS id, list_inner_product(q.qv, {EMB}) AS score FROM q, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {k}"""


def _dense(spark, sf, qfilter, k):
    e = _emb(spark, sf)
    q = e.where(qfilter).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = R.dense_topk(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), q, k)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("topk_similarity", sql=_dense_sql("vec_id = 0", 10), category="retrieval")
def q_topk_similarity(spark, sf):
    """L1: top-10 stored vectors for one query vector."""
    return _dense(spark, sf, F.col("vec_id") == 0, 10)


@query("topk_batch", sql=_dense_sql("true", 10), category="retrieval")
def q_topk_batch(spark, sf):
    """Top-10 per query, every vector being a query."""
    return _dense(spark, sf, F.lit(True), 10)


@query("maxsim_search", sql=f"""
WITH t AS (SELECT vec_id // 8 AS doc_id, vec_id, {EMB} AS v FROM embeddings),
q AS (SELECT doc_id AS qid, vec_id AS qtok, v FROM t),
m AS (SELECT q.qid, t.doc_id, q.qtok, max(list_inner_product(q.v, t.v)) AS mx FROM q, t GROUP BY ALL),
s AS (SELECT qid, doc_id, sum(mx) AS score FROM m GROUP BY qid, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT CAST(qid AS BIGINT) AS qid, CAST(doc_id AS BIGINT) AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM rk WHERE rank <= 5""", category="retrieval")
def q_maxsim_search(spark, sf):
    """V9: MaxSim; eight vectors make a document, and every document is a query."""
    docs, queries = _token_tables(spark, sf)
    r = R.maxsim(docs.select("doc_id", "vec"), queries, 5)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _token_tables(spark, sf):
    docs = _emb(spark, sf).select(F.floor(F.col("vec_id") / 8).alias("doc_id"), F.col("vec_id").alias("tok"),
                                  F.col("embedding").alias("vec"))
    return docs, docs.select(F.col("doc_id").alias("qid"), F.col("tok").alias("qtok"), F.col("vec").alias("qvec"))


@query("maxsim_rerank", sql=f"""
WITH t AS (SELECT vec_id // 8 AS doc_id, vec_id AS tok, {EMB} AS v FROM embeddings),
p AS (SELECT q.doc_id AS qid, q.tok AS qtok, t.doc_id, t.tok, list_inner_product(q.v, t.v) AS s FROM t AS q, t),
near AS (SELECT *, row_number() OVER (PARTITION BY qtok ORDER BY round(s, 9) DESC, tok) AS n FROM p),
best AS (SELECT qid, doc_id, qtok, max(s) AS s FROM near WHERE n <= 20 GROUP BY ALL),
one AS (SELECT qid, doc_id, sum(s) AS s FROM best GROUP BY ALL),
cand AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id) AS n FROM one)
         WHERE n <= 10),
mx AS (SELECT p.qid, p.doc_id, p.qtok, max(p.s) AS s FROM p JOIN cand USING (qid, doc_id) GROUP BY ALL),
ex AS (SELECT qid, doc_id, sum(s) AS score FROM mx GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ex)
SELECT CAST(qid AS BIGINT) AS qid, CAST(doc_id AS BIGINT) AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM rk WHERE rank <= 5""", category="retrieval")
def q_maxsim_rerank(spark, sf):
    """V9 with rerank: ten candidates a query from its tokens' 20 nearest tokens each, the
    five best of them by exact MaxSim; every document is a query."""
    r = R.maxsim_rerank(*_token_tables(spark, sf), top_k=10, rerank_k=5)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("l2_normalize", sql=f"""
SELECT vec_id, round({EMB}[1] / CASE WHEN sqrt(list_sum(list_transform({EMB}, lambda x: x * x))) = 0 THEN 1
                                     ELSE sqrt(list_sum(list_transform({EMB}, lambda x: x * x))) END, 6) AS first,
       round(sqrt(list_sum(list_transform({EMB}, lambda x: x * x))), 6) AS norm
FROM embeddings""", category="retrieval")
def q_l2_normalize(spark, sf):
    """F16: normalised vectors (first component) and the original norm."""
    e = _emb(spark, sf)
    n = F.sqrt(R.dot(F.col("embedding"), F.col("embedding")))
    return e.select("vec_id", F.round(F.element_at(R.l2_normalize("embedding"), 1), 6).alias("first"),
                    F.round(n, 6).alias("norm"))


@query("batch_bucket", sql="""
WITH t AS (SELECT source, max(len(regexp_extract_all(text, '\\w+|[^\\w\\s]'))) AS m FROM documents GROUP BY source)
SELECT source, CAST(m AS INTEGER) AS max_tokens, CASE WHEN m > 4096 THEN 4 WHEN m > 2048 THEN 8 WHEN m > 1024 THEN 16
                                     WHEN m > 512 THEN 32 ELSE 64 END AS batch_size FROM t""", category="retrieval")
def q_batch_bucket(spark, sf):
    """Encoder batch size per source from its longest document."""
    d = read_table(spark, sf, "documents", ["source", "text"])
    t = d.groupBy("source").agg(F.max(token_count("text")).alias("max_tokens"))
    return t.select("source", "max_tokens", R.batch_bucket("max_tokens").alias("batch_size"))


TABLE_DOCS = O.FILES + """,
corp AS (SELECT path AS id0, 'Table Name: ' || regexp_extract(path, '([^/]*)$', 1) || chr(10) || 'Table Path: ' || path
                || chr(10) || 'Table Content Preview:' || chr(10) || array_to_string(list_slice(lines, 1, 5), chr(10)) AS text
         FROM files)"""


@query("select_tables", sql="WITH " + _tfidf_sql(
    TABLE_DOCS.replace("corp AS (SELECT path AS id0,", "corp0 AS (SELECT path AS id0,")
    + ", corp AS (SELECT CAST(split_part(id0, '/', 2) AS BIGINT) AS id, text FROM corp0)",
    "qs AS (SELECT item_id AS qid, text FROM benchmark)", 3).replace("SELECT qid, id, round", "SELECT qid, id, round", 1),
       category="retrieval")
def q_select_tables(spark, sf):
    """V5 + J13: top-3 tables per benchmark item by preview document."""
    docs = C.table_documents(v_file_lines(spark, sf))
    corpus = docs.select(F.split("path", "/").getItem(1).cast("long").alias("id"), "text")
    return _tfidf(corpus, _benchmark_queries(spark, sf), 3)


ROW_Q = "qs AS (SELECT DENSE_RANK() OVER (ORDER BY p_brand) AS qid, 'parts of ' || p_brand AS text FROM (SELECT DISTINCT p_brand FROM part))"


@query("retrieve_rows", sql="WITH " + _tfidf_sql(
    O.ROW_LINES + """,
h AS (SELECT path, string_split(line, ',') AS hs FROM pl WHERE line_no = 1),
corp AS (SELECT CAST(split_part(string_split(r.line, ',')[1], ',', 1) AS BIGINT) AS id,
                'Table path: ' || r.path || chr(10) || array_to_string(
                  list_transform(range(1, least(len(h.hs), len(string_split(r.line, ','))) + 1),
                                 lambda i: h.hs[i] || ': ' || string_split(r.line, ',')[i]), ' | ') AS text
         FROM pl r JOIN h USING (path) WHERE r.line_no >= 2)""", ROW_Q, 5), category="retrieval")
def q_retrieve_rows(spark, sf):
    """V6: top-5 part rows per brand query by row document."""
    docs = C.row_documents(_row_lines(spark, sf))
    corpus = docs.select(F.regexp_extract("text", r"p_partkey: (\d+)", 1).cast("long").alias("id"), "text")
    p = read_table(spark, sf, "part", ["p_brand"]).distinct()
    from pyspark.sql import Window
    qs = p.select(F.dense_rank().over(Window.orderBy("p_brand")).cast("long").alias("qid"),
                  F.concat(F.lit("parts of "), F.col("p_brand")).alias("text"))
    return _tfidf(corpus, qs, 5)


@query("retrieve_columns", sql="WITH " + _tfidf_sql(
    O.ROW_LINES + """,
head AS (SELECT path, unnest(string_split(line, ',')) AS col, generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no = 1),
data AS (SELECT path, line_no, unnest(string_split(line, ',')) AS v, generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no BETWEEN 2 AND 6),
samp AS (SELECT path, col_no, list_slice(list(v ORDER BY line_no), 1, 5) AS vals FROM data
         WHERE regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL),
corp AS (SELECT CAST(row_number() OVER (ORDER BY h.path, h.col_no) AS BIGINT) AS id,
                'Table path: ' || h.path || ' | Column name: ' || h.col || ' | Sample values: '
                || array_to_string(coalesce(s.vals, []), ', ') AS text
         FROM head h LEFT JOIN samp s USING (path, col_no))""", ROW_Q, 3), category="retrieval")
def q_retrieve_columns(spark, sf):
    """V7: top-3 columns per brand query by column document."""
    from pyspark.sql import Window
    prof = C.column_profile(_row_lines(spark, sf))
    corpus = prof.select(F.row_number().over(Window.orderBy("path", "col_no")).cast("long").alias("id"), "text")
    p = read_table(spark, sf, "part", ["p_brand"]).distinct()
    qs = p.select(F.dense_rank().over(Window.orderBy("p_brand")).cast("long").alias("qid"),
                  F.concat(F.lit("parts of "), F.col("p_brand")).alias("text"))
    return _tfidf(corpus, qs, 3)


@query("hits_by_table", sql="WITH " + _tfidf_sql(
    O.ROW_LINES + """,
h AS (SELECT path, string_split(line, ',') AS hs FROM pl WHERE line_no = 1),
corp AS (SELECT CAST(string_split(r.line, ',')[1] AS BIGINT) AS id,
                'Table path: ' || r.path || chr(10) || array_to_string(
                  list_transform(range(1, least(len(h.hs), len(string_split(r.line, ','))) + 1),
                                 lambda i: h.hs[i] || ': ' || string_split(r.line, ',')[i]), ' | ') AS text
         FROM pl r JOIN h USING (path) WHERE r.line_no >= 2)""", ROW_Q, 5).replace(
    "SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 5",
    """SELECT rk.qid, 'part/' || lower(p.p_type) || '.csv' AS path, round(max(rk.score), 6) AS best_score, count(*) AS n_hits
FROM rk JOIN part p ON p.p_partkey = rk.id WHERE rk.rank <= 5 GROUP BY ALL"""), category="retrieval")
def q_hits_by_table(spark, sf):
    """A14 + J13: row hits looked up to their table and grouped per table."""
    docs = C.row_documents(_row_lines(spark, sf))
    corpus = docs.select(F.regexp_extract("text", r"p_partkey: (\d+)", 1).cast("long").alias("id"), "text")
    p = read_table(spark, sf, "part", ["p_brand"]).distinct()
    from pyspark.sql import Window
    qs = p.select(F.dense_rank().over(Window.orderBy("p_brand")).cast("long").alias("qid"),
                  F.concat(F.lit("parts of "), F.col("p_brand")).alias("text"))
    vocab = R.tfidf_fit(corpus, "id", "text")
    hits = R.sparse_topk(R.tfidf_vectors(corpus, vocab, "id", "text"),
                         R.tfidf_vectors(qs.withColumnRenamed("qid", "id"), vocab, "id", "text")
                         .withColumnRenamed("id", "qid"), 5, R.TFIDF_MAX_FEATURES)
    meta = read_table(spark, sf, "part", ["p_partkey", "p_type"]).select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("part/"), F.lower("p_type"), F.lit(".csv")).alias("path"))
    looked = R.hit_lookup(hits, meta)
    g = R.hits_by_table(looked.withColumn("item", F.col("id")))
    return g.select("qid", "path", F.round("best_score", 6).alias("best_score"), "n_hits")


@query("chunk_blocks")
def q_chunk_blocks(spark, sf):
    """V8: greedy 512-token blocks per document (2 header lines, 1-line overlap)."""
    return R.chunk_blocks(v_file_lines(spark, sf))


@query("fixed_chunks", sql=f"""
WITH {O.LINES}
SELECT path, line_no, CAST(floor((line_no - 1) / 200) + 1 AS INTEGER) AS chunk_no FROM lines""", category="retrieval")
def q_fixed_chunks(spark, sf):
    """V8 (parser form): 200-line chunks."""
    from quarry.plans.fixtures import v_lines
    return R.fixed_chunks(v_lines(spark, sf)).select("path", "line_no", "chunk_no")


def _all_against_all(spark, sf):
    e = _emb(spark, sf)
    return (e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")),
            e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")))


@query("ivf_search")
def q_ivf_search(spark, sf):
    """V3: IVF (KMeans lists) top-10, every vector being a query."""
    return R.ivf_search(*_all_against_all(spark, sf), 10)


@query("lsh_search")
def q_lsh_search(spark, sf):
    """V4: LSH top-10, every vector being a query."""
    return R.lsh_search(*_all_against_all(spark, sf), 10)


@query("dense_search", sql=_dense_sql("true", 5), category="retrieval")
def q_dense_search(spark, sf):
    """Dense retrieval, query × corpus inner products fused into a
    blocked top-5 (the score matrix is never materialised)."""
    return _dense(spark, sf, F.lit(True), 5)


@query("hit_lookup", sql=f"""
WITH q AS (SELECT vec_id AS qid, {EMB} AS qv FROM embeddings),
sc AS (SELECT q.qid, e.vec_id AS id, list_inner_product(q.qv, {EMB}) AS score FROM q, embeddings e),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT rk.qid, rk.id, CAST(rk.rank AS INTEGER) AS rank, e.label FROM rk JOIN embeddings e ON e.vec_id = rk.id
WHERE rk.rank <= 10""", category="retrieval")
def q_hit_lookup(spark, sf):
    """Top-10 hits joined to their metadata after the ranking."""
    hits = _dense(spark, sf, F.lit(True), 10).select("qid", "id", "rank")
    meta = _emb(spark, sf).select(F.col("vec_id").alias("id"), "label")
    return R.hit_lookup(hits, meta)


@query("query_corpus_scores", sql=_dense_sql("true", 20), category="retrieval")
def q_query_corpus_scores(spark, sf):
    """Inner products of every vector with the corpus, the 20 best of each."""
    hits = R.query_corpus_scores(*_all_against_all(spark, sf), 20)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("column_document", sql=f"""
WITH {O.ROW_LINES},
head AS (SELECT path, unnest(string_split(line, ',')) AS "column", generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no = 1),
data AS (SELECT path, line_no, unnest(string_split(line, ',')) AS v, generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no BETWEEN 2 AND 6),
samp AS (SELECT path, col_no, list_slice(list(v ORDER BY line_no), 1, 5) AS vals FROM data
         WHERE regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL)
SELECT h.path, CAST(h.col_no AS INTEGER) AS col_no,
       'Table path: ' || h.path || ' | Column name: ' || h."column" || ' | Sample values: '
         || array_to_string(coalesce(s.vals, []), ', ') AS text
FROM head h LEFT JOIN samp s USING (path, col_no)""", category="retrieval")
def q_column_document(spark, sf):
    """one retrieval document per column."""
    return C.column_profile(_row_lines(spark, sf)).select("path", "col_no", "text")


@query("encoder_hook")
def q_encoder_hook(spark, sf):
    """The default encoder (iterator pandas UDF) over benchmark texts."""
    b = read_table(spark, sf, "benchmark", ["item_id", "text"])
    enc = R.hashing_encoder()
    return b.select("item_id", enc(F.col("text")).alias("embedding"))


@query("embedding_store", sql="""
SELECT count(*) AS n_vectors, count(DISTINCT text) AS n_texts FROM (SELECT DISTINCT text FROM documents)""",
       category="retrieval")
def q_embedding_store(spark, sf):
    """Distinct document texts encoded once and appended to a Parquet
    store in the shared folder, then read back."""
    import uuid
    from quarry.session import checkpoint_dir
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    vec = R.embed_distinct(d, None).select(F.xxhash64("text").alias("text_hash"), "text", "embedding") \
        .dropDuplicates(["text_hash", "text"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/derived/store-{uuid.uuid4().hex[:12]}"
    store = R.embedding_store_append(vec, path)
    return store.agg(F.count("*").alias("n_vectors"), F.count_distinct("text").alias("n_texts"))
