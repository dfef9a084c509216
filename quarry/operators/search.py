"""Retrieval: TF-IDF and dense top-k, multi-vector MaxSim, IVF and LSH
approximations, chunking, the encoder hook (V1–V10, L1, L2, J7, J11, J13,
A14, A16, F16, X4).

Exact top-k runs numpy products of at most ``QUERIES_PER_BLOCK`` queries and
``STEP`` corpus rows and keeps a running top-k, so a score matrix is bounded
and only k rows a query leave a task.  Queries that fit one block (counted)
travel to the corpus, which then stays where it is; otherwise both sides are
stored once in blocks of ``ROWS_PER_BLOCK`` rows, and each task reads a part of the
corpus block by block beside one block of queries (a Cartesian product of blocks).
So nothing is sent once a pair of blocks, and only k rows a query and part
leave a task.  A final ``row_number() <= k`` (WindowGroupLimit) picks the winners.
IVF and LSH do alike; in a pair of blocks each list's or bucket's members meet the
queries that probe it in one product, so that no query x document pair is a
row before it is among the k best of its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import token_count
from quarry.session import cut_lineage, ship_package

# fixed values: the TF-IDF settings being mirrored
TFIDF_MAX_FEATURES = 512
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
# fixed values: encoder batch sizes by the longest text (tokens)
BATCH_LADDER = [(4096, 4), (2048, 8), (1024, 16), (512, 32)]
DEFAULT_BATCH = 64


def l2_normalize(v) -> Column:
    """F16: v / ||v|| (norm 0 → 1), in DOUBLE."""
    c = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    n = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(c, lambda x: x.cast("double") / n)


def dot(a, b) -> Column:
    """F16: inner product of two equal-length arrays (DOUBLE)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def batch_bucket(max_tokens) -> Column:
    """Encoder batch size for a group whose longest text has ``max_tokens``."""
    m = F.col(max_tokens) if isinstance(max_tokens, str) else max_tokens
    out = F.lit(DEFAULT_BATCH)
    for limit, size in reversed(BATCH_LADDER):
        out = F.when(m > limit, F.lit(size)).otherwise(out)
    return out


# ------------------------------------------------------------------ dense
# bounds on what one task holds: queries and corpus rows of a block, corpus rows of a product
QUERIES_PER_BLOCK = 1_000
ROWS_PER_BLOCK = 20_000
STEP = 2_000
# numbers in a block, which make its rows fewer where they are wide
BLOCK_CELLS = 4_000_000
# blocks of a side where rows are enough, and tasks, so that all cores have some
LEAST_BLOCKS, LEAST_TASKS = 8, 64


class RunningTopK:
    """The k best (score desc, id asc) of each query over pieces of a corpus."""

    #: No entry yet; an entry without an id, which is after the others.
    NONE, NULL = np.iinfo(np.int64).max, np.iinfo(np.int64).max - 1

    def __init__(self, qids: np.ndarray, k: int, digits: int = 9):
        self.qids, self.k, self.digits = np.asarray(qids), k, digits
        self._ids = np.full((len(self.qids), k), self.NONE)
        self._scores = np.full((len(self.qids), k), -np.inf)

    @property
    def ids(self) -> list[np.ndarray]:
        return [row[row != self.NONE] for row in self._ids]

    def add(self, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray | None = None, distinct: bool = False) -> None:
        """``scores[i, j]``: of query i (of query ``rows[i]``) and corpus row ``ids[j]``.
        ``distinct``: a pair may come again and counts once."""
        at = np.arange(len(self.qids)) if rows is None else rows
        if ids.dtype.kind == "f":  # some are null
            known = ~np.isnan(ids)
            whole = np.full(len(ids), self.NULL)
            whole[known] = ids[known].astype(np.int64)
            ids = whole
        # rows under the k-th best can't stay; equal ones, once rounded, may by their id
        low = self._scores[at, -1] - 10.0 ** -self.digits
        if scores.shape[1] > self.k and len(first := np.flatnonzero(low == -np.inf)):
            low[first] = np.partition(scores[first], -self.k, axis=1)[:, -self.k] - 10.0 ** -self.digits
        i, j = np.divmod(np.flatnonzero(scores >= low[:, None]), max(1, scores.shape[1]))
        if not len(i):
            return
        held = np.unique(at[i])
        query = np.r_[np.repeat(held, self.k), at[i]]
        found, value = np.r_[self._ids[held].ravel(), ids[j]], np.r_[self._scores[held].ravel(), scores[i, j]]
        some = found != self.NONE
        query, found, value = query[some], found[some], value[some]
        if distinct:
            order = np.lexsort((-value, found, query))
            query, found, value = query[order], found[order], value[order]
            new = np.r_[True, (query[1:] != query[:-1]) | (found[1:] != found[:-1])]
            query, found, value = query[new], found[new], value[new]
        order = np.lexsort((found, -np.round(value, self.digits), query))
        query, found, value = query[order], found[order], value[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        best = place < self.k
        self._ids[query[best], place[best]], self._scores[query[best], place[best]] = found[best], value[best]

    def frame(self, id_col: str = "id") -> pd.DataFrame:
        some = self._ids != self.NONE
        ids = self._ids[some]
        if (ids == self.NULL).any():
            ids = pd.array(ids, dtype="Int64")
            ids[ids == self.NULL] = pd.NA
        return pd.DataFrame({"qid": np.repeat(self.qids, some.sum(axis=1)), id_col: ids, "score": self._scores[some]})


def _ranked(cand: DataFrame, k: int, id_col: str = "id", digits: int = 9) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), F.asc(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pieces(n: int, per: int) -> int:
    return max(1, -(-n // per))


def _sides(n: int, other: int, dim: int = 1) -> tuple[int, int]:
    """Blocks of two sides that all meet: of ``ROWS_PER_BLOCK`` rows, fewer of wide rows;
    smaller ones where those make few tasks."""
    per = max(1, min(ROWS_PER_BLOCK, BLOCK_CELLS // max(1, dim)))
    few = lambda m: max(_pieces(m, per), min(LEAST_BLOCKS, _pieces(m, QUERIES_PER_BLOCK)))
    return few(n), few(other)


def _dim(df: DataFrame, col: str) -> int:
    """Length of some vector of the column."""
    row = df.select(F.size(col)).first()
    return row[0] if row else 1


def _blocks(df: DataFrame, key: str, n: int, files: int) -> DataFrame:
    """``df`` dealt by ``key`` into n blocks and stored: (_b, rows), the rows as one Arrow stream."""

    def pack(block: pa.Table) -> pa.Table:
        part, out = block.drop_columns(["_b"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, part.schema) as stream:
            stream.write_table(part)
        return pa.table({"_b": block.column("_b")[:1], "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    packed = dealt.groupBy("_b").applyInArrow(pack, "_b int, rows binary")
    return cut_lineage(packed.repartitionById(files, F.pmod("_b", F.lit(files)).cast("int")), "blocks")


def _met(corpus: DataFrame, queries: DataFrame, cid: str, qid: str, sides: tuple[int, int], begin, schema: str) -> DataFrame:
    """Every block of the corpus beside every block of queries.  ``begin(queries)`` gives two
    functions: one takes the blocks of a part of the corpus in turn, one returns what was found."""
    cb, qb = sides
    parts = min(cb, _pieces(LEAST_TASKS, qb))
    c = _blocks(corpus, cid, cb, parts).select(F.col("_b").alias("_cb"), F.col("rows").alias("_c"))
    q = _blocks(queries, qid, qb, qb).select(F.col("_b").alias("_qb"), F.col("rows").alias("_q"))
    # the left side is read row by row, a block of the right side is held
    pairs = c.hint("shuffle_replicate_nl").crossJoin(q.repartitionById(qb, "_qb"))
    names = [f.split()[0] for f in schema.split(", ")]
    types = pa.schema([(n, pa.float64() if n == "score" else pa.int64()) for n in names])

    def rows(cell) -> pd.DataFrame:
        return pa.ipc.open_stream(cell.as_buffer()).read_all().to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, at, part = {}, None, None
        for batch in batches:
            blocks = batch.column("_cb").to_pylist(), batch.column("_qb").to_pylist()
            for i, (block, query) in enumerate(zip(*blocks, strict=True)):
                if block != at:
                    at, part = block, rows(batch.column("_c")[i])
                if query not in asked:
                    asked[query] = begin(rows(batch.column("_q")[i]))
                asked[query][0](part)
        for _, found in asked.values():
            yield pa.RecordBatch.from_pandas(found()[names], types, preserve_index=False)

    return pairs.mapInArrow(run, schema)


def _topk(corpus: DataFrame, queries: DataFrame, k: int, corpus_matrix, digits: int = 9) -> DataFrame:
    """Top-k of ``corpus(id, …)`` for ``queries(qid, qvec)``; ``corpus_matrix``
    turns corpus rows into a matrix."""
    ship_package(corpus.sparkSession)
    schema, nq = "qid long, id long, score double", queries.count()

    def begin(qdf: pd.DataFrame):
        parts = [qdf.iloc[i:i + QUERIES_PER_BLOCK] for i in range(0, len(qdf), QUERIES_PER_BLOCK)]
        best = [(RunningTopK(p["qid"].to_numpy(), k, digits), np.vstack(p["qvec"].to_numpy()).astype(np.float64)) for p in parts]

        def add(cdf: pd.DataFrame) -> None:
            for i in range(0, len(cdf), STEP):
                part = cdf.iloc[i:i + STEP]
                ids, m = part["id"].to_numpy(), corpus_matrix(part).T
                for top, qm in best:
                    top.add(ids, qm @ m)

        return add, lambda: pd.concat([top.frame() for top, _ in best])

    if nq <= QUERIES_PER_BLOCK:
        qdf = queries.toPandas()

        def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if len(qdf):
                add, found = begin(qdf)
                for cdf in frames:
                    add(cdf)
                yield found()

        return _ranked(corpus.mapInPandas(local, schema), k, digits=digits)
    sides = _sides(corpus.count(), nq, _dim(queries, "qvec"))
    return _ranked(_met(corpus, queries, "id", "qid", sides, begin, schema), k, digits=digits)


def _vector(df: DataFrame, col: str):
    """The column as a vector: floats are sent as floats and widened where they are multiplied."""
    return F.col(col) if df.schema[col].dataType.simpleString() == "array<float>" else F.col(col).cast("array<double>")


def _dense_matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.vstack(rows["vec"].to_numpy()).astype(np.float64)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec",
               qid_col: str = "qid", qvec_col: str = "qvec", score_digits: int = 9) -> DataFrame:
    """Top-k corpus rows per query by inner product.

    Ties: score (rounded to ``score_digits``) desc, then id asc.  Output
    ``(qid, id, score, rank)``.
    """
    c = corpus.select(F.col(id_col).cast("long").alias("id"), _vector(corpus, vec_col).alias("vec"))
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), _vector(queries, qvec_col).alias("qvec"))
    return _topk(c, q, k, _dense_matrix, score_digits)


def maxsim(doc_tokens: DataFrame, query_tokens: DataFrame, k: int) -> DataFrame:
    """V9: late interaction — Σ over query tokens of max dot over the
    document's tokens; top-k documents per query.

    ``doc_tokens(doc_id, vec)``, ``query_tokens(qid, qtok, qvec)``.  All tokens
    of a document (as many as its encoder reads) and of a query hash to one
    block, so a block's sums are final and only k rows a query leave it.
    """
    ship_package(doc_tokens.sparkSession)
    c = doc_tokens.select(F.col("doc_id").cast("long").alias("doc_id"), _vector(doc_tokens, "vec").alias("vec"))
    q = query_tokens.select(F.col("qid").cast("long").alias("qid"), F.col("qtok").cast("long").alias("qtok"),
                            _vector(query_tokens, "qvec").alias("qvec"))

    def begin(qdf: pd.DataFrame):
        qdf = qdf.sort_values("qid", kind="stable")
        qids, q_start = np.unique(qdf["qid"].to_numpy(), return_index=True)
        qm = np.vstack(qdf["qvec"].to_numpy()).astype(np.float64)
        asked, i = [], 0
        while i < len(qids):  # whole queries, some QUERIES_PER_BLOCK tokens at a time
            j = max(i + 1, int(np.searchsorted(q_start, q_start[i] + QUERIES_PER_BLOCK)))
            end = q_start[j] if j < len(qids) else len(qm)
            asked.append((RunningTopK(qids[i:j], k), qm[q_start[i]:end], q_start[i:j] - q_start[i]))
            i = j

        def add(cdf: pd.DataFrame) -> None:
            cdf = cdf.sort_values("doc_id", kind="stable")
            ids = cdf["doc_id"].to_numpy()
            docs, starts = np.unique(ids, return_index=True)
            i = 0
            while i < len(docs):  # whole documents, some STEP tokens at a time
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP)))
                end = starts[j] if j < len(docs) else len(ids)
                tokens = _dense_matrix(cdf.iloc[starts[i]:end]).T
                for best, rows, first in asked:
                    per_doc = np.maximum.reduceat(rows @ tokens, starts[i:j] - starts[i], axis=1)
                    best.add(docs[i:j], np.add.reduceat(per_doc, first, axis=0))
                i = j

        return add, lambda: pd.concat([best.frame("doc_id") for best, _, _ in asked])

    sides = _sides(c.count(), q.count(), _dim(q, "qvec"))
    scores = _met(c, q, "doc_id", "qid", sides, begin, "qid long, doc_id long, score double")
    return _ranked(scores, k, "doc_id")


def maxsim_rerank(doc_tokens: DataFrame, query_tokens: DataFrame, top_k: int, rerank_k: int, near: int = 20) -> DataFrame:
    """V9 with rerank: candidates from single tokens, then their exact order.

    ``doc_tokens(doc_id, tok, vec)``, ``query_tokens(qid, qtok, qvec)``; ``tok`` and
    ``qtok`` are unique.  Each query token finds its ``near`` nearest document tokens; a
    document's first score is the sum, over query tokens, of its best found token.  The
    ``top_k`` documents by that are scored again on all of their tokens, and
    ``rerank_k`` remain.  Output ``(qid, doc_id, score, rank)``."""
    found = dense_topk(doc_tokens, query_tokens, near, "tok", "vec", "qtok", "qvec")
    best = (found.select(F.col("qid").alias("qtok"), F.col("id").alias("tok"), "score")
            .join(doc_tokens.select("tok", "doc_id"), "tok").join(query_tokens.select("qtok", "qid"), "qtok")
            .groupBy("qid", "doc_id", "qtok").agg(F.max("score").alias("score")))
    first = _ranked(best.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), top_k, "doc_id")
    # the tokens of a document or query: as many as its encoder reads
    docs = doc_tokens.groupBy("doc_id").agg(F.collect_list("vec").alias("vecs"))
    queries = query_tokens.groupBy("qid").agg(F.collect_list("qvec").alias("qvecs"))
    exact = F.aggregate(F.transform("qvecs", lambda q: F.array_max(F.transform("vecs", lambda v: dot(q, v)))),
                        F.lit(0.0), lambda acc, x: acc + x)
    pairs = first.select("qid", "doc_id").join(docs, "doc_id").join(queries, "qid")
    return _ranked(pairs.select("qid", "doc_id", exact.alias("score")), rerank_k, "doc_id")


# ----------------------------------------------------------------- TF-IDF
def tfidf_fit(docs: DataFrame, id_col: str, text_col: str, max_features: int = TFIDF_MAX_FEATURES) -> dict[str, tuple[int, float]]:
    """V1 fit: vocabulary = top ``max_features`` terms by corpus count (ties:
    term), smooth idf ``ln((1+n)/(1+df)) + 1``.  Returns term -> (index, idf):
    at most ``max_features`` entries, a size fixed by the parameter.

    A document sends each word once as a count and each different word once as
    a document; both are summed before the shuffle, which carries terms only."""
    toks = docs.select(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_RE), 0).alias("t"))
    seen = toks.select(F.inline(F.concat(
        F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))))
    stats = seen.groupBy("term").agg(F.sum("tf").alias("cnt"), F.sum("df").alias("df"))
    top = stats.orderBy(F.desc("cnt"), F.asc("term")).limit(max_features).collect()
    n = docs.count()
    return {r["term"]: (i, float(np.log((1 + n) / (1 + r["df"])) + 1)) for i, r in enumerate(top)}


def tfidf_vectors(docs: DataFrame, vocab: dict[str, tuple[int, float]], id_col: str, text_col: str) -> DataFrame:
    """V1 transform: L2-normalised sparse vectors ``(id, idx ARRAY<INT>, w ARRAY<DOUBLE>)``,
    document by document against the bounded vocabulary: nothing is shuffled.
    Texts with no vocabulary term keep an empty vector."""
    out = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(out)
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re
        import regex
        from collections import Counter
        words, plain, known = regex.compile(TOKEN_RE).findall, re.compile("[a-z0-9_]{2,}").findall, vocab.__contains__
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                tf = Counter(filter(known, plain(t) if t.isascii() else words(t)))  # lower-cased: the same words
                e = sorted((vocab[w][0], n * vocab[w][1]) for w, n in tf.items())
                norm = float(np.sqrt(sum(w * w for _, w in e)))
                rows.append(([i for i, _ in e], [w / norm for _, w in e]))
            yield pd.DataFrame(rows, columns=["idx", "w"])

    return docs.select(F.col(id_col).alias("id"), vector(F.lower(F.col(text_col))).alias("v")).select("id", "v.idx", "v.w")


def _sparse_matrix(dim: int):
    def dense(rows: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(rows), dim))
        for r, (i, w) in enumerate(zip(rows["idx"], rows["w"], strict=True)):
            m[r, np.asarray(i, dtype=np.int64)] = w
        return m
    return dense


def sparse_topk(corpus: DataFrame, queries: DataFrame, k: int, dim: int, score_digits: int = 9) -> DataFrame:
    """Top-k for sparse ``(id, idx, w)`` corpus / ``(qid, idx, w)`` queries:
    rows are made dense a piece at a time (``dim`` is the vocabulary size)."""
    c = corpus.select(F.col("id").cast("long").alias("id"), "idx", "w")
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.get("w", (F.array_position("idx", i) - 1).cast("int")), F.lit(0.0)))
    q = queries.select(F.col("qid").cast("long").alias("qid"), full.alias("qvec"))
    return _topk(c, q, k, _sparse_matrix(dim), score_digits)


# --------------------------------------------------------------- IVF / LSH
# vectors that the list centres are fitted on
IVF_SAMPLE = 100_000


def _rows_by_key(keys: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the rows that have it, of lists of keys or of bitmaps (``_bitmap``)."""
    if isinstance(keys.iloc[0], bytes):
        has = np.unpackbits(np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1), axis=1, bitorder="little")
        has = np.asfortranarray(has)
        for key in range(has.shape[1]):
            yield key, np.flatnonzero(has[:, key])
        return
    flat = np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    for i, j in zip(start, [*start[1:], len(flat)], strict=True):
        yield int(flat[i]), of[i:j]


def _probed_topk(members: DataFrame, queries: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """The k best ``(qid, id, score)`` of each query by blocks of the corpus: ``members(keys, id,
    vec)`` are the rows and the lists that hold them, ``queries(keys, qid, qvec)`` with the
    lists that they probe.  Rows of both sides are dealt by their ids into blocks of bounded size,
    where each list's members meet the queries that probe it; so a vector is sent once,
    however many lists are probed, and a full list is in many tasks."""
    ship_package(members.sparkSession)

    def begin(pdf: pd.DataFrame):
        best, qm = RunningTopK(pdf["qid"].to_numpy(), k), np.vstack(pdf["qvec"].to_numpy()).astype(np.float64)

        def add(mdf: pd.DataFrame) -> None:
            ids, mm = mdf["id"].to_numpy(), _dense_matrix(mdf)
            lists = dict(_rows_by_key(mdf["keys"]))
            for key, asked in _rows_by_key(pdf["keys"]):
                found = lists.get(key)
                if found is None or not len(asked):
                    continue
                wide = max(1, QUERIES_PER_BLOCK * STEP // min(len(found), STEP))
                for i in range(0, len(found), STEP):
                    part = mm[found[i:i + STEP]].T
                    for j in range(0, len(asked), wide):
                        rows = asked[j:j + wide]
                        best.add(ids[found[i:i + STEP]], qm[rows] @ part, rows, distinct)

        return add, best.frame

    sides = _sides(members.count(), queries.count(), _dim(queries, "qvec"))
    return _met(members, queries, "id", "qid", sides, begin, "qid long, id long, score double")


def _listed_topk(members: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """``_probed_topk`` of single ``members(key, id, vec)`` and ``probes(key, qid, qvec)``."""
    return _probed_topk(members.select(F.array("key").alias("keys"), "id", "vec"),
                        probes.groupBy("qid").agg(F.collect_set("key").alias("keys"), F.first("qvec").alias("qvec")), k)


def _nearest_lists(centres: np.ndarray, nprobe: int):
    """Column function: a query vector -> bitmap of the centres nearest to it (inner product, then number)."""
    @F.pandas_udf(T.BinaryType())
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for i in range(0, len(s), STEP):
                scores = np.vstack(s.iloc[i:i + STEP].to_numpy()).astype(np.float64) @ centres.T
                order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :nprobe]
                has = np.zeros(scores.shape, np.uint8)
                np.put_along_axis(has, order, 1, axis=1)
                out += [x.tobytes() for x in np.packbits(has, axis=1, bitorder="little")]
            yield pd.Series(out, dtype=object)
    return near


def _ivf(corpus: DataFrame, queries: DataFrame, seed: int, nlist: int | None) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """(members, queries, centres, number of lists asked for) of V3; queries without a qid find nothing."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ship_package(corpus.sparkSession)
    n = corpus.count()
    nl = nlist or max(1, int(n ** 0.5))
    c = corpus.select(F.col("id").cast("long").alias("id"), _vector(corpus, "vec").alias("vec"))
    f = c.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n or 1)) < IVF_SAMPLE
    model = KMeans(k=nl, seed=seed, featuresCol="features", predictionCol="key").fit(f.where(part))
    centres = np.array([[float(x) for x in v] for v in model.clusterCenters()])
    q = queries.select(F.col("qid").cast("long").alias("qid"), _vector(queries, "qvec").alias("qvec")).where("qid is not null")
    return model.transform(f).select(F.array(F.col("key").cast("int")).alias("keys"), "id", "vec"), q, centres, nl


def _probes(queries: DataFrame, centres: np.ndarray, nprobe: int | None, nl: int) -> list[DataFrame]:
    """(keys, qid, qvec) of the queries as ``_probed_topk`` takes them, ``nprobe`` lists a qid: rows that
    share a qid share its lists, those of all its rows."""
    nprobe = nprobe or max(5, -(-2 * nl // 3))
    near = _nearest_lists(centres, nprobe)
    again = queries.groupBy("qid").count().where("count > 1").select("qid")
    if again.isEmpty():
        return [queries.select(near("qvec").alias("keys"), "qid", "qvec")]
    once, more = queries.join(again, "qid", "left_anti"), queries.join(again, "qid", "left_semi")
    cent = queries.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "id long, vec array<double>")
    lists = dense_topk(cent, more, nprobe).groupBy("qid").agg(F.collect_list("id").alias("keys"))
    return [once.select(near("qvec").alias("keys"), "qid", "qvec"), more.join(lists, "qid").select("keys", "qid", "qvec")]


def ivf_lists(corpus: DataFrame, queries: DataFrame, nprobe: int | None = None, seed: int = 42,
              nlist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, probes) of V3: every vector's list, and the lists each query probes."""
    members, q, centres, nl = _ivf(corpus, queries, seed, nlist)
    first, *more = _probes(q, centres, nprobe, nl)
    byte = F.conv(F.hex(F.substring("keys", F.floor(F.col("key") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    every = first.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(centres) - 1).cast("long"))))
    probes = every.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("key") % 8).cast("int")) != 0).select("key", "qid", "qvec")
    for m in more:
        probes = probes.union(m.select(F.explode("keys").alias("key"), "qid", "qvec"))
    return members.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "id", "vec"), probes


def ivf_search(corpus: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None, seed: int = 42,
               nlist: int | None = None) -> DataFrame:
    """V3: inverted lists from KMeans (fixed seed, fitted on a bounded sample);
    each query probes its ``nprobe`` nearest lists, whose members are scored
    exactly, a block at a time.  ``nlist`` grows with the root of the corpus, two
    thirds of the lists are probed by default (recall of 0.9 even on vectors without
    any clusters); every vector is in a list."""
    members, q, centres, nl = _ivf(corpus, queries, seed, nlist)
    found = [_probed_topk(members, asked, k) for asked in _probes(q, centres, nprobe, nl)]
    return _ranked(reduce(DataFrame.union, found), k)


def lsh_keys(dim: int, bits: int, tables: int, probes: int, seed: int):
    """Column function: a vector -> bucket keys, ``probes`` of each table.  A table's key
    is the sides of ``bits`` random planes; further probes cross the planes that the
    vector is nearest to, up to three at once, by the smallest sum of squared distances."""
    from itertools import combinations

    nearest = min(bits, 7)
    flips = [c for r in range(min(3, nearest) + 1) for c in combinations(range(nearest), r)]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(seed).normal(size=(tables, dim, bits))
        for s in batches:
            if s.empty:
                yield pd.Series([], dtype=object)
                continue
            m, out = np.vstack(s.to_numpy()).astype(np.float64), []
            for t in range(tables):
                y = m @ planes[t]
                code = ((y > 0) << np.arange(bits)).sum(axis=1)
                order = np.argsort(np.abs(y), axis=1, kind="stable")[:, :nearest]
                far = np.take_along_axis(y * y, order, axis=1)
                cost = np.stack([far[:, list(c)].sum(axis=1) for c in flips], axis=1)
                mask = np.stack([(1 << order[:, list(c)]).sum(axis=1) for c in flips], axis=1)
                pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                out.append((t << bits) | (code[:, None] ^ np.take_along_axis(mask, pick, axis=1)))
            yield pd.Series(list(np.concatenate(out, axis=1)))
    return keys


def _lsh(corpus: DataFrame, queries: DataFrame, bits: int, tables: int, probes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(members, queries) of V4 as ``_probed_topk`` takes them.  Vectors are normalised."""
    ship_package(corpus.sparkSession)
    c = corpus.select(F.col("id").cast("long").alias("id"), l2_normalize("vec").alias("vec"))
    q = queries.select(F.col("qid").cast("long").alias("qid"), l2_normalize("qvec").alias("qvec"))
    one = c.select(F.size("vec").alias("dim")).first()
    dim = one["dim"] if one else 1
    own, around = lsh_keys(dim, bits, tables, 1, seed), lsh_keys(dim, bits, tables, probes, seed)
    small = "array<int>" if tables << bits < 1 << 31 else "array<long>"
    return (c.select(own("vec").cast(small).alias("keys"), "id", "vec"), q.select(around("qvec").cast(small).alias("keys"), "qid", "qvec"))


def lsh_buckets(corpus: DataFrame, queries: DataFrame, bits: int = 8, tables: int = 44, probes: int = 4,
                seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members, probes) of V4: the bucket of every vector in each table, and the
    buckets each query probes."""
    c, q = _lsh(corpus, queries, bits, tables, probes, seed)
    return (c.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "id", "vec"), q.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "qid", "qvec"))


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int, bits: int = 8, tables: int = 44, probes: int = 4,
               seed: int = 42) -> DataFrame:
    """V4: multi-probe LSH on unit vectors, ranked by inner product.  A bucket is one
    side of each of ``bits`` planes; a query reads ``probes`` buckets of each table,
    whose members are scored exactly, a block at a time.  The defaults reach a recall
    of 0.9 on vectors without any clusters; where neighbours are near, more bits
    compare fewer pairs.  A pair met in several tables counts once."""
    met = _probed_topk(*_lsh(corpus, queries, bits, tables, probes, seed), k, distinct=True)
    return _ranked(met.groupBy("qid", "id").agg(F.max("score").alias("score")), k)


# ----------------------------------------------------------- encoder / V10
def hashing_encoder(dim: int = 64):
    """X4 default encoder: signed feature hashing of word tokens, L2-normed.

    An iterator pandas UDF: a real model would be loaded once per Python
    worker at the top of ``enc`` and applied batch by batch."""
    import zlib

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        tok = re.compile(r"\w\w+")
        for s in batches:
            out = []
            for t in s.fillna(""):
                v = np.zeros(dim, dtype=np.float32)
                for w in tok.findall(t.lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
                n = float(np.linalg.norm(v))
                out.append(v / n if n else v)
            yield pd.Series(out)
    return enc


def embed_distinct(texts: DataFrame, store: DataFrame | None, text_col: str = "text", encoder=None) -> DataFrame:
    """V10 + J7: encode each distinct text once (texts missing from the
    store), then map vectors back to every input row.

    Returns ``(…input…, embedding)``; the newly encoded rows are available
    as ``missing_embeddings(...)`` for an append to the store (S8/U3).
    """
    ship_package(texts.sparkSession)
    enc = encoder or hashing_encoder()
    d = texts.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).distinct()
    new = missing_embeddings(d, store)
    # group similar lengths together before the encoder (length-aware batching)
    new = new.repartitionByRange(F.length("text"), "text_hash").select("text_hash", "text", enc(F.col("text")).alias("embedding"))
    allv = new if store is None else store.select("text_hash", "text", "embedding").join(
        d.select("text_hash", "text"), ["text_hash", "text"]).unionByName(new)
    allv = allv.withColumnRenamed("text", "_etext")
    key = (F.xxhash64(texts[text_col]) == allv["text_hash"]) & (texts[text_col] == allv["_etext"])
    return texts.join(allv, key, "left").drop("text_hash", "_etext")


def missing_embeddings(distinct_texts: DataFrame, store: DataFrame | None) -> DataFrame:
    """Distinct texts not yet in the store (anti-join on hash + text)."""
    if store is None:
        return distinct_texts
    return distinct_texts.join(store.select("text_hash", "text"), ["text_hash", "text"], "left_anti")


# ------------------------------------------------------------ chunking V8
# fixed values: the text framing a block's header lines
BLOCK_HEADER_PREFIX = "Header data:\n"
BLOCK_HEADER_SUFFIX = "\n-------\nSpecific table data:\n"


def chunk_blocks(files: DataFrame, max_tokens: int = 512, header_lines: int = 2) -> DataFrame:
    """V8: greedy blocks per file.  The header text (first ``header_lines``
    lines, framed) is counted once; data lines are added while the running
    count stays within ``max_tokens``; when the next line would overflow a
    non-empty block, the block is closed and the next one starts with its
    last line (one line of overlap).  ``start_line`` is 1-based.

    The greedy pass is a fold over the file's own line array (files are
    independent, so this is a narrow per-row expression); token counts are
    staged as columns so the fold reads them instead of re-counting.
    """
    head = F.concat(F.lit(BLOCK_HEADER_PREFIX), F.array_join(F.slice("lines", 1, header_lines), "\n"),
                    F.lit(BLOCK_HEADER_SUFFIX))
    files = files.select("path", "lines", head.alias("_head"),
                         F.transform("lines", lambda l: token_count(l)).alias("_toks"))
    files = files.withColumn("_htok", token_count("_head"))
    n = F.size("lines")
    htok, toks = F.col("_htok"), F.col("_toks")
    init = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("blocks"),
                    F.lit(-1).alias("s"), htok.alias("t"))

    def step(acc, i):
        tk = F.element_at(toks, i)
        overflow = (acc["t"] + tk > max_tokens) & (acc["s"] >= 0)
        closed = F.concat(acc["blocks"], F.array(F.struct(acc["s"].alias("s"), (i - 1).alias("e"))))
        blocks = F.when(overflow, closed).otherwise(acc["blocks"])
        start = F.when(overflow, i - 1).when(acc["s"] < 0, i).otherwise(acc["s"])
        t = F.when(overflow, htok + F.element_at(toks, i - 1)).otherwise(acc["t"]) + tk
        return F.struct(blocks.alias("blocks"), start.cast("int").alias("s"), t.alias("t"))

    data_idx = F.filter(F.sequence(F.lit(header_lines + 1), F.greatest(n, F.lit(header_lines + 1))), lambda i: i <= n)
    folded = F.aggregate(data_idx, init, step)
    blocks = F.when(folded["s"] >= 0, F.concat(folded["blocks"], F.array(F.struct(
        folded["s"].alias("s"), n.alias("e"))))).otherwise(folded["blocks"])
    df = files.select("path", "lines", "_head", F.posexplode(blocks).alias("pos", "b"))
    body = F.slice("lines", F.col("b.s"), F.col("b.e") - F.col("b.s") + 1)
    return df.select("path", (F.col("pos") + 1).alias("block_no"), F.col("b.s").alias("start_line"),
                     F.col("b.e").alias("end_line"), F.concat("_head", F.array_join(body, "\n")).alias("text"))


def fixed_chunks(lines: DataFrame, size: int = 200) -> DataFrame:
    """V8 (parser form): fixed chunks of ``size`` data lines."""
    return lines.withColumn("chunk_no", (F.floor((F.col("line_no") - 1) / size) + 1).cast("int"))


# ----------------------------------------------------------- J13 / A14
def hit_lookup(hits: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Top-k hits (ids) → document metadata; joined after the limit so
    metadata never rides through the ranking."""
    return hits.join(docs, hits["id"] == docs[id_col]).drop(docs[id_col]) if id_col != "id" \
        else hits.join(docs, "id")


def hits_by_table(hits: DataFrame, table_col: str = "path", item_col: str = "item") -> DataFrame:
    """Hits grouped per table: best score, count, items by score."""
    return hits.groupBy("qid", table_col).agg(
        F.max("score").alias("best_score"), F.count("*").alias("n_hits"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("s"),
                                                         F.col(item_col).alias("i")))), lambda x: x["i"])
        .alias("items"))


def query_corpus_scores(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Inner products of a query set with the corpus, of which the k best
    of each query are kept (the score matrix exists one bounded piece at a time)."""
    return dense_topk(corpus, queries, k)


def embedding_store_append(vectors: DataFrame, path: str) -> DataFrame:
    """Append ``(text_hash, text, embedding)`` rows to the Parquet store
    and return the store; a reader keeps only rows whose hash and text
    agree (``missing_embeddings`` uses the same key)."""
    vectors.select("text_hash", "text", "embedding").write.mode("append").parquet(path)
    return vectors.sparkSession.read.parquet(path)
