"""Ground-truth samples and trace ↔ sample alignment.

Samples: ``(ord, task, answer, table_path ARRAY, design STRUCT<type,
checkout_list ARRAY<STRUCT<idx, info_item, answer, related_tables,
score_points>>>)`` — the complex (checklist) or the simple (answer) shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename, py_strip
from quarry.session import cut_lineage

STEP_T = "struct<idx:int,info_item:string,answer:string,related_tables:array<string>,score_points:array<string>>"
# texts with fewer words have no inner run of three words to block on
MIN_WORDS_FOR_BLOCKING = 5
# characters of short texts searched for in one pass
BLOCK_CHARS = 1_000_000


def usable(samples: DataFrame) -> Column:
    """A sample can be scored if it has a checklist or an answer."""
    return F.col("design.checkout_list").isNotNull() | F.col("answer").isNotNull()


def explode_checklist(samples: DataFrame) -> DataFrame:
    """One row per expected step (checklist order), or one step for the
    simple shape (idx 1, info_item = stripped task, table path wrapped)."""
    simple = F.array(F.struct(
        F.lit(1).alias("idx"), py_strip(F.coalesce("task", F.lit(""))).alias("info_item"),
        F.col("answer").cast("string").alias("answer"),
        F.coalesce(F.col("table_path"), F.array()).cast("array<string>").alias("related_tables"),
        F.array().cast("array<string>").alias("score_points")))
    steps = F.when(F.col("design.checkout_list").isNotNull(), F.col("design.checkout_list").cast(f"array<{STEP_T}>")) \
        .when(F.col("answer").isNotNull(), simple.cast(f"array<{STEP_T}>"))
    return samples.select("ord", "task", F.posexplode(steps).alias("pos", "step")).select(
        "ord", "task", (F.col("pos") + 1).alias("step_no"), "step.idx", "step.info_item",
        F.col("step.answer").alias("true_answer"),
        F.coalesce("step.related_tables", F.array().cast("array<string>")).alias("related_tables"),
        F.coalesce("step.score_points", F.array().cast("array<string>")).alias("score_points"))


def first_occurrence(samples: DataFrame, key: str = "task", order: str = "ord") -> DataFrame:
    """First row per ``key`` in ``order``.

    ``min_by`` aggregates map-side, so a task repeated a billion times is
    combined before the shuffle (a row_number window would send every copy
    to one task); ``dropDuplicates`` would not fix which row survives.
    """
    cols = [c for c in samples.columns if c != key]
    agg = samples.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*samples.columns)


def duplicate_tasks(samples: DataFrame, key: str = "task") -> DataFrame:
    """Tasks that occur more than once, with their count."""
    return samples.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sample_limit(samples: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """L4: the first ``n`` samples in file order (0 = all)."""
    return samples if n == 0 else samples.orderBy(order).limit(n)


def pending_samples(samples: DataFrame, traces: DataFrame, query: str = "query") -> DataFrame:
    """Samples whose raw task is not among the stripped trace queries.

    The large trace side is reduced to 8-byte hashes of its stripped queries
    (distinct hashes are all that is shuffled); only traces whose hash hits
    a task are re-read to confirm the match by full-text equality.
    """
    q = traces.select(py_strip(F.col(query)).alias("_q")).where(F.col("_q").isNotNull()) \
        .withColumn("_h", F.xxhash64("_q"))
    s = samples.withColumn("_h", F.xxhash64("task"))
    hit_h = q.select("_h").distinct().join(s.select("_h").distinct(), "_h")
    confirmed = q.join(hit_h, "_h").select("_h", "_q").distinct()
    done = s.join(confirmed, (s["_h"] == confirmed["_h"]) & (s["task"] == confirmed["_q"]), "left_semi")
    return s.join(done.select("ord"), "ord", "left_anti").drop("_h")


def _words(x: Column) -> Column:
    """Words of any script."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), 0)


def _shingles(words: Column, first: Column, last: Column) -> Column:
    """Hash and length of each run of three words that starts at 1-based first..last."""
    at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(
        (F.length(F.get(words, i - 1)) + F.length(F.get(words, i)) + F.length(F.get(words, i + 1))).alias("n"),
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h")))


def _long_pairs(needles: DataFrame, big: DataFrame, b_key: str, b_col: str) -> DataFrame:
    """Needles ``(needle, text, words)`` of five words or more.  A needle's words
    but the first and the last are whole words of any text that contains it,
    so its longest run of three of them is also one of that text."""
    inner = _shingles(F.col("words"), F.lit(2), F.size("words") - 3)
    keyed = needles.select("needle", "text", F.element_at(F.sort_array(inner, asc=False), 1)["h"].alias("_h"))
    own = big.select(b_key, _words(F.col(b_col)).alias("_w"))
    own = own.select(b_key, F.explode(F.array_distinct(
        F.transform(_shingles(F.col("_w"), F.lit(1), F.size("_w") - 2), lambda s: s["h"]))).alias("_h"))
    cand = own.join(keyed.select("needle", "_h"), "_h").select("needle", b_key).distinct()
    return cand.join(keyed.select("needle", "text"), "needle").join(big.select(b_key, b_col), b_key) \
        .where(F.contains(F.col(b_col), F.col("text"))).select("needle", b_key)


def _scanner(rows: list[tuple[int, str]]):
    """str -> numbers of the needles inside it (one pass of a multi-pattern automaton)."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for i, text in rows:
        found.add_word(text, i)
    if rows:
        found.make_automaton()
    return lambda text: sorted({i for _, i in found.iter(text)}) if rows and text else []


def _short_pairs(needles: DataFrame, big: DataFrame, b_key: str, b_col: str) -> DataFrame:
    """Needles too short for an inner run of words: texts are scanned for all of
    them at once.  Up to ``BLOCK_CHARS`` of needles (counted) travel with the
    scan; more are dealt into blocks of that size, each met by each bounded
    part of the texts."""
    total = needles.agg(F.sum(F.length("text"))).first()[0] or 0
    key_type, blocks = big.schema[b_key].dataType.simpleString(), -(-total // BLOCK_CHARS)
    if blocks <= 1:
        rows = [(r["needle"], r["text"]) for r in needles.select("needle", "text").collect()]

        @F.pandas_udf("array<bigint>")
        def inside(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scan = _scanner(rows)
            for texts in batches:
                yield texts.map(scan)

        return big.select(F.explode(inside(F.coalesce(b_col, F.lit("")))).alias("needle"), b_key)
    parts = -(-(big.agg(F.sum(F.length(b_col))).first()[0] or 1) // (8 * BLOCK_CHARS))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        scan = _scanner(list(zip(left["needle"].tolist(), left["text"], strict=True)))
        hits = [(i, k) for k, t in zip(right["key"], right["text"], strict=True) for i in scan(t)]
        return pd.DataFrame(hits, columns=["needle", "key"])

    n = needles.select("needle", "text", F.pmod(F.xxhash64("needle"), F.lit(blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    h = big.select(F.col(b_key).alias("key"), F.col(b_col).alias("text"), F.pmod(F.xxhash64(b_key, b_col), F.lit(parts)).alias("part"),
                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    met = n.groupBy("block", "part").cogroup(h.groupBy("block", "part")).applyInPandas(meet, f"needle bigint, key {key_type}")
    return met.select("needle", F.col("key").alias(b_key)).distinct()


def _contained_pairs(small: DataFrame, s_col: str, big: DataFrame, b_key: str, b_col: str) -> DataFrame:
    """``(text, b_key)``: texts of ``small`` that lie inside ``big[b_col]``, exact.
    Each different non-empty text is looked for once, whatever repeats it."""
    texts = small.where(F.col(s_col) != "").select(F.col(s_col).alias("text")).distinct()
    needles = texts.select(F.xxhash64("text").alias("needle"), "text", _words(F.col("text")).alias("words"))
    needles = cut_lineage(needles, "needles")  # read by three plans below; its word lists are made once
    enough = F.size("words") >= MIN_WORDS_FOR_BLOCKING
    both = _long_pairs(needles.where(enough), big, b_key, b_col) \
        .unionByName(_short_pairs(needles.where(~enough), big, b_key, b_col))
    return both.join(needles.select("needle", "text"), "needle").select("text", b_key)


def match_sample(traces: DataFrame, samples: DataFrame, trace_key: str = "trace_id",
                 query: str = "query") -> DataFrame:
    """For each trace, the first usable sample (file order) whose stripped
    task equals, contains, or is contained in the stripped query.

    Rewritten without stripping the (large) query side up front:
    * task ⊆ query: a stripped non-empty task starts and ends with a
      non-space, so it lies inside the query iff inside its stripped form;
      equality with a non-empty task is a special case of it;
    * query ⊆ task: only queries no longer than the longest task can fit —
      a one-row aggregate prunes the rest before any tokenising;
    * both empty: blank queries match empty tasks.
    Candidates are reduced with ``min(ord)`` per trace (an aggregate).
    """
    s = samples.where(usable(samples)).select(F.col("ord").alias("_o"),
                                             py_strip(F.coalesce(F.col("task"), F.lit(""))).alias("_s"))
    s = s.groupBy("_s").agg(F.min("_o").alias("_o"))  # a repeated task: its first sample
    q_raw = traces.select(F.col(trace_key).alias("_t"), F.coalesce(F.col(query), F.lit("")).alias("_q"))
    s_in_q = _contained_pairs(s, "_s", q_raw, "_t", "_q").join(s, F.col("text") == F.col("_s")).select("_t", "_o")
    longest = s.agg(F.max(F.length("_s")).alias("_maxlen")).withColumn("_one", F.lit(1))
    fit = q_raw.select("_t", py_strip(F.col("_q")).alias("_q"), F.lit(1).alias("_one")) \
        .join(F.broadcast(longest), "_one").where(F.length("_q") <= F.col("_maxlen")).select("_t", "_q")
    # one answer for each different query text, then handed to the traces that ask it
    per_text = _contained_pairs(fit, "_q", s, "_o", "_s").groupBy("text").agg(F.min("_o").alias("_o"))
    q_in_s = fit.join(per_text, F.col("_q") == F.col("text")).select("_t", "_o")
    cand = s_in_q.unionByName(q_in_s).unionByName(_blank_pairs(q_raw, s))
    best = cand.groupBy("_t").agg(F.min("_o").alias("ord"))
    return best.select(F.col("_t").alias(trace_key), "ord")


def _blank_pairs(q_raw: DataFrame, s: DataFrame) -> DataFrame:
    """Blank query ↔ empty task (equality of two empty stripped strings):
    the earliest empty task is attached to every blank query by an
    equi-join on a constant key with a one-row side."""
    first_empty = s.where(F.col("_s") == "").agg(F.min("_o").alias("_o")).where(F.col("_o").isNotNull()) \
        .withColumn("_one", F.lit(1))
    blank = q_raw.where(py_strip(F.col("_q")) == "").select("_t", F.lit(1).alias("_one"))
    return blank.join(F.broadcast(first_empty), "_one").select("_t", "_o")


def align_steps(pairs: DataFrame, expected: DataFrame, links: DataFrame, trace_key: str = "trace_id") -> DataFrame:
    """I-th expected step ↔ i-th raw pair (left outer, positional).

    ``links`` maps trace → sample ``ord``; ``expected`` is
    ``explode_checklist``.  A step is missing unless the raw answer is
    non-empty; extra raw pairs are dropped; traces with no sample keep
    their raw pairs.
    """
    exp = links.join(expected, "ord").select(trace_key, F.col("step_no").alias("step_index"), "info_item",
                                              "true_answer", "related_tables", "score_points")
    raw = pairs.select(trace_key, "step_index", F.col("answer").alias("_raw_answer"),
                       F.col("query").alias("_raw_query"), "n_tools",
                       F.coalesce("data_source", F.array().cast("array<string>")).alias("_ds"))
    # one pass over the raw pairs tags each with its link; both branches
    # below read the same exchange
    raw = raw.join(links.select(trace_key, F.lit(True).alias("_linked")), trace_key, "left")
    al = exp.join(raw.where(F.col("_linked").isNotNull()), [trace_key, "step_index"], "left")
    has = F.coalesce(F.col("_raw_answer"), F.lit("")) != ""
    aligned = al.select(trace_key, "step_index", F.col("info_item").alias("query"),
                        F.when(has, F.col("_raw_answer")).otherwise(F.lit("")).alias("answer"),
                        (~has).alias("is_missing"), "true_answer",
                        F.coalesce("n_tools", F.lit(0)).alias("n_tools"),
                        F.when(has, F.transform("_ds", basename)).otherwise(F.array().cast("array<string>"))
                        .alias("data_source"), "related_tables", "score_points")
    unmatched = raw.where(F.col("_linked").isNull()).select(
        trace_key, "step_index", F.col("_raw_query").alias("query"), F.col("_raw_answer").alias("answer"),
        F.lit(False).alias("is_missing"), F.lit(None).cast("string").alias("true_answer"), "n_tools",
        F.col("_ds").alias("data_source"), F.lit(None).cast("array<string>").alias("related_tables"),
        F.array().cast("array<string>").alias("score_points"))
    return aligned.unionByName(unmatched)


def step_order(steps: DataFrame, trace_key: str = "trace_id", n_parts: int | None = None) -> DataFrame:
    """Steps ordered by (trace, step_index) across the whole output.

    Range partitioning on (trace, step) splits a huge trace over several
    tasks; each task sorts locally — no single-task sort, no collect.
    """
    n = n_parts or int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.repartitionByRange(n, trace_key, "step_index").sortWithinPartitions(trace_key, "step_index")
