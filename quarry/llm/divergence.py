"""Source divergence audit: how far each source's use of words lies from the other
sources of its language, and which words set it apart.

1. Counting.  Inside ``mapInArrow`` whole batches go through Arrow's compute
   kernels: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and a
   hash ``group_by``.  A task sends partial counts (lang, source, term, n, docs),
   merged up to ``FLUSH`` rows at a time, so a word of all documents reaches the
   shuffle a few times a task.
2. Merging.  Spark adds the partial counts, then gathers a term's sources into one
   row (at most one entry for each source of the language) and keeps terms that
   enough documents of the language hold.
3. Shards.  The kept terms of a language are dealt by hash into columnar shards
   of a bounded number of cells (terms by sources); each gives the divergences
   of its terms, summed afterwards, and its own best terms of each group.

Arithmetic is in integers throughout.  With c occurrences of a term, N of all
kept terms and V kept terms, p = 1 + floor(10^9 (c+2) / (N+2V)); two
frequencies differ by floor((p-q)^2 / (p+q)).

Cases: null text, lang and source are ''.  Each row is a document, also rows that
repeat a doc_id or have none.  A group without terms has only the smoothed
frequencies; in a language without kept terms all pairs have value 0.  A
language with one source gives no pairs.  Equal values rank by the item's UTF-8
bytes.  An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import discard, prepare, store

#: What lies between terms: every ASCII character but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 10 ** 9
#: Partial counts that a task merges before it sends them.
FLUSH = 200_000
#: Cells (terms by sources) of a shard, and steps (terms by pairs of sources).
CELLS, STEPS = 100_000, 4_000_000

KEYS = ["lang", "source", "term"]
PARTIAL = "lang string, source string, term string, n long, docs long"
VALUES = "part string, lang string, source string, item string, value long"


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (lang, source, text)."""
    lang, source, text = batch.columns
    found = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    doc = pc.list_parent_indices(found)
    terms = pc.list_flatten(found)
    real = pc.not_equal(terms, "")
    terms, doc = terms.filter(real).dictionary_encode(), doc.filter(real)
    each = (pa.table({"doc": doc, "code": terms.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")]))
    group = pa.table({"lang": lang.take(each["doc"]), "source": source.take(each["doc"]), "code": each["code"], "n": each["count_all"]})
    sums = group.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({"lang": sums["lang"], "source": sums["source"], "term": terms.dictionary.take(sums["code"].combine_chunks()),
                     "n": sums["n_sum"], "docs": sums["n_count"]})


def added(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return both.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])


def count_terms(flush: int = FLUSH):
    """mapInArrow function: (lang, source, text) -> partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = least = 0
        for batch in batches:
            held.append(batch_counts(batch))
            rows += len(held[-1])
            if rows >= max(flush, 2 * least):  # merge once the new rows outnumber the merged ones
                held = [added(held)]
                rows = least = len(held[0])
                if least >= flush:
                    yield from held[0].to_batches()
                    held, rows, least = [], 0, 0
        if held:
            yield from added(held).to_batches()

    return run


def ratio(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 c / total) for 0 <= c <= total < 9e15, digit group by digit group."""
    q, rest = np.zeros_like(c), c
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        q, rest = q * 1000 + digit, rest - digit * total
    return 1 + q


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def shard_values(top: int = TOP_TERMS):
    """cogrouped applyInArrow function: a shard's terms (term, at, n) and its
    language's groups (at, source, total, v) -> values of pairs, summed over the shard, and of
    the shard's best terms.  ``at`` numbers the sources of the language."""

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        lang = groups["lang"][0].as_py()
        order = pc.sort_indices(groups["at"])
        source = groups["source"].take(order).to_pylist()
        total = groups["total"].take(order).to_numpy()
        v, s, n_terms = groups["v"][0].as_py(), len(source), len(terms)
        names, counts = [], np.zeros((n_terms, s), np.int64)
        if n_terms:
            names = terms["term"].to_pylist()
            row = np.repeat(np.arange(n_terms), pc.list_value_length(terms["at"].combine_chunks()).to_numpy(zero_copy_only=False))
            counts[row, pc.list_flatten(terms["at"].combine_chunks()).to_numpy()] = pc.list_flatten(terms["n"].combine_chunks()).to_numpy()
        p = ratio(counts + 2, np.maximum(total + 2 * v, 2)) if n_terms else counts
        q = ratio(counts.sum(1) + 2, np.maximum(total.sum() + 2 * v, 2)) if n_terms else counts.sum(1)
        part, own, item, value = [], [], [], []
        for i in range(s):
            sums = apart(p[:, i:i + 1], p).sum(0)
            others = [j for j in range(s) if j != i]
            part += ["pair"] * len(others)
            own += [source[i]] * len(others)
            item += [source[j] for j in others]
            value += sums[others].tolist()
            high = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            f = apart(p[high, i], q[high])
            if len(f) > top:  # all that reach the shard's top values, ties included
                reach = f >= np.partition(f, -top)[-top]
                high, f = high[reach], f[reach]
            best = sorted(zip((-f).tolist(), [names[k].encode() for k in high], strict=True))[:top]
            part += ["term"] * len(best)
            own += [source[i]] * len(best)
            item += [b.decode() for _, b in best]
            value += [-x for x, _ in best]
        return pa.table({"part": pa.array(part, pa.string()), "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array(own, pa.string()),
                         "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, cells: int = CELLS,
          steps: int = STEPS, flush: int = FLUSH) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows to every other source
    of the language and the ``top`` ``term`` rows of each (lang, source)."""
    prepare(documents.sparkSession)
    docs = documents.select(plain("lang"), plain("source"), plain("text"))
    counts = docs.mapInArrow(count_terms(flush), PARTIAL).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # sources of a language by number; one row a group
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = store(docs.select("lang", "source").distinct().withColumn("at", number), "sources")
    kept = store(counts.join(groups, ["lang", "source"]).groupBy("lang", "term")
                 .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("at", "n")).alias("c"))
                 .filter(F.col("docs") >= least_docs)
                 .select("lang", "term", F.col("c.at").alias("at"), F.col("c.n").alias("n")), "kept_terms")
    totals = (kept.select("lang", F.inline(F.arrays_zip("at", "n"))).groupBy("lang", "at").agg(F.sum("n").alias("total")))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    zero = F.lit(0).cast("long")
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / F.lit(cells)), F.ceil(F.col("v") * F.col("s") * F.col("s") / F.lit(steps)))
    info = store(groups.join(totals, ["lang", "at"], "left").join(sizes, "lang", "left").join(width, "lang")
                 .select("lang", "source", "at", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), "s")
                 .withColumn("shards", shards.cast("int")), "source_totals")
    per_lang = info.groupBy("lang").agg(F.first("shards").alias("shards"))
    dealt = (kept.join(per_lang, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
             .select("lang", "shard", "term", "at", "n"))
    spread = (info.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .select("lang", "shard", "source", "at", "total", "v"))
    values = store(dealt.groupBy("lang", "shard").cogroup(spread.groupBy("lang", "shard"))
                   .applyInArrow(shard_values(top), VALUES), "shard_values")
    # a pair has a value from each shard, a term from its own only
    summed = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = summed.withColumn("rank", F.row_number().over(best)).filter(f"part = 'pair' or rank <= {int(top)}")
    discard(kept)
    return out.select("lang", "source", "part", "item", "value", "rank")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> str:
    """DuckDB twin over ``documents``."""
    def p(c: str, n: str) -> str:
        return f"1 + ({SCALE}::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"

    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
b AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang) AS lang_total,
             sum(n) OVER (PARTITION BY lang, term) AS lang_n FROM a),
f AS (SELECT lang, source, term, n, {p("n", "total")} AS p, {p("lang_n", "lang_total")} AS q FROM b),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, y.lang AS l2
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
pv AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
       FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT pair.lang, pair.source, part, pair.item, coalesce(value, 0) AS value FROM pair LEFT JOIN pv
        ON pv.lang = pair.lang AND pv.source = pair.source AND pv.item = pair.item
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM f WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM o WHERE part = 'pair' OR rank <= {top}"""
