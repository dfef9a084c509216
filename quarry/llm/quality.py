"""Quality rules with thresholds adapted to each language and source.

Base counts are per document.  For each (lang, source) the ratios below go into
quantile sketches of logarithmic buckets: a bucket's bounds differ by the factor
``GAMMA``, so any quantile is within 2.5 %; sketches merge by adding counts,
whatever the order, and have a bounded number of buckets.  A ratio is an outlier above
``q75 + SPREAD * max(q75 - q25, floor)`` of its own group.  The thresholds are
joined back on (lang, source), salted so that a hot source is shared out.

Cases: a null text has no words and fails the base rule.  Null lang or source
is a group of its own.  Repeated rows get equal results, extra columns are
dropped and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quarry.llm.common import prepare, store, whole_text

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
GAMMA = 1.05
#: Ratios below this fall into one lowest bucket.
SMALLEST = 1e-4
SPREAD = 3.0
#: metric -> least spread, so that groups without any variation keep a margin.
FLOORS = {"symbol_ratio": 0.04, "dup_line_ratio": 0.12, "caps_ratio": 0.06, "again_ratio": 0.06, "mean_chars": 1.0}
SALTS = 16

COUNTS = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    *(T.StructField(c, T.DoubleType()) for c in FLOORS)])


def repeat_words(ids: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in a k-word window found twice or more; k a power of two.
    Windows are compared exactly: ids of two halves make the id of the whole."""
    n, width = len(ids), 1
    if n <= k:
        return 0
    level = ids.astype(np.int64)
    while width < k:
        pair = level[:len(level) - width] * np.int64(n + 1) + level[width:]
        level = np.unique(pair, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(level)[level] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    chars = len(b"".join(found).decode("utf-8", "surrogatepass"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, n)
    caps = sum(w.isupper() for w in found)
    again = int((ids[1:] == ids[:-1]).sum())
    per = max(n, 1)
    return (n, chars, symbols, dup, repeat_words(ids),
            symbols / per, dup / max(len(lines), 1), caps / per, again / per, chars / per)


@F.pandas_udf(COUNTS)
def count_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([counts(t) for t in texts], columns=COUNTS.names)


def bucket(x: Column) -> Column:
    """Sketch bucket of a ratio; bucket 0 holds everything up to SMALLEST."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(x, F.lit(SMALLEST)) / SMALLEST) / math.log(GAMMA)).cast("int"))


def bucket_value(b: Column) -> Column:
    """The middle of a bucket."""
    return F.when(b == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(GAMMA), b) * 2 / (1 + GAMMA))


def sketches(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, bucket, n): mergeable sketches; partial counts are made
    before the shuffle, so a group sends at most its buckets from each task."""
    long = rows.select(*keys, F.inline(F.array(*(
        F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in metrics))))
    return long.groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], q: dict[str, float]) -> DataFrame:
    """(keys, metric, one column for each quantile) read off merged sketches."""
    w = Window.partitionBy(*keys, "metric")
    run = sketch.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    return run.groupBy(*keys, "metric").agg(*(
        bucket_value(F.min(F.when(F.col("upto") >= F.lit(p) * F.col("total"), F.col("bucket")))).alias(name)
        for name, p in q.items()))


def thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_<metric>): the upper limits of each group."""
    q = quantiles(sketches(rows, keys, list(FLOORS)), keys, {"q25": 0.25, "q75": 0.75})
    floor = F.create_map(*(F.lit(x) for kv in FLOORS.items() for x in kv))
    limit = F.col("q75") + SPREAD * F.greatest(F.col("q75") - F.col("q25"), floor[F.col("metric")])
    return (q.select(*keys, "metric", limit.alias("limit")).groupBy(*keys)
            .agg(*(F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"t_{m}") for m in FLOORS)))


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and ``failed_rule`` (null when kept)."""
    spark = documents.sparkSession
    prepare(spark)
    group = {"g_lang": "lang", "g_source": "source"}
    named = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c))).alias(g) for g, c in group.items()]
    rows = store(documents.select("doc_id", *named, count_text(whole_text()).alias("c"))
                 .select("doc_id", *group, "c.*"), "quality_counts")
    limits = thresholds(rows, list(group)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    rule = F.when(base, "base")
    for m in FLOORS:
        rule = rule.when(F.col(m) > F.col(f"t_{m}"), m)
    return (salted.join(limits, [*group, "salt"], "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("failed_rule")))
