"""Skew-safe ordered scans (running sums / running max per key).

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key
to one task; one trace holding a third of all rows would then be a single
task.  ``prefix_scan`` cuts each key into contiguous chunks instead, using
a *chunk column* that is monotone in the scan order (e.g. ``seq div 4096``
or the day of a timestamp), so chunk ids are pure functions of the data and
every re-read of the input agrees on them:

1. local running sums per (key, chunk) — windows of bounded size;
2. a chunk summary (one row per key×chunk) gets the carry-in of earlier
   chunks the same way once more: windows over ``SPAN`` chunks at a time, and
   over one row a span beyond that (a span holds 16 million rows of a key);
3. the carry-in is joined back on (key, chunk); the big side is already
   hash-partitioned by (key, chunk) for step 1, so only the summary moves.

The running maximum of a prefix-summed series (the FIFO matcher needs it)
decomposes the same way: max over the prefix = max(carry max of earlier
chunks, carry sum + local running max).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# rows per chunk for integer sequence orders
CHUNK_ROWS = 4096
# chunks per span of the carry
SPAN = 4096


def seq_chunk(col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk id for a dense-ish integer order column."""
    return F.floor(F.col(col) / F.lit(rows)).cast("long")


def time_chunk(col: str, seconds: int = 3600) -> Column:
    """Chunk id for a timestamp order column (default: hour buckets)."""
    return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def prefix_scan(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column],
                max_of: dict[str, str] | None = None, chunk: Column | None = None,
                skew_safe: bool = True) -> DataFrame:
    """Add inclusive running sums ``sums`` per ``key`` ordered by ``order``.

    ``max_of`` maps an output name to the name of one of ``sums``: the
    running maximum of that running sum (inclusive).  ``chunk`` must be
    non-decreasing along ``order`` within a key; default ``seq_chunk`` of
    the first order column.
    """
    max_of = max_of or {}
    if not skew_safe:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df
        for n, c in sums.items():
            out = out.withColumn(n, F.sum(c).over(w))
        for n, s in max_of.items():
            out = out.withColumn(n, F.max(s).over(w))
        return out

    ch = "_chunk"
    r = df.withColumn(ch, chunk if chunk is not None else seq_chunk(order[0]))
    wl = Window.partitionBy(*key, ch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    loc = r
    for n, c in sums.items():
        loc = loc.withColumn(f"_l_{n}", F.sum(c).over(wl))
    for n, s in max_of.items():
        loc = loc.withColumn(f"_lm_{n}", F.max(f"_l_{s}").over(wl))

    aggs = [F.sum(c).alias(f"_t_{n}") for n, c in sums.items()]
    aggs += [F.max(F.col(f"_lm_{n}")).alias(f"_tm_{n}") for n in max_of]
    # the summary reads ``loc``, which is already hash-partitioned by
    # (key, chunk): no new exchange, and both consumers share one shuffle
    summ = loc.groupBy(*key, ch).agg(*aggs)
    # inside a span of chunks: sums and maxima of the chunks before, from the span's start
    span = "_span"
    summ = summ.withColumn(span, F.floor(F.col(ch) / F.lit(SPAN)))
    wi = Window.partitionBy(*key, span).orderBy(ch)
    before = wi.rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})
    carry = carry.withColumns({f"_g_{n}": F.col(f"_i_{s}") + F.col(f"_tm_{n}") for n, s in max_of.items()})
    carry = carry.withColumns({f"_im_{n}": F.max(f"_g_{n}").over(before) for n in max_of})
    # the spans before: one row each
    ends = carry.groupBy(*key, span).agg(*[F.sum(f"_t_{n}").alias(f"_st_{n}") for n in sums],
                                         *[F.max(f"_g_{n}").alias(f"_sm_{n}") for n in max_of])
    ws = Window.partitionBy(*key).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_s_{n}": F.coalesce(F.sum(f"_st_{n}").over(ws), F.lit(0)) for n in sums})
    ends = ends.withColumns({f"_sg_{n}": F.col(f"_s_{s}") + F.col(f"_sm_{n}") for n, s in max_of.items()})
    ends = ends.withColumns({f"_sc_{n}": F.max(f"_sg_{n}").over(ws) for n in max_of})
    carry = carry.join(ends.select(*key, span, *[f"_s_{n}" for n in sums], *[f"_sc_{n}" for n in max_of]), [*key, span])
    carry = carry.withColumns({f"_c_{n}": F.col(f"_s_{n}") + F.col(f"_i_{n}") for n in sums})
    carry = carry.withColumns({f"_cm_{n}": F.greatest(F.col(f"_sc_{n}"), F.col(f"_s_{s}") + F.col(f"_im_{n}"))
                               for n, s in max_of.items()})  # greatest skips nulls: no earlier span, no earlier chunk
    keep = [*key, ch] + [f"_c_{n}" for n in sums] + [f"_cm_{n}" for n in max_of]
    j = loc.join(carry.select(*keep), [*key, ch])
    for n in sums:
        j = j.withColumn(n, F.col(f"_l_{n}") + F.col(f"_c_{n}"))
    for n, s in max_of.items():
        local_global = F.col(f"_c_{s}") + F.col(f"_lm_{n}")
        j = j.withColumn(n, F.when(F.col(f"_cm_{n}").isNull(), local_global)
                         .otherwise(F.greatest(F.col(f"_cm_{n}"), local_global)))
    drop = [c for c in j.columns if c.startswith(("_l_", "_lm_", "_c_", "_cm_"))] + [ch]
    return j.drop(*drop)
