"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..N-1, a keyed permutation of 0..N-1 shuffles
the numbers, and shard and slot follow by arithmetic: ``shard = p mod shards``,
``slot = p div shards``.  So counts differ by one at most, slots are gapless
and the place of a row is computable from its number, N and the key alone.
DataFrame expressions only.

Cases: a null text counts as empty (size 16, crc 0).  A null doc_id sorts
first.  Equal rows are interchangeable and take successive numbers.  The
numbers depend on the rows alone, not on files or partitions.  An empty table
gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import store, whole_text

ROUNDS = 5
SEED = 20_240_611
#: Rows numbered together by one sort; the number of such blocks grows with the table.
BLOCK_ROWS = 50_000
#: Walks start in a domain of a*a with a = ceil(sqrt(N)), so a step leaves
#: 0..N-1 with a chance below one half, mostly about 2/sqrt(N).
MAX_WALK = 128


def global_row_number(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """Adds a gapless 0-based number.  Rows are spread over blocks by a hash of
    ``order``, numbered inside their block and shifted by the rows of earlier
    blocks, so no sort sees more than a block.  ``df`` should be stored: it is
    read twice."""
    total = df.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    cols = [F.col(c) for c in order]
    keyed = df.withColumn("__block", F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int"))
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = (keyed.groupBy("__block").count()
              .select("__block", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("__before")))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(*(c.asc_nulls_first() for c in cols)))
    return (keyed.withColumn("__n", within).join(before, "__block")
            .withColumn(out, F.col("__before") + F.col("__n") - 1).drop("__block", "__before", "__n"))


def feistel(x: Column, a: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of an additive Feistel network: a permutation of 0..a*a-1."""
    left, right = F.floor(x / F.lit(a)), F.pmod(x, F.lit(a))
    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, k: Column) -> Column:
        mixed = F.pmod(acc["l"] + F.pmod(F.xxhash64(acc["r"], k, F.lit(seed)), F.lit(a)), F.lit(a))
        return F.struct(acc["r"].alias("l"), mixed.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), pair, step, lambda s: s["l"] * F.lit(a) + s["r"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """Keyed permutation of 0..n-1: walks along the cycle until inside."""
    a = max(1, int(n ** 0.5))
    while a * a < n:
        a += 1
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), feistel(x, a, seed),
                         lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(documents: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = whole_text()
    slim = store(documents.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text")), "shard_rows")
    n = slim.count()
    numbered = global_row_number(slim, ["doc_id", "text_crc32", "size", "__text"])
    place = permute(F.col("row_number"), n, seed)
    return (numbered.withColumn("__place", place)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
                    F.floor(F.col("__place") / F.lit(shards)).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
