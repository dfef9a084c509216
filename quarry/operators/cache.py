"""Request caches, embedding stores, summaries, manifests (S7, S8, S10, J7–J10,
U2–U4, U6, F13, A12, A17, L5, P5).

Caches are append-only tables keyed by a content hash; every "update" is
a new snapshot written next to the old one (never in place), built with
anti-joins and ``max_by`` aggregates rather than per-key windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the batch-API request line
BATCH_METHOD = "POST"
BATCH_URL = "/v1/chat/completions"
SKIPPED_EXTENSIONS = (".xlsx", ".xls")


def request_key(*cols: str) -> Column:
    """md5 of the canonical JSON of the non-null parameters, keys sorted.

    Canonical form is Spark's compact JSON (not byte-equal to Python's
    ``json.dumps`` spacing); NULL fields are omitted by ``to_json``.
    """
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def latest_per_key(log: DataFrame, key: str = "hash", order=("timestamp",)) -> DataFrame:
    """The latest entry per key (later entries win); an aggregate with
    map-side combine, so a hot key is reduced before the shuffle."""
    cols = [c for c in log.columns if c != key]
    g = log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def cache_ttl(entries: DataFrame, cutoff, ts: str = "timestamp") -> DataFrame:
    """U4: keep entries with ``coalesce(ts, 0) >= cutoff`` (missing → removed)."""
    return entries.where(F.coalesce(F.col(ts), F.lit(0)) >= cutoff)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """Requests left-joined to the cache; ``hit`` marks filled results;
    the request ordinal is kept so output order can be restored."""
    c = cache.select(key, F.col("result").alias("_cached"), F.lit(True).alias("_hit"))
    j = requests.join(c, key, "left")
    return j.select(*requests.columns, F.coalesce("_hit", F.lit(False)).alias("hit"), F.col("_cached").alias("result"))


def pending_requests(requests: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """J8 misses: requests that still need a call."""
    return requests.join(cache.select(key), key, "left_anti")


def request_lines(requests: DataFrame, order: str, model: str, system: str, prompt: str) -> DataFrame:
    """Batch-API JSONL lines, ``custom_id`` 1-based in request order.

    The ordinal comes from ``zipWithIndex``-style ranking in Spark SQL:
    ``row_number`` over the global order runs once on the request table,
    which is the order the file must have."""
    from quarry.operators.scan import prefix_scan
    # one global ordinal: chunks of 2^20 ids keep both the local windows and
    # the single chunk-summary window bounded (10^12 rows -> ~10^6 chunks)
    r = prefix_scan(requests.withColumn("_all", F.lit(0)), ["_all"], [order], {"custom_id": F.lit(1)},
                    chunk=F.floor(F.col(order) / F.lit(1 << 20)).cast("long"))
    body = F.struct(F.col(model).alias("model"), F.array(
        F.struct(F.lit("system").alias("role"), F.col(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.col("custom_id").cast("long").alias("custom_id"), F.lit(BATCH_METHOD).alias("method"),
                              F.lit(BATCH_URL).alias("url"), body.alias("body")))
    return r.select(F.col("custom_id").cast("long").alias("custom_id"), line.alias("line"))


def cache_stats(entries: DataFrame, line: str = "line") -> DataFrame:
    """Number of entries and size in MB (2 dp) of their JSON lines."""
    return entries.agg(F.count("*").alias("entries"),
                       F.round(F.coalesce(F.sum(F.length(line) + 1), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"))


def store_union(cached: DataFrame, new: DataFrame, key: str = "text_hash") -> DataFrame:
    """Cached ∪ new, the new row wins per key (one aggregate)."""
    u = cached.withColumn("_pri", F.lit(0)).unionByName(new.withColumn("_pri", F.lit(1)))
    cols = [c for c in cached.columns if c != key]
    g = u.groupBy(key).agg(F.max_by(F.struct(*cols), "_pri").alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def summary_upsert(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """Insert or replace: old rows without a new version, plus new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def fresh_summaries(summaries: DataFrame, manifest: DataFrame) -> DataFrame:
    """A summary is valid iff the path matches and it is not older than
    the file (equi-join on path + ``>=`` residual)."""
    m = manifest.select(F.col("path").alias("file_path"), F.col("mtime").alias("_mtime"))
    return summaries.join(m, "file_path").where(F.col("last_modified") >= F.col("_mtime")).drop("_mtime")


def file_diff(now: DataFrame, snapshot: DataFrame, snapshot_filter: bool = True) -> DataFrame:
    """Files now − files at the snapshot.  The snapshot skips names
    starting with '.' or '_', the later listing does not."""
    s = snapshot
    if snapshot_filter:
        s = s.where(~(F.startswith("name", F.lit(".")) | F.startswith("name", F.lit("_"))))
    return now.join(s.select("path"), "path", "left_anti")


def split_supported(manifest: DataFrame, first_n: int = 3) -> DataFrame:
    """P5: processed (csv/tsv) vs skipped (xlsx/xls) counts and the first
    ``first_n`` skipped paths (a top-n, not a collect)."""
    skipped = F.col("extension").isin(*SKIPPED_EXTENSIONS)
    counts = manifest.agg(F.count_if(~skipped).alias("n_processed"), F.count_if(skipped).alias("n_skipped"))
    first = manifest.where(skipped).select("path").orderBy("path").limit(first_n) \
        .agg(F.sort_array(F.collect_list("path")).alias("first_skipped"))
    return counts.withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k").drop("_k")


def folder_rollup(manifest: DataFrame, rel: str = "relative_path") -> DataFrame:
    """One row per directory prefix: files beneath it and direct
    children (dirs + files) — a ROLLUP over path parts."""
    parts = F.split(F.col(rel), "/")
    d = manifest.select(parts.alias("p"))
    pre = d.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("depth"))
    pre = pre.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("dir"), "depth",
                     F.element_at("p", F.col("depth") + 1).alias("child"),
                     (F.col("depth") + 1 == F.size("p")).alias("is_file"))
    return pre.groupBy("dir", "depth").agg(F.count_if("is_file").alias("n_files_here"),
                                           F.count("*").alias("n_files_below"),
                                           F.count_distinct("child").alias("n_children"))


def dirs_first_order(manifest: DataFrame, quota: int = 10, rel: str = "relative_path") -> DataFrame:
    """What a folder view shows: the root's children first, then those of the
    first directory, of the first directory in it, and so on while the quota
    lasts; directories before files, then by name.  A level that doesn't fit
    shows what the quota still allows and is the last.  ``n_children`` tells
    how many the level has, so ``n_children - shown`` are left out.

    The chain of first directories is one minimum over the paths (map-side
    combined); the levels on it are few, however large the tree.
    """
    parts = F.split(F.col(rel), "/")
    beyond = "\U0010ffff"  # sorts behind every name, so that a longer chain beats its own start
    d = manifest.select(parts.alias("p"))
    chain = d.agg(F.min(F.concat(F.slice("p", 1, F.size("p") - 1), F.array(F.lit(beyond)))).alias("chain"))
    chain = chain.select(F.slice("chain", 1, F.size("chain") - 1).alias("chain"))
    on = d.withColumn("_k", F.lit(1)).join(F.broadcast(chain.withColumn("_k", F.lit(1))), "_k").select(  # the chain is one row
        "chain", F.explode(F.filter(F.sequence(F.lit(0), F.size("p") - 1),
                                    lambda k: (k <= F.size("chain")) & (F.slice("p", 1, k) == F.slice("chain", 1, k)))).alias("depth"), "p")
    nodes = on.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("parent"), "depth",
                      F.element_at("p", F.col("depth") + 1).alias("name"),
                      (F.col("depth") + 1 == F.size("p")).alias("is_file")).distinct()
    levels = nodes.groupBy("depth").agg(F.count("*").alias("n_children"))
    before = F.coalesce(F.sum("n_children").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("depth", "n_children", F.least("n_children", F.greatest(F.lit(quota) - before, F.lit(0))).alias("shown"))
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("depth").orderBy("is_file", "name"))) \
        .where(F.col("rank") <= quota)
    return ranked.join(levels, "depth").where(F.col("rank") <= F.col("shown")) \
        .select("parent", "name", "is_file", "rank", "n_children")
