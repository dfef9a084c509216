"""Line search over a file corpus.

Input is the per-file array form ``(path, lines ARRAY<STRING>)`` produced by
``sources.files.file_lines`` — one row per file.  Everything a grep does is
file-local, so every operator here is a narrow per-row expression (filter /
transform / slice / posexplode): no shuffle at any scale.  The only
cross-file step is the top-files report, a ``TakeOrderedAndProject`` that
keeps k rows per task before one tiny merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import line_label, py_regex
from quarry.sources.files import GREP_EXTENSIONS, SKIP_DIRS

# fixed values: report limits (files shown in detail, hits per file, page size)
MAX_DETAIL_FILES = 5
MAX_MATCHES_PER_FILE = 10
DEFAULT_PAGE_SIZE = 10


def _hits(lines: Column, pattern: str, ignore_case: bool) -> Column:
    """ARRAY<STRUCT<line_no, line>> of matching lines, in file order."""
    p = py_regex(pattern, ignore_case)
    numbered = F.transform(lines, lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(p))


def grep_lines(files: DataFrame, pattern: str, ignore_case: bool = True, keys=("path",)) -> DataFrame:
    """``(keys…, line_no, line)`` for every matching physical line."""
    return files.select(*keys, F.inline(_hits(F.col("lines"), pattern, ignore_case)))


def grep_file_filter(manifest: DataFrame, file_regex: str | None = None) -> DataFrame:
    """Extension allow-list, case-sensitive name regex, skipped dirs.

    Applied to the manifest, so file bodies of rejected files are never read.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    dir_part = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    cond = ext.isin(*GREP_EXTENSIONS)
    for d in SKIP_DIRS:
        cond = cond & ~F.contains(dir_part, F.lit(d))
    if file_regex:
        cond = cond & F.col("name").rlike(file_regex.replace("(?P<", "(?<"))
    return manifest.where(cond)


def matches_per_file(files: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Hits per file (files with at least one hit)."""
    p = py_regex(pattern, ignore_case)
    n = F.size(F.filter("lines", lambda l: l.rlike(p)))
    return files.select("path", n.alias("n_matches")).where("n_matches > 0")


def grep_overview(files: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """A11 totals: matching files and total matches (one row)."""
    per = matches_per_file(files, pattern, ignore_case)
    return per.agg(F.count("*").alias("total_files"),
                   F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("total_matches"))


def top_matches_per_file(files: DataFrame, pattern: str, ignore_case: bool = True,
                         max_files: int = MAX_DETAIL_FILES, per_file: int = MAX_MATCHES_PER_FILE) -> DataFrame:
    """Top files by hit count (ties: path), first ``per_file`` hits each.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own top ``max_files`` rows, so only k rows per task reach the merge.
    """
    hits = _hits(F.col("lines"), pattern, ignore_case)
    per = files.select("path", hits.alias("hits")).select("path", "hits", F.size("hits").alias("n_matches")) \
        .where("n_matches > 0")
    top = per.orderBy(F.desc("n_matches"), F.asc("path")).limit(max_files)
    # rank first (window over <= max_files rows), then explode
    top = top.withColumn("file_rank", F.row_number().over(_global_order()))
    ranked = top.select("path", "n_matches", "file_rank",
                        F.posexplode(F.slice("hits", 1, per_file)).alias("pos", "hit"))
    return ranked.select("file_rank", "path", "n_matches", (F.col("pos") + 1).alias("hit_rank"),
                         F.col("hit.line_no").alias("line_no"), F.col("hit.line").alias("line"))


def _global_order():
    from pyspark.sql import Window as W
    # runs on <= max_files rows (after the limit), never on the corpus
    return W.orderBy(F.desc("n_matches"), F.asc("path"))


def remaining_files(files: DataFrame, pattern: str, ignore_case: bool = True,
                    max_files: int = MAX_DETAIL_FILES) -> DataFrame:
    """W8 tail: files beyond the detailed ones, with their hit counts."""
    per = matches_per_file(files, pattern, ignore_case)
    top = per.orderBy(F.desc("n_matches"), F.asc("path")).limit(max_files).select("path")
    return per.join(F.broadcast(top), "path", "left_anti")


def grep_context(files: DataFrame, pattern: str, k: int = 2, ignore_case: bool = True) -> DataFrame:
    """±k lines around each hit, clipped to the file.

    The range self-join becomes an in-row ``sequence`` over the file's own
    line array: one output row per (hit, context line), no join, no shuffle.
    """
    hit_nos = F.transform(_hits(F.col("lines"), pattern, ignore_case), lambda x: x["line_no"])

    def around(hit):
        return F.transform(F.sequence(F.greatest(F.lit(1), hit - k), F.least(F.size("lines"), hit + k)), lambda i: F.struct(
            hit.alias("hit_line_no"), i.alias("line_no"), F.element_at("lines", i).alias("line"), (i == hit).alias("is_match")))

    # the slices are cut in the row, so no output row carries the file's lines
    return files.select("path", F.inline(F.flatten(F.transform(hit_nos, around))))


def merge_context(files: DataFrame, pattern: str, k: int = 2, ignore_case: bool = True,
                  per_file: int = MAX_MATCHES_PER_FILE) -> DataFrame:
    """Union of context lines of a file's first ``per_file`` hits.

    ``is_match`` is OR-ed over overlapping windows; ``gap_before`` marks a
    separator where line numbers jump.  Per-file, in-row: no shuffle.
    """
    # no filter on the derived arrays: a pushed-down predicate would inline
    # the line split into the lambda; an empty ``ctx`` explodes to no rows.
    n = F.size("lines")
    hit_nos = F.slice(F.transform(_hits(F.col("lines"), pattern, ignore_case), lambda x: x["line_no"]),
                      1, per_file)
    df = files.select("path", "lines", hit_nos.alias("hit_nos"))
    ctx = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "hit_nos", lambda h: F.sequence(F.greatest(F.lit(1), h - k), F.least(n, h + k))))))
    df = df.select("path", "lines", "hit_nos", ctx.alias("ctx"))
    rows = F.transform("ctx", lambda i, pos: F.struct(
        i.alias("line_no"), F.element_at("lines", i).alias("line"), F.array_contains("hit_nos", i).alias("is_match"),
        F.when(pos > 0, i > F.get("ctx", pos - 1) + 1).otherwise(F.lit(False)).alias("gap_before")))
    return df.select("path", F.inline(rows))


def page_matches(files: DataFrame, pattern: str, start: int = 0, max_matches: int | None = None,
                 ignore_case: bool = True) -> DataFrame:
    """L3: hits ``[start, start+max)`` of each file (0-based start)."""
    m = max_matches or DEFAULT_PAGE_SIZE
    hits = _hits(F.col("lines"), pattern, ignore_case)
    return files.select("path", F.posexplode(F.slice(hits, start + 1, m)).alias("pos", "hit")) \
        .select("path", (F.col("pos") + start + 1).alias("match_idx"),
                F.col("hit.line_no").alias("line_no"), F.col("hit.line").alias("line"))


def line_slice(files: DataFrame, start: int = 1, n: int = 10) -> DataFrame:
    """Lines ``start … start+n-1`` (start clamped to 1), total and remaining."""
    s = max(start, 1)
    total = F.size("lines")
    return files.select("path", total.alias("total_lines"),
                        F.posexplode(F.slice("lines", s, n)).alias("pos", "line")) \
        .select("path", (F.col("pos") + s).alias("line_no"), "line", "total_lines",
                F.greatest(F.lit(0), F.col("total_lines") - (s + n - 1)).alias("remaining"))


def head_tail_preview(files: DataFrame, n: int = 5, tail: bool = False) -> DataFrame:
    """First (or last) ``n`` lines with the file's total line count."""
    total = F.size("lines")
    start = F.greatest(total - n + 1, F.lit(1)) if tail else F.lit(1)
    sl = F.slice("lines", start, F.lit(n)) if tail else F.slice("lines", 1, n)
    return files.select("path", total.alias("total_lines"), start.alias("first_no"),
                        F.posexplode(sl).alias("pos", "line")) \
        .select("path", (F.col("pos") + F.col("first_no")).alias("line_no"), "line", "total_lines")


# fixed values: width of the rule under a preview's heading
PREVIEW_RULE = "─" * 40


def preview_text(files: DataFrame, start: int = 1, n: int = 5) -> DataFrame:
    """P7 as text: a file's first ``n`` lines, labelled from ``start``, under its
    name, its line count and the number of lines not shown."""
    total = F.size("lines")
    name = F.element_at(F.split("path", "/"), -1)
    head = F.concat(F.lit("["), name, F.lit("] Total rows: "), total.cast("string"), F.lit(", remaining rows not shown: "),
                    F.greatest(total - n, F.lit(0)).cast("string"))
    shown = F.transform(F.slice("lines", 1, n), lambda x, i: line_label(i + start, x))
    return files.select("path", F.concat(head, F.lit("\n" + PREVIEW_RULE + "\n"), F.array_join(shown, "\n")).alias("text"))


def grep_line_rows(lines: DataFrame, pattern: str, ignore_case: bool = True, text: str = "line") -> DataFrame:
    """P1 on the long form ``(path, line_no, line)`` — for files too large
    for one row (``sources.files.big_file_lines``): a plain filter, so the
    file's splits are searched in parallel."""
    return lines.where(F.col(text).rlike(py_regex(pattern, ignore_case)))
