"""Registered grep / line queries over V-lines (documents as files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import grep
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_file_lines
from quarry.registry import query

# the search pattern used by the registered grep queries (word "the")
PATTERN = r"\bthe\b"
RE = r"(?i)\bthe\b"


@query("grep_lines", sql=f"""
WITH {O.LINES}
SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{RE}')""", category="search")
def q_grep_lines(spark, sf):
    """Every line matching ``\\bthe\\b`` (case-insensitive)."""
    return grep.grep_lines(v_file_lines(spark, sf), PATTERN)


@query("matches_per_file", sql=f"""
WITH {O.FILES}
SELECT path, CAST(len(list_filter(lines, lambda l: regexp_matches(l, '{RE}'))) AS INTEGER) AS n_matches
FROM files WHERE len(list_filter(lines, lambda l: regexp_matches(l, '{RE}'))) > 0""", category="search")
def q_matches_per_file(spark, sf):
    """Hits per file."""
    return grep.matches_per_file(v_file_lines(spark, sf), PATTERN)


@query("grep_overview", sql=f"""
WITH {O.LINES}
SELECT COUNT(DISTINCT path) AS total_files, COUNT(*) AS total_matches
FROM lines WHERE regexp_matches(line, '{RE}')""", category="search")
def q_grep_overview(spark, sf):
    """A11 totals: matching files, total matches."""
    return grep.grep_overview(v_file_lines(spark, sf), PATTERN)


@query("top_matches_per_file", sql=f"""
WITH {O.LINES},
hits AS (SELECT * FROM lines WHERE regexp_matches(line, '{RE}')),
per AS (SELECT path, COUNT(*) AS n FROM hits GROUP BY path),
top AS (SELECT path, n, row_number() OVER (ORDER BY n DESC, path) AS file_rank FROM per
        ORDER BY n DESC, path LIMIT 5),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY h.path ORDER BY h.line_no) AS hit_rank FROM hits h
           WHERE h.path IN (SELECT path FROM top))
SELECT CAST(t.file_rank AS INTEGER) AS file_rank, t.path, CAST(t.n AS INTEGER) AS n_matches,
       CAST(r.hit_rank AS INTEGER) AS hit_rank, r.line_no, r.line
FROM top t JOIN ranked r ON r.path = t.path WHERE r.hit_rank <= 10""", category="search")
def q_top_matches_per_file(spark, sf):
    """Top 5 files by hits, first 10 hits each."""
    return grep.top_matches_per_file(v_file_lines(spark, sf), PATTERN)


@query("remaining_files", sql=f"""
WITH {O.LINES},
per AS (SELECT path, COUNT(*) AS n FROM lines WHERE regexp_matches(line, '{RE}') GROUP BY path),
top AS (SELECT path FROM per ORDER BY n DESC, path LIMIT 5)
SELECT path, CAST(n AS INTEGER) AS n_matches FROM per WHERE path NOT IN (SELECT path FROM top)""",
       category="search")
def q_remaining_files(spark, sf):
    """W8 tail: files past the detailed five, with counts."""
    return grep.remaining_files(v_file_lines(spark, sf), PATTERN)


@query("grep_context", sql=f"""
WITH {O.LINES},
hits AS (SELECT path, line_no AS hit_line_no FROM lines WHERE regexp_matches(line, '{RE}'))
SELECT h.path, h.hit_line_no, l.line_no, l.line, l.line_no = h.hit_line_no AS is_match
FROM hits h JOIN lines l ON l.path = h.path AND l.line_no BETWEEN h.hit_line_no - 2 AND h.hit_line_no + 2""",
       category="search")
def q_grep_context(spark, sf):
    """±2 lines of context around each hit."""
    return grep.grep_context(v_file_lines(spark, sf), PATTERN, k=2)


@query("merge_context", sql=f"""
WITH {O.LINES},
hits AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn
         FROM lines WHERE regexp_matches(line, '{RE}')),
shown AS (SELECT path, line_no FROM hits WHERE rn <= 10),
ctx AS (SELECT l.path, l.line_no, l.line, bool_or(l.line_no = s.line_no) AS is_match
        FROM shown s JOIN lines l ON l.path = s.path AND l.line_no BETWEEN s.line_no - 2 AND s.line_no + 2
        GROUP BY l.path, l.line_no, l.line)
SELECT path, line_no, line, is_match,
       coalesce(line_no > lag(line_no) OVER (PARTITION BY path ORDER BY line_no) + 1, false) AS gap_before
FROM ctx""", category="search")
def q_merge_context(spark, sf):
    """Merged context of each file's first 10 hits, with separators."""
    return grep.merge_context(v_file_lines(spark, sf), PATTERN, k=2)


@query("page_matches", sql=f"""
WITH {O.LINES},
hits AS (SELECT path, line_no, line, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn
         FROM lines WHERE regexp_matches(line, '{RE}'))
SELECT path, CAST(rn AS INTEGER) AS match_idx, line_no, line FROM hits WHERE rn > 2 AND rn <= 2 + 10""",
       category="search")
def q_page_matches(spark, sf):
    """L3: hits 3..12 of every file (start=2, max=10)."""
    return grep.page_matches(v_file_lines(spark, sf), PATTERN, start=2, max_matches=10)


@query("line_slice", sql=f"""
WITH {O.LINES},
tot AS (SELECT path, CAST(len(lines) AS INTEGER) AS total_lines FROM files)
SELECT l.path, l.line_no, l.line, t.total_lines, CAST(greatest(0, t.total_lines - (3 + 4 - 1)) AS INTEGER) AS remaining
FROM lines l JOIN tot t USING (path) WHERE l.line_no BETWEEN 3 AND 3 + 4 - 1""", category="search")
def q_line_slice(spark, sf):
    """Lines 3..6 of every file with total and remaining."""
    return grep.line_slice(v_file_lines(spark, sf), start=3, n=4)


@query("head_tail_preview", sql=f"""
WITH {O.LINES},
tot AS (SELECT path, CAST(len(lines) AS INTEGER) AS total_lines FROM files)
SELECT l.path, l.line_no, l.line, t.total_lines FROM lines l JOIN tot t USING (path)
WHERE l.line_no > t.total_lines - 3""", category="search")
def q_head_tail_preview(spark, sf):
    """Last 3 lines of every file with its total."""
    return grep.head_tail_preview(v_file_lines(spark, sf), n=3, tail=True)


@query("preview_text", sql=f"""
WITH {O.FILES},
l AS (SELECT path, len(lines) AS n, list_transform(list_slice(lines, 1, 5), lambda x, i:
        lpad(CAST(i + 9 AS VARCHAR), 3, ' ') || '| ' || regexp_replace(x, '\\s+$', '')) AS shown FROM files)
SELECT path, '[' || regexp_extract(path, '([^/]*)$', 1) || '] Total rows: ' || n || ', remaining rows not shown: ' || greatest(n - 5, 0)
       || chr(10) || repeat('─', 40) || chr(10) || array_to_string(shown, chr(10)) AS text FROM l""", category="search")
def q_preview_text(spark, sf):
    """The head of every file as text, labelled from 10."""
    return grep.preview_text(v_file_lines(spark, sf), start=10)


@query("clip_tail", sql="""
SELECT doc_id, CASE WHEN length(text) > 6144
                    THEN '[Truncated leading part, original length: ' || CAST(length(text) AS VARCHAR) || '] ...' || chr(10)
                         || right(text, 6144) ELSE text END AS clipped
FROM documents""", category="search")
def q_clip_tail(spark, sf):
    """tool results longer than 6,144 chars keep the tail with a note."""
    from quarry.functions.text import clip_tail
    from quarry.sources.tables import read_table
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", clip_tail("text").alias("clipped"))


@query("token_count", sql="""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS INTEGER) AS n_tokens FROM documents""", category="search")
def q_token_count(spark, sf):
    """default tokenizer length of every document."""
    from quarry.functions.text import token_count
    from quarry.sources.tables import read_table
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", token_count("text").alias("n_tokens"))


@query("line_label", sql=f"""
WITH {O.LINES}
SELECT path, line_no, lpad(CAST(line_no AS VARCHAR), CAST(greatest(3, length(CAST(line_no AS VARCHAR))) AS INTEGER), ' ') || '| '
       || regexp_replace(line, '\\s+$', '') AS label
FROM lines""", category="search")
def q_line_label(spark, sf):
    """every line with its number."""
    from quarry.functions.text import line_label
    from quarry.plans.fixtures import v_lines
    p = v_lines(spark, sf)
    return p.select("path", "line_no", line_label(F.col("line_no"), F.col("line")).alias("label"))
