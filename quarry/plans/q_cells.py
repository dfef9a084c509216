"""Registered cell / header / document queries (V-cells, V-rows, V-lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.plans import oracle as O
from quarry.plans.fixtures import v_cells, v_file_lines, v_lines, v_merged, v_row_lines
from quarry.registry import query
from quarry.sources.tables import read_table

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
JUNK = f"({{0}} IS NULL OR {STRIP.format('{0}')} = '' OR regexp_matches({STRIP.format('{0}')}, '(?i)^Unnamed:\\s*\\d+$'))"


def junk(x):
    return JUNK.format(x)


def _cells(spark, sf):
    """The cell table as a stored input: derived once and checkpointed in the
    shared folder, since the cleaning operators read it several times."""
    from quarry.session import cut_lineage
    return cut_lineage(v_cells(spark, sf))


def _row_lines(spark, sf):
    from quarry.session import cut_lineage
    return cut_lineage(v_row_lines(spark, sf))


@query("junk_predicate", sql=f"""
WITH {O.CELLS}
SELECT path, sheet, r, c, {junk('value')} AS is_junk FROM cells""", category="cells")
def q_junk_predicate(spark, sf):
    """Junk flag of every cell."""
    return v_cells(spark, sf).select("path", "sheet", "r", "c", C.is_junk("value").alias("is_junk"))


NUM = "'^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$'"


@query("normalize_cell", sql=f"""
WITH {O.CELLS},
n AS (SELECT *, {STRIP.format('value')} AS t, regexp_replace({STRIP.format('value')}, '[,%]', '', 'g') AS cl FROM cells)
SELECT path, sheet, r, c,
       CASE WHEN value IS NULL OR t = '' THEN '' WHEN regexp_matches(cl, {NUM}) THEN cl ELSE value END AS text,
       CASE WHEN value IS NULL OR t = '' THEN NULL WHEN regexp_matches(cl, {NUM})
            THEN CASE WHEN ends_with(t, '%') THEN CAST(cl AS DOUBLE) / 100 ELSE CAST(cl AS DOUBLE) END END AS num,
       NOT (value IS NULL OR t = '') AND regexp_matches(cl, '^[+-]?\\d+$') AND NOT ends_with(t, '%') AS is_int
FROM n""", category="cells")
def q_normalize_cell(spark, sf):
    """cell text → number (thousands separators, percent)."""
    n = C.normalize_cell("value")
    return v_cells(spark, sf).select("path", "sheet", "r", "c", n["text"].alias("text"), n["num"].alias("num"),
                                     n["is_int"].alias("is_int"))


DROP = f"""
j AS (SELECT *, NOT {junk('value')} AS ok FROM cells),
st AS (SELECT path, sheet, min(r) AS s FROM j WHERE ok GROUP BY ALL),
rest AS (SELECT j.*, st.s FROM j JOIN st USING (path, sheet) WHERE r >= s),
kc AS (SELECT path, sheet, c, row_number() OVER (PARTITION BY path, sheet ORDER BY c) AS nc
       FROM rest GROUP BY path, sheet, c HAVING bool_or(ok)),
dropped AS (SELECT rest.path, rest.sheet, CAST(r - s + 1 AS INTEGER) AS r, CAST(kc.nc AS INTEGER) AS c, value
            FROM rest JOIN kc USING (path, sheet, c))"""


@query("drop_junk", sql=f"WITH {O.CELLS}, {DROP} SELECT * FROM dropped", category="cells")
def q_drop_junk(spark, sf):
    """Leading junk rows and all-junk columns removed, renumbered."""
    return C.drop_junk(_cells(spark, sf))


@query("fill_merged_cells", sql=f"""
WITH {O.CELLS},
cover AS (SELECT path, sheet, r0, c0, range_no, unnest(range(r0, r1 + 1)) AS r, c1 FROM merged),
cover2 AS (SELECT path, sheet, r0, c0, range_no, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, c0 AS cstart FROM cover)),
win AS (SELECT path, sheet, r, c, arg_max(r0, range_no) AS r0, arg_max(c0, range_no) AS c0 FROM cover2 GROUP BY ALL),
src AS (SELECT w.path, w.sheet, w.r, w.c, t.value AS tl FROM win w
        LEFT JOIN cells t ON t.path = w.path AND t.sheet = w.sheet AND t.r = w.r0 AND t.c = w.c0)
SELECT c.path, c.sheet, c.r, c.c, CASE WHEN s.r IS NOT NULL THEN s.tl ELSE c.value END AS value
FROM cells c LEFT JOIN src s ON s.path = c.path AND s.sheet = c.sheet AND s.r = c.r AND s.c = c.c""",
       category="cells")
def q_fill_merged_cells(spark, sf):
    """Merged ranges filled with their top-left value."""
    return C.fill_merged_cells(v_cells(spark, sf), v_merged(spark, sf))


@query("flatten_header", sql=f"""
WITH {O.CELLS}, {DROP},
h AS (SELECT *, CASE WHEN NOT (value IS NULL OR {STRIP.format('value')} = '') THEN {STRIP.format('value')} END AS v0
      FROM dropped WHERE r <= 2),
hv AS (SELECT *, last(v0 IGNORE NULLS) OVER (PARTITION BY path, sheet, c ORDER BY r ROWS UNBOUNDED PRECEDING) AS v FROM h),
hf AS (SELECT *, coalesce(v, last(v IGNORE NULLS) OVER (PARTITION BY path, sheet, r ORDER BY c
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS f FROM hv)
SELECT path, sheet, c, array_to_string(list_filter(lst, lambda x, i: list_position(lst, x) = i), '-') AS label
FROM (SELECT path, sheet, c, list(f ORDER BY r) FILTER (WHERE f IS NOT NULL) AS lst FROM hf GROUP BY path, sheet, c)""", category="cells")
def q_flatten_header(spark, sf):
    """Two header rows flattened into one label per column."""
    return C.flatten_header(C.drop_junk(_cells(spark, sf)), 2)


@query("flatten_banner_rows", sql=f"""
WITH {O.CELLS}, {DROP},
rows AS (SELECT path, sheet, r,
                list_distinct(list(value) FILTER (WHERE NOT (value IS NULL OR {STRIP.format('value')} = ''))) AS vals
         FROM dropped GROUP BY ALL),
rb AS (SELECT *, len(vals) = 1 AS banner,
              sum(CASE WHEN len(vals) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, sheet ORDER BY r) AS bno FROM rows),
lab AS (SELECT k.path, k.sheet, k.r, b.vals[1] AS grp FROM rb k LEFT JOIN rb b
          ON b.path = k.path AND b.sheet = k.sheet AND b.banner AND b.bno = k.bno WHERE NOT k.banner)
SELECT d.path, d.sheet, d.r, d.c, d.value, lab.grp AS "group" FROM dropped d JOIN lab USING (path, sheet, r)""",
       category="cells")
def q_flatten_banner_rows(spark, sf):
    """Banner rows become a 'group' column of the rows below."""
    return C.flatten_banner_rows(C.drop_junk(_cells(spark, sf)))


@query("split_discrete_tables", sql=f"""
WITH {O.LINES},
b AS (SELECT *, CAST(line IS NULL OR {STRIP.format('line')} = '' AS INTEGER) AS blank FROM lines),
s AS (SELECT *, sum(blank) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS nb FROM b)
SELECT path, CAST(nb + 1 AS INTEGER) AS table_no, line_no, line FROM s WHERE blank = 0""", category="cells")
def q_split_discrete_tables(spark, sf):
    """Blank lines split each file into independent tables."""
    return C.split_discrete_tables(v_lines(spark, sf))


@query("excel_date", sql="""
SELECT s_suppkey, strftime(DATE '1899-12-30' + CAST(floor(abs(s_acctbal)) AS INTEGER), '%Y-%m-%d') AS day
FROM supplier""", category="cells")
def q_excel_date(spark, sf):
    """serial day numbers (|acctbal|) → dates."""
    s = read_table(spark, sf, "supplier", ["s_suppkey", "s_acctbal"])
    return s.select("s_suppkey", C.excel_date(F.abs("s_acctbal").cast("string")).alias("day"))


@query("fit_row_width", sql=f"""
WITH {O.ROW_LINES}
SELECT path, line_no, list_slice(list_concat(string_split(line, ','), ['', '', '', '']), 1, 4) AS cells FROM pl""",
       category="cells")
def q_fit_row_width(spark, sf):
    """every CSV row padded / cut to 4 fields."""
    rl = v_row_lines(spark, sf)
    return rl.select("path", "line_no", C.fit_row_width(F.split("line", ",", -1), 4).alias("cells"))


@query("unpivot_repeated", sql="""
SELECT p_partkey, "group", value FROM (
  UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)
  ON p_size, p_retailprice INTO NAME "group" VALUE value)""", category="cells")
def q_unpivot_repeated(spark, sf):
    """Repeated measure columns → (group, value) rows."""
    p = read_table(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice"]) \
        .withColumn("p_size", F.col("p_size").cast("double"))
    return C.unpivot_repeated(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query("column_profile", sql=f"""
WITH {O.ROW_LINES},
head AS (SELECT path, unnest(string_split(line, ',')) AS "column", generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no = 1),
data AS (SELECT path, line_no, unnest(string_split(line, ',')) AS v, generate_subscripts(string_split(line, ','), 1) AS col_no
         FROM pl WHERE line_no BETWEEN 2 AND 6),
samp AS (SELECT path, col_no, list_slice(list(v ORDER BY line_no), 1, 5) AS vals FROM data
         WHERE {STRIP.format('v')} <> '' GROUP BY ALL)
SELECT h.path, CAST(h.col_no AS INTEGER) AS col_no, h."column", array_to_string(coalesce(s.vals, []), ', ') AS sample_values,
       'Table path: ' || h.path || ' | Column name: ' || h."column" || ' | Sample values: '
         || array_to_string(coalesce(s.vals, []), ', ') AS text
FROM head h LEFT JOIN samp s USING (path, col_no)""", category="cells")
def q_column_profile(spark, sf):
    """Column documents with sample values."""
    return C.column_profile(v_row_lines(spark, sf))


@query("row_document", sql=f"""
WITH {O.ROW_LINES},
h AS (SELECT path, string_split(line, ',') AS hs FROM pl WHERE line_no = 1)
SELECT r.path, r.line_no, 'Table path: ' || r.path || chr(10) || array_to_string(
         list_transform(range(1, least(len(h.hs), len(string_split(r.line, ','))) + 1),
                        lambda i: h.hs[i] || ': ' || string_split(r.line, ',')[i]), ' | ') AS text
FROM pl r JOIN h USING (path) WHERE r.line_no >= 2""", category="cells")
def q_row_document(spark, sf):
    """one retrieval document per CSV row."""
    return C.row_documents(v_row_lines(spark, sf))


@query("table_document", sql=f"""
WITH {O.FILES}
SELECT path, 'Table Name: ' || regexp_extract(path, '([^/]*)$', 1) || chr(10) || 'Table Path: ' || path || chr(10)
       || 'Table Content Preview:' || chr(10) || array_to_string(list_slice(lines, 1, 5), chr(10)) AS text
FROM files""", category="cells")
def q_table_document(spark, sf):
    """table preview documents (name, path, first 5 lines)."""
    return C.table_documents(v_file_lines(spark, sf))


@query("describe_table", sql=f"""
WITH {O.ROW_LINES},
d AS (SELECT path, count(*) - 1 AS n, max(CASE WHEN line_no = 1 THEN line END) AS header FROM pl GROUP BY path)
SELECT path AS file_path, 'File path: ' || path
       || CASE WHEN n % 3 = 0 THEN '' ELSE chr(10) || 'Table description: ' || CAST(n AS VARCHAR) || ' rows' END
       || CASE WHEN n % 4 = 0 THEN '' ELSE chr(10) || 'Column information:' || chr(10) || array_to_string(list_transform(
            string_split(header, ','), lambda x: '  - ' || CASE WHEN x = 'p_size' THEN 'Unknown' ELSE x END
            || ' (' || CASE WHEN x = 'p_name' THEN '' ELSE 'string' END || '): '), chr(10)) END AS text
FROM d""", category="cells")
def q_describe_table(spark, sf):
    """table description text from a (path, desc, columns) record; some
    records lack the description, the columns, a column's name or type."""
    rl = v_row_lines(spark, sf)
    d = rl.groupBy("path").agg((F.count("*") - 1).alias("n"),
                               F.max(F.when(F.col("line_no") == 1, F.col("line"))).alias("header"))
    columns = F.transform(F.split("header", ","), lambda x: F.struct(
        F.when(x != "p_size", x).alias("col_name"), F.when(x != "p_name", "string").alias("col_type"),
        F.lit(None).cast("string").alias("col_desc")))
    desc = d.select(F.col("path").alias("file_path"),
                    F.when(F.col("n") % 3 != 0, F.concat(F.col("n").cast("string"), F.lit(" rows"))).alias("table_desc"),
                    F.when(F.col("n") % 4 != 0, columns).alias("column_info"))
    return C.describe_table(desc)
