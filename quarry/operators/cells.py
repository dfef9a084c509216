"""Cell-table cleaning and reshaping.

Cells are long: ``(path, sheet, r INT, c INT, value STRING)`` (1-based), so a
file of any width or height is just rows; merged ranges are
``(path, sheet, r0, r1, c0, c1)`` (inclusive).  Per-file state is carried
by aggregates and by ``scan.prefix_scan``; nothing collects a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import py_strip
from quarry.operators.scan import prefix_scan, seq_chunk

FILE = ["path", "sheet"]
# strict number syntax (Spark's cast also takes '1d', '1f'; Python's int/float do not)
NUM_RE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INT_RE = r"^[+-]?\d+$"
JUNK_RE = r"(?i)^Unnamed:\s*\d+$"
# rows per piece when a merged range is expanded into its cells
RANGE_PIECE_ROWS = 4096


def is_junk(x) -> Column:
    """NULL, blank, or a pandas placeholder header ``Unnamed: n``."""
    c = F.col(x) if isinstance(x, str) else x
    s = py_strip(c)
    return c.isNull() | (s == "") | s.rlike(JUNK_RE)


def normalize_cell(x) -> Column:
    """STRUCT<text, num DOUBLE, is_int>.

    Blank → ''.  Strip, drop every ',' and '%'; an int or float parses to
    ``num`` (÷100 when the text ended in '%'); otherwise the untrimmed
    original text is kept and ``num`` is NULL.
    """
    c = F.col(x) if isinstance(x, str) else x
    t = py_strip(c)
    clean = F.regexp_replace(t, "[,%]", "")
    pct = F.endswith(t, F.lit("%"))
    ok = clean.rlike(NUM_RE)
    num = F.when(ok, clean.try_cast("double"))
    num = F.when(pct, num / 100).otherwise(num)
    blank = c.isNull() | (t == "")
    return F.struct(F.when(blank, F.lit("")).when(ok, clean).otherwise(c).alias("text"),
                    F.when(~blank, num).alias("num"),
                    (~blank & clean.rlike(INT_RE) & ~pct).alias("is_int"))


def fit_row_width(arr, width: int) -> Column:
    """pad with '' or cut each row to ``width``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(F.concat(a, F.array_repeat(F.lit(""), width)), 1, width)


def excel_date(serial, date1904: bool = False) -> Column:
    """Excel serial day number → 'Y-MM-DD' text (NULL when empty)."""
    s = F.col(serial) if isinstance(serial, str) else serial
    base = F.lit("1904-01-01" if date1904 else "1899-12-30").cast("date")
    d = F.date_add(base, F.floor(s.try_cast("double")).cast("int"))
    return F.when(s.isNotNull() & (py_strip(s.cast("string")) != ""), F.date_format(d, "y-MM-dd"))


def drop_junk(cells: DataFrame) -> DataFrame:
    """Drop leading all-junk rows, then columns junk in every remaining row.

    The first kept row is ``min(r)`` of rows with a non-junk cell; kept
    columns are renumbered densely over the small per-file column table.
    """
    j = cells.withColumn("_ok", ~is_junk("value"))
    start = j.where("_ok").groupBy(*FILE).agg(F.min("r").alias("_start"))
    rest = j.join(start, FILE).where(F.col("r") >= F.col("_start"))
    cols = rest.groupBy(*FILE, "c").agg(F.bool_or("_ok").alias("_keep")).where("_keep")
    cols = cols.withColumn("_c", F.row_number().over(Window.partitionBy(*FILE).orderBy("c")))
    out = rest.join(cols.select(*FILE, "c", "_c"), [*FILE, "c"])
    return out.select(*FILE, (F.col("r") - F.col("_start") + 1).alias("r"), F.col("_c").alias("c"), "value")


def fill_merged_cells(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Every cell of a merged rectangle takes its top-left value; a
    later range overwrites an earlier one.

    The range join becomes equi-joins: ranges expand to the cells they cover
    (output-sized), the latest range per cell wins by ``max_by``, then the
    top-left value is looked up on (file, r0, c0).
    """
    m = merged.withColumn("_ord", F.monotonically_increasing_id()) if "range_no" not in merged.columns \
        else merged.withColumn("_ord", F.col("range_no"))
    # a range may span millions of rows: cut it into row pieces first and
    # spread the pieces over tasks, so no single task expands a huge range
    blk = F.explode(F.sequence(F.floor(F.col("r0") / RANGE_PIECE_ROWS), F.floor(F.col("r1") / RANGE_PIECE_ROWS)))
    pieces = m.select(*FILE, "r0", "r1", "c0", "c1", "_ord", blk.alias("_blk"))
    pieces = pieces.select(*FILE, "r0", "c0", "c1", "_ord",
                           F.greatest("r0", F.col("_blk") * RANGE_PIECE_ROWS).cast("int").alias("_p0"),
                           F.least("r1", F.col("_blk") * RANGE_PIECE_ROWS + RANGE_PIECE_ROWS - 1).cast("int")
                           .alias("_p1")).repartition(*FILE, "_p0")
    cover = pieces.select(*FILE, "r0", "c0", "_ord", F.explode(F.sequence("_p0", "_p1")).alias("r"), "c1") \
        .select(*FILE, "r0", "c0", "_ord", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    win = cover.groupBy(*FILE, "r", "c").agg(F.max_by(F.struct("r0", "c0"), "_ord").alias("_src"))
    tl = cells.select(*FILE, F.col("r").alias("_r0"), F.col("c").alias("_c0"), F.col("value").alias("_tl"))
    src = win.select(*FILE, "r", "c", F.col("_src.r0").alias("_r0"), F.col("_src.c0").alias("_c0")) \
        .join(tl, [*FILE, "_r0", "_c0"], "left")
    out = cells.join(src.select(*FILE, "r", "c", "_tl", F.lit(True).alias("_in")), [*FILE, "r", "c"], "left")
    return out.select(*FILE, "r", "c", F.when(F.col("_in").isNotNull(), F.col("_tl")).otherwise(F.col("value"))
                      .alias("value"))


def flatten_header(cells: DataFrame, n_rows: int) -> DataFrame:
    """First ``n_rows`` rows → one '-'-joined label per column.

    V = last non-empty value above (inclusive) in the column; F = V, else
    the last non-empty V to the left in that row; label = distinct F in
    row order.  Windows run over the header rows only.
    """
    h = cells.where(F.col("r") <= n_rows).withColumn(
        "_v0", F.when(~(F.col("value").isNull() | (py_strip(F.col("value")) == "")), py_strip(F.col("value"))))
    wv = Window.partitionBy(*FILE, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_v", F.last("_v0", ignorenulls=True).over(wv))
    wh = Window.partitionBy(*FILE, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_f", F.coalesce("_v", F.last("_v", ignorenulls=True).over(wh)))
    lab = h.groupBy(*FILE, "c").agg(F.sort_array(F.collect_list(F.struct("r", "_f"))).alias("_l"))
    label = F.array_join(F.array_distinct(F.filter(F.transform("_l", lambda s: s["_f"]), lambda x: x.isNotNull())), "-")
    return lab.select(*FILE, "c", label.alias("label"))


def flatten_banner_rows(cells: DataFrame, label_col: str = "group") -> DataFrame:
    """A row whose non-blank cells all hold one value is a banner; rows
    below inherit it as a new column until the next banner; banners drop.

    Banner ordinal = running count of banners (skew-safe prefix scan); the
    label is an equi-join on (file, ordinal) — no per-file window.
    """
    nb = F.when(~(F.col("value").isNull() | (py_strip(F.col("value")) == "")), F.col("value"))
    rows = cells.groupBy(*FILE, "r").agg(F.min(nb).alias("_lo"), F.max(nb).alias("_hi"))
    rows = rows.withColumn("_banner", F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False)))
    rows = prefix_scan(rows, FILE, ["r"], {"_bno": F.col("_banner").cast("int")}, chunk=seq_chunk("r"))
    banners = rows.where("_banner").select(*FILE, "_bno", F.col("_lo").alias(label_col))
    keep = rows.where(~F.col("_banner")).select(*FILE, "r", "_bno")
    lab = keep.join(banners, [*FILE, "_bno"], "left").select(*FILE, "r", label_col)
    return cells.join(lab, [*FILE, "r"]).select(*FILE, "r", "c", "value", label_col)


def split_discrete_tables(lines: DataFrame, key=("path",), order: str = "line_no", text: str = "line") -> DataFrame:
    """Blank rows divide independent tables; island id = 1 + blank rows
    before; blank rows dropped."""
    blank = (F.col(text).isNull() | (py_strip(F.col(text)) == "")).cast("int")
    s = prefix_scan(lines.withColumn("_blank", blank), list(key), [order], {"_nb": F.col("_blank")},
                    chunk=seq_chunk(order))
    return s.where("_blank = 0").select(*key, (F.col("_nb") + 1).cast("int").alias("table_no"), order, text)


def unpivot_repeated(df: DataFrame, ids: list[str], values: list[str], group: str = "group",
                     value: str = "value") -> DataFrame:
    """Fixed columns kept, repeated columns become (group, value) rows."""
    return df.unpivot(ids, values, group, value)


# -------------------------------------------------------- documents
def _fields(line: Column) -> Column:
    return F.split(line, ",", -1)


def column_profile(lines: DataFrame, n_rows: int = 5, n_values: int = 5) -> DataFrame:
    """A13 + F3: per column of each file, name and up to ``n_values``
    non-blank values from the first ``n_rows`` data lines (naive split)."""
    head = lines.where(F.col("line_no") == 1).select("path", F.posexplode(_fields(F.col("line"))).alias("c0", "column"))
    data = lines.where((F.col("line_no") >= 2) & (F.col("line_no") <= n_rows + 1)) \
        .select("path", "line_no", F.posexplode(_fields(F.col("line"))).alias("c0", "v")) \
        .where(py_strip(F.col("v")) != "")
    samp = data.groupBy("path", "c0").agg(F.sort_array(F.collect_list(F.struct("line_no", "v"))).alias("_s"))
    j = head.join(samp, ["path", "c0"], "left")
    vals = F.slice(F.transform(F.coalesce("_s", F.array()), lambda x: x["v"]), 1, n_values)
    sample = F.array_join(vals, ", ")
    text = F.concat(F.lit("Table path: "), F.col("path"), F.lit(" | Column name: "), F.col("column"),
                    F.lit(" | Sample values: "), sample)
    return j.select("path", (F.col("c0") + 1).alias("col_no"), "column", sample.alias("sample_values"),
                    text.alias("text"))


def row_documents(lines: DataFrame) -> DataFrame:
    """``"Table path: p\\n" + "h1: v1 | h2: v2"`` per data line (line ≥ 2),
    header and values zipped to the shorter side.  A hash table of the headers meets the
    lines as they come: sorted by path, all lines of a task would be held with their values."""
    head = lines.where(F.col("line_no") == 1).select("path", _fields(F.col("line")).alias("_h"))
    rows = lines.where(F.col("line_no") >= 2).select("path", "line_no", _fields(F.col("line")).alias("_v"))
    j = rows.join(head.hint("shuffle_hash"), "path")
    n = F.least(F.size("_h"), F.size("_v"))
    parts = F.zip_with(F.slice("_h", 1, n), F.slice("_v", 1, n), lambda h, v: F.concat(h, F.lit(": "), v))
    text = F.concat(F.lit("Table path: "), F.col("path"), F.lit("\n"), F.array_join(parts, " | "))
    return j.select("path", "line_no", text.alias("text"))


def table_documents(files: DataFrame, n_lines: int = 5) -> DataFrame:
    """name, relative path and the first ``n_lines`` lines (the table's
    preview) of each table.  The preview is not cut further: whole lines go
    to the encoder, which batches by length."""
    prev = F.array_join(F.slice("lines", 1, n_lines), "\n")
    name = F.element_at(F.split("path", "/"), -1)
    text = F.concat(F.lit("Table Name: "), name, F.lit("\nTable Path: "), F.col("path"),
                    F.lit("\nTable Content Preview:\n"), prev)
    return files.select("path", text.alias("text"))


def describe_table(desc: DataFrame) -> DataFrame:
    """path, description and column list as text; a null part is left out."""
    cols = F.array_join(F.concat(F.array(F.lit("Column information:")), F.transform("column_info", lambda ci: F.concat(
        F.lit("  - "), F.coalesce(ci["col_name"], F.lit("Unknown")), F.lit(" ("), F.coalesce(ci["col_type"], F.lit("")),
        F.lit("): "), F.coalesce(ci["col_desc"], F.lit(""))))), "\n")
    return desc.select("file_path", F.concat_ws("\n", F.concat(F.lit("File path: "), F.col("file_path")),
                                                F.concat(F.lit("Table description: "), F.col("table_desc")), cols).alias("text"))
