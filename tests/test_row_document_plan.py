"""Row documents don't sort the lines of a file."""

from quarry.operators import cells as C


def test_lines_are_not_sorted_by_path(spark):
    rows = [("a", 1, "h,k"), ("a", 2, "1,2,3"), ("a", 3, "4"), ("b", 2, "5"), (None, 1, "x"), ("c", 1, "only")]
    lines = spark.createDataFrame(rows, "path string, line_no int, line string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.row_documents(lines)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
        assert {tuple(r) for r in out.collect()} == {("a", 2, "Table path: a\nh: 1 | k: 2"), ("a", 3, "Table path: a\nh: 4")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
