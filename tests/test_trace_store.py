"""Evaluation write-back: new versions appear whole, failed writes leave the old one."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import trace_store as TS

SCHEMA = "coverage double, passed boolean"


@pytest.fixture()
def store(spark):
    root = f"{tempfile.mkdtemp(prefix='quarry-test-')}/store"
    messages = spark.range(90).select((F.col("id") % 9).alias("trace_id"), F.floor(F.col("id") / 9).alias("seq"),
                                      F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    meta = spark.createDataFrame([(i, f"task {i}") for i in range(9)] + [(None, "no id")], "trace_id long, task string")
    TS.create(messages, meta, root)
    return root


def _evaluation(spark, rows):
    return spark.createDataFrame(rows, "trace_id long, file_name string, eval_steps array<int>, coverage double, "
                                       "passed boolean")


def _read(spark, root, version=None):
    rows = TS.read_documents(spark, root, SCHEMA, version).collect()
    return {r.trace_id: r.evaluation and tuple(r.evaluation) for r in rows}


def test_write_back(spark, store):
    nothing = {**dict.fromkeys(range(9)), None: None}
    assert _read(spark, store) == nothing
    assert TS.write_evaluation(_evaluation(spark, [(1, "a", [1], 0.5, False), (2, "b", None, 1.0, True),
                                                   (77, "c", [], 1.0, True), (None, "d", [], 1.0, True)]), store) == 2
    assert _read(spark, store) == {**nothing, 1: (0.5, False), 2: (1.0, True)}
    # a later one replaces it whole, nulls included; the largest text of a repeated trace stays; others keep theirs
    TS.write_evaluation(_evaluation(spark, [(1, "a", [], None, True), (5, "a", [], 0.25, True),
                                            (5, "a", [], 0.75, False)]), store)
    assert _read(spark, store) == {**nothing, 1: (None, True), 2: (1.0, True), 5: (0.75, False)}
    assert _read(spark, store, 1) == nothing
    assert "file_name" not in TS._read_headers(spark, store, TS._manifest(spark, store, 2)[1], range(TS.BUCKETS)) \
        .where("trace_id = 1").first().evaluation
    assert TS.write_evaluation(_evaluation(spark, []), store) == 4
    assert _read(spark, store) == _read(spark, store, 3)
    assert TS.read_messages(spark, store).count() == 90


def test_failed_write_leaves_the_version(spark, store):
    TS.write_evaluation(_evaluation(spark, [(3, "a", [], 1.0, True)]), store)
    before = _read(spark, store)
    bad = _evaluation(spark, [(3, "a", [], 0.0, False), (4, "a", [], 0.0, False)]) \
        .withColumn("coverage", F.when(F.col("trace_id") == 4, F.raise_error(F.lit("lost"))).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        TS.write_evaluation(bad, store)
    assert TS.versions(spark, store) == [1, 2] and _read(spark, store) == before


def test_two_writers_of_a_version(spark, store):
    version, manifest = TS._manifest(spark, store, None)
    TS.write_evaluation(_evaluation(spark, [(3, "a", [], 1.0, True)]), store)
    with pytest.raises(Exception, match="exist"):
        TS._commit(spark, store, version + 1, manifest)
    assert _read(spark, store)[3] == (1.0, True)
