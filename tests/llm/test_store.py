"""A stored table's shuffle files go with its write."""

import os
import time

from pyspark.sql import functions as F

from quarry.llm import common


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {os.path.join(r, f) for d in env.blockManager().diskBlockManager().localDirs()
            for r, _, fs in os.walk(d.getPath()) for f in fs if f.startswith("shuffle_")}


def test_store_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = common.store(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "cleanup_test")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 100
    assert spark.conf.get(common.CLEANUP, "false") == "false"
