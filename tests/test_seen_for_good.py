"""A key that was seen once stays skipped, in later batches and later runs."""

import datetime as dt
import tempfile
import time

import pytest

from quarry.streaming import streams as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


@pytest.mark.parametrize("merge_after", [16, 1])
def test_key_of_ten_days_ago_stays_skipped(spark, merge_after):
    d, base = tempfile.mkdtemp(prefix="quarry-arrive-"), tempfile.mkdtemp(prefix="quarry-seen-")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    arrivals = [[(1, day(0), 1, "a"), (2, day(0), None, "a"), (3, day(0), 1, "a")],
                [(4, day(5), 2, "a"), (5, day(5), None, "a")],
                [(6, day(6), 2, None), (7, day(4), 3, "late")],  # late rows are no less new
                [(8, day(10), 1, "a"), (9, day(10), 2, None), (10, day(10), 4, "a")]]
    for n, rows in enumerate(arrivals):  # each batch is a run of its own
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{d}/b={n}")
        time.sleep(1.1)
        stream = S.event_stream(spark, f"{d}/b=*").select("event_id", "ts", "user_id", "event_type")
        got = S.new_items(stream, "seen", ["user_id", "event_type"], folder=base, merge_after=merge_after)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 4, 6, 7, 10]
    assert bool(S._batches(spark, f"{base}/merged")) == (merge_after == 1)
