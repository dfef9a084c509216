"""Sketches rule out pairs before any set is made or sent, and never a similar one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import links, partenum
from tests.llm.test_links_and_sets import as_dict, brute


def test_unlike_texts_make_no_sets(spark, monkeypatch):
    """All texts share a passage and their only signature, but few are similar: the others' items stay unmade."""
    rng, made, store = random.Random(4), {}, partenum.store
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(150)]
    rows += [(1_000 + i, rows[i][1] + " end") for i in range(0, 150, 30)]

    def spy(df, name):
        out = store(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(partenum, "store", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df, make=lambda items: np.array([7], np.uint64))) == brute(rows, 4, 85)
    assert made["item_sets"] <= 10


def families(rng, sizes):
    """Sets of these sizes, each with two copies around the threshold."""
    out = []
    for n in sizes:
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        for drop in (n // 20, n // 8):
            out.append(np.unique(np.r_[a[drop:], rng.integers(0, 2 ** 64, n // 30, dtype=np.uint64)]))
        out.append(a)
    out.append(np.arange(700, dtype=np.uint64))  # one part holds more than a byte can count
    out.append(np.arange(20, 700, dtype=np.uint64))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_parts_keep_every_similar_pair(percent):
    sets = families(np.random.default_rng(percent), [1, 5, 40, 250, 1_000, 1_030, 2_100, 9_000, 9_000])
    ids = np.arange(len(sets)) * 7 - 20
    table = pa.table({"id": ids, "component": ids, "size": [len(s) for s in sets], "sketch": [links.sketch(s) for s in sets]})
    found = links.likely_parts(percent)(table.take(list(reversed(range(len(sets))))))
    part = dict(zip(found.column("id").to_pylist(), found.column("part").to_pylist(), strict=True))
    similar = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                similar += 1
                assert part[ids[i]] == part[ids[j]]
    assert similar >= 15 and len(set(part.values())) >= 7


@pytest.mark.parametrize("places", [1_000_000, 0])
def test_texts_stay_in_place(spark, monkeypatch, places):
    """Whatever Spark's own threshold is, a bounded number of places travels, not the texts."""
    monkeypatch.setattr(partenum, "PLACES", places)
    plans, store = [], partenum.store

    def spy(df, name):
        if name == "item_sets":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return store(df, name)

    monkeypatch.setattr(partenum, "store", spy)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"{text} {i}") for i in range(4)] + [(9, "alone")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert as_dict(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 4, 85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and all(("BroadcastHashJoin" in p) == (places > 0) for p in plans)
