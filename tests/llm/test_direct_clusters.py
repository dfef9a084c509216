"""Clusters that one product can hold are compared at once."""

import random

import numpy as np

from quarry.llm import links, partenum
from tests.llm.test_links_and_sets import as_dict, brute


def test_clusters_of_some_hundred_members_make_no_item_rows(spark, monkeypatch):
    """Unlike texts with a common passage fill one cluster; none of their items becomes a row."""
    rng, rounds, compared = random.Random(4), [], links.compared
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(300)]
    rows += [(1_000 + i, rows[i][1] + " end") for i in range(0, 300, 30)]

    def spy(*args):
        out = compared(*args)
        rounds.append(out[1])
        return out

    monkeypatch.setattr(links, "compared", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df, make=lambda items: np.array([7], np.uint64))) == brute(rows, 4, 85)
    assert rounds == [None]
