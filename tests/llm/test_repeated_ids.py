"""Ids that repeat with different texts: each text is judged by itself."""

import corpus_pipeline
from quarry.llm import partenum
from tests.conftest import SF_SMALL

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
NEAR_A, NEAR_B = A + " a60", B + " b60"


def test_texts_of_an_id_link_by_themselves(spark):
    rows = [(1, ""), (1, A), (2, NEAR_A), (3, B), (3, C), (3, C), (4, NEAR_B), (None, A)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = partenum.jaccard_components(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([
        (None, 57, None), (1, 0, 1), (1, 57, 1), (2, 58, 1), (3, 57, 3), (3, 57, 3), (3, 57, 3), (4, 58, 3)], key=str)


def test_components_are_named_by_real_ids(spark):
    rows = [(1, A), (1, B), (2, B), (3, C), (3, C + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in partenum.jaccard_components(df).collect())
    assert got == [(1, 57, 1), (1, 57, 1), (2, 57, 1), (3, 57, 3), (3, 58, 3)]


def test_names_that_two_digests_share():
    """Digests of equal first halves are told apart by the rest."""
    clashes = frozenset({5, -6})
    names = {partenum.node(a, b, clashes) for a in (5, -6, 7) for b in (1, -2)}
    assert len(names) == 5 and 7 in names and all(-2 ** 63 <= n < 2 ** 63 for n in names)


def test_pipeline_keeps_each_different_text(spark):
    rows = [(1, A, "y"), (1, B, "x"), (1, B, "w"), (2, NEAR_A, "x"), (5, C, "x"), (5, "", "x"), (None, A, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, did string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, SF_SMALL).collect()
    assert sum(r.doc_id is None for r in got) == 1
    kept = [tuple(r) for r in got if r.doc_id is not None]
    of_a = [r for r in kept if r[1] in (A, NEAR_A)]
    assert len(of_a) == 1
    assert sorted(r for r in kept if r not in of_a) == [(1, B, "w"), (5, "", "x"), (5, C, "x")]
