"""Many texts at once give the sets and signatures of each; wide clusters meet in blocks, edges in one task."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import links, partenum, words
from tests.llm.conftest import odd_rows
from tests.llm.test_links_and_sets import as_dict, brute


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_word_hashes_tell_the_words(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = ["skipped", "", " ", "A b", "é É x", "a\tb\x0bc\x0cd\re\nf", "\x85 \xa0 y", " " * 9000 + "q w", "xy" * 5000 + " " + "yx" * 5000, "end",
             *(t or "" for _, t in odd_rows())]
    cut, hashes, many = [w for t in texts[1:] for w in words.words(t)], [], []
    for part in words.blocks(pa.array(texts).slice(1)):
        h, n = words.word_hashes(part)
        hashes += h.tolist()
        many += n.tolist()
    assert many == [len(words.words(t)) for t in texts[1:]]
    assert len(hashes) == len(cut) and len(set(hashes)) == len(set(cut)) == len(set(zip(hashes, cut, strict=True)))


@pytest.mark.parametrize("k", [4, 5])
def test_shingle_sets_are_those_of_each_text(k):
    texts = [t or "" for _, t in odd_rows()] + ["a b c", "a b c d", "a b c d e"]
    items, ends = words.shingle_sets(pa.array(texts), k)
    sets = [items[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    old = [np.unique(words.shingles(t, k)).tolist() for t in texts]
    assert all(s == sorted(set(s)) for s in sets)
    for i, a in enumerate(sets):
        for j in range(i + 1):
            assert len({*a} & {*sets[j]}) == len({*old[i]} & {*old[j]})


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_of_many_sets_are_those_of_each(percent):
    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for n in [0, 1, 2, 5, *range(9, 30), 0, 45, 90, 400, 3000, 0]]
    sigs, of = partenum.signature_sets(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])], percent)
    for i, s in enumerate(sets):
        assert np.array_equal(np.sort(sigs[of == i]), partenum.signatures(s, percent))
    assert len(partenum.signature_sets(np.zeros(0, np.uint64), np.zeros(3, np.int64), percent)[0]) == 0


def test_clusters_of_some_blocks_need_no_pivots(spark, monkeypatch):
    """A cluster of eight times the members that one product holds, and no item of it becomes a row."""
    monkeypatch.setattr(links, "SMALL", 40)
    rng, rounds, compared = random.Random(5), [], links.compared
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(250)]
    rows += [(1_000 + i, rows[i][1] + " end") for i in range(0, 250, 10)]

    def spy(*args):
        out = compared(*args)
        rounds.append(out[1])
        return out

    monkeypatch.setattr(links, "compared", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df, make=lambda items: np.array([7], np.uint64))) == brute(rows, 4, 85)
    assert rounds == [None]


@pytest.mark.parametrize("edges", [500_000, 0])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(links, "EDGES", edges)
    rng = random.Random(9)
    pairs = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(20)] + [(5, 5)]
    up = {x: x for p in pairs for x in p}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert got == {x: c for x, c in up.items() if x != c}
    more = spark.createDataFrame([(1003, -150), (7, 2000)], "a long, b long")
    first = links.components(spark.createDataFrame([(1000, 1003), (2000, 3000)], "a long, b long"))
    assert {tuple(r) for r in links.merged(first, more).collect()} == {(1000, -150), (1003, -150), (2000, 7), (3000, 7)}
    none = spark.createDataFrame([], "a long, b long")
    assert links.components(none).count() == 0
