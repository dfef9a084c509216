"""PartEnum join, MinHash bands, verified links: against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import fingerprints, links, partenum
from tests.llm.conftest import odd_rows


def brute(rows, k, percent):
    """doc_id -> (set size, smallest id reachable)"""
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(seed, bases, vocabulary=200):
    """Texts of many sizes with chains of edited copies around the threshold."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for _ in range(bases):
        text = [rng.choice(word) for _ in range(rng.choice([1, 3, 4, 6, 8, 9, 12, 20, 45, 90, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((3 * len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(word)
    rng.shuffle(rows)
    return rows


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_partenum_equals_brute_force(spark, odd):
    rows = family(3, 45) + [(10_000 + i, t) for i, t in odd_rows()]
    got = as_dict(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows, 4, 85)


def one_signature(items):
    return np.array([7], np.uint64)


@pytest.mark.parametrize("small", [100, 2])
def test_one_hot_signature_is_compared_whole(spark, monkeypatch, small):
    """All sets share the only signature; with the small limits only pivots thin
    them out, round after round, and must still find every link."""
    if small == 2:
        for name, value in (("SMALL", 2), ("GROWTH", 1)):
            monkeypatch.setattr(links, name, value)
    rows = family(8, 14) if small == 100 else family(9, 7, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df, make=one_signature)) == brute(rows, 4, 85)


def test_edited_family_by_pivots(spark, monkeypatch):
    """One family of edited, cut and extended copies, thinned out by pivots first."""
    for name, value in (("SMALL", 5), ("GROWTH", 2), ("CELLS", 500)):
        monkeypatch.setattr(links, name, value)
    rng = random.Random(6)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(400)}"
        if rng.random() < 0.3:
            text = text[:rng.randrange(60, 120)]
        if rng.random() < 0.3:
            text += [f"tail{j}" for j in range(rng.choice([4, 9, 25]))]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df)) == brute(rows, 4, 85)


def test_family_of_unlinked_copies(spark):
    """A thousand copies of one text, each edited too far to be linked, among them some links."""
    rng = random.Random(12)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(1_000):
        text = list(base)
        for j in rng.sample(range(120), 6):
            text[j] = f"x{rng.randrange(10 ** 6)}"
        if i % 40 == 0:
            rows.append((10_000 + i, " ".join([*text[:-1], "end"])))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_dict(partenum.jaccard_components(df)) == brute(rows, 4, 85)


def test_bands_find_near_duplicates(spark):
    rows = family(21, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_dict(fingerprints.near_duplicates(df)) == brute(rows, 5, 80)


@pytest.mark.parametrize("size", [6, 7, 9, 20, 33, 60, 150, 700])
def test_similar_sets_share_a_signature(size):
    """The guarantee itself: any two sets at the threshold share a signature."""
    rng = np.random.default_rng(size)
    for _ in range(150):
        a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
        drop, add = rng.integers(0, max(2, size // 6), 2)
        b = np.unique(np.r_[a[drop:], rng.integers(0, 2 ** 63, add, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) or drop or add:
            if 100 * both >= 85 * (len(a) + len(b) - both):
                shared = np.intersect1d(partenum.signatures(a), partenum.signatures(b))
                assert len(shared) or np.array_equal(a, b)


def test_null_ids_and_repeated_ids(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, None), (7, text), (7, text), (3, text + " w31"), (9, None)]
    got = partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got
                   if r.doc_id is not None or r.component_id is None)
    assert len(got) == 6 and [x[2] for x in found if x[0] >= 0] == [3, 3, 3, 9]
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert partenum.jaccard_components(empty).count() == 0
