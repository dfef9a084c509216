"""Interval expansion and passage removal: against brute force."""

import hashlib
import random
from collections import defaultdict

from quarry.llm import bwt, suffix_dedup
from tests.llm.conftest import odd_rows


def test_repeated_substrings_of_a_block():
    rng = random.Random(3)
    for _ in range(80):
        least = rng.choice([1, 2, 3, 5, 8, 20])
        letters = rng.choice([b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
        pool = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(4)]
        strings = [b"".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 20))]
        places = defaultdict(set)
        for i, s in enumerate(strings):
            for j in range(len(s) - least + 1):
                places[s[j:j + least]].add((i, j))
        got = defaultdict(set)
        for a, b, c in zip(*(x.tolist() for x in bwt.repeated(strings, least)), strict=True):
            got[c].add((a, b))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in places.values() if len(v) > 1}


def brute(rows):
    first, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if first.setdefault(raw[s:s + 100], (d, s)) != (d, s):
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(b for b, m in zip(raw, gone, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(gone) if m and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    from tests.llm.conftest import words

    shared = [words(rng, 60) for _ in range(4)]
    rows = []
    for i in range(150):
        text = words(rng, rng.choice([0, 3, 30]))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            text += p[a:a + rng.choice([90, 99, 100, 101, 150, 300])] + words(rng, rng.choice([0, 5, 20]))
        rows.append((7 * i, text))
    return rows + [(9000, "ab" * 300), (9001, "x" * 600)]


def report(df):
    return {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_report(df).collect()}


def test_removal_equals_brute_force(spark, odd):
    assert report(odd) == brute(odd_rows())
    rows = passages(2)
    assert report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_crowded_anchors_are_made_longer(spark, monkeypatch):
    """Small limits force every level of the splitting; results stay the same."""
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    rows = passages(5)
    assert report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute(rows)


def test_texts_without_passages(spark, odd, empty):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    told = brute(odd_rows())
    for r in out.select("doc_id", "text", "n_chars").collect():
        if r.text is None:
            assert told[r.doc_id][0] == 0
        else:
            assert len(r.text) == r.n_chars and len(r.text.encode()) <= told[r.doc_id][0] - told[r.doc_id][1]
    assert suffix_dedup.removed_report(empty).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0


def test_clashing_and_null_ids(spark):
    rows = [(1, "a" * 150), (1, "b" * 150), (None, "a" * 150), (None, None), (2, "b" * 150)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.removed_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the null id's text comes first; under id 1 one text has the id's place, the other comes last
    assert [x[:2] for x in got] == [(0, 0), (0, 150), (1, 150), (1, 150), (2, 150)]
    assert sum(x[2] for x in got) in (150 + 149 + 149 + 150, 150 + 149 + 150 + 149)


def test_equal_windows_choose_alike_in_any_batch():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdef ") for _ in range(400))
    alone = suffix_dedup.runs([text])
    for size in (300, 70_000, 1_100_000):  # other texts of the batch change nothing
        other = bytes(rng.choice(b"ghijkl ") for _ in range(1000)) * (size // 1000 + 1)
        who, first, windows, shift, anchor = suffix_dedup.runs([other, text])
        mine = who == 1
        for a, b in zip(alone[1:], (first, windows, shift, anchor), strict=True):
            assert a.tolist() == b[mine].tolist()
