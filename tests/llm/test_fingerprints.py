"""Fingerprints of documents and their edits: against brute force."""

import hashlib

import numpy as np

from quarry.llm import fingerprints as fp
from tests.llm.conftest import odd_rows


def expected(rows):
    rows = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = fp.signature(t), fp.signature(edited), fp.signature(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.as_hex(a), fp.as_hex(b), fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_edits_across_ranges(odd, empty, monkeypatch):
    for size in (2_048, 5):
        monkeypatch.setattr(fp, "RANGE_ROWS", size)
        got = [tuple(r) for r in fp.in_ranges(odd, size).mapInArrow(fp._compare, fp.RESULT).collect()]
        assert sorted(got) == sorted(expected(odd_rows()))
    assert fp.fingerprint_edits(empty).count() == 0


def test_single_and_null_ids(spark):
    one = fp.fingerprint_edits(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    big = 2 ** 60 + 1  # beyond what a float holds
    rows = fp.fingerprint_edits(spark.createDataFrame([(None, None), (big, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in rows) == [str(big), "None", "None"]


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 10 ** 6, 800)]
    for cut in (0, 100, 400):
        other = words[:800 - cut] + [f"v{i}" for i in range(cut)]
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, other))
        true = len(a & b) / len(a | b)
        assert abs(fp.likeness(fp.signature(" ".join(words)), fp.signature(" ".join(other))) - true) < 0.15
