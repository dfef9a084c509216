"""Source divergence: against a plain count in Python integers."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quarry.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        own = {s: counts[lang, s] for k, s in groups if k == lang}
        total = {s: sum(c[t] for t in kept) for s, c in own.items()}

        def p(c, n, v=v):
            return 1 + 10 ** 9 * (c + 2) // (n + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        freq = {s: {t: p(c[t], total[s]) for t in kept} for s, c in own.items()}
        whole = {t: p(sum(c[t] for c in own.values()), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(sum(f(freq[s][t], freq[o][t]) for t in kept), o) for o in own if o != s]
            best = [(f(freq[s][t], whole[t]), t) for t in kept if own[s][t] and freq[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def rows_of(odd):
    return [(r.text, r.lang, r.source) for r in odd.collect()]


def more(spark, odd):
    extra = [("Straße ÄÖ zwei\x00zwei a_b C-3 x퟿ 漢字 漢字。ü", "de", f"q{i % 3}") for i in range(12)]
    extra += [("Tie tIe even odd " * 3, "de", "q0"), ("", "xx", "alone"), (None, "xx", None), ("words but too few", "yy", "z"), ("a", "yy", "y")]
    full = [(i, t, k, s, 0, 1, "k", None, "s", 2) for i, (t, k, s) in enumerate(extra)]
    return odd.unionByName(spark.createDataFrame(full, odd.schema)).repartition(5)


@pytest.mark.parametrize("least,top,flush,cells", [(10, 10, 200_000, 100_000), (2, 3, 50, 20), (1, 1, 1, 1)])
def test_audit(spark, odd, least, top, flush, cells):
    docs = more(spark, odd)
    got = divergence.audit(docs, least, top, cells, cells, flush).collect()
    assert sorted(tuple(r) for r in got) == plain(rows_of(docs), least, top)


def test_empty(empty):
    assert divergence.audit(empty).count() == 0


def test_ratio_is_exact_for_large_counts():
    import numpy as np
    c = np.array([2, 10 ** 13 + 7, 8 * 10 ** 15 - 1, 5], np.int64)
    n = np.array([5, 3 * 10 ** 13 + 1, 8 * 10 ** 15, 5], np.int64)
    assert divergence.ratio(c, n).tolist() == [1 + 10 ** 9 * int(a) // int(b) for a, b in zip(c, n, strict=True)]


def test_sql_twin(spark, odd):
    docs = more(spark, odd)
    con = duckdb.connect()
    frame = docs.select("text", "lang", "source").toArrow()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    assert sorted(con.execute(divergence.oracle()).fetchall()) == plain(rows_of(docs))
