"""Language ID, toxicity and quality: held-out accuracy and brute force."""

import re
from collections import Counter

import numpy as np

from quarry.llm import langid, quality, toxicity
from tests.conftest import SF_ORACLE
from tests.llm.conftest import odd_rows


def test_network_equals_plain_convolution():
    net = langid.Network.fresh(["a", "b", "c"], seed=5)
    raw = bytes(range(200)) * 2
    windows = langid.windows_of(raw)
    assert windows.shape == (2, langid.WINDOW) and bytes(windows.ravel()[:len(raw)]) == raw
    for window, got in zip(windows, net.probabilities(windows), strict=True):
        pooled = []
        for w in langid.WIDTHS:
            f = net.filters[w]
            sums = [net.embed[window[i:i + w]].ravel() @ f[:-1] + f[-1] for i in range(langid.WINDOW - w + 1)]
            pooled.append(np.maximum(np.max(sums, 0), 0))
        z = np.concatenate(pooled) @ net.out[:-1] + net.out[-1]
        p = np.exp(z - z.max())
        assert np.allclose(got, p / p.sum(), atol=1e-4)


def test_network_gradients():
    net = langid.Network.fresh(["a", "b"], seed=2)
    for p in (net.embed, net.out, *net.filters.values()):
        p[...] = p.astype(np.float32)
    windows, y = langid.windows_of(b"the cat sat on the mat" * 20), np.array([0, 1])
    grads = net._gradients(windows, y)
    for p, g in zip((net.embed, *(net.filters[w] for w in langid.WIDTHS), net.out), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at], 1e-2
        loss = []
        for d in (eps, -eps):
            p[at] = keep + d
            loss.append(-np.log(net.probabilities(windows)[np.arange(2), y]).mean())
        p[at] = keep
        assert abs((loss[0] - loss[1]) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    rows = langid.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_cases(odd, empty, spark):
    told = {r.doc_id: r for r in langid.classify(odd).collect()}
    for i, t in odd_rows():
        assert (told[i].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
    assert langid.classify(empty).count() == 0
    none = spark.createDataFrame([(1, "abc", None), (None, None, None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.classify(none).collect()] == ["und", "und"]


def test_machine_learns_pairs():
    """A label that needs two terms together, beyond any additive weights."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["idiots"] * a + ["foreigners"] * b + [f"w{i}" for i in rng.integers(0, 50, 6)]))
        y.append(int(a and b) if rng.random() < 0.97 else int(rng.integers(0, 2)))
    m = toxicity.Machine(float(np.log(np.mean(y) / (1 - np.mean(y)))), {})
    label, docs = np.array(y, float), [toxicity.text_terms(t) for t in texts]
    a, c = (np.bincount(np.concatenate([d for d, z in zip(docs, y, strict=True) if z == k]), minlength=toxicity.BUCKETS) for k in (1, 0))
    m.choose(np.arange(toxicity.BUCKETS), a, c, label.sum(), (1 - label).sum())
    m.learn([np.array([m.terms[int(h)] for h in d if int(h) in m.terms], np.int64) for d in docs], label)

    def score(t):
        return float(m.score([np.array(sorted(m.terms[int(h)] for h in toxicity.text_terms(t) if int(h) in m.terms))])[0])

    both, one, other = score("idiots foreigners w1"), score("idiots w1 w2"), score("foreigners w3")
    assert both > 0.5 > max(one, other) and m.v is not None


def test_toxicity_held_out(spark):
    d = SF_ORACLE.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.05


def test_toxicity_odd_cases(odd, empty, spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10, 40)] + [(None, 0, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    told = toxicity.classify(odd, labels).collect()
    assert len(told) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in told)
    assert len({r.score for r in told if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.classify(empty, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.classify(odd, labels.limit(0)).collect())


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_quality_counts():
    texts = [t or "" for _, t in odd_rows()] + ["a b c d e f g h " * 9, "x\nx\n\n \nx", "#a|b <c> & $5 100%", "one two " * 4 + "three " + "one two " * 4,
                                                "p q r s t u v w z p q r s t u v w"]
    for t in texts:
        assert quality.counts(t)[:5] == brute_counts(t)


def test_quantile_sketches_merge(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0, 1, 4000)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double").repartition(7)
    q = quality.quantiles(quality.sketches(df, ["g"], ["v"]), ["g"], {"a": 0.25, "b": 0.75, "c": 0.99}).first()
    for got, p in ((q.a, 0.25), (q.b, 0.75), (q.c, 0.99)):
        assert abs(got / np.quantile(x, p, method="inverted_cdf") - 1) < 0.03


def test_quality_verdicts(spark, odd, empty):
    rng = np.random.default_rng(5)

    def line(n):
        return " ".join(f"word{i}" for i in rng.integers(0, 10 ** 6, n))

    rows = [(i, line(60), "en", "hot") for i in range(300)] + [(1000 + i, line(40).replace(" ", "*** "), "en", "hot") for i in range(10)]
    rows += [(2000, "too short", "en", "hot"), (2001, None, None, None), (2002, line(50), None, "rare")]
    told = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(told[i].kept for i in range(300)) and not any(told[1000 + i].kept for i in range(10))
    assert told[2000].base_failed and told[2001].base_failed and told[2002].kept
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).count() == 0
