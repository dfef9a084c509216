"""Toxicity by a factorization machine over hashed terms.

Terms are a text's different words and their character 4- and 5-grams, hashed;
the machine scores b + sum w_i + sum_{i<j} <v_i, v_j> over the terms present, so
that pairs count beyond their parts (an insult beside a group mention).  It
learns from a bounded sample of labelled rows; the terms kept are those whose
presence there goes with the label (G-test).

Cases: null or empty text has no terms and scores the labels' base rate.
Without labelled rows of both kinds every score is the base rate (0 without any
label).  Rows with null labels are not learned from.  Repeated rows get equal
results; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, kept, prepare, store
from quarry.llm.langid import held_out

BUCKETS = 1 << 20
GRAMS = (4, 5)
#: The training sample: so many labelled documents of each kind at most.
DOCS_PER_LABEL = 2_500
MAX_TERMS = 4_096
MIN_G, MIN_DOCS = 24.0, 6
FACTORS = 8
EPOCHS = 12
LEAST_STEPS = 600
RATE, DECAY = 0.05, 1e-4
CUT = 0.3
#: Different words remembered between batches; the memory starts afresh beyond it.
MEMORY = 300_000
letters = re.compile(r"[^\W\d_]+").findall


def term_hashes(word: str) -> set[int]:
    marked = f"<{word}>"
    terms = {marked, *(marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1))}
    return {xxhash.xxh32_intdigest(t) % BUCKETS for t in terms}


def text_terms(text: str) -> np.ndarray:
    found: set[int] = set()
    for w in set(letters(text.lower())):
        found |= term_hashes(w)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Machine:
    base: float  # log odds of the label over all labelled rows
    terms: dict[int, int]  # term hash -> row of w and v
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    b: float = 0.0

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.b)
        if self.w is not None:
            for i, r in enumerate(rows):
                if len(r):
                    f = self.v[r]
                    out[i] += self.w[r].sum() + 0.5 * ((f.sum(0) ** 2).sum() - (f * f).sum())
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(rows), -30, 30)))

    def choose(self, terms: np.ndarray, a: np.ndarray, c: np.ndarray, pos: float, neg: float) -> None:
        """Keep the terms whose presence (in ``a`` of ``pos`` and ``c`` of ``neg``
        documents) goes with the label most."""
        g = g_test(a, c, pos, neg)
        best = np.flatnonzero((g >= MIN_G) & (a + c >= MIN_DOCS))
        best = best[np.lexsort((terms[best], -g[best]))][:MAX_TERMS]
        self.terms = {int(t): i for i, t in enumerate(terms[best])}

    def learn(self, data: list[np.ndarray], label: np.ndarray, seed: int = 3) -> None:
        """AdaGrad on the log loss; ``data`` holds rows of kept terms.  The sample's
        label rate differs from the labels'; the constant is put back after."""
        pos, neg, many = label.sum(), (1 - label).sum(), len(self.terms)
        rng = np.random.default_rng(seed)
        w, v = np.zeros(many), rng.normal(0, 0.01, (many, FACTORS))
        sw, sv, b, sb = np.full(many, 1e-6), np.full(v.shape, 1e-6), float(np.log(pos / neg)), 1e-6
        steps = max(1, len(data) // 64)
        for _ in range(max(EPOCHS, LEAST_STEPS // steps)):
            for part in np.array_split(rng.permutation(len(data)), steps):
                rows = [data[i] for i in part]
                flat = np.concatenate(rows)
                of = np.repeat(np.arange(len(part)), [len(r) for r in rows])
                f = v[flat]
                sums = np.zeros((len(part), FACTORS))
                np.add.at(sums, of, f)
                squares = np.bincount(of, (f * f).sum(1), len(part))
                z = b + np.bincount(of, w[flat], len(part)) + 0.5 * ((sums ** 2).sum(1) - squares)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
                gw, gv = DECAY * w, DECAY * v
                np.add.at(gw, flat, d[of])
                np.add.at(gv, flat, d[of, None] * (sums[of] - f))
                sw += gw * gw
                sv += gv * gv
                sb += d.sum() ** 2
                w -= RATE * gw / np.sqrt(sw)
                v -= RATE * gv / np.sqrt(sv)
                b -= RATE * d.sum() / np.sqrt(sb)
        self.w, self.v = w, v
        self.b = b + self.base - float(np.log(pos / neg))


def g_test(a: np.ndarray, c: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """How far presence and label depend on each other, for each term."""
    n, seen = pos + neg, a + c
    out = np.zeros(len(a))
    for observed, total, kind in ((a, pos, seen), (c, neg, seen), (pos - a, pos, n - seen), (neg - c, neg, n - seen)):
        expected = total * kind / n
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(observed > 0, observed * np.log(observed / np.maximum(expected, 1e-12)), 0.0)
    return 2 * out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def all_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([text_terms(t or "") for t in texts])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    """Learn ``label`` from the labelled rows that are not held out."""
    rows = labels.filter(~held_out("doc_id", 4, 2) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Machine(-30.0 if not pos else 30.0, {}, b=-30.0 if not pos else 30.0)
    base = float(np.log(pos / neg))
    draw = F.xxhash64("doc_id", F.lit(23))
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col(label) == y).select("doc_id", F.col(label).alias("__y")).orderBy(draw, "doc_id").limit(DOCS_PER_LABEL)
        chosen = part if chosen is None else chosen.union(part)
    sample = store(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * DOCS_PER_LABEL ids
                   .select("doc_id", "__y", all_terms("text").alias("terms")), "toxic_sample")
    machine = Machine(base, {}, b=base)
    of = {r[0]: r[1] for r in sample.groupBy("__y").count().collect()}
    if len(of) < 2:
        return machine
    counts = (sample.select("__y", F.explode("terms").alias("term")).groupBy("term")
              .agg(F.sum("__y").alias("a"), F.sum(1 - F.col("__y")).alias("c")).filter(F.col("a") + F.col("c") >= MIN_DOCS).toPandas())
    machine.choose(*(counts[x].to_numpy(np.int64) for x in ("term", "a", "c")), of[1], of[0])
    kept = F.array(*(F.lit(t) for t in machine.terms)).cast("array<int>")
    rows = sample.select("doc_id", "__y", F.array_intersect("terms", kept).alias("terms")).toPandas().sort_values(["doc_id", "__y"])
    discard(sample)
    machine.learn([np.array([machine.terms[int(t)] for t in r], np.int64) for r in rows["terms"]], rows["__y"].to_numpy(np.float64))
    return machine


def predict(machine: Machine, text: Column) -> Column:
    """The score of a text column."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("toxicity")
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            rows = []
            for t in texts:
                found = set(letters((t or "").lower()))
                for w in found.difference(known):
                    known[w] = tuple(machine.terms[h] for h in term_hashes(w) if h in machine.terms)
                hits = sorted(set().union(*map(known.__getitem__, found)))
                rows.append(np.array(hits, np.int64))
                if len(known) > MEMORY:
                    known = {}
            yield pd.Series(machine.score(rows))

    return run(text)


def classify(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(documents.sparkSession)
    machine = train(documents, labels)
    return (documents.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), predict(machine, F.col("text")).alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted")))
