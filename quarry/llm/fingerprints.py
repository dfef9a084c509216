"""MinHash document fingerprints.

A fingerprint holds, for each of ``PERMUTATIONS`` universal hash functions
h(x) = (a*x + b) mod 2^64, 16 bits of the smallest value over the document's
five-word shingles.  The share of equal places estimates the Jaccard
similarity of two shingle sets.  Near duplicates are found by joining bands of
the signatures and verified exactly.

Cases: a null text is empty.  Texts without words have the all-ones
fingerprint, alike to each other (1.0) and to nothing else; texts of fewer than
five words are one shingle.  Equal texts have equal fingerprints.  Documents
are taken in descending doc_id, null ids last, equal ids by text; a repeated
row is its twin's next document.  A single document is its own next one.  An
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import prepare, whole_text
from quarry.llm.partenum import jaccard_components
from quarry.llm.words import PLACE, mix, shingles

SHINGLE_WORDS = 5
PERMUTATIONS = 128
BANDS = 32
SEED = 7
#: Documents in an id range that is walked in one go.
RANGE_ROWS = 2_048
#: Ranges at most (their ends are held by every task); beyond it they get longer.
#: A range is walked as a stream, so its length costs no memory.
MOST_RANGES = 20_000
#: Shingles hashed at once: a table of so many rows by PERMUTATIONS stays in cache.
STEP = 256

_rng = np.random.default_rng(SEED)
A = _rng.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
B = _rng.integers(0, 2 ** 63, PERMUTATIONS, dtype=np.uint64)


def minima(x: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over hashed shingles."""
    low = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), STEP):
        h = x[i:i + STEP, None] * A
        h += B
        np.minimum(low, h.min(0), out=low)
    return low


def signature(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The 16-bit minimum hashes of a text."""
    return (minima(shingles(text, k)) >> np.uint64(32)).astype(np.uint16)


def bands(items: np.ndarray) -> np.ndarray:
    """One hash for each band of a signature: sets of similarity 0.8 share a band
    but for one pair in 20 million."""
    rows = minima(items).reshape(BANDS, -1)
    return mix((rows * PLACE[:rows.shape[1]]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents that share a band are joined on
    it, verified by the exact Jaccard similarity of their shingle sets and labelled
    with the smallest doc_id that links reach."""
    return jaccard_components(documents, SHINGLE_WORDS, percent, bands)


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks ranges of documents in order; a row is done when its next one is seen."""
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    held = None  # (range, ghost, doc_id, text, signature) of the row before
    for rows in batches:
        done = []
        for span, ghost, doc_id, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            sig = signature(text)
            if held is not None and held[0] == span and not held[1]:
                _, _, key, own, first = held
                half = len(own) // 2
                edited = own[:len(own) - half] + text[:half]
                changed = signature(edited)
                done.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_hex(first), as_hex(changed),
                             likeness(first, changed), likeness(first, sig)))
            held = (span, ghost, doc_id, text, sig)
        if done:
            cols = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], RESULT.names)


def in_ranges(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(range, ghost, doc_id, text): documents dealt into ranges of ids.  The
    upper end of each range is a document; it is sent to the range above as
    well (``ghost``), where it follows the last one, and the highest document
    of all to the lowest range.  Only the ids are read to find the ends, one
    for some ``range_rows`` documents, ``MOST_RANGES`` at most."""
    spark = documents.sparkSession
    rank = F.coalesce(F.col("doc_id"), F.lit(-2 ** 63))
    ids = documents.select(rank.alias("id"))
    count = ids.count()
    cuts = max(1, min(count // range_rows, MOST_RANGES))
    # quantiles are found in floating point, so each range's end is then read off its ids
    about = ids.agg(F.percentile_approx("id", [(i + 1) / cuts for i in range(cuts)], max(10_000, 20 * cuts))).first()[0] or []
    about = spark.sparkContext.broadcast(np.array(sorted(set(about)), np.int64))

    @F.pandas_udf(T.IntegerType())
    def nearest(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(about.value, ids.to_numpy()))

    tops = ids.groupBy(nearest("id")).agg(F.max("id").alias("top")).select("top").toPandas()["top"]
    shared = spark.sparkContext.broadcast(np.sort(tops.to_numpy(np.int64)))

    place = T.ArrayType(T.StructType([T.StructField("range", T.IntegerType()), T.StructField("ghost", T.BooleanType())]))

    @F.pandas_udf(place)
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ends = shared.value
        for ids in batches:
            at = np.searchsorted(ends, ids.to_numpy())
            is_end = ends[at] == ids.to_numpy()
            yield pd.Series([[{"range": int(i), "ghost": False}]
                             + ([{"range": (int(i) + 1) % len(ends), "ghost": True}] if e else [])
                             for i, e in zip(at, is_end, strict=True)])

    return (documents.select("doc_id", whole_text().alias("text"), rank.alias("rank"))
            .select("doc_id", "text", "rank", F.inline(places("rank")))
            .repartition("range")
            .sortWithinPartitions("range", "ghost", F.col("rank").desc(), "text")
            .select("range", "ghost", "doc_id", "text"))


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses."""
    prepare(documents.sparkSession)
    return in_ranges(documents).mapInArrow(_compare, RESULT)
