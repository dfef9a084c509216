"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its different 4-word shingles.  Sets are grouped into size
bands; similar sets lie in the same band or in neighbouring ones, and differ in
at most k items, k following from the bands' sizes.  For each pair of
neighbouring bands the feature domain is cut by a hash into n1 groups of n2
parts.  Of two similar sets, at least one group differs in k2 parts at most, so
some subset of n2 - k2 parts is the same in both: each such subset is hashed into
a signature, and similar sets share one.  No similar pair is missed.

Groups beyond the needed number (``extra``) let a set leave out signatures of
empty subsets: if two similar sets agree in more groups than one of them has
groups with an empty subset, they share one that isn't empty.  Sets with more of
those keep all signatures.

Candidates are verified exactly (100 * intersection >= 85 * union) and joined to
components in ``links``, after their sketches (how many items lie in each part of the
range of hashes) have ruled out most of those that are not similar.

Nodes of the graph are different sets, named by 64 bits of their digest (the rare names that
two digests share are told apart by the rest), so equal sets are one node
wherever they lie, and a signature that only copies of one set hold is gone after the first shuffle.

Cases: a null or wordless text has an empty set and no links; a text with fewer
words than a shingle is one shingle.  Equal sets link whatever their size.
Each row is judged by its own text: rows that repeat a doc_id have the component of their
text, whose name is the smallest doc_id that any of its rows has.  Rows with a null
doc_id are linked with nothing and have a null component.  An empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm import links
from quarry.llm.common import discard, give_back, kept, prepare, store, whole_text
from quarry.llm.words import blocks, mix, shingle_sets

SHINGLE_WORDS = 4
#: Similarity in hundredths.
PERCENT = 85
#: Up to this many differing items one group of parts is used, with subsets of two parts.
SMALL_K = 4
#: Signatures a task holds before it sends them.
FLUSH = 250_000
#: Wanted sets whose places (three numbers each) are broadcast to the texts.
PLACES = 1_000_000


@lru_cache(maxsize=None)
def band_ends(percent: int, upto: int) -> list[int]:
    """Largest size of each band, to one that is at least ``upto``."""
    ends, low = [0], 1
    while ends[-1] < upto:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return ends


@lru_cache(maxsize=None)
def plan(j: int, percent: int) -> tuple[int, int, int, int, int]:
    """(k, n1, n2, k2, extra) for the bands j-1 and j."""
    size = 64
    while len(ends := band_ends(percent, size)) <= j:
        size *= 2
    k = (100 - percent) * (ends[j - 1] + ends[j]) // (100 + percent)
    if k == 0:
        return 0, 0, 0, 0, 0
    if k <= SMALL_K:
        return k, 1, k + 2, k, 0
    n1 = -(-(k + 1) // 2)
    least = (ends[j - 2] if j > 1 else 0) + 1
    sparse = n1 * 2 * math.exp(-least / (2 * n1))
    extra = math.ceil(sparse + 3 * math.sqrt(sparse) + 1)
    return k, n1 + extra, 2, 1, extra


def signatures(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit hashes (sorted, distinct)."""
    n = len(items)
    if not n:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(band_ends(percent, 1 << (n + 1).bit_length()), n))
    out = []
    for j in (band, band + 1):
        k, n1, n2, k2, extra = plan(j, percent)
        if not k:
            continue  # equal sets only: linked by their digest
        parts = n1 * n2
        part = ((mix(items ^ np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32))
                * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        # sums of the parts' hashes modulo 2^64, from exact sums of their halves
        low = np.bincount(part, (items & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
        high = np.bincount(part, (items >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
        held = np.bincount(part, minlength=parts).reshape(n1, n2)
        sums = mix((low + (high << np.uint64(32))) + np.arange(parts, dtype=np.uint64)).reshape(n1, n2)
        subsets = list(combinations(range(n2), n2 - k2))
        empty = np.stack([held[:, c].sum(1) == 0 for c in subsets], 1)
        sigs = np.stack([sums[:, c].sum(1, dtype=np.uint64) + np.uint64(1 + i) for i, c in enumerate(subsets)], 1)
        sigs = mix(sigs * np.uint64(2 * j + 1) + np.arange(n1, dtype=np.uint64)[:, None] * np.uint64(len(subsets) + 1))
        out.append(sigs[~empty] if int(empty.any(1).sum()) <= extra and n1 > 1 else sigs.ravel())
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signature_sets(items: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """What ``signatures`` gives for each of many sets that lie one after the other (set i from
    ``ends[i]`` to ``ends[i + 1]``), and the number of the set that each signature is of."""
    n = np.diff(ends)
    limits = np.array(band_ends(percent, 1 << int(n.max(initial=0) + 1).bit_length()))
    band = np.searchsorted(limits, n)
    plans = {j: plan(j, percent) for j in range(1, int(band.max(initial=0)) + 2)}
    wide = np.array([j > 0 and plans[j][0] > SMALL_K for j in band], bool)
    out, who = [], []
    for i in np.flatnonzero(~wide & (n > 0)):
        out.append(signatures(items[ends[i]:ends[i + 1]], percent))
        who.append(np.full(len(out[-1]), i))
    sets = np.flatnonzero(wide)
    of = np.repeat(np.arange(len(sets)), n[sets])
    items = items[np.repeat(wide, n)]
    low, high = ((items & np.uint64(0xFFFFFFFF)).astype(np.float64), (items >> np.uint64(32)).astype(np.float64))
    for j in (band[sets], band[sets] + 1) if len(sets) else ():
        groups, extra = (np.array([plans[x][c] for x in j], np.int64) for c in (1, 4))
        parts = 2 * groups
        begin = np.cumsum(parts) - parts
        total = int(parts.sum())
        salt = j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = (mix(items ^ salt[of]) >> np.uint64(32)) * parts.astype(np.uint64)[of] >> np.uint64(32)
        at = at.astype(np.int64) + begin[of]
        sums = np.bincount(at, low, total).astype(np.uint64) + (np.bincount(at, high, total).astype(np.uint64) << np.uint64(32))
        empty = np.bincount(at, minlength=total) == 0
        own = np.repeat(np.arange(len(sets)), parts)
        part = (np.arange(total) - begin[own]).astype(np.uint64)
        sums = mix(sums + part) + np.uint64(1) + (part & np.uint64(1))
        sigs = mix(sums * (2 * j + 1).astype(np.uint64)[own] + (part >> np.uint64(1)) * np.uint64(3))
        sparse = np.add.reduceat(empty.reshape(-1, 2).any(1).astype(np.int64), begin // 2)
        sent = ~(empty & (sparse <= extra)[own])
        out.append(sigs[sent])
        who.append(sets[own[sent]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(who)


def digest(items: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


SET_FIELDS = (T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
              T.StructField("sketch", T.BinaryType()))


def describe(k: int):
    """mapInArrow function: rows with their text as last column -> the same with size, digest
    and sketch of its shingle set in its place."""
    names = [f.name for f in SET_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("partenum")
        for batch in batches:
            rows = []
            for texts in blocks(batch.column(batch.num_columns - 1)):
                items, ends = shingle_sets(texts, k)
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    rows.append((b - a, *digest(items[a:b]), links.sketch(items[a:b])))
            told = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *told], [*batch.schema.names[:-1], *names])

    return run


def item_sets(k: int):
    """mapInArrow function: (id, text) -> (id, items), the text's shingle set as sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("partenum")
        for batch in batches:
            first = 0
            for texts in blocks(batch.column(1)):
                items, ends = shingle_sets(texts, k)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], ["id", "items"])
                first += len(texts)

    return run


SIGS = T.StructType([T.StructField("sig", T.LongType()), T.StructField("id", T.LongType()),
                     T.StructField("rep", T.LongType()), T.StructField("many", T.BooleanType())])


def node(d1: int, d2: int, clashes: frozenset[int]) -> int:
    """The 64-bit name of a set with this digest."""
    return xxhash.xxh3_64_intdigest(d1.to_bytes(8, "little", signed=True) + d2.to_bytes(8, "little", signed=True)) - (1 << 63) if d1 in clashes else d1


def deal(sig: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    """What a task sends of signatures and the ids that hold them: of each signature the smallest id
    (``many``: others of this task hold it too), and the others with that id as ``rep``."""
    order = np.argsort(sig)
    sig, who = sig[order], who[order]
    new = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.r_[start, len(sig)])
    several = np.flatnonzero(size[run] > 1)
    who[several] = who[several[np.lexsort((who[several], sig[several]))]]
    rep = who[start][run] if len(sig) else who
    return pa.RecordBatch.from_arrays([
        pa.array(sig.view(np.int64)), pa.array(who), pa.array(rep, mask=new), pa.array(new & (size[run] > 1))], SIGS.names)


def signature_rows(make, k: int, clashes: frozenset[int] = frozenset(), flush: int = FLUSH):
    """mapInArrow function: texts -> (sig, id, rep, many) of their sets; ``make`` turns
    a set into signatures (a number: those of ``signatures`` with that similarity in hundredths).
    Of equal sets in a task only one is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("partenum")
        seen: set[tuple[int, int]] = set()
        sigs, whos, held = [], [], 0
        for batch in batches:
            for texts in blocks(batch.column(0)):
                items, ends = shingle_sets(texts, k)
                fresh, ids = np.zeros(len(texts), bool), []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    mark = digest(items[a:b])
                    if a == b or mark in seen:
                        continue
                    seen.add(mark)
                    fresh[i] = True
                    ids.append(node(*mark, clashes))
                size = np.diff(ends)
                items, ends = items[np.repeat(fresh, size)], np.r_[0, np.cumsum(size[fresh])]
                if isinstance(make, int):
                    sig, of = signature_sets(items, ends, make)
                else:
                    each = [make(items[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    sig = np.concatenate([np.zeros(0, np.uint64), *each])
                    of = np.repeat(np.arange(len(each)), [len(s) for s in each])
                sigs.append(sig)
                whos.append(np.array(ids, np.int64)[of])
                held += len(sig)
                if held >= flush:
                    yield deal(np.concatenate(sigs), np.concatenate(whos))
                    sigs, whos, held = [], [], 0
        if held:
            yield deal(np.concatenate(sigs), np.concatenate(whos))
        del seen, sigs, whos
        give_back()  # the joins that follow need the memory more than an idle worker

    return run


def set_components(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, make=None) -> DataFrame:
    """doc_id, text_key, n_shingles, component of every row.  ``component`` names the linked sets
    (null: an empty set or no doc_id), ``text_key`` a row's text among those of its doc_id."""
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select("doc_id", whole_text().alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = store(keyed.mapInArrow(describe(k), T.StructType([*keyed.schema.fields[:2], *SET_FIELDS])), "shingle_sets")
    some = rows.filter("doc_id is not null and n_shingles > 0")
    # names that several digests share: about one in N * N / 2^65 sets
    clash = some.groupBy("d1").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi")).filter("lo <> hi").select("d1")
    clashes = frozenset(r["d1"] for r in clash.collect())
    named = F.udf(lambda a, b: node(a, b, clashes), "long")("d1", "d2")
    name = F.when(F.col("d1").isin(*clashes), named).otherwise(F.col("d1")) if clashes else F.col("d1")

    repeats = not some.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    sent = docs.filter("doc_id is not null").select("text").mapInArrow(signature_rows(make or percent, k, clashes), SIGS)
    members = store(links.shared(sent), "shared_sigs")
    several = members.select("id").union(members.select("first")).distinct()
    marks = store(some.select(name.alias("id"), F.col("n_shingles").alias("size"), "sketch").join(several, "id", "left_semi")
                  .dropDuplicates(["id"]), "set_marks")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # one row of each wanted set: its smallest doc_id and there the smallest text
        held = some.select(name.alias("id"), "doc_id", "text_key").join(wanted, "id", "left_semi")
        # up to PLACES of them travel to the texts, which stay where they are; more are met in a shuffle
        first = store(held.groupBy("id").agg(F.min(F.struct("doc_id", "text_key")).alias("at")).select("id", "at.*"), "set_places")
        at = F.broadcast(first) if first.count() <= PLACES else first
        sets = keyed.join(at, ["doc_id", "text_key"]).select("id", "text").mapInArrow(item_sets(k), "id long, items array<long>")
        out = store(sets.dropDuplicates(["id"]) if repeats else sets, "item_sets")
        discard(first)
        return out

    comps = links.link(members, marks, sets_of, percent)
    for done in (members, marks):
        discard(done)
    ids = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), name)
    return links.label(rows.withColumn("id", ids), comps, "id", "component").select("doc_id", "text_key", "n_shingles", "component")


def jaccard_components(documents: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, make=None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the graph
    that links sets with 100 * |A and B| >= percent * |A or B|."""
    rows = store(set_components(documents, k, percent, make), "set_components")
    least = rows.filter("component is not null").groupBy(F.col("component").alias("__c")).agg(F.min("doc_id").alias("__least"))
    return (rows.join(least, rows["component"] == least["__c"], "left")
            .select("doc_id", "n_shingles", F.coalesce("__least", "doc_id").alias("component_id")))
