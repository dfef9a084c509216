"""Removal of repeated passages: every byte covered by a 100-byte string that
also starts earlier in the corpus.

1. Anchors.  Of the ``GRAM``-byte grams in a 100-byte window the one with the
   smallest hash is its anchor, so equal windows have equal anchors at the same
   place.  Consecutive windows with one anchor form a run.
2. Runs whose anchor is unique in the corpus hold no repeated window; the others
   are cut out of the texts as contexts (the bytes of all their windows).
3. Contexts with the same anchor meet in a block.  Equal ones are merged (already
   in the task that cuts them, so a passage in a third of all documents reaches
   the shuffle once a task); strings that differ are searched for common 100-byte
   substrings by a Burrows-Wheeler transform (``bwt``).  In each class of equal
   substrings the first by (doc_id, start) stays.
4. An anchor with more than ``GROUP_LIMIT`` contexts is made longer: its windows
   are split into those that reach far to the left of it and those that reach
   far to the right, and the bytes that all of them share become the new anchor.
   This repeats until groups are small or the anchor is the window itself.

Exact copies are settled by digest first: of equal texts the smallest doc_id
holds the text, the others lose all of it if it has 100 bytes.

Cases: null text is empty.  Shorter texts lose nothing.  Equal rows (same doc_id
and text) are one document and get equal results.  Of different texts under one
doc_id, the smallest digest has its place and the others count as later than all
doc_ids; texts under a null doc_id count as earlier than all.  Cuts are made by
bytes; text that is returned leaves out characters cut in half.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from quarry.llm import bwt
from quarry.llm.common import discard, kept, prepare, store, whole_text
from quarry.llm.words import mix

LEAST = 100
GRAM = 32
#: Anchors, and bytes of contexts, that a task holds before it sends them.
FLUSH_ANCHORS = 1_000_000
FLUSH_BYTES = 24_000_000
#: Contexts of one anchor before it is made longer; bytes of a block.
GROUP_LIMIT = 4_000
BLOCK_BYTES = 1_000_000
SALTS = 64

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Places in a batch: an Arrow batch's text has fewer than 2^31 bytes.
PLACE_BITS = 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def runs(texts: list[bytes], least: int = LEAST, gram: int = GRAM):
    """(text, first window, windows, anchor minus first window, anchor hash) of
    the runs of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(sizes)
    n = int(stop[-1]) if len(texts) else 0
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none, none.astype(np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power, out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    # the smallest hash of each window, leftmost first: its place rides in the low bits,
    # of which there are as many in every batch, so that equal windows choose alike
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, span = least - gram + 1, 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = width - span
    low = np.minimum(low[:len(low) - rest], low[rest:])
    anchor = (low & mask).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    big = sizes >= least
    np.add.at(inside, (stop - sizes)[big], 1)
    np.add.at(inside, np.minimum((stop - least + 1)[big], len(anchor)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    owner = np.searchsorted(stop, np.arange(len(anchor)), side="right")
    differ = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
    opens = inside & (differ | np.r_[True, ~inside[:-1]])
    closes = inside & np.r_[differ[1:] | ~inside[1:], True]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    who = owner[first]
    return who, first - (stop - sizes)[who], last - first + 1, anchor[first] - first, h[anchor[first]]


ANCHORS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("salt", T.IntegerType()),
                        T.StructField("did", T.LongType()), T.StructField("place", T.LongType()),
                        T.StructField("known", T.BooleanType())])


def pack_place(first, windows, shift):
    return first << 14 | windows << 7 | shift


def send_anchors(grams: np.ndarray, dids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row of each anchor is dealt by the anchor (salt 0), to be compared
    with other tasks; the rest are known to repeat and go anywhere."""
    order = np.argsort(grams, kind="stable")
    grams, dids, places = grams[order], dids[order], places[order]
    new = np.r_[True, grams[1:] != grams[:-1]]
    run = np.cumsum(new) - 1
    known = np.bincount(run)[run] > 1
    salt = np.where(new, 0, 1 + np.arange(len(grams)) % SALTS).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(grams.view(np.int64)), pa.array(salt), pa.array(dids), pa.array(places), pa.array(known)], ANCHORS.names)


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (did, text) -> anchors; of equal texts in a task only one is read."""
    kept("suffix_dedup")
    seen: set[bytes] = set()
    parts, held = [], 0

    def all_parts():
        return send_anchors(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    for batch in batches:
        dids, texts = [], []
        for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            mark = xxhash.xxh3_128_digest(raw)
            if len(raw) >= LEAST and mark not in seen:
                seen.add(mark)
                dids.append(did)
                texts.append(raw)
        who, first, windows, shift, gram = runs(texts)
        if len(who):
            parts.append((gram, np.array(dids, np.int64)[who], pack_place(first, windows, shift)))
            held += len(who)
        if held >= FLUSH_ANCHORS:
            yield all_parts()
            parts, held = [], 0
    if parts:
        yield all_parts()


#: A context: the key its group meets by, its document and start, its bytes, and
#: where in them the shared anchor lies.  Rows without bytes are removed already.
CONTEXTS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("did", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("size", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    T.StructField("context", T.BinaryType())])


class Contexts:
    """Contexts cut by one task: equal ones are merged, the first occurrence stays."""

    def __init__(self):
        self.kept: dict[tuple[bytes, int, int], tuple[int, int]] = {}
        self.gone: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, did: int, start: int, context: bytes, a: int, b: int) -> None:
        name, place = (context, a, b), (did, start)
        other = self.kept.get(name)
        if other is None:
            self.kept[name] = place
            self.bytes += len(context) + 150
            return
        if place < other:
            self.kept[name], place, other = place, other, place
        if place > other:
            self.gone.append((*place, len(context)))
            self.bytes += 100

    def batch(self) -> pa.RecordBatch:
        names, places, gone = list(self.kept), list(self.kept.values()), self.gone
        blank = [None] * len(gone)
        key = [xxhash.xxh3_64_intdigest(c[a:b], a << 16 | b if b - a == len(c) else 0) for c, a, b in names]
        cols = [np.array(key, np.uint64).view(np.int64).tolist() + blank,
                [p[0] for p in places] + [g[0] for g in gone], [p[1] for p in places] + [g[1] for g in gone],
                [len(n[0]) for n in names] + [g[2] for g in gone], [n[1] for n in names] + blank,
                [n[2] for n in names] + blank, [n[0] for n in names] + blank]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], CONTEXTS.names)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (did, text, places) -> contexts."""
    out = Contexts()
    for batch in batches:
        for did, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for p in places:
                first, windows, shift = p >> 14, p >> 7 & 127, p & 127
                out.add(did, first, raw[first:first + windows - 1 + LEAST], shift, shift + GRAM)
            if out.bytes >= FLUSH_BYTES:
                yield out.batch()
    yield out.batch()


def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: contexts of crowded anchors -> contexts of longer ones."""
    out = Contexts()
    for batch in batches:
        for _, did, start, size, a, b, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spare = LEAST - (b - a)  # bytes of a window beside the anchor
            reach = (spare + 1) // 2
            windows = size - LEAST + 1
            cut = min(max(a - reach + 1, 0), windows)  # windows before this start have ``reach`` bytes left of the anchor
            if cut:
                out.add(did, start, context[:cut - 1 + LEAST], a - reach, b)
            if cut < windows:
                right = b + spare - reach + 1
                out.add(did, start + cut, context[cut:], a - cut, min(right, size) - cut)
        if out.bytes >= FLUSH_BYTES:
            yield out.batch()
    yield out.batch()


RANGES = T.StructType([T.StructField(c, T.LongType()) for c in ("did", "start", "stop")])


def search_block(block: pa.Table) -> pa.Table:
    """A block's contexts -> ranges to remove (did, start, stop)."""
    keys, dids, starts = (np.array(block.column(c), np.int64) for c in ("key", "did", "start"))
    texts = block.column("context").to_pylist()
    number: dict[tuple[int, bytes], int] = {}
    which = np.fromiter((number.setdefault(kt, len(number)) for kt in zip(keys.tolist(), texts, strict=True)), np.int64, len(texts))
    order = np.lexsort((starts, dids, which))
    head = np.r_[True, which[order][1:] != which[order][:-1]]
    lead = order[head]  # first occurrence of each different context, in the order of their numbers
    later = order[~head]
    later = later[(dids[later] != dids[lead][which[later]]) | (starts[later] != starts[lead][which[later]])]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    removed = [(dids[later], starts[later], starts[later] + sizes[later])]
    own_key = keys[lead]
    values, per_key = np.unique(own_key, return_counts=True)
    compare = np.flatnonzero(per_key[np.searchsorted(values, own_key)] > 1)
    if len(compare):
        lead = lead[compare]
        who, offset, group = bwt.repeated([texts[i] for i in lead], LEAST)
        did, start = dids[lead][who], starts[lead][who] + offset
        order = np.lexsort((start, did, group))
        did, start, group = did[order], start[order], group[order]
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        owner = head[np.cumsum(np.bincount(head, minlength=len(group))) - 1] if len(group) else head
        gone = (did != did[owner]) | (start != start[owner])
        did, start = did[gone], start[gone]
        order = np.lexsort((start, did))
        did, start = did[order], start[order]
        if len(did):
            fresh = np.r_[True, (did[1:] != did[:-1]) | (start[1:] > start[:-1] + 1)]
            head = np.flatnonzero(fresh)
            tail = np.r_[head[1:] - 1, len(did) - 1]
            removed.append((did[head], start[head], start[tail] + LEAST))
    cols = [np.concatenate(c) for c in zip(*removed, strict=True)]
    return pa.table(dict(zip(RANGES.names, cols, strict=True)))


def numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, places, docs): ``rows`` holds doc_id, digest and n_bytes of every row,
    ``places`` also did and owner of every different one; ``docs`` are the documents
    with their ``did``, the number that stands for (doc_id, text) in the order of
    the corpus."""
    text = whole_text()
    rows = store(documents.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")),
                 "byte_rows")
    each = rows.distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    odd = store(each.withColumn("nth", nth).filter("doc_id is null or nth > 1").select("doc_id", "digest", "nth"), "odd_ids")
    docs = documents.withColumn("did", F.col("doc_id"))
    each = each.withColumn("did", F.col("doc_id"))
    if not odd.isEmpty():
        ends = rows.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("hi")).first()
        # null ids before all others, further texts of an id after them
        late = F.row_number().over(Window.partitionBy(F.col("doc_id").isNull()).orderBy("doc_id", "digest"))
        odd = store(odd.select("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.lit(ends["lo"]) - late)
                               .otherwise(F.lit(ends["hi"]) + late).cast("long").alias("other")), "odd_ids")
        match = odd.select(F.col("doc_id").alias("o_id"), F.col("digest").alias("o_digest"), "other")

        def place(df: DataFrame, digest) -> DataFrame:
            return (df.join(match, df["doc_id"].eqNullSafe(match["o_id"]) & (digest == match["o_digest"]), "left")
                    .withColumn("did", F.coalesce("other", "doc_id")).drop("o_id", "o_digest", "other"))

        each, docs = place(each, F.col("digest")), place(docs, F.sha2(text, 256))
    owned = each.groupBy("digest").agg(F.min("did").alias("owner"))
    return rows, store(each.join(owned, "digest"), "byte_docs"), docs


def repeated_ranges(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(did, ranges): what to remove from each document that is no copy; ``docs``
    holds did and text, ``places`` did, digest and owner."""
    anchors = docs.select("did", "text").mapInArrow(anchor_rows, ANCHORS)
    w = Window.partitionBy("gram", "salt").orderBy("did", "place")
    seen = anchors.select("did", "place", "known", F.lag("did").over(w).alias("before"), F.lead("did").over(w).alias("after"))
    repeats = (seen.filter("known or before is not null or after is not null")
               .groupBy("did").agg(F.collect_list("place").alias("places")))  # the anchors of one text
    who = places.select("did", "owner").distinct()
    lists = store(repeats.join(who, "did").groupBy("owner").agg(F.min_by("places", "did").alias("places"))
                  .withColumnRenamed("owner", "did"), "anchor_lists")
    found = store(docs.select("did", "text").join(lists, "did").select("did", "text", "places")
                  .mapInArrow(cut_contexts, CONTEXTS), "contexts")
    discard(lists)
    settled, spare = [], LEAST - GRAM
    while True:
        settled.append(found.filter("context is null").select("did", "start", (F.col("start") + F.col("size")).alias("stop")))
        live = found.filter("context is not null")
        crowded = None
        if spare:
            crowded = store(live.groupBy("key").count().filter(F.col("count") > GROUP_LIMIT).select("key"), "crowded")
            if crowded.isEmpty():
                crowded = None
        calm = live if crowded is None else live.join(crowded, "key", "left_anti")
        settled.append(search(calm.select("key", "did", "start", "context")))
        if crowded is None:
            break
        found = store(live.join(crowded, "key", "left_semi").select(*CONTEXTS.names).mapInArrow(lengthen, CONTEXTS), "contexts")
        spare -= (spare + 1) // 2
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    # the ranges of one text
    return store(out.groupBy("did").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")


def search(contexts: DataFrame) -> DataFrame:
    """Ranges found in contexts, block by block; all of a key are in one block."""
    total = contexts.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return (contexts.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
            .applyInArrow(search_block, RANGES))


def spans_of(ranges, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


REMOVED = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                        T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(REMOVED)
def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, ranges in batches:
        rows = []
        for text, r in zip(texts, ranges, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = spans_of(r, len(raw))
            rows.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
        yield pd.DataFrame(rows, columns=REMOVED.names)


@F.pandas_udf(T.StringType())
def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, ranges in batches:
        yield pd.Series([t if t is None or r is None or not len(r) else
                         kept_bytes(raw := t.encode("utf-8", "surrogatepass"), spans_of(r, len(raw))).decode("utf-8", "ignore")
                         for t, r in zip(texts, ranges, strict=True)])


def removed_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    prepare(documents.sparkSession)
    slim = documents.select("doc_id", whole_text().alias("text"))
    rows, places, docs = numbered(slim)
    ranges = repeated_ranges(docs, places)
    cut = store(docs.join(ranges, "did").dropDuplicates(["did"]).select("did", measure("text", "ranges").alias("m"))
                .select("did", "m.*"), "removed")
    copy = (F.col("did") != F.col("owner")) & (F.col("n_bytes") >= LEAST)
    result = (places.join(cut, "did", "left")
              .select(F.col("doc_id").alias("p_id"), F.col("digest").alias("p_digest"),
                      F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256")))
    return (rows.join(result, rows["doc_id"].eqNullSafe(result["p_id"]) & (rows["digest"] == result["p_digest"]))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated passages cut out of the text
    (and ``n_chars``, if there is one, counted anew)."""
    prepare(documents.sparkSession)
    slim = documents.select("doc_id", whole_text().alias("text"))
    _, places, docs = numbered(slim)
    ranges = repeated_ranges(docs, places)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copies = places.filter((F.col("did") != F.col("owner")) & (F.col("n_bytes") >= LEAST)).select("did", whole.alias("ranges"))
    cuts = (ranges.unionByName(copies).join(places.select("did", "doc_id", "digest"), "did")
            .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("ranges").alias("__ranges")))
    here = documents.withColumn("__own", F.sha2(whole_text(), 256))
    out = (here.join(cuts, here["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left")
           .withColumn("text", strip("text", "__ranges")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))
