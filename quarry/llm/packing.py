"""Best-fit packing of token sequences by hierarchical residual packing.

Every task tokenizes its documents, cuts those that are too long and packs its
own pieces by best fit, largest first.  Bins that are nearly full are final.
The rest become items: the first round deals them into groups of about
``GROUP_ITEMS`` and packs each by best fit.  After that any two bins of a group
together exceed the capacity, so that at most one a group is half full or less.
Two bins can be joined only if one of them is, and where anything fits, the least
filled bins take it: each further round merges the K bins up to half full with the
K least filled of the others, in some ten thousandth of the groups before, until
one group is left.  Then no two of the sequences that aren't nearly full can be
joined.  The rounds' moves are composed first, and the pieces that move are joined
with them once.  A piece's final place is its place in its first bin plus the
shifts of the bins around it.

Cases: null text is empty (one token, the end mark).  Null or repeated doc_ids
are packed row by row.  Equal lengths keep their order in the task.  Texts of
any length are tokenized whole.  An empty table gives an empty result; extra
columns are dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import kept, prepare, store, whole_text

CAPACITY = 4096
END = 1
#: A bin with fewer free tokens than this is final.
SLACK = 16
GROUP_ITEMS = 20_000
#: Pieces packed together inside one task.
LOCAL_ITEMS = 200_000
#: Different words remembered between batches; the memory starts afresh beyond it.
MEMORY = 600_000


class WordEncoder:
    """Token ids of whole texts.  The tokenizer drops white space and splits
    there, so a text's ids are those of its words in turn; each different word
    is encoded once.  A word of letters is one unit for the tokenizer, so that
    many of them are encoded in one call and told apart by the ids that end a
    unit; a comma or full stop behind them is a unit of its own."""

    #: Letters below this code point lower-case one by one, the same everywhere, but for these two.
    SIMPLE, ODD = "\u0530", re.compile("[\u0130\u03a3]").search
    TAILS = b",."
    TOGETHER = 1_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ends_unit = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_unit[i] = token.endswith("</w>")
        self.tails = dict(zip(self.TAILS, self._each(list(self.TAILS.decode())), strict=True))
        self.known: dict[bytes, bytes] = {}
        self.units: dict[bytes, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        simple, other = [], []
        for raw in words:
            core, tail = raw, self.tails.get(raw[-1], b"")
            if tail:
                core = raw[:-1]
            if core.isalpha():  # ASCII letters only
                simple.append((raw, core.lower(), tail))
                continue
            if not core.isascii():
                w = core.decode()
                if w.isalpha() and max(w) < self.SIMPLE and not self.ODD(w):
                    simple.append((raw, w.lower().encode(), tail))
                    continue
            other.append(raw)
        new = list({core for _, core, _ in simple}.difference(self.units))
        for k in range(0, len(new), self.TOGETHER):
            part = new[k:k + self.TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends_unit[ids]) + 1
            if len(cut) == len(part):
                coded, cut = ids.tobytes(), (4 * cut).tolist()
                self.units.update((w, coded[i:j]) for w, i, j in zip(part, [0, *cut], cut, strict=False))
            else:
                self.units.update(zip(part, self._each([w.decode() for w in part]), strict=True))
        known, units = self.known, self.units
        for raw, core, tail in simple:
            known[raw] = units[core] + tail if tail else units[core]
        known.update(zip(other, self._each([w.decode() for w in other]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known, self.units, new = {}, {}, set().union(*split)
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def encoder_of(path: str) -> WordEncoder:
    """The encoder of a vocabulary file: one in each worker process, whose words serve all of the
    process's tasks until another operator's run there."""
    encoders = kept("packing")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and each bin's fill.  Items go in by falling
    size, each into the fullest bin that still has room."""
    place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has r free tokens
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += s
        room -= s
        if not with_room[room]:
            some |= 1 << room
        with_room[room].append(b)
    return place, offset, np.array(fill, np.int64)


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("bin", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])


def local_packer(path: str, capacity: int = CAPACITY):
    """mapInArrow function: documents -> pieces packed within the task."""
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def flush(rows: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        cols = {n: pa.array(c, t) for (n, t), c in zip(types.items(), zip(*rows, strict=True), strict=True)}
        place, offset, fill = best_fit(np.array([r[3] for r in rows], np.int64), capacity)
        cols |= {"bin": pa.array(place + first), "offset": pa.array(offset), "fill": pa.array(fill[place])}
        return pa.RecordBatch.from_pydict(cols), first + len(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(path)
        end = np.array([END], "<u4").tobytes()
        rows, first = [], TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= LOCAL_ITEMS:
                out, first = flush(rows, first)
                rows = []
                yield out
        if rows:
            yield flush(rows, first)[0]

    return run


def repack(items: pd.DataFrame) -> pd.DataFrame:
    """One group of a round: (bin, fill) -> (bin, parent, shift, fill of the parent).
    A parent takes the id of its first item."""
    items = items.sort_values(["fill", "bin"])
    place, offset, fill = best_fit(items["fill"].to_numpy())
    bins = items["bin"].to_numpy()
    name = np.empty(len(fill), np.int64)
    name[place[offset == 0]] = bins[offset == 0]
    return pd.DataFrame({"bin": bins, "parent": name[place], "shift": offset, "fill": fill[place]})


def joinable(items: DataFrame) -> DataFrame:
    """Of packed groups' bins (bin, fill), those that a further round needs: the K
    that are at most half full, and the K least filled of the others.  Fills are
    counted by value, of which there are at most ``CAPACITY``."""
    counts = {r["fill"]: r["count"] for r in items.groupBy("fill").count().collect()}
    half = CAPACITY // 2
    need = sum(c for f, c in counts.items() if f <= half)
    out = items.filter(F.col("fill") <= half)
    for fill in sorted(f for f in counts if f > half):
        if not need:
            break
        here = items.filter(F.col("fill") == fill)
        out = out.union(here if counts[fill] <= need else here.limit(need))
        need -= min(need, counts[fill])
    return out


def pack(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    prepare(documents.sparkSession)
    pieces = store(documents.select("doc_id", whole_text().alias("text"))
                   .mapInArrow(local_packer(path), PIECES), "packed_pieces")
    is_open = F.col("fill") <= CAPACITY - SLACK
    items = pieces.filter((F.col("offset") == 0) & is_open).select("bin", "fill")  # one row a bin: pieces aren't empty
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    left, moves = items.count(), None
    while left > 1:
        groups = -(-left // GROUP_ITEMS)
        step = store(items.groupBy(F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups)))
                     .applyInPandas(repack, "bin long, parent long, shift long, fill long"), "packed_moves")
        if moves is None:
            moves = step.drop("fill")
        else:  # a later round moves the bins of earlier ones
            then = step.select(F.col("bin").alias("parent"), F.col("parent").alias("above"), F.col("shift").alias("more"))
            moves = (moves.join(then, "parent", "left")
                     .select("bin", F.coalesce("above", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        if groups == 1:
            break
        items = store(joinable(step.filter((F.col("shift") == 0) & is_open).select(F.col("parent").alias("bin"), "fill")), "packed_items")
        left = items.count()
    if moves is None:
        return pieces.withColumnRenamed("bin", "sequence_id").select(*names)
    final = pieces.filter(~is_open).withColumnRenamed("bin", "sequence_id").select(*names)
    moved = (pieces.filter(is_open).join(moves, "bin").withColumnRenamed("parent", "sequence_id")
             .withColumn("offset", F.col("offset") + F.col("shift")).select(*names))
    return final.union(moved)
