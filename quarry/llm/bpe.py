"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is split by the vocabulary's pattern; each piece is a row of byte
positions.  A segment tree over the positions keeps the leftmost minimum rank
of the pairs that start there.  A merge takes the root's pair, joins it with
its right neighbour and point-updates the ranks of the two live pairs around
it along their paths to the root.  Pieces of like length share one numpy
array, so that each step runs for all of them at once; every different piece
of a batch is encoded once.

Cases: a null text is empty: no ids, the digests of zero bytes.  Texts of any
length are encoded whole.  Repeated rows get equal results; extra columns are
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import prepare, whole_text

#: "no such pair"
NONE = np.uint32(0xFFFFFFFF)
#: Pieces remembered between batches (some 60 MB at most); the memory starts
#: afresh beyond it, which costs time but never changes a result.
MEMORY = 300_000
#: Bytes of tree rows handled in one numpy step.
STEP_CELLS = 1 << 20


class BytePairs:
    """Ranks of a ``.tiktoken`` file: token bytes and their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.of_byte = np.full(256, NONE, np.uint32)
        for b in range(256):
            if bytes([b]) in self.ranks:
                self.of_byte[b] = self.ranks[bytes([b])]
        # two tokens merge when their joined bytes are a token; its id is the pair's rank
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], i) for t, i in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.uint64)
        self.pair_ranks = np.array([r for _, r in pairs], np.uint32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.full(left.shape, NONE)
        key = left.astype(np.uint64) << np.uint64(32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, ``width`` a power of two."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place < size[:, None]
        ids = np.where(live, self.of_byte[flat], NONE)
        after = np.where(place + 1 < size[:, None], place + 1, width).astype(np.int32)  # next live position
        before = np.broadcast_to(place - 1, (n, width)).astype(np.int32)
        tree = np.full((n, 2 * width), NONE)  # node i covers nodes 2i and 2i+1; leaves start at width
        has_next = after[:, :-1] < width if width > 1 else np.zeros((n, 0), bool)
        if width > 1:
            r, c = np.nonzero(has_next)
            tree[r, width + c] = self.rank(ids[r, c], ids[r, c + 1])
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE) if width > 1 else np.array([], np.int64)
        while len(rows):
            best = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < width:  # towards the leftmost leaf that holds the minimum
                node = 2 * node + (tree[rows, 2 * node] != best)
            at = node - width
            gone = after[rows, at]
            ids[rows, at] = best
            live[rows, gone] = False
            then = after[rows, gone]
            after[rows, at] = then
            r = np.flatnonzero(then < width)
            before[rows[r], then[r]] = at[r]
            # the three pairs that change: the merged one's, its left neighbour's, the one that is gone
            new = np.full(len(rows), NONE)
            new[r] = self.rank(best[r], ids[rows[r], then[r]])
            self._put(tree, rows, at, new, width)
            self._put(tree, rows, gone, np.full(len(rows), NONE), width)
            prev = before[rows, at]
            r = np.flatnonzero(prev >= 0)
            if len(r):
                self._put(tree, rows[r], prev[r], self.rank(ids[rows[r], prev[r]], best[r]), width)
            rows = rows[tree[rows, 1] != NONE]
        out = ids[live].astype("<u4")
        return np.split(out, np.cumsum(live.sum(1))[:-1])

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        node = at.astype(np.int64) + width
        tree[rows, node] = rank
        while node[0] > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, STEP_CELLS // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self.encode_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids.tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Encodes batches of texts; different pieces are encoded once a batch."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pairs, self.find = BytePairs(path), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        new = list(set().union(*found).difference(self.known)) if found else []
        if len(self.known) + len(new) > MEMORY:
            self.known, new = {}, list(set().union(*found))
        self.known.update(zip(new, self.pairs.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in found]


def encode_decode(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to every row, and with
    ``ids`` the token ids themselves (``token_ids``)."""
    prepare(documents.sparkSession)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.LongType())))

    @F.pandas_udf(T.StructType(fields))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, pattern)
        for texts in batches:
            coded = encoder.encode(texts.tolist())
            out = {"n_tokens": [len(x) // 4 for x in coded],
                   "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                   "decoded_sha256": [hashlib.sha256(encoder.pairs.decode(x)).hexdigest() for x in coded]}
            if ids:
                out["token_ids"] = [np.frombuffer(x, "<u4").astype(np.int64) for x in coded]
            yield pd.DataFrame(out)

    names = [f.name for f in fields]
    kept = [c for c in documents.columns if c not in names]
    return (documents.withColumn("__bpe", run(whole_text(text)))
            .select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"__bpe.{c}").alias(c) for c in names)))
