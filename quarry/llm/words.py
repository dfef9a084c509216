"""Words and shingles of a text, hashed in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers that place a word in its shingle, and those of the final mix.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S33)) * MIX_A
    x = (x ^ (x >> S33)) * MIX_B
    return x ^ (x >> S33)


def words(text: str) -> list[bytes]:
    """Runs of bytes other than space and 09-0D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` words, repeats included; the whole
    sequence as one when it has fewer words; nothing without words."""
    found = words(text)
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    if n < k:
        return mix(np.array([(h * PLACE[:n]).sum() + np.uint64(n)], np.uint64))
    out = h[:n - k + 1] * PLACE[0]
    for j in range(1, k):
        out += h[j:n - k + 1 + j] * PLACE[j]
    return mix(out)


#: Bytes of texts hashed at once: few arrays of eight bytes a byte fit a core's cache.
BLOCK = 1 << 18
#: Places in a word that have a factor of their own; beyond them it is a product of two.
PLACES = 1 << 12
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _factors(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers without a pattern."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) | np.uint64(1)


BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
BYTE[65:91] = BYTE[97:123]
BYTE[SPACE] = 0
IN_WORD = _factors(PLACES, 2)


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``BLOCK`` bytes, of at least one text."""
    ends = _ends(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
        yield texts.slice(first, last - first)
        first = last


def _ends(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, as ``words`` cuts them, and how many words each has:
    the mixed sum of a number for each byte times a number for its place in the word."""
    ends = _ends(texts)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8)[ends[0]:ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    first = ~SPACE[data]
    inner = first.copy()
    first[1:] &= ~inner[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] = inner[begin]
    start = np.flatnonzero(first)
    del first, inner
    many = np.diff(np.searchsorted(start, ends))
    out = np.zeros(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + BLOCK, BLOCK)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # words that begin in one block
        low, high = int(start[a]), int(start[b]) if b < len(start) else len(data)
        at = start[a:b] - low
        span = np.diff(np.r_[at, high - low])
        place = np.arange(high - low, dtype=np.int32) - np.repeat(at.astype(np.int32), span)  # an Arrow text is below 2^31 bytes
        part = BYTE[data[low:high]]
        if span.max() > PLACES:
            far = np.r_[np.uint64(1), _factors(int(span.max()) // PLACES, 3)]
            part *= far[place // PLACES]
            place %= PLACES
        part *= IN_WORD[place]
        out[a:b] = np.add.reduceat(part, at)
    return mix(out), many


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of ``k`` words of each text, hashed and sorted, one set after the
    other, and where the sets begin and the last one ends.  A text with fewer words is one shingle."""
    h, many = word_hashes(texts)
    last = np.cumsum(many)
    left = np.repeat(last, many) - np.arange(len(h))  # words from here to the text's end
    whole = left >= k
    items = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        for j in range(k):
            items[:len(h) - k + 1] += h[j:len(h) - k + 1 + j] * PLACE[j]
    for i in np.flatnonzero((many > 0) & (many < k)):
        n, begin = int(many[i]), int(last[i] - many[i])
        items[begin] = (h[begin:begin + n] * PLACE[:n]).sum() + np.uint64(n)
        whole[begin] = True
    items = mix(items[whole])
    of = np.repeat(np.arange(len(many)), many)[whole]
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(many)))].astype(np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        items[a:b].sort()
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (of[1:] != of[:-1])
    return items[new], np.r_[0, np.cumsum(np.bincount(of[new], minlength=len(many)))].astype(np.int64)
