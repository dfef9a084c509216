"""BPE and packing: against the libraries and exact round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, packing
from tests.llm.conftest import odd_rows

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n  x", "Don't  STOP\u00a0it's", "a" * 700, "日本語のテキスト", "naïve café é", "<|endoftext|>", "\x00\x1c\x85",
       "1234567 12.5% ___ ...", "\U0001f600\U0001f601 ok", "İstanbul ΣΑΣ", "ª º ǅ ŉ", "e\u0301 \u0301x"]


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segment_tree_equals_the_library():
    enc, own = library(), bpe.Encoder(RANKS, P.PATTERN)
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    for text, ids in zip(ODD + noise, own.encode(ODD + noise), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert own.pairs.decode(ids) == text.encode()


def test_bpe_of_a_table(odd, empty):
    enc, texts = library(), dict(odd_rows())
    out = bpe.encode_decode(odd, RANKS, P.PATTERN, ids=True)
    assert out.columns == [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids").collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_decode(empty, RANKS, P.PATTERN).count() == 0


def tokenizer():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 40)
    t, own = tokenizer(), packing.WordEncoder(WORDS)
    texts = ODD + [x or "" for _, x in odd_rows()]
    for k in range(0, len(texts), 7):
        for text, ids in zip(texts[k:k + 7], own.encode([x.encode() for x in texts[k:k + 7]]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_best_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 900):
        sizes = rng.integers(1, 4097, n)
        place, offset, fill = packing.best_fit(sizes)
        for b in range(len(fill)):
            inside = np.flatnonzero(place == b)
            order = inside[np.argsort(offset[inside])]
            assert offset[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist()
            assert sizes[order].sum() == fill[b] <= 4096


def check_packing(rows, out):
    t = tokenizer()
    expected = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in out) == sorted(expected)
    inside = {}
    for r in out:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(inside)


def test_packing_of_a_table(odd, empty):
    rows = odd_rows()
    check_packing(rows, packing.pack(odd, WORDS).collect())
    assert packing.pack(empty, WORDS).count() == 0


def test_rounds_merge_what_tasks_left_open(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    rng = random.Random(4)
    rows = [(i, " ".join(["ab"] * rng.choice([3, 40, 500, 1300, 2500]))) for i in range(150)]
    rows += [(None, "x y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    out = packing.pack(df, WORDS).collect()
    bins = check_packing([(-1 if i is None else i, t) for i, t in rows],
                         [type(r)(**{**r.asDict(), "doc_id": -1 if r.doc_id is None else r.doc_id}) for r in out])
    lower = -(-sum(r.length for r in out) // 4096)
    assert bins <= lower * 1.15 + 2
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    low = sorted(f for f in fill.values() if f <= 4096 - packing.SLACK)
    assert len(low) < 2 or low[0] + low[1] > 4096  # no two sequences can be joined


def test_least_filled_bins_take_what_is_left(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([100, 900, 2048, 2049, 2500, 2500, 2500, 4000])) for i in range(300)]
    got = [r.fill for r in packing.joinable(spark.createDataFrame(rows, "bin long, fill long")).collect()]
    small = [f for _, f in rows if f <= 2048]
    large = sorted(f for _, f in rows if f > 2048)
    assert sorted(got) == sorted(small + large[:len(small)])
    assert packing.joinable(spark.createDataFrame([(1, 3000), (2, 2049)], "bin long, fill long")).count() == 0
