"""The pipeline against a plain version of each stage, and the registered queries."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import langid, queries, toxicity
from tests.conftest import SF_SMALL
from tests.llm.test_links_and_sets import brute as components

LEAST = 100


def plain_strip(rows):
    """Texts without 100-byte strings that start earlier."""
    first, out = set(), {}
    for d, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - LEAST + 1):
            w = raw[s:s + LEAST]
            if w in first:
                gone[s:s + LEAST] = b"\1" * LEAST
            first.add(w)
        out[d] = bytes(b for b, m in zip(raw, gone, strict=True) if not m).decode("utf-8", "ignore")
    return out


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = langid.train(docs, ~langid.held_out())

    def language_kept(t):
        if t is None or not any(map(str.isalpha, t)):
            return False
        w = langid.windows_of(t.encode())
        weight = np.maximum((w != 0).sum(1), 1)
        return (net.probabilities(w) * weight[:, None]).sum(0).max() / weight.sum() >= corpus_pipeline.LEAST_LANG_SCORE

    rows = {i: t for i, t in rows.items() if language_kept(t)}
    kept = docs.filter(docs.doc_id.isin(list(rows)))
    machine = toxicity.train(kept, labels)

    def clean(t):
        hits = sorted(machine.terms[int(h)] for h in toxicity.text_terms(t) if int(h) in machine.terms)
        return machine.score([np.array(hits, np.int64)])[0] < toxicity.CUT

    rows = {i: t for i, t in rows.items() if clean(t)}
    group = components(list(rows.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    rows = plain_strip([(i, t) for i, t in rows.items() if group[i][1] == i])
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in rows.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 4096, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for a, b in zip(places, places[1:], strict=False):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name == corpus_pipeline.STAGES[-1][0]:
                assert out.columns[:2] == ["doc_id", "piece"]
            else:
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
                assert out.count() <= docs.count()


CONTRACT = {
    1: "doc_id held_out lang_pred score", 2: "doc_id n_tokens ids_sha256 decoded_sha256",
    3: "doc_id piece start length ids_crc32 sequence_id offset",
    4: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    5: "doc_id n_shingles component_id", 6: "doc_id held_out score predicted",
    7: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    8: "doc_id n_bytes n_removed n_spans kept_sha256", 9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "page_id host path rule verdict"}


@pytest.mark.parametrize("n", sorted(CONTRACT))
def test_contract_columns(spark, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert out.columns[:len(CONTRACT[n].split())] == CONTRACT[n].split()
    if n != 3:
        table = "pages" if n == 10 else "documents"
        assert out.count() == spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
