"""The registered queries of this subpackage: one per operator, each over its
whole table, and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (bpe, divergence, fingerprints, langid, packing, partenum, quality, sharding, suffix_dedup, toxicity, urls,
                        vector_codes, warc)
from quarry.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_language_id")
def op1(spark, sf_dir):
    """Predicted language of every document."""
    return langid.classify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op2_bpe_segment_tree")
def op2(spark, sf_dir):
    """Byte-level BPE ids of every text and their decoding, as digests."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return (bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    """Every document's token pieces and their places in sequences of 4096."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path("word_bpe_49k.json"))


@query("op4_fingerprints")
def op4(spark, sf_dir):
    """MinHash fingerprints of every document and its edited text."""
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_ngram_jaccard_join")
def op5(spark, sf_dir):
    """Component of every document under 4-word shingle Jaccard of 0.85 or more."""
    return partenum.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_toxicity")
def op6(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    """Quality counts and verdict on every document."""
    return quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    """What remains of every document without repeated 100-byte strings."""
    return suffix_dedup.removed_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_feistel_sharding")
def op9(spark, sf_dir):
    """Every document's shard and slot among 40."""
    return sharding.shard(read(spark, sf_dir, "documents"), 40)


@query("op10_url_filter", urls.oracle())
def op10(spark, sf_dir):
    """Verdict on every page's url."""
    return (urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
            .select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"))


@query("op11_warc", warc.oracle())
def op11(spark, sf_dir):
    """The records of every page, written to WARC archives and read back."""
    return warc.archived(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op12_vector_codes", vector_codes.oracle())
def op12(spark, sf_dir):
    """Product code and error of every vector."""
    return vector_codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op13_source_divergence", divergence.oracle())
def op13(spark, sf_dir):
    """Divergences between the sources of each language and their telling terms."""
    return divergence.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))
