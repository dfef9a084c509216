"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; ``run`` writes each result as Parquet under the shared
checkpoint folder and reads it back for the next.  All stages but the last
return the columns of documents.

Cases: null texts have no language and go in the first stage, as do texts without
letters and texts whose language is uncertain.  Rows that repeat a doc_id and
its text are one document from the third stage on; different texts of an id are
documents of their own there.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import langid, packing, partenum, suffix_dedup, toxicity
from quarry.llm.common import prepare, read, store, whole_text

#: Documents whose best language has less than this probability are rejected.
LEAST_LANG_SCORE = 0.5
#: Five-word shingles and a similarity of 0.8, for the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _plain(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in names))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    prepare(spark)
    net = langid.train(docs, ~langid.held_out())
    own = _fresh(docs, "told_lang")
    told = docs.withColumn(own, langid.predict(net, F.col("text")))
    kept = (F.col(f"{own}.lang_pred") != langid.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_LANG_SCORE)
    return _plain(told.filter(kept), docs.columns)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    prepare(spark)
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    own = _fresh(docs, "toxic_score")
    told = docs.withColumn(own, toxicity.predict(machine, F.col("text")))
    return _plain(told.filter(F.col(own) < toxicity.CUT), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, of its
    texts the one with the smallest key."""
    key, did = _fresh(docs, "key"), _fresh(docs, "id")
    rows = store(partenum.set_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT), "near_sets")
    named = rows.filter("doc_id is not null")
    kept = named.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("at")).select("at.*")
    kept = kept.union(named.filter("component is null").select("doc_id", "text_key"))  # without words
    kept = store(kept.select(F.col("doc_id").alias(did), F.col("text_key").alias(key)).distinct(), "kept_ids")
    here = docs.filter("doc_id is not null").withColumn(did, F.col("doc_id")).withColumn(key, F.xxhash64(whole_text()))
    out = here.join(kept, [did, key], "left_semi")
    if not named.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():  # equal texts of an id: the smallest row
        out = out.groupBy(did, key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")).select("row.*")
    return _plain(out, docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus."""
    return suffix_dedup.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, f"stage_{name}")
    return docs
