"""Corpus preparation in five stages; each works on all that the one before kept.

``STAGES`` lists them in order as (name, function); each function takes (spark, docs, sf_dir). All but the last
return the columns of ``documents``. SQL can express neither the XXH64 fingerprints nor the tokenizer, so there
is no SQL for the whole; the tests hold every stage against a brute-force version on its own input.

In every stage a null text is empty, other columns may be null and are carried on, and a table without rows gives
none; each stage says what it does with repeated rows and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import mixing, packing, quality, simhash, suffix
from reelframe.llm.cluster import settle, shared_dir
from reelframe.llm.tokens import public_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected; each of repeated rows is judged alike."""
    return quality.keep_good(spark, docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are alike by 0.8 or more the one with the
    smallest doc_id. Rows repeated under that doc_id all stay; rows without a doc_id stay only where no other row
    of their component has one; texts without words are alike."""
    return simhash.keep_one(spark, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 that stand elsewhere too, repeated rows among them; a document
    of which nothing is left stays with an empty text."""
    return suffix.without_repeats(spark, docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws of each document, a row for each time through its source. A document without
    words is never drawn; rows that share a doc_id or have none are rows of their own; a null source is a source."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of the mix's documents in sequences of 4096 tokens, a row a piece; repeated rows have a piece each."""
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mixing_sources),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
