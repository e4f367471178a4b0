"""Cleaning pipeline over documents: language, near copies, repeated passages, leaked tests, tokens.

Each stage works on what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, bwt, langid, minhash, tiling
from rasterloom.llm.common import stage, table, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose n-grams are further out of place than this share of the profile, in whatever language, are rejected.
LEAST_SCORE = 0.25
#: Near copies have at least this percentage of their shingles of five words in common.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; rejected are null texts, those without a letter and those far from every profile."""
    tune(spark)
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs.withColumnRenamed("lang", "own_lang"), langid.learn(docs), ["doc_id", "text", "own_lang", "source", "n_chars"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumnRenamed("own_lang", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    tune(spark)
    return minhash.first_of_groups(docs.select(*COLUMNS), NEAR_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with a smaller doc_id hold; n_chars is that of the text left."""
    tune(spark)
    rest = bwt.remove_repeats(docs.select(*COLUMNS), ["lang", "source", "n_chars"])
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return tiling.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left, encoded and decoded."""
    tune(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("tokenise", tokenise),
]

#: Signatures, tilings and merges of subwords are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
