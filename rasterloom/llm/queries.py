"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, bpe, bwt, crf, langid, minhash, oracle, suffixtree, tiff, tiling, urls
from .common import crc_mod, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeats(table(spark, sf_dir, "documents"))


# The rules of the URL query.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(crc_mod("doc_id", 5) != 0))
    own = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return langid.identify(own, profiles, ["doc_id", "held_out"])


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    own = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return crf.score(own, crf.learn(docs, labels), ["doc_id", "held_out"])


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, _ = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_digests(table(spark, sf_dir, "documents"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffixtree.score(docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 1).alias("held_out")))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.tokenise_to_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_tiff_media that don't depend on the stored form."""
    return op8_tiff_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def word_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_suffix_tree that don't depend on the tree."""
    return op9_suffix_tree(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 5))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_language_id, op4_toxic_spans, op5_string_tiling, op6_byte_bpe, op7_super_minhash, op8_tiff_media, op9_suffix_tree, op10_token_shards, media_payloads, word_base_scores)}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = oracle.sql(URL_RULES)
