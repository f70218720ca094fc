"""Registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, license_scan, maxscore, media_chunks, ngram_join, packing, pii, source_mix, token_codes, toxicity
from .common import table



def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file; the variable TIDEMARK_TOKENIZERS names another folder of them."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_table(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_table(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("id % 50 = 0"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_chunks": op1_media_chunks,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_codes": op6_token_codes,
    "op7_source_mix": op7_source_mix,
    "op8_license_scan": op8_license_scan,
    "op9_maxscore": op9_maxscore,
    "op10_best_fit": op10_best_fit,
}

ORACLES: dict[str, str] = {
    "op7_source_mix": source_mix.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op9_maxscore": maxscore.ORACLE,
}
