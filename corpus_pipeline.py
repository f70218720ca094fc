"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns a DataFrame; all but
the last return the columns of ``documents``. Null and empty texts, repeated rows, extra columns and empty tables are
handled as the operators' docstrings define; extra columns of ``documents`` are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngram_join, packing, pii, source_mix, toxicity
from tidemark.llm.common import durable, shrink_heaps, small_batches, table
from tidemark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows to an Arrow batch in all stages: one executor lives through all of them, and what it and its workers once held for a
#: batch stays with them in part.
ROWS = 500


def begin(spark: SparkSession) -> None:
    """No stage begins with the heap that the one before it left, and none takes more than small batches."""
    shrink_heaps(spark)
    small_batches(spark, ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    begin(spark)
    docs = docs.select(COLUMNS)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    begin(spark)
    return ngram_join.keep_one(docs.select(COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    begin(spark)
    docs = docs.select(COLUMNS)
    return pii.redact(docs, pii.train(docs)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source's words meet its target."""
    begin(spark)
    return source_mix.mixed_rows(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 1024 tokens."""
    begin(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers, a trained model and greedy packing have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
