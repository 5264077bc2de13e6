"""A training corpus from raw documents: identified, without near copies and test items, mixed, and written as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, jaccard_join, language_id, mixing, token_file
from corpusloom.llm.common import staged, table
from corpusloom.llm.queries import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that identification rejects go."""
    return language_id.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document."""
    return mixing.mix_sources(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written to a token file in the shared folder; what is read back: doc_id, start, n_tokens, ids_crc32."""
    return token_file.round_trip(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("jaccard_join", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_file", token_ids),
]

#: Learned models, alignment and tokenizing have no SQL twin; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again: doc_id, start, n_tokens, ids_crc32, a row for each repetition.

    documents may hold any further columns, whatever their names. Null, empty and letterless texts go with the first stage, as no
    language is identified; of rows that repeat id and text one stays, of near copies the one with the smallest id (null ids last);
    rows with one id and unlike texts stay rows of their own, and a null id stays null. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
