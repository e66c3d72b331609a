"""From raw documents to a training mix in five stages, each written before the next one reads it.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps
(the last one: the mix). run(spark, sf_dir) applies them to the table `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadweave.llm import bagminhash, langid, mixing, positional, secrets
from leadweave.shipping import ship
from leadweave.storage import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Null, empty and letterless texts are in none and go; so does every text if no row says its language. Texts of any
    length are read whole, rows of equal text fare alike, repeated rows stay. All columns stay, whatever their names.
    An empty table gives an empty one.
    """
    ship(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Of a group stays the row with the smallest doc_id, null ids last; of rows with equal id and text any one. Groups are
    told by texts alone, so that equal and null ids of different texts join nothing. Null and wordless texts all stay.
    Texts of any length are compared whole. All columns stay, whatever their names. An empty table gives an empty one.
    """
    ship(spark)
    return bagminhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay, and so does all if there are no items. Whole texts of any length are
    searched; each row fares by its own text, so repeated rows and ids do alike. All columns stay, whatever their
    names. An empty table gives an empty one.
    """
    ship(spark)
    return positional.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the names of the kinds.

    Null and empty texts stay as they are, texts of any length are searched whole, repeated rows stay. All columns
    stay, whatever their names. An empty table gives an empty one.
    """
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often: mix_size, mix_copies.

    A null source is one of its own; null and empty texts have size 0. Rows of equal id are taken alike. All columns
    stay; where one has a name of the two new ones, those get an underscore. An empty table gives an empty one.
    """
    return mixing.take_mix(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("source_mix", mix),
]

#: The stages learn from, hash and compare whole texts in ways that SQL can't express; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents.

    Each stage but the last is written to the shared folder and read again, so that a lost executor costs its tasks
    alone. Odd rows and tables fare as the stages say; an empty table of documents gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
