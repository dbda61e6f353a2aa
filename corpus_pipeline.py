"""A corpus pipeline from the operators of graphspark.llm: language, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of `documents`, and other columns of docs, whatever their names, are left out. What holds for every stage: an empty table
gives no rows; texts of any length are worked on whole; null doc_ids and repeated rows are rows like any other, but for
near-duplicates. Each stage says the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import langid, mixing, packing, pii, simhash
from graphspark.session import cut, read_table, remove_dir, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if no language is likelier than this; texts without letters always are.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; if no row has a language to learn from, all that hold a letter.

    Null and empty texts, and those without a letter, go. Of equally likely languages the first by name counts.
    """
    names, params = langid.train(docs)
    return langid.recognised(docs.select(COLUMNS), (names, params), LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, null ones after all others.

    Near-duplicates share five-word shingles with a Jaccard similarity of 0.8 or more, as wide signatures tell. Texts without
    a word, null ones among them, are one group; of rows that repeat one another one stays.
    """
    return simhash.deduplicated(docs.select(COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and n_chars by what the text then has; spans that overlap become one. A null text stays null."""
    return pii.redacted(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents.

    A null source is a source of its own; texts without a word take nothing and go; rows that repeat one another share what
    they take evenly.
    """
    return mixing.mixed(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a null text is just the closing id."""
    return packing.packing(docs.select(COLUMNS))


STAGES = [("language", language), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

#: Network training, hashing and tokens can't be said in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read again.

    The folders go as soon as the next stage is written. The last stage's rows are a checkpoint, which Spark removes with
    the frame where its cleaner is set to.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        before = None
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before:
                remove_dir(spark, before)
            before = f"{folder}/{k}-{name}"
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove_dir(spark, folder)
