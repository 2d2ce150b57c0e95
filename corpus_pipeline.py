"""The corpus pipeline: documents in, tokens of the clean and different ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowecho.llm import decontam, exact_dedup, langid, pieces, simhash
from rowecho.llm.common import new_path, sample_texts, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus itself teaches; those without a letter or far from every
    language go."""
    learnt = langid.learn(sample_texts(langid.learning_rows(docs), langid.SAMPLE_ROWS, langid.SAMPLE_CHARS))
    return langid.drop_rejected(docs, learnt)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the smallest id."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return exact_dedup.drop_duplicates(docs, name, f"{shared_folder(spark)}/{name}")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked SimHash fingerprints: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and digests of them and of the text they decode to."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: models learnt from the corpus, fingerprints and merge rounds are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
