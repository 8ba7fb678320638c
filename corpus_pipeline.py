"""A corpus pipeline of five stages, from documents to files of token ids.

Each stage reads all that the one before it kept. All but the last give the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, langid, mixing, simhash, tokenids
from corpusmill.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without a letter, and those whose best language has too small a share.

    Long texts are scored whole; repeated rows are kept or dropped alike; an empty table gives no rows.
    """
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least doc_id, a null one first; of rows of one id, the first by file and place.

    Texts without words, null ones too, are copies of each other; an empty table gives no rows.
    """
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark passages.

    Null and empty texts, and texts without words, hold none and stay; repeated rows stay or go alike; an empty benchmark drops nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads sources in the shares that their weights ask for: a row for each time that a document is read, up to three.

    Texts without words, null ones too, are never read; a null source is a source of its own; rows of one id are separate documents; a
    source's last document may be cut.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids as ORC files; a row for each document written, from those files.

    A null or empty text is the end id alone; a null doc_id comes first; rows of one id follow each other by a hash of their text.
    """
    return tokenids.encode_and_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: A learned classifier and a tokenizer are no SQL: tests/llm/test_pipeline.py holds the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
