"""A corpus pipeline of five stages, each an operator of ``quern.llm`` over all that its predecessor kept.

Every stage takes null, empty and very long texts, null ids, repeated rows, empty tables and columns of any further names,
which it hands on as they are; what each makes of such texts is told at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.byte_bpe import round_trip
from quern.llm.decontaminate import with_leaks
from quern.llm.language import UNKNOWN, identify, train
from quern.llm.near_duplicates import one_of_each
from quern.llm.queries import PATTERN, tokenizer_file
from quern.llm.secret_scan import redact
from quern.llm.shared import free_name, shared_path

#: Share of a document's words that must favour its language; below it the language is taken as unknown.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts among them), and those no language of which is clear.

    The model learns from ``docs``; where none has a language, all are dropped. Repeated rows stay or go together.
    """
    name = free_name(docs.columns, "__language")
    found = identify(docs, train(docs), into=name)
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, and one of a row given several times; texts without a word stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item. Null and empty texts hold none and stay, as does all if there is no item."""
    name = free_name(docs.columns, "__leaks")
    return with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=name).where(F.size(name) == 0).drop(name)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, a null text as null. ``n_chars`` follows the text where there is
    such a column."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to; a null text is an empty one."""
    return round_trip(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the learned model nor the merges; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
