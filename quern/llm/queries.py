"""The queries of the operators, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import oracles

TOKENIZER_FILES = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file: that of the installed package, else of the folder above."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_FILES}/{name}"
    return public_tokenizers.path(name)


#: Fixed value: the pattern that splits text before the merges of the rank files (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import language_table

    return language_table(_table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_store import store_round_trip

    return store_round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_table

    return quality_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licences import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.vector_duplicates import vector_classes

    return vector_classes(_table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.periodic_runs import run_table

    return run_table(_table(spark, sf_dir, "documents"))


def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.interpolation import score_table

    return score_table(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.hard_negatives import negative_table

    return negative_table(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_language_id, op4_html_text, op5_token_store, op6_near_duplicates, op7_vector_duplicates, op8_secret_scan, op9_byte_bpe, op10_licence_scan, op11_periodic_runs, op12_interpolation, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op7_vector_duplicates": oracles.vector_classes(), "op10_licence_scan": oracles.licence_scan(), "op13_hard_negatives": oracles.hard_negatives()}
