"""The registry of the engine's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import NAMESPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a function of (spark, sf_dir) as query ``name``, with its SQL if it has one.

    ``ints`` are columns that are 32-bit in Spark, where DuckDB makes them 64-bit.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if not ints else f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in ints)}) FROM ({sql})"
        return f

    return add


def file_order() -> tuple[Column, Column]:
    """Columns file and row, by which a table's rows stand as its files hold them: for order lines of one number of an order.

    A function, as a column can't be made before there is a Spark session, and queries are listed before there is one.
    """
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of DuckDB SQL, each a second writing of an expression in quern.functions.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '([\\x{{0D80}}-\\x{{0DFF}}\\x{{200D}}]+|[a-zA-Z]+|\\p{{Nd}}+)', 1), lambda t: trim(t, chr(8205))), lambda t: length(t) >= 2)"


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def sql_estimate(text: str) -> str:
    return f"CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE greatest(1, CAST(trunc(len({sql_words(text)}) * 1.35::DOUBLE + length(regexp_replace({text}, '[\\x00-\\x7f]', '', 'g')) / 4.0::DOUBLE) AS INTEGER)) END"


def sql_uuid5(name: str) -> str:
    """Of a name that is a column or other cheap expression, as it is written four times."""
    d = f"sha1(unhex('{NAMESPACE.hex}') || encode({name}))"
    return f"({d}[1:8] || '-' || {d}[9:12] || '-5' || {d}[14:16] || '-' || lower(printf('%02x', (('0x' || {d}[17:18])::INTEGER & 63) | 128)) || {d}[19:20] || '-' || {d}[21:32])"


def sql_unit(v: str) -> str:
    return f"list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"
