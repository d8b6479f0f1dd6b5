"""Histograms with fixed bounds, as monitoring systems keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """(by, le, n): how many values are at most each bound, infinity included, in one aggregation."""
    edges = [*bounds, float("inf")]
    counted = rows.groupBy(by).agg(F.array(*[F.count_if(F.col(value) <= F.lit(e)) for e in edges]).alias("__n"))
    return counted.select(by, F.explode(F.arrays_zip(F.array(*map(F.lit, edges)).alias("le"), F.col("__n").alias("n"))).alias("b")).select(by, F.col("b.le").alias("le"), F.col("b.n").alias("n"))
