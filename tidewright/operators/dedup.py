"""Deterministic deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order`` (nulls last). Give an order that is total.

    The first row is the one with none before it; a rank of 1 would make Spark sort all rows before
    the shuffle as well, which pays only where most rows are repeats."""
    by = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    name = "__first"
    return df.withColumn(name, F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col(name).isNull()).drop(name)
