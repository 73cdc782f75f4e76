"""Joins of two streams whose rows belong together within a span of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, earliest: str, latest: str, left_delay: str = "10 minutes", right_delay: str = "10 minutes", how: str = "left") -> DataFrame:
    """Rows of ``left`` with those of ``right`` that have their keys and lie between ``earliest`` and
    ``latest`` behind them; ``how="left"`` gives a row without a partner once none can come.

    Both sides have a watermark and the condition bounds the time between them, so a stream keeps
    of each side only what can still find a partner, and a row that comes behind the watermark
    is dropped. Without partner, a row is given when the watermark (the lesser of the two) passes
    its span. On tables the watermarks mean nothing and the result is the same, for rows that are
    not late. Null keys and times have no partner. Columns: those of left, then right's others.
    """
    a, b = left.alias("l"), right.alias("r")
    if left.isStreaming:
        a, b = left.withWatermark(left_ts, left_delay).alias("l"), right.withWatermark(right_ts, right_delay).alias("r")
    on = (F.col(f"r.{right_ts}") >= F.col(f"l.{left_ts}") + F.expr(f"INTERVAL {earliest}")) & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + F.expr(f"INTERVAL {latest}"))
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return a.join(b, on, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])
