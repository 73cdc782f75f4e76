"""Exact distinct counts that add up: bitmaps over dense ids, stored by day and merged for any longer time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that values are numbered in.
CELLS = 4096


def dense_ids(values: DataFrame, column: str, known: DataFrame | None = None, cells: int = CELLS) -> DataFrame:
    """(column, id) with ids 0, 1, 2 ... for all values; those in ``known`` keep theirs, new ones follow.

    Values are dealt over cells by their hash, cells are counted, and a value's id is its cell's start
    plus its place there, so no task sees more than a cell. Null has no id.
    """
    c = F.col
    new = values.select(column).dropna().distinct()
    start = 0
    if known is not None:
        new = new.join(known, column, "left_anti")
        start = (known.agg(F.max("id")).first()[0] if not known.isEmpty() else -1) + 1
    new = new.withColumn("__cell", F.pmod(F.xxhash64(column), F.lit(cells)))
    counts = new.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    bases = counts.select("__cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy(column)) - 1
    out = new.withColumn("__at", place).join(F.broadcast(bases), "__cell").select(column, (c("__base") + c("__at") + start).alias("id"))
    return out if known is None else known.select(column, "id").unionByName(out)


def bitmaps(rows: DataFrame, keys: list[str], ids: DataFrame, column: str) -> DataFrame:
    """keys, bucket, bits: which ids occur under each key, 32 768 to a bitmap, one row a key and bucket.

    Ids are dealt before bitmaps are made of them: a bitmap has 4 KB whatever is in it, and where a
    task sees few ids of a key, bitmaps combined before the shuffle would be a thousand times the ids.
    Bitmaps of coarser keys are made by ``merged``."""
    found = rows.join(ids, column).select(*keys, F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("__at"))
    return found.repartition(*keys, "bucket").groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("__at").alias("bits"))


def merged(parts: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Bitmaps of coarser keys (a week for its days) from finer ones, sorted once, after the shuffle."""
    keyed = parts.select(*keys, "bucket", "bits")
    names = keyed.columns[:-1]
    return keyed.repartition(*names).groupBy(*names).agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(parts: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """How many different ids lie under each key; each bucket must have one row a key (``merged``)."""
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
