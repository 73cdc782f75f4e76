"""Pieces shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components, cut  # noqa: F401

#: The words of a text: runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of the session's checkpoints; only where neither is
    set and the master is local (tests on one machine) a new local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words_of(text: Column) -> Column:
    """Array of words; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches at row borders so that each holds about ``max_bytes`` of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows + 1, np.int64)
        np.cumsum(byte_lengths(batch.column(column)), out=sizes[1:])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[start] + max_bytes, "right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end


def byte_lengths(strings: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each string, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, salts: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... without gaps inside each group, however large a group is.

    A group is dealt over ``salts`` cells by a hash of ``order`` (by default so many that the
    table's rows, were they one group, gave cells of 50 000); cells are counted with map-side
    aggregation, their starts are running sums of at most ``salts`` counts a group, and only the rows
    of one cell meet in a task. The number of a row depends on its content alone, so a lost task
    gives the same numbers again; rows that agree in ``order`` may swap numbers.
    """
    cell, base, at = "__cell", "__base", "__at"
    if salts is None:
        salts = max(512, df.count() // 50_000)
    df = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, cell, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)).cast("long") - 1
    ranked = df.withColumn(at, inside)
    joined = ranked.join(bases, [*group, cell])
    return joined.withColumn(name, F.col(base) + F.col(at)).drop(cell, base, at)
