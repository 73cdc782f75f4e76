"""Structured Streaming: landing, deduplication, rollups, upserts and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import upsert
from ..sources.bronze import envelope
from ..sources.snapshots import Snapshots


def sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> StreamingQuery:
    """Append micro-batches to a table. Default trigger: 30 s; ``{"availableNow": True}`` runs once."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)


def ingest(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, ingested_at: Column | None = None) -> StreamingQuery:
    """Land a stream of records under their envelope, partitioned by ingestion date and hour."""
    return sink(envelope(records, ingested_at), path, checkpoint, trigger, ("ingestion_date", "ingestion_hour"))


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for a run-once query, and stop it if ``timeout`` seconds pass."""
    try:
        if not query.awaitTermination(timeout) and timeout is not None:
            raise TimeoutError(f"the stream ran longer than {timeout} s")
    finally:
        query.stop()


def dedup(df: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """Drop repeats that arrive within ``delay`` of each other; state older than that is dropped too."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rollup(df: DataFrame, keys: list[str], ts: str, value: str, delay: str = "24 hours", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Windowed aggregates; a window is emitted when the watermark passes its end."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = df.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("reading_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return g.select(F.col("window.start").alias("hour"), *keys, "reading_count", "min_value", "max_value")


def session_rollup(df: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes", delay: str = "24 hours") -> DataFrame:
    """Sessions of a key: runs of events with no pause of ``gap``."""
    g = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_sink(base: str, keys: list[str], reduce: Callable[[DataFrame], DataFrame], update: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps snapshots base/0, base/1, ... of an upserted table.

    Snapshot n is made from snapshot n - 1 and batch n alone, so a batch that runs again after a
    failure writes the same snapshot again. The latest is at base/<last batch id>.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{base}/{batch_id - 1}") if batch_id else None
        upsert(before, reduce(batch), keys, update).write.mode("overwrite").parquet(f"{base}/{batch_id}")

    return apply


def bucket(keys: list[str], buckets: int) -> Column:
    """The hash bucket of a row's keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def bucket_upsert_sink(base: str, keys: list[str], reduce: Callable[[DataFrame], DataFrame], buckets: int = 256, update: dict[str, Column] | None = None, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps an upserted table in hash buckets of its keys (``Snapshots``).

    A batch reads and writes only the buckets that its keys fall into and publishes them as the
    version of its number; a batch that is replayed after that does nothing, one that failed
    before it starts again. The last ``keep`` versions stay readable.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = Snapshots(spark, base)
        if batch_id in table.versions() or batch_id < (table.versions() or [-1])[-1]:
            return
        new = reduce(batch).withColumn("bucket", bucket(keys, buckets)).persist()
        try:
            touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
            schema = new.drop("bucket").schema
            before = table.read(schema, part="bucket", kind="int", only=touched)
            after = upsert(before.select(*new.columns), new, ["bucket", *keys], update)
            table.replace(after, "bucket", batch_id)
        finally:
            new.unpersist()
        table.clean(keep)

    return apply


def in_range(bronze: DataFrame, start: str | Column, end: str | Column, column: str = "ingestion_date") -> DataFrame:
    """Bronze rows ingested in [start, end], by the partition column, so that other days are not read."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return bronze.filter(F.col(column).between(lit(start), lit(end)))


def backfill(bronze: DataFrame, start: str, end: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return build(in_range(bronze, start, end))


def reconcile(bronze: DataFrame, as_of: str, hours: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Recompute from what was ingested in the ``hours`` up to ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    start = F.timestamp_seconds(F.unix_timestamp(end) - hours * 3600)
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    recent = in_range(bronze, day(start), day(end)).filter(F.col("ingestion_timestamp").between(start, end))
    return build(recent)


def reconcile_into(table: Snapshots, bronze: DataFrame, as_of: str, hours: int, build: Callable[[DataFrame], DataFrame], part: str = "ingestion_date", digits: int = 10) -> int:
    """Recompute the parts of ``table`` that the ``hours`` up to ``as_of`` touch, and replace them in one step.

    A part is the first ``digits`` digits of the ingestion date, a day unless given. A part is read
    whole, and only the parts that are replaced are read (a filter on the partition column), so the
    new ones are complete. ``build`` gets those records with the column ``part`` and keeps it. A
    reader sees all parts old or all new; if anything fails they stay old. Gives the version.
    """
    spark = bronze.sparkSession
    first, last = spark.sql(f"SELECT date_format(timestamp'{as_of}' - INTERVAL {hours} HOURS, 'yyyy-MM-dd'), date_format(timestamp'{as_of}', 'yyyy-MM-dd')").first()
    recent = in_range(bronze, first[:digits], last[:digits] + "~")  # behind every date of the last part
    return table.replace(build(recent.withColumn(part, F.substring("ingestion_date", 1, digits))), part)


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Overwrite just the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def run_once(spark: SparkSession, df: DataFrame, out: str, checkpoint: str, timeout: int = 300) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    schema = df.schema
    finish(sink(df, out, checkpoint, {"availableNow": True}), timeout)
    return spark.read.schema(schema).parquet(out)
