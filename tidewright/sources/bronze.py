"""Raw landing: the event envelope, batch and stream readers, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a log broker's source gives for every record.
STREAM_SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"
#: The columns of the two seed files.
KITCHEN_SCHEMA = "kitchen_id string, name string, city string, state string, lat double, lon double, capacity_orders_per_hour int, opened_date date, is_active boolean"
BRAND_SCHEMA = "brand_id string, brand_name string, cuisine_type string, launch_date date, is_active boolean"


def envelope(records: DataFrame, ingested_at: Column | None = None, day: Column | None = None) -> DataFrame:
    """Raw value as text, broker columns, and the ingestion time with its partition strings. ``day``: the
    day of that time, where the records have it already.

    The clock is a parameter; on a stream leave it out for the time of each micro-batch.
    """
    df = records.select(
        F.col("value").cast("string").alias("raw_value"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingestion_timestamp"),
        *([] if day is None else [day.alias("ingestion_date")]),
    )
    if day is None:
        df = df.withColumn("ingestion_date", F.date_format("ingestion_timestamp", "yyyy-MM-dd"))
    return df.withColumn("ingestion_hour", F.date_format("ingestion_timestamp", "HH"))


def read_stream(spark: SparkSession, topic: str, servers: str | None = None, fmt: str = "kafka", schema: str | None = None, **options: str) -> DataFrame:
    """A stream of records; ``fmt`` other than kafka reads files of the same schema at ``path``."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        base = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"}
        return reader.options(**(base | options)).load()
    path = options.pop("path")
    return reader.schema(schema or STREAM_SCHEMA).options(**options).load(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table by format; ``mergeSchema="true"`` takes the columns of all its files."""
    return spark.read.format(fmt).options(**options).load(path)


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A seed CSV with a header under an explicit schema; column names in lower case."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.toDF(*[c.lower() for c in df.columns])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
