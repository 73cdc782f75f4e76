"""Sensor readings: cleaning, anomaly rules, rollups and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_key
from .dedup import dedup_first
from .facts import resolve_fk

SCHEMA = "reading_id string, sensor_id string, kitchen_id string, sensor_type string, value string, unit string, zone string, event_timestamp string"
#: A reading above its type's limit is anomalous; a type without a limit never is.
TYPE_LIMITS = {"temperature": 400.0, "humidity": 75.0, "fryer_timer": 600.0}
#: Temperature limits by zone, and the humidity limit of any zone.
ZONE_LIMITS = {("temperature", "fryer"): 400.0, ("temperature", "grill"): 500.0, ("temperature", "cooler"): 45.0, ("temperature", "ambient"): 85.0, ("humidity", None): 75.0}


def type_rule(limits: dict[str, float] = TYPE_LIMITS) -> Column:
    out = F.lit(False)
    for kind, limit in limits.items():
        out = F.when(F.col("sensor_type") == kind, F.col("value") > limit).otherwise(out)
    return out


def zone_rule(limits: dict[tuple[str, str | None], float] = ZONE_LIMITS) -> Column:
    out = F.lit(False)
    for (kind, zone), limit in limits.items():
        here = (F.col("sensor_type") == kind) & (F.lit(True) if zone is None else F.col("zone").eqNullSafe(F.lit(zone)))
        out = F.when(here, F.col("value") > limit).otherwise(out)
    return out


def clean(bronze: DataFrame, rule: Column | None = None) -> DataFrame:
    """Parsed readings, the first ingested of each id, without those that have no value."""
    p = bronze.select("*", F.explode(F.array(F.from_json("raw_value", SCHEMA))).alias("p"))
    df = p.select(
        "p.reading_id", "p.sensor_id", "p.kitchen_id", "p.sensor_type", F.col("p.value").try_cast("double").alias("value"), "p.unit", "p.zone",
        F.try_to_timestamp("p.event_timestamp").alias("event_timestamp"), "ingestion_timestamp", "kafka_offset",
    )
    df = dedup_first(df, ["reading_id"], ["ingestion_timestamp", "kafka_offset"]).drop("kafka_offset").filter("value is not null")
    return df.withColumn("is_anomaly", type_rule() if rule is None else rule)


def hourly(clean_readings: DataFrame) -> DataFrame:
    keys = ["kitchen_id", "sensor_id", "sensor_type", "zone", F.date_trunc("hour", "event_timestamp").alias("hour")]
    return clean_readings.groupBy(*keys).agg(
        F.round(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count_if("is_anomaly").alias("anomaly_count"), F.count(F.lit(1)).alias("reading_count"),
    )


def fact_hourly(clean_readings: DataFrame, kitchens: DataFrame) -> DataFrame:
    """The hourly rollup with the keys of its dimensions; unknown kitchens are -1."""
    h = resolve_fk(hourly(clean_readings), kitchens, "kitchen_id", "kitchen_key")
    return h.withColumn("date_key", date_key(F.col("hour")))


def _by_sensor() -> Window:
    return Window.partitionBy("sensor_id").orderBy("event_timestamp", "reading_id")


def jumps(readings: DataFrame, most: float = 20.0) -> DataFrame:
    """Readings that differ from their sensor's last one by ``most`` or more."""
    df = readings.withColumn("previous_value", F.lag("value").over(_by_sensor()))
    return df.withColumn("drift", F.abs(F.col("value") - F.col("previous_value"))).filter(F.col("drift") >= most)


def gaps(readings: DataFrame, seconds: int = 300) -> DataFrame:
    """Silences of a sensor longer than ``seconds``."""
    df = readings.withColumn("previous_timestamp", F.lag("event_timestamp").over(_by_sensor()))
    gap = F.unix_timestamp("event_timestamp") - F.unix_timestamp("previous_timestamp")
    return df.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > seconds)


def arrival_lag(rows: DataFrame, group: str, event: str, arrived: str) -> DataFrame:
    """Lag of arrival behind the event, and events that arrived after a later one."""
    df = rows.withColumn("lag_s", F.unix_timestamp(arrived) - F.unix_timestamp(event))
    seen = F.max(event).over(Window.partitionBy(group).orderBy(arrived, event).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("late_order", F.col(event) < seen)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("lag_s").alias("min_lag"), F.max("lag_s").alias("max_lag"), F.percentile("lag_s", F.lit(0.5)).alias("median_lag"), F.count_if("late_order").alias("out_of_order"))
