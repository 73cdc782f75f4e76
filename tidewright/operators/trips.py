"""Courier positions to delivery trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_key, haversine_km, minutes_between, mph_to_kmh, strip_platform, surrogate_key
from .dedup import dedup_first

SCHEMA = "delivery_id string, order_id string, driver_id string, lat string, lon string, speed_mph string, event_timestamp string, sync_timestamp string"


def pings(bronze: DataFrame) -> DataFrame:
    """Parsed, valid positions, one per delivery and instant."""
    p = bronze.select("*", F.explode(F.array(F.from_json("raw_value", SCHEMA))).alias("p"))
    num = lambda c: F.col(f"p.{c}").try_cast("double").alias(c)
    time = lambda c: F.try_to_timestamp(f"p.{c}").alias(c)
    df = p.select("p.delivery_id", "p.order_id", "p.driver_id", num("lat"), num("lon"), num("speed_mph"), time("event_timestamp"), time("sync_timestamp"), "ingestion_timestamp", "kafka_offset")
    df = df.filter("delivery_id is not null and event_timestamp is not null and lat between -90 and 90 and lon between -180 and 180")
    return dedup_first(df, ["delivery_id", "event_timestamp"], ["lat", "lon", "kafka_offset"]).drop("kafka_offset")


def summarise(p: DataFrame) -> DataFrame:
    """One row per delivery that moved: one hash aggregation, no sort and no self-join."""
    at, spot = F.struct("event_timestamp", "lat", "lon"), F.struct("lat", "lon", "order_id", "driver_id", "event_timestamp")
    g = p.groupBy("delivery_id").agg(F.min_by(spot, at).alias("a"), F.max_by(spot, at).alias("b"), F.avg("speed_mph").alias("speed"), F.count(F.lit(1)).alias("ping_count"))
    c = F.col
    trips = g.select(
        surrogate_key(c("delivery_id")).alias("trip_key"), "delivery_id", c("a.order_id").alias("order_id"), c("a.driver_id").alias("driver_id"), date_key(c("a.event_timestamp")).alias("date_key"),
        c("a.lat").alias("pickup_lat"), c("a.lon").alias("pickup_lon"), c("b.lat").alias("dropoff_lat"), c("b.lon").alias("dropoff_lon"),
        F.round(haversine_km(c("a.lat"), c("a.lon"), c("b.lat"), c("b.lon")), 3).alias("distance_km"),
        minutes_between(c("a.event_timestamp"), c("b.event_timestamp")).alias("duration_minutes"), mph_to_kmh(c("speed")).alias("avg_speed_kmh"), "ping_count",
    )
    return trips.filter("distance_km > 0")


def path_distance(p: DataFrame) -> DataFrame:
    w = Window.partitionBy("delivery_id").orderBy("event_timestamp", "lat", "lon")
    c = F.col
    seg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), c("lat"), c("lon"))
    late = (F.unix_timestamp("sync_timestamp") - F.unix_timestamp("event_timestamp")) > 60
    return p.withColumn("seg", seg).withColumn("late", late).groupBy("delivery_id").agg(F.count(F.lit(1)).alias("ping_count"), F.round(F.coalesce(F.sum("seg"), F.lit(0.0)), 3).alias("path_km"), F.count_if("late").alias("late_pings"))


def orders_of_couriers(fact_order: DataFrame) -> DataFrame:
    """(order_id, kitchen_key, zone_key): one row per order id as couriers know it, without the platform.
    Where two platforms share an id, the order whose full id comes first stands for it, so that no trip is doubled."""
    places = F.min_by(F.struct("kitchen_key", "zone_key"), "platform_order_id").alias("o")
    one = fact_order.groupBy(strip_platform(F.col("platform_order_id")).alias("order_id")).agg(places)
    return one.select("order_id", "o.kitchen_key", "o.zone_key")


def link_orders(trips: DataFrame, fact_order: DataFrame) -> DataFrame:
    """Each trip, once, with its order's kitchen and zone (-1: unknown)."""
    return trips.join(orders_of_couriers(fact_order), "order_id", "left").withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("kitchen_key", "zone_key")})
