"""Fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_key, time_key


def resolve_fk(df: DataFrame, dim: DataFrame, on: str, key: str, unknown: int = -1) -> DataFrame:
    """Add a dimension's key; ``unknown`` where the natural key is null or not there.

    No forced broadcast: Spark broadcasts a dimension whose measured size is below its threshold
    and sorts and merges (with skew handling) one above it.
    """
    return df.join(dim.select(on, key), on, "left").withColumn(key, F.coalesce(key, F.lit(unknown)))


def default_zone(aligned: DataFrame, kitchens: DataFrame, zones: DataFrame, suffix: str = "-DOWNTOWN") -> DataFrame:
    """Orders without a zone get the default zone (the one that ends in ``suffix``) of their kitchen's city."""
    by_city = zones.filter(F.col("zone_id").endswith(suffix)).groupBy("city").agg(F.min("zone_id").alias("__zone"))
    by_kitchen = kitchens.select("kitchen_id", "city").join(by_city, "city").select("kitchen_id", "__zone")
    return aligned.join(by_kitchen, "kitchen_id", "left").withColumn("zone_id", F.coalesce("zone_id", "__zone")).drop("__zone")


def orders(aligned: DataFrame, kitchens: DataFrame, brands: DataFrame, zones: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """One row per order in its final state. ``final``: what ``final_state`` makes of the status events."""
    df = resolve_fk(aligned, kitchens, "kitchen_id", "kitchen_key")
    df = resolve_fk(df, brands, "brand_name", "brand_key")
    df = resolve_fk(df, zones, "zone_id", "zone_key")
    if final is None:
        df = df.withColumns({"is_cancelled": F.lit(False), "delivered_ts": F.lit(None).cast("timestamp"), "delivery_seconds": F.lit(None).cast("long"), "cancellation_reason": F.lit(None).cast("string")})
    else:
        df = df.join(final.select(F.col("order_id").alias("platform_order_id"), "is_cancelled", "delivered_ts", "delivery_seconds", "cancellation_reason"), "platform_order_id", "left").withColumn("is_cancelled", F.coalesce("is_cancelled", F.lit(False)))
    ts = F.col("order_timestamp")
    return df.select(date_key(ts).alias("date_key"), time_key(ts).alias("time_key"), "kitchen_key", "brand_key", F.col("customer_key").alias("customer_hk"), "zone_key", "platform", "platform_order_id", "order_total_cents", "item_count", ts.alias("order_placed_ts"), "is_late_arriving", "is_cancelled", F.col("delivered_ts").alias("order_delivered_ts"), F.round(F.col("delivery_seconds") / 60, 2).alias("delivery_duration_min"), "cancellation_reason")


def state_intervals(events: DataFrame) -> DataFrame:
    """``events`` with the state before each, the seconds spent there, and the state's own interval."""
    w = Window.partitionBy("order_id").orderBy("status_timestamp", "status")
    secs = lambda a, b: (F.unix_timestamp(a) - F.unix_timestamp(b)).cast("long")
    df = events.withColumns({
        "previous_status": F.lag("status").over(w),
        "time_in_previous_status_seconds": secs(F.col("status_timestamp"), F.lag("status_timestamp").over(w)),
        "effective_end": F.lead("status_timestamp").over(w),
    })
    return df.withColumn("is_current", F.col("effective_end").isNull())


def state_history(events: DataFrame, kitchens: DataFrame) -> DataFrame:
    """Each state with the one before it, the seconds spent there, and its own interval."""
    df = state_intervals(events).withColumn("date_key", date_key(F.col("status_timestamp")))
    df = resolve_fk(df, kitchens, "kitchen_id", "kitchen_key")
    return df.select("order_id", "status", "status_timestamp", "previous_status", "time_in_previous_status_seconds", "date_key", "kitchen_key", "effective_end", "is_current")


def final_state(events: DataFrame) -> DataFrame:
    """One row per order: its last state, when it was placed and delivered, and why it was cancelled."""
    at = F.struct("status_timestamp", "status")
    placed = F.min(F.when(F.col("status") == "placed", F.col("status_timestamp")))
    done = F.max(F.when(F.col("status") == "delivered", F.col("status_timestamp")))
    said = F.col("reason") if "reason" in events.columns else F.lit(None).cast("string")
    reason = F.max(F.when(F.col("status") == "cancelled", said)).alias("cancellation_reason")
    df = events.groupBy("order_id").agg(F.max_by("status", at).alias("final_status"), placed.alias("placed_ts"), done.alias("delivered_ts"), F.bool_or(F.col("status") == "cancelled").alias("is_cancelled"), reason)
    return df.withColumn("delivery_seconds", (F.unix_timestamp("delivered_ts") - F.unix_timestamp("placed_ts")).cast("long"))
