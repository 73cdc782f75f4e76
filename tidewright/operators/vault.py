"""Hubs, links and satellites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import insert_only, scd2_apply


def hub(target: DataFrame | None, rows: DataFrame, hash_key: str, business_key: str, source: str, order: list[str], load_ts: Column) -> DataFrame:
    """One row per hash key; the record source is that of its earliest row. Null keys are dropped."""
    first = F.min(F.struct(*order, F.col(source).alias("record_source"), F.col(business_key).alias("bk"))).alias("f")
    new = rows.dropna(subset=[hash_key]).groupBy(hash_key).agg(first)
    new = new.select(hash_key, F.col("f.bk").alias(business_key), load_ts.alias("load_ts"), F.col("f.record_source").alias("record_source"))
    return insert_only(target, new, [hash_key])


def hub_customer(target: DataFrame | None, orders: DataFrame, load_ts: Column) -> DataFrame:
    rows = orders.select(F.col("customer_key").alias("customer_hk"), F.col("raw_email").alias("customer_bk"), "platform", "order_timestamp", "platform_order_id")
    return hub(target, rows, "customer_hk", "customer_bk", "platform", ["order_timestamp", "platform_order_id"], load_ts)


def hub_order(target: DataFrame | None, orders: DataFrame, load_ts: Column) -> DataFrame:
    rows = orders.dropna(subset=["platform_order_id"]).withColumn("order_hk", F.sha2("platform_order_id", 256))
    return hub(target, rows, "order_hk", "platform_order_id", "platform", ["order_timestamp"], load_ts)


def hub_of(target: DataFrame | None, rows: DataFrame, business_key: str, source: str, order: list[str], load_ts: Column) -> DataFrame:
    """A hub on any business key, hashed with SHA-256: kitchens, menu items."""
    name = f"{business_key}_hk"
    return hub(target, rows.withColumn(name, F.sha2(F.col(business_key).cast("string"), 256)), name, business_key, source, order, load_ts)


def link(target: DataFrame | None, rows: DataFrame, name: str, hub_keys: list[str], load_ts: Column) -> DataFrame:
    """Distinct pairs of hub keys, hashed together."""
    new = rows.dropna(subset=hub_keys).select(*hub_keys).distinct().withColumn(name, F.sha2(F.concat_ws("||", *hub_keys), 256)).withColumn("load_ts", load_ts)
    return insert_only(target, new.select(name, *hub_keys, "load_ts"), [name])


#: What makes a new version of an order; the basket counts as a text, so that one of equal size and total is another.
ORDER_TRACKED = ["customer_key", "order_total_cents", "order_timestamp", "kitchen_id", "brand_name", "zone_id", "items_json", "item_count", "is_late_arriving"]


def sat_order_details(target: DataFrame | None, orders: DataFrame, eff_ts: str = "ingestion_timestamp") -> DataFrame:
    src = orders.withColumn("order_hk", F.sha2("platform_order_id", 256))
    return scd2_apply(target, src, ["order_hk"], ORDER_TRACKED, eff_ts)


def sat_customer_profile(target: DataFrame | None, bridge: DataFrame) -> DataFrame:
    """Platform ids of each customer as a JSON map, versioned."""
    one = bridge.groupBy("customer_hk", "platform").agg(F.min("platform_customer_id").alias("id"), F.max("last_seen").alias("seen"))
    ids = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "id")))))
    src = one.groupBy("customer_hk").agg(ids.alias("platform_ids"), F.max("seen").alias("seen"))
    return scd2_apply(target, src, ["customer_hk"], ["platform_ids"], "seen")
